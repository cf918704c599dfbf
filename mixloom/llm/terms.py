"""Frequencies of all terms, kept up to date by signed deltas."""

from __future__ import annotations

import json
import posixpath
import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.operators.bow import owner_by_range
from mixloom.session import bounded_rows, checkpoint_dir, cut


def plain_term(term: pd.Series) -> pd.Series:
    """Lower case, trimmed, composed (NFC); null stays null."""
    return term.map(lambda t: None if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).lower().strip()))


def terms_of(vocab: DataFrame) -> DataFrame:
    """(word_id, term) with plain terms; null ids and null or empty terms are left out.

    Of several rows with one id the smallest plain term counts.
    """
    udf = F.pandas_udf(plain_term, "string")
    named = vocab.where("word_id IS NOT NULL AND term IS NOT NULL").select("word_id", udf("term").alias("term")).where("term <> ''")
    return named.groupBy("word_id").agg(F.min("term").alias("term"))


def placed_entries(tokens: DataFrame) -> DataFrame:
    """Counting entries (token_pos, doc_id, word_id, word_count), each once.

    Rows with one ``token_pos`` are one entry (of differing rows each column's smallest
    non-null value counts); rows without ``token_pos`` are entries of their own if otherwise
    different. Null, NaN, infinite and non-positive counts and null words do not count.
    """
    good = "word_count > 0 AND NOT isnan(word_count) AND word_count < double('Infinity') AND word_id IS NOT NULL"
    rows = tokens.select("token_pos", "doc_id", "word_id", "word_count").where(good)
    placed = rows.where("token_pos IS NOT NULL").groupBy("token_pos").agg(*[F.min(c).alias(c) for c in ("doc_id", "word_id", "word_count")])
    return placed.unionByName(rows.where("token_pos IS NULL").distinct())


def summed_entries(entries: DataFrame, named: DataFrame) -> DataFrame:
    """Entries (doc_id, word_id, word_count) as (doc_id, term, n, total); words without a term do not count."""
    # summed per (document, word) before the join, so a very common word costs one row per document
    summed = entries.groupBy("doc_id", "word_id").agg(F.count("*").alias("n"), F.sum("word_count").alias("total"))
    return summed.join(named, "word_id").groupBy("doc_id", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class TermCounts:
    """Persistent counts per term, changed by signed deltas.

    Two tables of signed changes under ``folder``, each version of them a folder of its own:
    ``pairs`` (doc_id, term, n, total), partitioned by a hash of the document, and ``terms``
    (term, n, total, n_docs). ``apply`` takes the added and removed entries of changed records
    only. It reads the pairs of the parts that these documents are in, and no others, to see which
    documents win or lose a term, and appends the delta and the changes of its terms; nothing is
    rewritten. A count is the sum of its changes. Every ``compact_after`` versions both tables
    are summed up into one, with as many parts as the pairs need (``pairs_per_part``).

    Numbered manifests name the versions that count. The manifest of a new version is written
    beside the old ones and renamed as the last step, so a run that fails before it leaves the old
    state, and what it wrote is overwritten by the next. Files that the last two manifests do
    not name are removed after a commit. One writer at a time; the folder must be one that all
    executors share.
    """

    PAIRS = "doc_id bigint, term string, n bigint, total double, version bigint, part int"
    TERMS = "term string, n bigint, total double, n_docs bigint, version bigint"

    def __init__(self, spark: SparkSession, folder: str | None = None, parts: int = 16, *, compact_after: int = 8, pairs_per_part: int = 2_000_000):
        self.spark, self.compact_after, self.pairs_per_part = spark, compact_after, pairs_per_part
        self.folder = folder or posixpath.join(checkpoint_dir(spark), f"term-counts-{uuid.uuid4().hex}")
        self.parts = self._manifest().get("parts", parts)

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.folder, *names))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, *names: str) -> list[int]:
        """The numbers in the names of the files or folders there (manifest-7.json, version=7)."""
        fs, at = self._fs(), self._path(*names)
        found = [str(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"(?:manifest-|version=)(\d+)(?:\.json)?", f)))

    def _manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "versions": []}
        return self._read_manifest(numbers[-1])

    def _read_manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(posixpath.join(self.folder, f"manifest-{number}.json"), wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        fs, number = self._fs(), manifest["number"]
        new, at = self._path(f"new-{number}.json"), self._path(f"manifest-{number}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(new, at):
            raise RuntimeError(f"version {number} is there already: another writer")
        self.parts = manifest["parts"]
        for old in self._numbers()[:-2]:
            fs.delete(self._path(f"manifest-{old}.json"), False)
        named = {v for k in self._numbers() for v in self._read_manifest(k)["versions"]}
        for what in ("pairs", "terms"):
            for v in self._numbers(what):
                if v not in named:
                    fs.delete(self._path(what, f"version={v}"), True)

    def _changes(self, what: str, schema: str) -> DataFrame:
        versions = self._manifest()["versions"]
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(posixpath.join(self.folder, what)).where(F.col("version").isin(versions))

    def pairs(self, parts: list[int] | None = None) -> DataFrame:
        """(doc_id, term, n, total) with entries, of all or some parts."""
        rows = self._changes("pairs", self.PAIRS)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        return rows.groupBy("doc_id", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")

    def terms(self) -> DataFrame:
        """(term, total, n_docs) with entries; totals to nine decimals, which takes off what is left of removed fractions."""
        rows = self._changes("terms", self.TERMS).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "total", "n_docs")])
        return rows.where("n > 0").select("term", F.round("total", 9).alias("total"), "n_docs")

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")

    def _write(self, version: int, parts: int, pairs: DataFrame, terms: DataFrame) -> None:
        at = lambda what: posixpath.join(self.folder, what, f"version={version}")
        pairs.select("doc_id", "term", "n", "total", self._part(parts).alias("part")).write.mode("overwrite").partitionBy("part").parquet(at("pairs"))
        terms.select("term", "n", "total", "n_docs").write.mode("overwrite").parquet(at("terms"))

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Merges entries (doc_id, term, n, total): ``added`` with sign +1, ``removed`` with -1.

        A changed record is its old entries removed and its new ones added. A pair whose entries
        are all gone leaves, and its term loses a document; a term without any entry leaves.
        Null documents hold entries but count as no document.
        """
        signed = None
        for df, sign in ((added, 1), (removed, -1)):
            if df is not None:
                one = df.select("doc_id", "term", (F.col("n") * sign).alias("n"), (F.col("total") * sign).alias("total"))
                signed = one if signed is None else signed.unionByName(one)
        if signed is None:
            return
        delta = cut(signed.groupBy("doc_id", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n <> 0 OR total <> 0"))
        manifest = self._manifest()
        first = not manifest["versions"]
        parts = self._wanted(delta.count()) if first else manifest["parts"]
        touched = [r[0] for r in bounded_rows(delta.select(self._part(parts)).distinct(), parts, "parts")]
        if not touched:
            return
        change = delta.select("doc_id", "term", F.lit(0).cast("bigint").alias("before"), F.col("n"), "total")
        if not first:
            before = self._changes("pairs", self.PAIRS).where(F.col("part").isin(touched))
            # the pairs of the delta only, each with what it was and how it changes
            old = before.select("doc_id", "term", F.col("n").alias("before"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("total"))
            both = change.withColumn("changed", F.lit(True)).unionByName(old.withColumn("changed", F.lit(False)))
            change = both.groupBy("doc_id", "term").agg(*[F.sum(c).alias(c) for c in ("before", "n", "total")], F.max("changed").alias("changed")).where("changed")
        held = lambda n: (F.col("doc_id").isNotNull() & (n > 0)).cast("bigint")
        steps = change.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(held(F.col("before") + F.col("n")) - held(F.col("before"))).alias("n_docs"))
        number = manifest["number"] + 1
        self._write(number, parts, delta, steps)
        self._commit({"number": number, "versions": [*manifest["versions"], number], "parts": parts})
        if len(manifest["versions"]) + 1 > self.compact_after:
            self.compact()

    def _wanted(self, pairs: int) -> int:
        return max(self.parts, -(-pairs // self.pairs_per_part))

    def compact(self) -> None:
        """Sums up all changes into one version."""
        manifest = self._manifest()
        number, pairs = manifest["number"] + 1, cut(self.pairs())
        parts = self._wanted(pairs.count())
        terms = self._changes("terms", self.TERMS).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "total", "n_docs")]).where("n > 0")
        self._write(number, parts, pairs, terms)
        self._commit({"number": number, "versions": [number], "parts": parts})

    def drop(self) -> None:
        self._fs().delete(self._path(), True)


def mark(n_docs_total: int, *, min_total: float = 5, min_docs: int = 3, max_share: float = 0.2) -> Column:
    """``rare``, else ``common``, else null, for columns total and n_docs."""
    rare = (F.col("total") < min_total) | (F.col("n_docs") < min_docs)
    return F.when(rare, "rare").when(F.col("n_docs") > max_share * n_docs_total, "common")


def term_frequencies(tokens: DataFrame, docs: DataFrame, vocab: DataFrame, *, folder: str | None = None, batches: int = 2) -> DataFrame:
    """(term, total, n_docs, mark) for every term with a counting entry.

    The collection comes to ``TermCounts`` as signed deltas: the entries of the documents in
    ``batches`` loads, entries without ``doc_id`` for the time being under no document, in
    the last of them; then, as a change of these records, each of them whose position a document's range holds is
    removed there and added to that document. What counts is said at ``placed_entries``; words
    that the vocabulary lacks or that have a null term do not count, and an entry that no range
    holds counts for no document. A term both rare and common is rare (``mark``).

    With ``folder`` the state is left there; else it is removed once the result is written.
    Empty tables give no rows; other columns are never read.
    """
    spark = tokens.sparkSession
    entries, named = cut(placed_entries(tokens)), cut(terms_of(vocab))
    state = TermCounts(spark, folder)
    batch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    for b in range(batches):
        state.apply(added=summed_entries(entries.where(batch == b), named))
    lost = entries.where("doc_id IS NULL AND token_pos IS NOT NULL")
    moved = cut(lost.drop("doc_id").join(owner_by_range(lost, docs), "token_pos"))
    now, then = moved.withColumnRenamed("owner", "doc_id"), moved.withColumn("doc_id", F.lit(None).cast("bigint"))
    state.apply(added=summed_entries(now, named), removed=summed_entries(then, named))
    n = docs.agg(F.count_distinct("doc_id")).first()[0]
    found = state.terms().withColumn("mark", mark(n))
    if folder is None:
        found = cut(found)
        state.drop()
    return found
