"""Bags of words: counting, summaries, subsets, splits, and hard-label topic statistics.

A bag is the long table (doc_id, word, word_count). Nothing here needs a dense matrix; every
operator is a grouped sum, an equi-join or a window over small groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.functions.special import digamma_col, lgamma_col


def tokens(docs: DataFrame, *keep: str, pattern: str = "([a-z]+)") -> DataFrame:
    """One row per word of the lower-cased text: (doc_id, *keep, word). Null texts give none."""
    return docs.select("doc_id", *keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern))).alias("word"))


def count_words(docs: DataFrame, *keep: str) -> DataFrame:
    """The bag of words (doc_id, *keep, word, word_count)."""
    return tokens(docs, *keep).groupBy("doc_id", *keep, "word").agg(F.count("*").cast("double").alias("word_count"))


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct values of ``key`` numbered 0, 1, ... in ascending order, without a global sort in one task.

    Values are range-partitioned; each partition numbers its own, and offsets come from the
    partition sizes (as many rows as there are partitions). The partitioning is fixed by a
    checkpoint, as range bounds are sampled.
    """
    from mixloom.session import cut

    parts = cut(df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parts.withColumn("_rank", rank).join(F.broadcast(sizes), "_part").select(key, (F.col("_rank") + F.col("_before")).cast("int").alias(name))


def vocabulary(bag: DataFrame) -> DataFrame:
    """(word, n_docs, total)."""
    return bag.groupBy("word").agg(F.count("*").alias("n_docs"), F.sum("word_count").alias("total"))


def histogram(df: DataFrame, value: Column, edges: list[float], count: str) -> DataFrame:
    """(bin, lower, <count>) for bins [edge, next edge), the last open; all bins are listed."""
    place = F.lit(-1)
    for i, e in enumerate(edges):
        place = F.when(value >= e, i).otherwise(place)
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "bin int, lower double")
    counted = df.select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias(count))
    return bins.join(counted, "bin", "left").select("bin", "lower", F.coalesce(count, F.lit(0)).alias(count))


def doc_frequency_histogram(bag: DataFrame, edges: list[float], vocab: DataFrame | None = None) -> DataFrame:
    """Words per bin of document frequency; words of ``vocab`` that occur nowhere count as 0."""
    df = vocabulary(bag).select("word", "n_docs")
    if vocab is not None:
        df = vocab.select("word").distinct().join(df, "word", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return histogram(df, F.col("n_docs"), edges, "n_words")


def doc_sizes(bag: DataFrame) -> DataFrame:
    """(doc_id, n_unique, n_tokens)."""
    return bag.groupBy("doc_id").agg(F.count("*").alias("n_unique"), F.sum("word_count").alias("n_tokens"))


def doc_size_percentiles(bag: DataFrame, percents: tuple[int, ...] = (0, 5, 50, 95, 100)) -> DataFrame:
    """(percent, n_unique, n_tokens) with linear interpolation."""
    at = F.array(*[F.lit(p / 100) for p in percents])
    both = doc_sizes(bag).agg(F.percentile("n_unique", at).alias("u"), F.percentile("n_tokens", at).alias("t"))
    rows = F.arrays_zip(F.array(*[F.lit(p) for p in percents]).alias("percent"), F.col("u").alias("n_unique"), F.col("t").alias("n_tokens"))
    return both.select(F.inline(rows))


def ldac_lines(bag_ids: DataFrame) -> DataFrame:
    """(doc_id, line): ``U id:count id:count ...`` by ascending id, from (doc_id, word_id, word_count)."""
    pairs = F.array_sort(F.collect_list(F.struct("word_id", F.col("word_count").cast("bigint").alias("c"))))
    shown = F.transform(pairs, lambda p: F.concat_ws(":", p["word_id"].cast("string"), p["c"].cast("string")))
    return bag_ids.groupBy("doc_id").agg(shown.alias("_s")).select("doc_id", F.concat_ws(" ", F.size("_s").cast("string"), F.concat_ws(" ", "_s")).alias("line"))


def docs_with_tokens(bag: DataFrame, least: float) -> DataFrame:
    """(doc_id, n_tokens) of documents with at least ``least`` tokens."""
    return bag.groupBy("doc_id").agg(F.sum("word_count").alias("n_tokens")).where(F.col("n_tokens") >= least)


def threshold_tokens(weighted: DataFrame, least: float) -> DataFrame:
    """Tokens of weight ``w`` >= least, with counts ceil(word_count * w); emptied documents vanish."""
    return weighted.where(F.col("w") >= least).select("doc_id", "word", F.ceil(F.col("word_count") * F.col("w")).cast("double").alias("word_count"))


def topic_word_counts(bag: DataFrame, topic: str) -> DataFrame:
    """(topic, word, word_count) for hard topics per document."""
    return bag.groupBy(topic, "word").agg(F.sum("word_count").alias("word_count"))


def top_words(counts: DataFrame, topic: str, n: int) -> DataFrame:
    """The ``n`` most frequent words per topic, by count then word."""
    order = Window.partitionBy(topic).orderBy(F.desc("word_count"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def dirichlet_cumulants(counts: DataFrame, topic: str, lam: float, n_vocab: Column) -> DataFrame:
    """(topic, n_words, total, cumulant) of Dirichlet(counts + lam) over the whole vocabulary:
    G(sum) - sum G; words that a topic lacks enter through their number."""
    per = counts.groupBy(topic).agg(
        F.count("*").alias("n_words"), F.sum("word_count").alias("total"), F.sum(lgamma_col(F.col("word_count") + lam)).alias("_held")
    )
    absent = (n_vocab - F.col("n_words")) * lgamma_col(F.lit(lam))
    return per.withColumn("cumulant", lgamma_col(F.col("total") + n_vocab * lam) - F.col("_held") - absent).drop("_held")


def topic_log_probs(counts: DataFrame, topic: str, lam: float, n_vocab: Column) -> DataFrame:
    """E[log phi] of the words a topic holds: (topic, word, e_log_phi), and of any other word ``e_log_absent``."""
    total = F.sum("word_count").over(Window.partitionBy(topic)) + n_vocab * lam
    rows = counts.withColumn("_norm", digamma_col(total))
    return rows.select(
        topic, "word", (digamma_col(F.col("word_count") + lam) - F.col("_norm")).alias("e_log_phi"), (digamma_col(F.lit(lam)) - F.col("_norm")).alias("e_log_absent")
    )


def doc_topic_loglik(bag: DataFrame, log_probs: DataFrame, topic: str) -> DataFrame:
    """(doc_id, topic, loglik): sum of word_count * E[log phi], unseen words included.

    A document's tokens meet only the topics that hold their words; the rest is its token
    total times the topic's value for absent words, so no documents x vocabulary table arises.
    """
    topics = log_probs.groupBy(topic).agg(F.first("e_log_absent").alias("e_log_absent"))
    gain = bag.join(log_probs, "word").groupBy("doc_id", topic).agg(F.sum(F.col("word_count") * (F.col("e_log_phi") - F.col("e_log_absent"))).alias("gain"))
    sizes = bag.groupBy("doc_id").agg(F.sum("word_count").alias("n"))
    every = sizes.join(F.broadcast(topics))  # topics: K rows
    return every.join(gain, ["doc_id", topic], "left").select("doc_id", topic, (F.col("n") * F.col("e_log_absent") + F.coalesce("gain", F.lit(0.0))).alias("loglik"))


def unseen_vocabulary(bag: DataFrame) -> DataFrame:
    """(doc_id, n_unseen): words of the corpus that a document lacks, by difference of counts."""
    n_vocab = bag.agg(F.count_distinct("word").alias("v"))
    return bag.groupBy("doc_id").agg(F.count("*").alias("u")).join(F.broadcast(n_vocab)).select("doc_id", (F.col("v") - F.col("u")).alias("n_unseen"))


def _packed(blocks: int):
    """For mapInArrow: documents as lists of words and counts, packed once a batch and sent to every block."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            entries = b.column("entries")
            size, flat = np.diff(entries.offsets.to_numpy()), entries.flatten()
            coded = flat.field(0).dictionary_encode()
            words = np.array(coded.dictionary.to_pylist(), dtype=object)
            order = np.argsort(words)
            rank = np.empty(len(words), dtype=np.int64)
            rank[order] = np.arange(len(words))
            at, counts = rank[coded.indices.to_numpy()], flat.field(1).to_numpy().astype(np.int64)
            by = np.lexsort((at, np.repeat(np.arange(len(size)), size)))  # ascending words in each document
            packed = zlib.compress(np.concatenate(([len(size)], size, np.diff(at[by], prepend=0), counts[by])).astype(np.int32).tobytes())
            yield pa.record_batch({
                "block": pa.array(range(blocks), pa.int32()), "packed": pa.array([packed] * blocks, pa.binary()),
                "words": pa.array([" ".join(words[order])] * blocks, pa.string()),
            })

    return run


def _summed(key, n, product):
    """Equal keys added up, in ascending order."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n[order], first), np.add.reduceat(product[order], first)


def _pair_sums(blocks: int, at_once: int = 4_000_000):
    """For mapInArrow: (word_a, word_b, n_docs, product) of the pairs with word_a in the partition's block."""

    def chunk(ids, counts, ends, mine):
        """Sums of the pairs of each entry of ``mine`` with the entries after it in its document."""
        import numpy as np

        many = ends[mine] - mine - 1
        b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(mine + 1, many)
        key, product = np.repeat(ids[mine] << 31, many) | ids[b], np.repeat(counts[mine], many) * counts[b]
        if len(key) and int(ids.max()) < 1 << 22 and int(product.max()) < 1 << 20:  # one sort of whole numbers is much faster
            both = np.sort((key >> 31).astype(np.uint64) << np.uint64(42) | ids[b].astype(np.uint64) << np.uint64(20) | product.astype(np.uint64))
            pair, product = both >> np.uint64(20), (both & np.uint64((1 << 20) - 1)).astype(np.float64)
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            top = pair[first].astype(np.int64)
            return (top >> 22) << 31 | top & ((1 << 22) - 1), np.diff(first, append=len(pair)), np.add.reduceat(product, first)
        return _summed(key, np.ones(len(key), np.int64), product.astype(np.float64)) if len(key) else None

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        number: dict[str, int] = {}
        sums: dict[int, list] = {}  # by block, partial sums of falling size
        for batch in batches:
            for block, packed, words in zip(batch.column("block").to_pylist(), batch.column("packed"), batch.column("words").to_pylist()):
                x = np.frombuffer(zlib.decompress(packed.as_py()), np.int32).astype(np.int64)
                size, rest = x[1 : x[0] + 1], x[x[0] + 1 :]
                words, at, counts = words.split(), np.cumsum(rest[: len(rest) // 2]), rest[len(rest) // 2 :]
                ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)[at]
                own_words = np.array([zlib.crc32(w.encode()) % blocks == block for w in words], dtype=bool)
                ends = np.repeat(np.cumsum(size), size)
                mine = np.flatnonzero(own_words[at])
                cuts = np.flatnonzero(np.diff(np.cumsum(ends[mine] - mine) // at_once)) + 1
                for part in np.split(mine, cuts):
                    if (found := chunk(ids, counts, ends, part)) is not None:
                        own = sums.setdefault(block, [])
                        own.append(found)
                        while len(own) > 1 and len(own[-2][0]) < 2 * len(own[-1][0]):
                            own[-2:] = [_summed(*map(np.concatenate, zip(*own[-2:])))]
        names = pa.array(number, pa.string())
        for own in sums.values():
            key, n, product = _summed(*map(np.concatenate, zip(*own)))
            for k in range(0, len(key), 100_000):
                at = slice(k, k + 100_000)
                yield pa.record_batch({"word_a": names.take(pa.array(key[at] >> 31)), "word_b": names.take(pa.array(key[at] & ((1 << 31) - 1))), "n_docs": n[at], "product": product[at]})

    return run


def cooccurrence(bag: DataFrame, pairs_per_block: int = 50_000_000) -> DataFrame:
    """(word_a, word_b, n_docs, product) for all word_a < word_b that share a document: documents
    with both, and the sum of the products of their counts (the upper half of X^T X).

    Words are dealt to blocks, of ``pairs_per_block`` pairs of entries on average. Documents go to
    every block, packed; a task adds up the pairs whose first word is of its block, so pairs are
    never shuffled. A task holds the vocabulary and the sums of its block."""
    from mixloom.session import cut

    spark = bag.sparkSession
    docs = cut(bag.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("word", "word_count")).alias("entries")).select("entries"))
    n_pairs = docs.agg(F.sum(F.size("entries").cast("bigint") * (F.size("entries") - 1) / 2)).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil(n_pairs / pairs_per_block))
    # a value for each block that hashing sends to a partition of its own
    places = spark.range(50 * blocks).select(F.col("id").cast("int").alias("place"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks)).alias("p"))
    place = {r["p"]: r["place"] for r in places.groupBy("p").agg(F.min("place").alias("place")).collect()}
    to = F.array(*[F.lit(place.get(k, k)) for k in range(blocks)])
    sent = docs.mapInArrow(_packed(blocks), "block int, packed binary, words string").repartition(blocks, F.get(to, F.col("block")))
    return sent.mapInArrow(_pair_sums(blocks), "word_a string, word_b string, n_docs bigint, product double")


def doc_usage(mass: DataFrame, topic: str, least: float = 0.01) -> DataFrame:
    """(topic, n_docs) with a share of more than ``least``, from (doc_id, topic, mass)."""
    share = F.col("mass") / F.sum("mass").over(Window.partitionBy("doc_id"))
    return mass.withColumn("_s", share).groupBy(topic).agg(F.sum((F.col("_s") > least).cast("bigint")).alias("n_docs"))


def token_split(bag: DataFrame, hex_digits: str = "0123") -> DataFrame:
    """(doc_id, word, word_count, part): ``heldout`` if md5 of document and word begins with one
    of ``hex_digits``, else ``train``; the same on every engine and partitioning."""
    first = F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "word")), 1, 1)
    return bag.withColumn("part", F.when(first.isin(*hex_digits), "heldout").otherwise("train"))


def bernoulli_counts(bag: DataFrame, topic: str) -> DataFrame:
    """(topic, word, count1, count0): documents of the topic with and without the word."""
    docs = bag.select(topic, "doc_id").distinct().groupBy(topic).agg(F.count("*").alias("n"))
    held = bag.groupBy(topic, "word").agg(F.count("*").alias("count1"))
    return held.join(F.broadcast(docs), topic).select(topic, "word", "count1", (F.col("n") - F.col("count1")).alias("count0"))


def merge_gaps(counts: DataFrame, topic: str, lam: float, n_vocab: Column) -> DataFrame:
    """(topic_a, topic_b, gap) for topic_a < topic_b: c(A) + c(B) - c(prior) - c(AB), the gain of merging.

    Only words held by both topics need the pair; all others follow from per-topic sums.
    """
    lg = lambda c: lgamma_col(c + lam)
    per = dirichlet_cumulants(counts, topic, lam, n_vocab)
    held = counts.groupBy(topic).agg(F.sum(lg(F.col("word_count")) - lgamma_col(F.lit(lam))).alias("h"))
    per = per.join(held, topic)
    a, b = (per.select(F.col(topic).alias(f"topic_{s}"), F.col("total").alias(f"t_{s}"), F.col("cumulant").alias(f"c_{s}"), F.col("h").alias(f"h_{s}")) for s in "ab")
    wa, wb = (counts.select(F.col(topic).alias(f"topic_{s}"), "word", F.col("word_count").alias(f"n_{s}")) for s in "ab")
    both = wa.join(wb, "word").where("topic_a < topic_b").groupBy("topic_a", "topic_b")
    extra = both.agg(F.sum(lg(F.col("n_a") + F.col("n_b")) - lg(F.col("n_a")) - lg(F.col("n_b")) + lgamma_col(F.lit(lam))).alias("x"))
    pairs = a.join(F.broadcast(b), F.col("topic_a") < F.col("topic_b")).join(extra, ["topic_a", "topic_b"], "left")  # K rows each
    flat = n_vocab * lgamma_col(F.lit(lam))
    merged = lgamma_col(F.col("t_a") + F.col("t_b") + n_vocab * lam) - (flat + F.col("h_a") + F.col("h_b") + F.coalesce("x", F.lit(0.0)))
    prior = lgamma_col(n_vocab * lam) - flat
    return pairs.select("topic_a", "topic_b", (F.col("c_a") + F.col("c_b") - prior - merged).alias("gap"))


def owner_by_range(entries: DataFrame, docs: DataFrame, *, stretch: int = 1024) -> DataFrame:
    """``entries`` (token_pos, ...) with ``owner``: the document whose range [start, stop) holds token_pos.

    Positions are cut into stretches; a document lies in every stretch that it touches, so the
    range join is an equi-join with few candidates each, however long a document is.
    """
    ranges = docs.where("doc_id IS NOT NULL AND size(doc_range) >= 2").select(F.col("doc_id").alias("owner"), F.get("doc_range", F.lit(0)).alias("start"), F.get("doc_range", F.lit(1)).alias("stop")).distinct()
    ranges = ranges.where("start < stop")
    at = lambda c: F.floor(c / stretch).cast("bigint")
    ranges = ranges.withColumn("stretch", F.explode(F.sequence(at(F.col("start")), at(F.col("stop") - 1))))
    hit = entries.select("token_pos", at(F.col("token_pos")).alias("stretch")).join(ranges, "stretch").where("token_pos >= start AND token_pos < stop")
    return hit.groupBy("token_pos").agg(F.min("owner").alias("owner"))
