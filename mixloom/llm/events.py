"""Events of action sequences: proper names for spellings, and one event per step."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.session import bounded_rows

MAX_DICTIONARY = 4096


def bare(name: Column) -> Column:
    """A name without letter case, blanks and separators."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def _swapped(a: Column, b: Column) -> Column:
    """Two neighbouring letters of ``a``, exchanged, give ``b``."""
    at = F.sequence(F.lit(1), F.length(a) - 1)
    return F.exists(at, lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)


def proper_names(df: DataFrame, name: str, dictionary: DataFrame, dictionary_name: str = "action_name") -> DataFrame:
    """``df`` and STRING ``action``: the dictionary's name for the spelling in column ``name``.

    A spelling stands for the entry from which it differs only in letter case, blanks,
    separators and at most one typing slip: a letter changed, dropped, added, or exchanged
    with its neighbour. A spelling that fits no entry, or several entries equally, is an
    action of its own: ``action`` is then its bare spelling between parentheses, which no
    proper name can be. Null, blank and separator-only names give null.

    The dictionary is a fixed table of at most ``MAX_DICTIONARY`` names; it is read to the
    driver and travels as a broadcast table and a literal. Exact matches take a hash join;
    only the rest is compared with the entries.
    """
    own = bounded_rows(dictionary.select(dictionary_name, bare(F.col(dictionary_name)).alias("bare")).where("bare <> ''").distinct(), MAX_DICTIONARY, "dictionary")
    proper = {b: n for n, b in sorted(own, reverse=True)}
    spark = df.sparkSession
    lookup = spark.createDataFrame(sorted(proper.items()) or [("", "")], "_bare string, _proper string")
    slip = F.lit(None).cast("string")
    if proper:
        entry = lambda b: F.struct(F.lit(b).alias("bare"), F.lit(proper[b]).alias("name"))
        lengths = sorted({len(b) + d for b in proper for d in (-1, 0, 1)})
        # a slip changes the length by one at most, so a spelling meets only entries of about its length
        by_length = F.create_map(*[x for n in lengths for x in (F.lit(n), F.array(*[entry(b) for b in sorted(proper) if abs(len(b) - n) <= 1]))])

        def near(e: Column) -> Column:
            same_length = F.length(e["bare"]) == F.length("_bare")
            close = F.levenshtein(F.col("_bare"), e["bare"], 1) >= 0
            return close | (same_length & (F.length("_bare") > 1) & _swapped(F.col("_bare"), e["bare"]))

        fits = F.filter(by_length[F.length("_bare")], near)
        # bound by the lambda, so that the entries are compared once
        slip = F.get(F.transform(F.array(fits), lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))["name"])), F.lit(0))
    out = df.withColumn("_bare", bare(F.col(name))).join(F.broadcast(lookup), "_bare", "left")
    action = F.when(F.col("_bare") != "", F.coalesce(F.col("_proper"), slip, F.concat(F.lit("("), F.col("_bare"), F.lit(")"))))
    return out.withColumn("action", action).drop("_bare", "_proper")


def is_proper(action: Column) -> Column:
    return ~action.startswith("(")


def events(steps: DataFrame, dictionary: DataFrame, *, block: int, halo: int = 0) -> DataFrame:
    """One row (seq_id, block, tstep_id, action, own) per event, placed by (seq_id, block).

    Rows with null ``seq_id``, null ``tstep_id`` or null or blank ``action_name`` are no
    events. Of several rows with one (seq_id, tstep_id) the latest ``logged_at`` counts; at
    the same time the largest name, a null time being the earliest.

    ``block`` steps form a block, so that a sequence of any length is spread over many
    tasks. With ``halo``, a block also gets the last ``halo`` steps before it, marked as
    not ``own``. Repeated loggings of a step are reduced before the shuffle.
    """
    rows = steps.select("seq_id", "tstep_id", "action_name", "logged_at").where("seq_id IS NOT NULL AND tstep_id IS NOT NULL AND action_name IS NOT NULL")
    rows = proper_names(rows, "action_name", dictionary).where(F.col("action").isNotNull())
    rows = rows.select("seq_id", "tstep_id", "action", "logged_at", F.floor(F.col("tstep_id") / block).cast("bigint").alias("block"))
    places = [F.struct(F.col("block").alias("block"), F.lit(True).alias("own"))]
    if halo:
        near_end = F.pmod(F.col("tstep_id"), F.lit(block)) >= block - halo
        places = F.when(near_end, F.array(*places, F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(*places))
        rows = rows.select("seq_id", "tstep_id", "action", "logged_at", F.inline(places))
    else:
        rows = rows.withColumn("own", F.lit(True))
    one = rows.groupBy("seq_id", "block", "own", "tstep_id").agg(F.max(F.struct("logged_at", "action")).alias("last"))
    return one.select("seq_id", "block", "own", "tstep_id", F.col("last.action").alias("action"))


def events_sql() -> str:
    """The same events for DuckDB, as CTEs ``ev`` (seq_id, tstep_id, action)."""
    return r"""
dict AS (SELECT DISTINCT action_name AS name, regexp_replace(lower(action_name), '[^a-z0-9]', '', 'g') AS b FROM action_names),
spelt AS (SELECT DISTINCT action_name, regexp_replace(lower(action_name), '[^a-z0-9]', '', 'g') AS b FROM actions_per_tstep WHERE action_name IS NOT NULL),
named AS (SELECT s.action_name, coalesce(min(d.name) FILTER (WHERE d.b = s.b), min(d.name), '(' || min(s.b) || ')') AS action
          FROM spelt s LEFT JOIN dict d ON damerau_levenshtein(s.b, d.b) <= 1 WHERE s.b <> '' GROUP BY s.action_name),
ev AS (SELECT seq_id, tstep_id, action FROM (
         SELECT a.seq_id, a.tstep_id, n.action, row_number() OVER (PARTITION BY a.seq_id, a.tstep_id ORDER BY a.logged_at DESC NULLS LAST, n.action DESC) AS k
         FROM actions_per_tstep a JOIN named n USING (action_name) WHERE a.seq_id IS NOT NULL AND a.tstep_id IS NOT NULL) WHERE k = 1)"""
