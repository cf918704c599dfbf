"""Orphan references: rows that refer to records that are missing, deleted, or not there yet.

The plan reads each referring table once and reduces it to one row per
(table, period, key) before anything is shuffled by key, so a key that holds a
third of all rows costs one row per period. A blocked Bloom filter of the
parents' keys, held as a broadcast table of 64-bit words of bounded size, proves
most missing keys; only groups that pass it are joined exactly. Rows are looked
at again only for groups whose first and last row are live while a gap in the
record's life lies between them, and pass a second filter of those groups before
they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.session import cut


def _begin() -> Column:
    return F.lit("0001-01-01 00:00:00").cast("timestamp")


def _forever() -> Column:
    return F.lit("9999-12-31 00:00:00").cast("timestamp")


#: Decimal digits of other scripts, in the order 0 to 9.
OTHER_DIGITS = (
    "０１２３４５６７８９"
    "٠١٢٣٤٥٦٧٨٩"
    "۰۱۲۳۴۵۶۷۸۹"
    "०१२३४५६७८९"
)


@dataclass(frozen=True)
class Reference:
    """A referring table: its name in the report, its rows, key and time columns."""

    name: str
    df: DataFrame
    key: Column
    time: Column


def written_number(text: Column) -> Column:
    """The whole number that a text writes, as BIGINT; null if it writes none.

    Whatever stands around or between the digits is ignored (prefixes, blanks,
    grouping marks, leading zeros), as are one or two zero decimals at the end.
    Numbers beyond BIGINT give null.
    """
    plain = F.translate(text, OTHER_DIGITS, "0123456789" * (len(OTHER_DIGITS) // 10))
    plain = F.regexp_replace(plain, r"([0-9])[.,]0{1,2}(?![0-9])", "$1")
    return F.regexp_replace(plain, "[^0-9]", "").try_cast("bigint")


def _word_and_mask(key: Column, n_words: int) -> tuple[Column, Column]:
    place, spread = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(4):
        bit = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return F.pmod(place, F.lit(n_words).cast("bigint")), mask


def bloom_words(keys: DataFrame, key: str, *, bits_per_key: int = 12, max_words: int = 1 << 20) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of ``keys[key]`` as rows (bloom_word, bloom_bits), and its number of words.

    Four bits per key in one 64-bit word. The table never exceeds ``max_words``
    rows (16 MB of data by default), however many keys there are: beyond
    ``64 * max_words / bits_per_key`` keys the filter lets more through, which
    costs time in the exact join but changes no result.
    """
    n = keys.agg(F.approx_count_distinct(key)).first()[0] or 0
    n_words = max(1, min(max_words, -(-int(n * 1.05 + 1) * bits_per_key // 64)))
    word, mask = _word_and_mask(F.col(key), n_words)
    words = keys.where(F.col(key).isNotNull()).groupBy(word.alias("bloom_word")).agg(F.bit_or(mask).alias("bloom_bits"))
    return words, n_words


def with_bloom_test(df: DataFrame, key: str, words: DataFrame, n_words: int) -> DataFrame:
    """``df`` and BOOLEAN ``maybe_parent``; false proves that no parent has the key."""
    word, mask = _word_and_mask(F.col(key), n_words)
    found = df.withColumn("bloom_word", word).join(F.broadcast(words), "bloom_word", "left")
    test = F.coalesce(F.col("bloom_bits").bitwiseAND(mask) == mask, F.lit(False))
    return found.withColumn("maybe_parent", test).drop("bloom_word", "bloom_bits")


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    """Joins touching intervals [since, until) within each group of ``by``."""
    order = Window.partitionBy(*by).orderBy("since", "until")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("since") > before)).cast("int")
    return (
        df.withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(order))
        .groupBy(*by, "_island")
        .agg(F.min("since").alias("since"), F.max("until").alias("until"))
        .drop("_island")
    )


def lifetimes(parents: DataFrame, key: str, arrived: str, deleted: str) -> tuple[DataFrame, DataFrame]:
    """(keys, gaps): ``keys`` has each parent key with its first arrival, ``gaps`` the
    times [since, until) after it at which no row of the key is live.

    Intervals are first joined per key and year, then per key, so a key with very
    many rows reaches one task only as the islands of its years.
    """
    rows = parents.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(arrived), _begin()).alias("since"),
        F.when(F.col(arrived).isNull(), _begin()).otherwise(F.coalesce(F.col(deleted), _forever())).alias("until"),
    ).where(F.col("key").isNotNull())
    rows = rows.groupBy("key", "since").agg(F.max("until").alias("until"))
    keys = cut(rows.groupBy("key").agg(F.min("since").alias("first_arrival")))
    live = rows.where("until > since").withColumn("year", F.year("since"))
    live = cut(_islands(_islands(live, ["key", "year"]).drop("year"), ["key"]))
    per_key = live.groupBy("key").agg(F.min("since").alias("first_live"), F.max("until").alias("last_live"))
    edge = keys.join(per_key, "key", "left")
    before = edge.where(F.col("first_live").isNull() | (F.col("first_live") > F.col("first_arrival"))).select(
        "key", F.col("first_arrival").alias("since"), F.coalesce("first_live", _forever()).alias("until")
    )
    after = edge.where(F.col("last_live") < _forever()).select("key", F.col("last_live").alias("since"), _forever().alias("until"))
    order = Window.partitionBy("key").orderBy("since")
    between = live.select("key", F.lag("until").over(order).alias("_since"), F.col("since").alias("until"))
    between = between.where(F.col("_since").isNotNull()).select("key", F.col("_since").alias("since"), "until")
    return keys, before.unionByName(between).unionByName(after)


def orphan_references(
    references: list[Reference],
    parents: DataFrame,
    *,
    key: str = "seq_id",
    arrived: str = "arrived_at",
    deleted: str = "deleted_at",
    period_format: str = "yyyy-MM",
    max_words: int = 1 << 20,
) -> DataFrame:
    """Distinct (table_name, period, <key>, kind) of references without a live parent row.

    A parent row is live from ``arrived`` (included) to ``deleted`` (excluded; null: for
    ever). Kinds: ``missing`` if no parent row has the key, ``late`` if all its rows arrive
    after the reference, else ``deleted``.

    Defined results: a null key is no reference. A row without a time is a case only if its
    key is missing, with a null period. A parent row without an arrival is never live but
    makes its key neither missing nor late. Repeated rows on either side change nothing.
    Empty tables give no rows (an empty parent table makes every reference missing). Other
    columns, of whatever names, are never read.
    """
    rows = None
    for r in references:
        one = r.df.select(F.lit(r.name).alias("table_name"), r.key.cast("bigint").alias("key"), r.time.cast("timestamp").alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.where(F.col("key").isNotNull()).withColumn("period", F.date_format("at", period_format))
    groups = rows.groupBy("table_name", "period", "key").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    group = ["table_name", "period", "key"]

    keys, gaps = lifetimes(parents, key, arrived, deleted)
    words, n_words = bloom_words(parents.select(F.col(key).alias("key")), "key", max_words=max_words)
    groups = cut(with_bloom_test(groups, "key", words, n_words))

    proven = groups.where(~F.col("maybe_parent")).select(*group, F.lit("missing").alias("kind"))
    joined = groups.where("maybe_parent").join(keys, "key", "left")
    wrong = joined.where(F.col("first_arrival").isNull()).select(*group, F.lit("missing").alias("kind"))
    late = joined.where(F.col("first_at") < F.col("first_arrival")).select(*group, F.lit("late").alias("kind"))

    near = groups.where("maybe_parent").join(gaps, "key").where((F.col("since") <= F.col("last_at")) & (F.col("until") > F.col("first_at")))
    at_end = lambda c: (F.col(c) >= F.col("since")) & (F.col(c) < F.col("until"))
    near = cut(near.withColumn("sure", at_end("first_at") | at_end("last_at")))
    sure = near.where("sure").select(*group).distinct()
    unsure = near.where(~F.col("sure")).join(sure.select("table_name", "period", "key"), group, "left_anti").select(*group, "since", "until")
    # rows meet the few groups in question only behind a filter of them, so the rest is not shuffled again
    unsure = cut(unsure)
    number = F.xxhash64(*group)
    few, n_few = bloom_words(unsure.select(number.alias("group")), "group", max_words=max_words)
    asked = with_bloom_test(rows.withColumn("group", number), "group", few, n_few).where("maybe_parent").drop("group", "maybe_parent")
    within = asked.join(unsure, group).where((F.col("at") >= F.col("since")) & (F.col("at") < F.col("until"))).select(*group).distinct()
    gone = sure.unionByName(within).withColumn("kind", F.lit("deleted"))

    found = proven.unionByName(wrong).unionByName(late).unionByName(gone)
    return found.select("table_name", "period", F.col("key").alias(key), "kind")


def orphan_report(found: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """Per table, period and kind the number of orphaned keys."""
    return found.groupBy("table_name", "period", "kind").agg(F.count(key).alias("n_keys"))
