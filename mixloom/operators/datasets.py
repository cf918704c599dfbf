"""Subsets, unions, samples and batches of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subset_by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows (whole groups, for a group key) whose ``key`` is among ``ids``; repeated ids change nothing."""
    return df.join(ids.select(key), key, "left_semi")


def rows_in_order(df: DataFrame, key: str, wanted: DataFrame, place: str) -> DataFrame:
    """A gather: rows in the order of ``wanted`` (key, place); ids may repeat."""
    return wanted.join(df, key).orderBy(place)


def append(a: DataFrame, b: DataFrame, group: str | None = None) -> DataFrame:
    """Both datasets; with ``group``, b's group ids are shifted past a's, so groups stay apart."""
    if set(a.columns) != set(b.columns):
        raise ValueError("datasets differ in their columns")
    if group:
        top = a.agg(F.coalesce(F.max(group) + 1, F.lit(0)).alias("_top"))
        b = b.join(F.broadcast(top)).withColumn(group, F.col(group) + F.col("_top")).drop("_top")  # one row
    return a.unionByName(b)


def random_rows(df: DataFrame, key: str, n: int, seed: int, weight: Column | None = None) -> DataFrame:
    """``n`` rows without replacement, the same for every partitioning: smallest md5 of key and seed,
    with ``weight`` smallest -ln(u) / weight."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    if weight is None:
        return df.orderBy(h, key).limit(n)
    u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    return df.where(weight > 0).orderBy(-F.ln(u) / weight, key).limit(n)


def with_batches(df: DataFrame, key: str, n_batches: int, seed: int = 0) -> DataFrame:
    """Adds ``batch_id`` by a hash of the key: fixed for all laps, about even."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("batch_id", (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % n_batches).cast("int"))


def stored_batches(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a dataset with ``batch_id`` as one folder per batch and reads it back, so that a pass over
    one batch opens that batch's files only. The folder defaults to a new one in the shared
    checkpoint folder."""
    import posixpath
    import uuid

    from mixloom.session import checkpoint_dir

    at = folder or posixpath.join(checkpoint_dir(df.sparkSession), f"batches-{uuid.uuid4().hex}")
    df.write.partitionBy("batch_id").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def batch_sizes(df: DataFrame) -> DataFrame:
    """(n_batches, total, median) of the rows per batch."""
    return df.groupBy("batch_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_batches"), F.sum("n").alias("total"), F.percentile("n", F.lit(0.5)).alias("median"))


def birth_targets(resp: DataFrame, group: str, r: Column, least: float, min_mass: float) -> DataFrame:
    """(group, mass): groups whose rows with responsibility above ``least`` weigh at least ``min_mass``."""
    return resp.where(r > least).groupBy(group).agg(F.sum(r).alias("mass")).where(F.col("mass") >= min_mass)
