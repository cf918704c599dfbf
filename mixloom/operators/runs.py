"""Analysis of run logs, and evaluation of labels. A log is a table (job, task, lap, loss, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parsed_options(df: DataFrame, path: str) -> DataFrame:
    """Adds MAP ``options`` from a path of ``key=value`` parts joined by ``-``."""
    return df.withColumn("options", F.str_to_map(F.col(path), F.lit("-"), F.lit("=")))


def jobs_with(df: DataFrame, path: str, **wanted: str) -> DataFrame:
    """Rows whose options equal all the wanted values."""
    out = parsed_options(df, path)
    for k, v in wanted.items():
        out = out.where(F.col("options")[k] == v)
    return out.drop("options")


def differing_options(df: DataFrame, path: str) -> DataFrame:
    """(key, n_values) of options that do not have one and the same value in all jobs."""
    each = parsed_options(df, path).select(F.explode("options").alias("key", "value"))
    return each.groupBy("key").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def final_losses(log: DataFrame, *key: str) -> DataFrame:
    """(*key, loss) at the last lap."""
    return log.groupBy(*key).agg(F.max_by("loss", "lap").alias("loss"))


def ranked(df: DataFrame, job: str, task: str, loss: str) -> DataFrame:
    """Adds ``rank`` (1 = lowest loss, then lowest task), ``n`` per job, and ``place``: best, median, worst or null.

    The median is rank ceil(n / 2) and exists for more than three tasks."""
    w = Window.partitionBy(job)
    out = df.withColumn("rank", F.row_number().over(w.orderBy(loss, task))).withColumn("n", F.count("*").over(w))
    place = F.when(F.col("rank") == 1, "best").when(F.col("rank") == F.col("n"), "worst")
    place = place.when((F.col("n") > 3) & (F.col("rank") == F.ceil(F.col("n") / 2)), "median")
    return out.withColumn("place", place)


def best_jobs(df: DataFrame, group: str, job: str, score: Column) -> DataFrame:
    """(group, job, score) of the job with the highest score per group; lowest job on ties."""
    s = df.groupBy(group, job).agg(score.alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), job)
    return s.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def effective_k(counts: DataFrame, least: float) -> DataFrame:
    """(lap, k_trained, k_effective): components, and those with a count above ``least``."""
    return counts.groupBy("lap").agg(F.count("*").alias("k_trained"), F.sum((F.col("n") > least).cast("bigint")).alias("k_effective"))


def nearest_lap(checkpoints: DataFrame, key: str, lap: float) -> DataFrame:
    """(key, lap) of the checkpoint nearest to ``lap``; the lower one on ties."""
    gap = F.struct(F.abs(F.col("lap") - lap), F.col("lap"))
    return checkpoints.groupBy(key).agg(F.min_by("lap", gap).alias("lap"))


def loss_deltas(log: DataFrame, *key: str) -> DataFrame:
    """Adds ``delta``: the change of the loss since the lap before."""
    return log.withColumn("delta", F.col("loss") - F.lag("loss").over(Window.partitionBy(*key).orderBy("lap")))


def confusion(df: DataFrame, true: str, found: str) -> DataFrame:
    return df.groupBy(true, found).agg(F.count("*").alias("n"))


def hamming(df: DataFrame, true: Column, found: Column) -> DataFrame:
    """(n, distance): share of rows with differing labels; negative or null true labels do not count."""
    rows = df.select(true.alias("t"), found.alias("f")).where("t >= 0")
    return rows.agg(F.count("*").alias("n"), F.avg((~F.col("t").eqNullSafe(F.col("f"))).cast("double")).alias("distance"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(n_pos, n_neg, auc) by the rank sum with mid-ranks for ties.

    Rows are first counted per distinct score, so only distinct scores are ranked."""
    per = df.groupBy(score).agg(F.sum(positive.cast("bigint")).alias("p"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = per.withColumn("_mid", before + (F.col("n") + 1) / 2).agg(F.sum(F.col("p") * F.col("_mid")).alias("s"), F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"))
    return r.select("n_pos", "n_neg", ((F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def pair_sizes(comps: DataFrame, k: str, n: str) -> DataFrame:
    """(k_a, k_b, total) for a < b, largest total first: candidates for merging. ``comps`` has K rows."""
    a, b = (comps.select(F.col(k).alias(f"k_{s}"), F.col(n).alias(f"n_{s}")) for s in "ab")
    return a.join(F.broadcast(b), F.col("k_a") < F.col("k_b")).select("k_a", "k_b", (F.col("n_a") + F.col("n_b")).alias("total"))


def delete_target(comps: DataFrame, k: str, n: str, most: float) -> DataFrame:
    """(k, n) of the largest component of at most ``most``; the lowest on ties."""
    own = comps.where(F.col(n) <= most)
    return own.agg(F.max_by(F.struct(k, n), F.struct(F.col(n), -F.col(k))).alias("t")).select(f"t.{k}", f"t.{n}")
