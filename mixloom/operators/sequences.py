"""Ordered groups: previous observations, state counts, blocks, and window forms of stick breaking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the previous ``value`` of the group; null at its first row."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(group).orderBy(*order)))


def ar_stats(df: DataFrame, group: str, order: list[str], state: str, x: str) -> DataFrame:
    """First-order autoregression sums per state: (state, n, xx, pp, px); first rows have no past and do not count."""
    rows = with_previous(df.select(group, *order, state, F.col(x).cast("double").alias("_x")), group, order, "_x", "_p").where(F.col("_p").isNotNull())
    return rows.groupBy(state).agg(
        F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_p") * F.col("_p")).alias("pp"), F.sum(F.col("_p") * F.col("_x")).alias("px")
    )


def start_counts(df: DataFrame, group: str, order: list[str], state: str) -> DataFrame:
    """(state, n): groups that begin in the state. A grouped minimum, no sort of the groups."""
    first = df.groupBy(group).agg(F.min(F.struct(*order, state)).alias("f"))
    return first.groupBy(F.col(f"f.{state}").alias(state)).agg(F.count("*").alias("n"))


def transition_counts(df: DataFrame, group: str, order: list[str], state: str) -> DataFrame:
    """(state_from, state_to, n)."""
    rows = with_previous(df, group, order, state, "state_from").where(F.col("state_from").isNotNull())
    return rows.groupBy("state_from", F.col(state).alias("state_to")).agg(F.count("*").alias("n"))


def contiguous_blocks(df: DataFrame, group: str, order: list[str], state: str) -> DataFrame:
    """(group, block, state, start, size): stretches of one state, ``start`` being the 0-based row of the group."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.select(group, *order, state, (F.row_number().over(w) - 1).alias("_i"), F.lag(state).over(w).alias("_p"))
    rows = rows.withColumn("_new", (F.col("_p").isNull() | (F.col("_p") != F.col(state))).cast("int"))
    rows = rows.withColumn("block", F.sum("_new").over(w) - 1)
    return rows.groupBy(group, "block").agg(F.first(state).alias(state), F.min("_i").alias("start"), F.count("*").alias("size"))


def even_blocks(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """(group, block, start, size): each group cut into k even blocks, the remainder to the first ones."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.select(group, F.ntile(k).over(w).alias("block"), (F.row_number().over(w) - 1).alias("_i"))
    return rows.groupBy(group, "block").agg(F.min("_i").alias("start"), F.count("*").alias("size"))


def later_counts(comps: DataFrame, k: str, n: str) -> DataFrame:
    """Adds ``n_later``: the count of all components after this one. ``comps`` has K rows."""
    w = Window.orderBy(k).rowsBetween(1, Window.unboundedFollowing)
    return comps.withColumn("n_later", F.coalesce(F.sum(n).over(w), F.lit(0)))


def stick_weights(comps: DataFrame, k: str, rho: str) -> DataFrame:
    """Adds ``weight`` = rho times the product of (1 - rho) before. ``comps`` has K rows."""
    w = Window.orderBy(k).rowsBetween(Window.unboundedPreceding, -1)
    return comps.withColumn("weight", F.col(rho) * F.exp(F.coalesce(F.sum(F.ln(1 - F.col(rho))).over(w), F.lit(0.0))))
