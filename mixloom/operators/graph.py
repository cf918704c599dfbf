"""Directed graphs as edge tables (src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges without self-loops; an edge that occurs twice is an error, checked before loops are dropped."""
    twice = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"edge {twice[0].src} -> {twice[0].dst} occurs {twice[0].n} times")
    return edges.where("src <> dst")


def unique_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, n): repeated edges counted, self-loops left out."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, n_edges): incidence sums over both ends."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("n_edges"))


def node_state_counts(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(node, state, n): for each end of an edge the state of the other end; ``states`` is (node, state)."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return ends.join(states.select(F.col("node").alias("other"), "state"), "other").groupBy("node", "state").agg(F.count("*").alias("n"))


def block_counts(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(state_src, state_dst, n): edges between states, by two equi-joins."""
    src, dst = (states.select(F.col("node").alias(e), F.col("state").alias(f"state_{e}")) for e in ("src", "dst"))
    return edges.join(src, "src").join(dst, "dst").groupBy("state_src", "state_dst").agg(F.count("*").alias("n"))


def dense_edges(nodes: DataFrame) -> DataFrame:
    """All ordered pairs of different nodes, for small adjacency matrices given in full."""
    return nodes.select(F.col("node").alias("src")).join(nodes.select(F.col("node").alias("dst")), F.col("src") != F.col("dst"))


def adjacency_to_edges(rows: DataFrame) -> DataFrame:
    """(src, ARRAY values) rows of an adjacency matrix to edges (src, dst, x), loops left out."""
    return rows.select("src", F.posexplode("values").alias("dst", "x")).where("src <> dst").select("src", F.col("dst").cast("bigint"), F.col("x").cast("double"))
