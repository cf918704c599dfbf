"""Splits that keep tied records together: distributed union-find, then greedy assignment."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.session import bounded_rows, cut


def _local_forest(batches: Iterator) -> Iterator:
    """For mapInPandas: edges (a, b) of a partition to (node, root), roots being smallest nodes."""
    import pandas as pd

    parent: dict = {}

    def find(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pd.DataFrame({"node": part, "root": [find(x) for x in part]})


def connected_components(edges: DataFrame, *, edges_per_task: int = 1_000_000, fan_in: int = 8) -> DataFrame:
    """(node, component) for every node of ``edges`` (a BIGINT, b BIGINT) with a neighbour;
    ``component`` is the smallest node that is connected with it.

    Each task runs union-find over its edges (dealt by a hash of both ends, so those of a hub
    are spread) and keeps a forest of (node, local root), so of
    any number of edges one per node and task is left. Forests are merged in ``fan_in`` times
    fewer tasks per round. As long as there are more than ``edges_per_task`` edges for one
    task, a round also merges trees across tasks: nodes toss a coin (a hash of node and
    round), and each node of one side joins its smallest neighbour of the other, which settles
    about a quarter of the nodes. The last forest is one task's; settled nodes are resolved
    backwards, round by round. Nothing is collected on the driver.

    Null ends and self-loops tie nothing; repeated edges change nothing; no edges, no rows.
    """
    rest = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    rest = cut(rest)
    settled, round_ = [], 0
    tasks = max(1, -(-rest.count() // edges_per_task))
    while True:
        forest = cut(rest.repartition(tasks, "a", "b").mapInPandas(_local_forest, "node bigint, root bigint"))
        if tasks == 1:
            known = forest.select("node", F.col("root").alias("component"))
            break
        kept = forest.select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
        both = kept.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(kept.select(F.col("b").alias("node"), F.col("a").alias("to")))
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(round_)), F.lit(2))  # noqa: E731, B023
        to = cut(both.where((coin("node") == 1) & (coin("to") == 0)).groupBy("node").agg(F.min("to").alias("to")))
        settled.append(to)
        at = lambda e: to.select(F.col("node").alias(e), F.col("to").alias(f"to_{e}"))  # noqa: E731, B023
        moved = kept.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where("a <> b")
        rest = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        round_ += 1
        tasks = max(-(-rest.count() // edges_per_task), tasks // fan_in, 1)
    several = bool(settled)
    while settled:
        lower = settled.pop().join(known.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
        known = cut(lower.unionByName(known))
    known = known.unionByName(known.select(F.col("component").alias("node"), "component").distinct()).distinct()
    if not several:
        return known
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))


def tied_groups(trials: DataFrame, aliases: DataFrame) -> DataFrame:
    """(seq_id, first_seq_id) for every distinct non-null ``seq_id``: the smallest one of those it is tied to.

    Trials are tied by a shared ``subj_uid``, by several uids of one ``seq_id``, and by rows
    (subj_uid, alias_uid), through chains of any length. Null uids tie nothing; uids without
    trials tie those around them. Repeated rows and self-aliases change nothing.

    Trials shrink to their smallest uid first, so the graph has uids as its only nodes, and
    a subject with a third of all trials costs one row per uid.
    """
    rows = trials.select("seq_id", "subj_uid").where("seq_id IS NOT NULL").distinct()
    least = rows.groupBy("seq_id").agg(F.min("subj_uid").alias("uid"), F.max("subj_uid").alias("other"))
    several = least.where("other > uid").select("seq_id", "uid")
    edges = several.join(rows, "seq_id").select(F.col("uid").alias("a"), F.col("subj_uid").alias("b"))
    edges = edges.unionByName(aliases.select(F.col("subj_uid").alias("a"), F.col("alias_uid").alias("b")))
    component = connected_components(edges)
    per_uid = least.where("uid IS NOT NULL").groupBy("uid").agg(F.min("seq_id").alias("first"))
    per_uid = per_uid.join(component.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    per_component = per_uid.groupBy("component").agg(F.min("first").alias("first_seq_id"))
    by_uid = per_uid.join(per_component, "component").select("uid", "first_seq_id")
    return least.select("seq_id", "uid").join(by_uid, "uid", "left").select("seq_id", F.coalesce("first_seq_id", "seq_id").alias("first_seq_id"))


def greedy_quotas(classes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """Largest-first greedy: for each (size, number of groups) how many groups go to which split.

    Each group goes to the split that is furthest below its target (ties: the name that sorts
    first). Groups of one size are alike, so only their numbers are kept; a long stretch of
    equal groups is dealt in whole rounds.
    """
    total = sum(s * n for s, n in classes)
    weight = sum(shares.values())
    lack = {k: total * v / weight for k, v in shares.items()}
    out: dict[int, list[tuple[str, int]]] = {}
    for size, n in sorted(classes, reverse=True):
        got = dict.fromkeys(lack, 0)
        # what certainly goes to each split before the last few groups are dealt one by one
        level = (sum(lack.values()) - size * n) / len(lack)
        while n > 1000:
            over = {k: v for k, v in lack.items() if v > level + size}
            level = (sum(over.values()) - size * n) / len(over) if over else level
            sure = {k: max(0, int((v - level) // size) - 1) for k, v in over.items()}
            sure = {k: c for k, c in sure.items() if c > 0}
            if not sure or sum(sure.values()) > n:
                break
            for k, c in sure.items():
                got[k] += c
                lack[k] -= c * size
                n -= c
        heap = [(-v, k) for k, v in lack.items()]
        heapq.heapify(heap)
        for _ in range(n):
            v, k = heap[0]
            heapq.heapreplace(heap, (v + size, k))
            got[k] += 1
            lack[k] -= size
        out[size] = [(k, c) for k, c in sorted(got.items()) if c]
    return out


def assign_splits(trials: DataFrame, aliases: DataFrame, shares: DataFrame, *, buckets: int = 64, ranked_per_task: int = 1_000_000) -> DataFrame:
    """Every distinct non-null ``seq_id`` with its group and split: (seq_id, first_seq_id, split_name).

    Groups of tied trials (``tied_groups``) go, largest first, to the split furthest below its
    share of the trials. The greedy run needs only the number of groups per size: there are at
    most sqrt(2 N) sizes for N trials, so that histogram, and nothing else, is read by the
    driver. Within a size, groups are ranked by a hash of their id, in two levels
    (``buckets`` per size, more where that leaves above ``ranked_per_task`` each), so the many
    groups of size one never meet in one task.

    Shares are normalised by their sum; null, negative and repeated names are errors. Empty
    trials give no rows. Repeated trial rows count once.
    """
    want = {r.split_name: r.share for r in bounded_rows(shares.select("split_name", "share"), 1000, "splits")}
    if not want or any(k is None or v is None or not v >= 0 for k, v in want.items()) or sum(want.values()) <= 0:
        raise ValueError("splits need names and shares of at least zero, not all zero")
    tied = cut(tied_groups(trials, aliases))
    buckets = max(buckets, -(-tied.count() // ranked_per_task))
    groups = tied.groupBy("first_seq_id").agg(F.count("*").alias("size"))
    groups = cut(groups.withColumn("bucket", F.pmod(F.xxhash64("first_seq_id"), F.lit(buckets))))
    counts = groups.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    sizes = bounded_rows(counts.groupBy("size").agg(F.sum("n").alias("n")), 5_000_000, "group sizes")
    quotas = greedy_quotas([(r["size"], r["n"]) for r in sizes], want)
    steps = []
    for size, parts in quotas.items():
        upto = 0
        for name, c in parts:
            steps.append((size, upto, upto + c, name))
            upto += c
    quota = trials.sparkSession.createDataFrame(steps, "size bigint, since bigint, until bigint, split_name string")
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("offset", offset).select("size", "bucket", "offset")
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(F.xxhash64("first_seq_id"), "first_seq_id")) - 1
    placed = groups.withColumn("rank", rank).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    # at most sqrt(2 N) sizes times the splits, so broadcast: most groups have size one, which as a join key would be one task's
    placed = placed.join(F.broadcast(quota), "size").where("rank >= since AND rank < until").select("first_seq_id", "split_name")
    return tied.join(placed, "first_seq_id").select("seq_id", "first_seq_id", "split_name")
