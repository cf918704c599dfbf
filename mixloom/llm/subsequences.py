"""Frequent ordered patterns with bounded gaps, mined from sequence decision diagrams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.llm.events import events, is_proper
from mixloom.session import bounded_rows, cut, spread

SEPARATOR = ">"


class Diagrams:
    """A shared acyclic graph of diagrams, each the set of patterns that start at some place.

    A node is the tuple of its (label, child) edges; equal nodes exist once. ``weight`` counts,
    per root, the sequences whose whole pattern set is that diagram. All sets are closed under
    prefixes, so every node accepts.
    """

    def __init__(self, length: int, reach: int, allowed: set[tuple] | None):
        self.length, self.reach, self.allowed = length, reach, allowed
        self.begins = None if allowed is None else {a[:i] for a in allowed for i in range(1, len(a) + 1)}
        self.ids: dict[tuple, int] = {(): 0}
        self.edges: list[tuple] = [()]
        self.built: dict[tuple, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.mined: dict[frozenset, dict] = {}
        self.weight: Counter = Counter()

    def node(self, children: dict) -> int:
        key = tuple(sorted(children.items()))
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.edges)
            self.edges.append(key)
        return i

    def union(self, a: int, b: int) -> int:
        if a == b or not b:
            return a
        if not a:
            return b
        key = (a, b) if a < b else (b, a)
        out = self.joined.get(key)
        if out is None:
            children = dict(self.edges[a])
            for label, child in self.edges[b]:
                children[label] = self.union(children[label], child) if label in children else child
            out = self.joined[key] = self.node(children)
        return out

    def fits(self, so_far: tuple) -> bool:
        if self.allowed is None:
            return True
        if len(so_far) < self.length:
            return so_far in self.begins
        return so_far[1:] in self.allowed

    def after(self, so_far: tuple, window: tuple) -> int:
        """The diagram of what may follow ``so_far`` when ``window`` comes next."""
        left = self.length - len(so_far)
        if not left:
            return 0
        window = window[: self.reach * left]
        key = (so_far, window)
        out = self.built.get(key)
        if out is None:
            children: dict = {}
            for i in range(min(self.reach, len(window))):
                label = window[i]
                if label is None or not self.fits(so_far + (label,)):
                    continue
                child = self.after(so_far + (label,), window[i + 1 :])
                children[label] = self.union(children[label], child) if label in children else child
            out = self.built[key] = self.node(children)
        return out

    def of(self, items: list, tail: list) -> int:
        """The diagram of all patterns that begin in ``items``; ``tail`` follows them."""
        line, far, roots = tuple(items) + tuple(tail), self.reach * (self.length - 1), {}
        for i, label in enumerate(items):
            if label is not None and self.fits((label,)):
                child = self.after((label,), line[i + 1 : i + 1 + far])
                roots[label] = self.union(roots[label], child) if label in roots else child
        return self.node(roots)

    def mine(self, bag: dict, depth: int) -> dict:
        """Patterns of ``depth`` further labels with their weights, in a weighted bag of diagrams.

        The conditional bag of a label holds the children along it; equal bags are mined once.
        """
        if not depth:
            return {(): sum(bag.values())}
        key = frozenset(bag.items())
        out = self.mined.get((depth, key))
        if out is None:
            conditional: dict = {}
            for node, weight in bag.items():
                for label, child in self.edges[node]:
                    to = conditional.setdefault(label, {})
                    to[child] = to.get(child, 0) + weight
            out = {}
            for label, below in conditional.items():
                for rest, weight in self.mine(below, depth - 1).items():
                    out[(label, *rest)] = weight
            self.mined[(depth, key)] = out
        return out

    def patterns(self, root: int) -> list[tuple]:
        return list(self.mine({root: 1}, self.length))


def _miner(length: int, reach: int, allowed: set[tuple] | None, max_nodes: int):
    """For mapInPandas: rows (seq_id, items, tail, split) to (pattern, seq_id, n). Whole
    sequences are counted; parts of split sequences give their patterns by sequence."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        counts: Counter = Counter()
        diagrams = Diagrams(length, reach, allowed)

        def harvest() -> None:
            for p, n in diagrams.mine(dict(diagrams.weight), length).items():
                counts[p] += n

        for pdf in batches:
            parts = []
            for seq, items, tail, split in zip(pdf.seq_id, pdf["items"], pdf["tail"], pdf["split"]):
                root = diagrams.of(list(items), list(tail))
                if not root:
                    continue
                if split:
                    parts += [(SEPARATOR.join(p), seq) for p in diagrams.patterns(root)]
                else:
                    diagrams.weight[root] += 1
                if len(diagrams.edges) + len(diagrams.built) > max_nodes:  # bounded memory; counts add up
                    harvest()
                    diagrams = Diagrams(length, reach, allowed)
            if parts:
                yield pd.DataFrame(parts, columns=["pattern", "seq_id"]).assign(n=1)
        harvest()
        if counts:
            yield pd.DataFrame({"pattern": [SEPARATOR.join(p) for p in counts], "seq_id": None, "n": list(counts.values())}).astype({"seq_id": "Int64"})

    return run


def action_lists(steps: DataFrame, dictionary: DataFrame, *, tail: int, block: int = 4096) -> DataFrame:
    """Each sequence's list of actions, repeats listed once, in parts of at most ``block`` items:
    (seq_id, block, items, tail, split). ``tail`` are the items that follow in the next parts,
    as many as asked; ``split`` tells sequences of several parts. Null items stand for names
    outside the dictionary.
    """
    ev = events(steps, dictionary, block=block)
    parts = ev.groupBy("seq_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("tstep_id", "action"))), lambda e: e["action"]).alias("all"))
    parts = cut(parts.select("seq_id", "block", F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1))).alias("items")))
    # what a part shows its neighbours: a few items, so a window over a huge sequence holds little of it
    edge = parts.select("seq_id", "block", F.element_at("items", -1).alias("end"), F.slice("items", 1, tail + 1).alias("head"), F.size("items").alias("size"))
    order = Window.partitionBy("seq_id").orderBy("block")
    edge = edge.withColumn("before", F.lag("end").over(order))
    opens = F.get("head", F.lit(0)) == F.col("before")  # the first item goes on from the part before
    edge = edge.withColumn("skip", F.when(opens, 1).otherwise(0)).where("size > skip")
    edge = edge.withColumn("head", F.slice("head", F.col("skip") + 1, F.lit(tail)))
    heads = F.collect_list("head").over(order.rowsBetween(1, tail))
    more = F.count("*").over(Window.partitionBy("seq_id")) > 1
    edge = edge.select("seq_id", "block", "skip", F.slice(F.flatten(heads), 1, tail).alias("tail"), more.alias("split"))
    parts = parts.join(edge, ["seq_id", "block"]).select("seq_id", "block", F.slice("items", F.col("skip") + 1, F.size("items")).alias("items"), "tail", "split")
    only_proper = lambda c: F.transform(c, lambda x: F.when(is_proper(x), x))
    return parts.withColumns({"items": only_proper("items"), "tail": only_proper("tail")})


def frequent_subsequences(
    steps: DataFrame,
    dictionary: DataFrame,
    *,
    min_share: float = 0.05,
    max_between: int = 2,
    lengths: tuple[int, ...] = (3, 4),
    block: int = 4096,
    max_patterns: int = 1_000_000,
    max_nodes: int = 400_000,
) -> DataFrame:
    """Patterns (pattern, length, support, n_sequences) held by at least ``min_share`` of the sequences.

    Of each sequence's list of actions (repeats that follow directly are listed once), a
    pattern takes items in order with at most ``max_between`` others between neighbours. A
    sequence counts once per pattern. Every non-null ``seq_id`` with an event is a sequence.
    Patterns consist of dictionary names only; other names hold their place in the list.

    Lengths are mined level by level: a pattern can be frequent only if both its parts without
    the first and without the last action are. The frequent patterns of a level, at most
    ``max_patterns`` (else an error; the dictionary bounds them too), go to the tasks of the
    next. Each task compresses its sequences into one diagram graph (``Diagrams``) and counts
    in it; counts are added per pattern. Sequences of several parts are counted through
    distinct (pattern, sequence) pairs. Parts meet their neighbours in a window over a few items
    of each, and are mined where (sequence, block) puts them, so a huge sequence is spread over
    many tasks.

    Empty tables, or no event at all, give no rows; nulls, ties and repeated rows are treated
    as said at ``events``; other columns are never read.
    """
    longest = max(lengths)
    lists = spread(action_lists(steps, dictionary, tail=(longest - 1) * (max_between + 1), block=block), "seq_id", "block")
    n = lists.agg(F.count_distinct("seq_id")).first()[0]
    least = max(1, math.ceil(min_share * n - 1e-9))
    allowed, out = None, None
    for length in range(2, longest + 1):
        counted = lists.select("seq_id", "items", "tail", "split").mapInPandas(_miner(length, max_between + 1, allowed, max_nodes), "pattern string, seq_id bigint, n bigint")
        # without a sequence: added counts; with one: once per sequence
        once = counted.groupBy("pattern", "seq_id").agg(F.sum("n").alias("n"))
        support = once.groupBy("pattern").agg(F.sum(F.when(F.col("seq_id").isNull(), F.col("n")).otherwise(1)).alias("support"))
        level = cut(support.where(F.col("support") >= least))
        if length in lengths:
            own = level.select("pattern", F.lit(length).alias("length"), "support", F.lit(n).cast("bigint").alias("n_sequences"))
            out = own if out is None else out.unionByName(own)
        if length < longest:
            allowed = {tuple(r.pattern.split(SEPARATOR)) for r in bounded_rows(level, max_patterns, f"frequent patterns of length {length}")}
    return out
