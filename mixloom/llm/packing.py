"""Packing texts into windows of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.tokens import DEFAULT_TOKENIZER, n_tokens
from mixloom.session import cut


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin). Items of 1 to ``capacity`` are placed in the given order.

    An item goes where the sum of squares of the numbers of open bins per residual gap becomes
    smallest; of equal choices to the smallest gap, a new bin last.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins per gap; full bins are not open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, fills = np.empty(len(sizes), dtype=np.int64), []
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        gap, best = 0, far
        if s < capacity:
            # choosing gap g: N[g] loses one and N[g - s] wins one (none at 0)
            change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
            change[0] -= 1
            held = count[s:capacity] > 0
            if held.any():
                change = np.where(held, change, far)
                k = int(change.argmin())
                gap, best = k + s, int(change[k])
            new = 2 * int(count[capacity - s]) + 1
        else:
            new = 0
        if best <= new:
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            b, gap = len(fills), capacity
            fills.append(0)
        fills[b] += s
        where[i] = b
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return where, np.asarray(fills, dtype=np.int64)


def pack(items: DataFrame, *, capacity: int, items_per_task: int = 200_000, full: float = 0.98) -> DataFrame:
    """``items`` (item, size with 1 <= size <= capacity) to (item, window).

    Items are dealt by hash into shards of about ``items_per_task``; each shard is packed by
    ``sum_of_squares``, largest first. Windows filled to less than ``full`` of the capacity
    are items of the next level, packed over all shards in the same way, until one shard is
    left or a level puts no two of them together; so what a shard leaves open is filled up from the others.
    """
    level, names, depth = items.select("item", "size"), None, 0
    while True:
        n = level.count()
        shards, at = max(1, -(-n // items_per_task)), depth

        def one(key, pdf):
            pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable", ignore_index=True)
            where, fills = sum_of_squares(pdf["size"].to_numpy(), capacity)
            pdf["window"] = [f"{at}-{key[0]}-{b}" for b in where]
            pdf["fill"] = fills[where]
            return pdf[["item", "window", "fill"]]

        sharded = level.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
        placed = cut(sharded.groupBy("shard").applyInPandas(one, "item string, window string, fill bigint"))
        names = placed if names is None else names.join(placed.select(F.col("item").alias("window"), F.col("window").alias("upper")), "window", "left").select("item", F.coalesce("upper", "window").alias("window"))
        combined = shards > 1 and placed.agg(F.count_distinct("window")).first()[0] < n
        if not combined:
            return names.select("item", "window")
        level = placed.where(F.col("fill") < full * capacity).select(F.col("window").alias("item"), F.col("fill").alias("size")).distinct()
        depth += 1


def pack_windows(docs: DataFrame, *, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, items_per_task: int = 200_000) -> DataFrame:
    """Windows of ``capacity`` tokens from whole texts: (window, doc_id, piece, first_token, n_tokens).

    Texts are sized in tokens of the tokenizer in the file ``tokenizer``. Only a text that alone
    exceeds a window is cut: into full windows and a rest. Null and empty texts have no tokens
    and no row. Every row of ``docs`` is a text of its own, also with a null or repeated
    ``doc_id``. Only sizes are shuffled, never texts; other columns are never read.
    """
    sized = docs.select("doc_id", n_tokens(F.col("text"), tokenizer).alias("tokens")).where("tokens > 0")
    # checkpointed, so the row ids below are drawn once
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()))
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1))
    pieces = sized.withColumn("piece", piece).withColumn("first_token", F.col("piece").cast("bigint") * capacity)
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("first_token")))
    pieces = pieces.withColumn("item", F.concat_ws(".", "row", "piece"))
    whole = F.col("n_tokens") == capacity
    out = ["window", "doc_id", "piece", "first_token", "n_tokens"]
    filled = pieces.where(whole).withColumn("window", F.concat(F.lit("full-"), F.col("item"))).select(*out)
    rest = pieces.where(~whole)
    packed = pack(rest.select("item", F.col("n_tokens").alias("size")), capacity=capacity, items_per_task=items_per_task)
    return filled.unionByName(rest.join(packed, "item").select(*out))
