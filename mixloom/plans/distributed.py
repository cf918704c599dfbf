"""Distributed sums: numpy statistics computed per partition and added in a tree."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]
PAYLOAD = "slot int, payload binary"


def pack(values: Arrays) -> bytes:
    return b"".join(np.ascontiguousarray(values[k], dtype=np.float64).tobytes() for k in sorted(values))


def unpack(payload: bytes, shapes: dict[str, tuple]) -> Arrays:
    flat, out, at = np.frombuffer(payload, np.float64), {}, 0
    for k in sorted(shapes):
        n = math.prod(shapes[k])
        out[k] = flat[at : at + n].reshape(shapes[k]).copy()
        at += n
    return out


def _add(key, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pdf["payload"].iloc[0], np.float64).copy()
    for p in pdf["payload"].iloc[1:]:
        total += np.frombuffer(p, np.float64)
    return pd.DataFrame({"slot": [key[0]], "payload": [total.tobytes()]})


def column_matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A numeric column as a vector, an array column of equal lengths as a matrix."""
    col = batch.column(name)
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(col), -1)
    return col.to_numpy(zero_copy_only=False).astype(np.float64)


def summed(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[Arrays]], *, slots: int | None = None) -> dict | None:
    """Adds what ``step`` yields over all partitions; None for no rows at all.

    Each partition yields one block of arrays; blocks are added per slot by tasks, and the
    driver adds as many blocks as there are slots (about the root of the partitions).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: Arrays | None = None
        for part in step(batches):
            if total is None:
                total = {k: np.array(v, dtype=np.float64) for k, v in part.items()}
            else:
                for k, v in part.items():
                    total[k] = total[k] + v
        if total is not None:
            shapes = json.dumps({k: list(np.shape(v)) for k, v in total.items()})
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int32()), "payload": pa.array([pack(total)], pa.binary()), "shapes": pa.array([shapes])})

    blocks = df.mapInArrow(run, PAYLOAD + ", shapes string")
    n = df.rdd.getNumPartitions() if slots is None else slots**2
    if n > 64:
        width = int(math.sqrt(n)) if slots is None else slots

        def add(key, pdf):
            return _add(key, pdf).assign(shapes=pdf["shapes"].iloc[0])

        blocks = blocks.withColumn("slot", F.col("slot") % width).groupBy("slot").applyInPandas(add, PAYLOAD + ", shapes string")
    total = None
    for r in blocks.collect():  # at most 64 blocks, or as many as slots
        part = unpack(bytes(r["payload"]), {k: tuple(v) for k, v in json.loads(r["shapes"]).items()})
        total = part if total is None else {k: total[k] + v for k, v in part.items()}
    return total
