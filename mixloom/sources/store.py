"""Sinks: datasets, parameters by lap, statistics, and the logs of a run, as tables."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAYS = "lap double, part string, name string, shape array<int>, values array<double>"


def write_csv(df: DataFrame, path: str, x: str = "x") -> None:
    """Vectors as CSV columns dim_0, dim_1, ..., with a header."""
    d = len(df.select(x).first()[0])
    df.select(*[F.col(x)[i].alias(f"dim_{i}") for i in range(d)]).write.mode("overwrite").csv(path, header=True)


def write_ldac(bag: DataFrame, path: str) -> None:
    """One ``U id:count ...`` line per document, from (doc_id, word_id, word_count)."""
    from mixloom.operators.bow import ldac_lines

    ldac_lines(bag).select("line").write.mode("overwrite").text(path)


def write_tokenlist(bag: DataFrame, path: str, first_index: int = 1) -> None:
    """One line of token ids per document, each repeated by its count."""
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "word_count"))), lambda e: F.array_repeat((e["word_id"] + first_index).cast("string"), e["word_count"].cast("int"))))
    bag.groupBy("doc_id").agg(F.concat_ws(" ", tokens).alias("line")).select("line").write.mode("overwrite").text(path)


def write_info(df: DataFrame, path: str, vocab_size: int) -> None:
    """One row of totals of a bag of words."""
    df.agg(F.count_distinct("doc_id").alias("nDocTotal"), F.sum("word_count").alias("nTokensTotal")).withColumn("vocab_size", F.lit(vocab_size)).write.mode("overwrite").json(path)


def flat_arrays(params: dict, prefix: str = "") -> dict[str, np.ndarray]:
    """Nested parameter dicts as ``part.name`` keys."""
    out = {}
    for k, v in params.items():
        if isinstance(v, dict):
            out |= flat_arrays(v, f"{prefix}{k}.")
        elif v is not None:
            out[f"{prefix}{k}"] = np.asarray(v, float)
    return out


def nested_arrays(flat: dict[str, np.ndarray]) -> dict:
    out: dict = {}
    for k, v in flat.items():
        *path, name = k.split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[name] = v
    return out


class RunStore:
    """Tables of one run under a folder: ``params`` and ``stats`` by lap, and appended logs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.clock: dict[str, float] = {}

    def _append(self, table: str, rows: list, schema: str) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{table}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def save(self, lap: float, params: dict, part: str = "params", *, least: float | None = None) -> None:
        """All arrays of ``params`` at a lap; ``least`` zeroes smaller values first (sparse topics)."""
        rows = []
        for name, v in flat_arrays(params).items():
            v = np.where(np.abs(v) < least, 0.0, v) if least else v
            rows.append((float(lap), part, name, list(v.shape), v.ravel().tolist()))
        self._append("arrays", rows, ARRAYS)

    def laps(self, part: str = "params") -> list[float]:
        return sorted(r[0] for r in self.table("arrays").where(F.col("part") == part).select("lap").distinct().collect())

    def load(self, lap: float | None = None, part: str = "params") -> tuple[float, dict]:
        """The parameters nearest to ``lap`` (the lower lap on ties), or the last."""
        laps = self.laps(part)
        at = laps[-1] if lap is None else min(laps, key=lambda x: (abs(x - lap), x))
        rows = self.table("arrays").where((F.col("part") == part) & (F.col("lap") == at)).collect()
        return at, nested_arrays({r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in rows})

    def log_trace(self, trace: list[dict]) -> None:
        rows = [(float(t["lap"]), float(t["loss"]), int(t["k"]), t.get("seconds"), t.get("rows")) for t in trace]
        self._append("trace", rows, "lap double, loss double, k int, seconds double, rows double")

    def log_counts(self, lap: float, uids: list[int], counts) -> None:
        self._append("counts", [(float(lap), int(u), float(n)) for u, n in zip(uids, counts)], "lap double, uid int, n double")

    def log_moves(self, moves: list[dict]) -> None:
        rows = [(float(m["lap"]), m["move"], bool(m["accepted"]), [int(u) for u in m.get("uids", ())]) for m in moves]
        self._append("moves", rows, "lap double, move string, accepted boolean, uids array<int>")

    def start(self, event: str) -> None:
        self.clock[event] = time.time()

    def stop(self, event: str, lap: float) -> None:
        self._append("timings", [(float(lap), event, time.time() - self.clock.pop(event))], "lap double, event string, seconds double")

    def callback(self, every: float = 5, early: float = 0):
        """A callback for fits that saves parameters and counts when a checkpoint is due."""
        from mixloom.plans.fit import should_save

        seen = {"n": 0}

        def on(event) -> None:
            if should_save(event.lap, seen["n"], every=every, early=early):
                self.save(event.lap, event.params)
                self.log_counts(event.lap, event.uids or list(range(event.k)), event.stats["N"])
            seen["n"] += 1

        return on
