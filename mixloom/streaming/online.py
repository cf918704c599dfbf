"""Single-pass stochastic VB and running statistics over Structured Streaming sources."""

from __future__ import annotations

import json
import posixpath
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.models.mixtures import Mixture
from mixloom.plans.fit import learning_rate, one_pass
from mixloom.sources.store import flat_arrays, nested_arrays


class _Kept:
    """State of an online fit: parameters, rows seen, step and last epoch, saved with every epoch.

    With a folder (one that the next driver sees too, such as one beside the stream's checkpoint)
    a restarted query goes on from the saved parameters. The file of an epoch is written under
    another name and renamed before the epoch is reported done, so an epoch that Spark hands out again is
    known and left out; the last two files are kept."""

    folder: str | None = None

    def _fs(self, spark):
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.folder, name))

    def _epochs(self, spark) -> list[int]:
        fs, at = self._fs(spark)
        names = [str(f.getPath().getName()) for f in fs.listStatus(at(""))] if fs.exists(at("")) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"epoch-(\d+)\.json", n)))

    def resume(self, spark, folder: str) -> bool:
        """Uses ``folder`` for the state and takes up what it holds; whether it held any."""
        self.folder = folder
        epochs = self._epochs(spark)
        if not epochs:
            return False
        found = json.loads(spark.read.text(posixpath.join(folder, f"epoch-{epochs[-1]}.json"), wholetext=True).first()[0])
        self.params = nested_arrays({k: np.array(v, float) for k, v in found["params"].items()})
        self.seen, self.step, self.last, self.trace = found["seen"], found["step"], found["last"], found["trace"]
        return True

    def _save(self, spark) -> None:
        if self.folder is None:
            return
        fs, at = self._fs(spark)
        state = {"params": {k: np.asarray(v).tolist() for k, v in flat_arrays(self.params).items()}, "seen": self.seen, "step": self.step, "last": self.last, "trace": self.trace}
        out = fs.create(at("new.json"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.rename(at("new.json"), at(f"epoch-{self.last}.json"))
        for old in self._epochs(spark)[:-2]:
            fs.delete(at(f"epoch-{old}.json"), False)


class OnlineFit(_Kept):
    """Stochastic VB as a foreachBatch sink: each micro-batch moves the natural parameters.

    The driver holds K-sized parameters only. ``n_total`` is the size the stream stands for
    (unknown: the rows seen so far). Batches seen before (by epoch id) are left out, so a
    restarted query does not count them twice; ``resume`` keeps the state over a restart.
    """

    def __init__(self, model: Mixture, first: dict, *, n_total: float | None = None, delay: float = 1.0, power: float = 0.5):
        self.model, self.params, self.n_total = model, model.global_step(first), n_total
        self.delay, self.power, self.seen, self.step, self.last = delay, power, 0.0, 0, -1
        self.trace: list[dict] = []

    def __call__(self, df: DataFrame, epoch: int) -> None:
        if epoch <= self.last:
            return
        part = one_pass(df, self.model.scorer(self.params), self.model)
        if part is None:
            return
        n = float(part["n"][0])
        self.seen += n
        total = self.n_total or self.seen
        self.params = self.model.stochastic_step(self.params, part, learning_rate(self.step, delay=self.delay, power=self.power), total / n)
        self.step += 1
        whole = {k: v * (total / n) for k, v in part.items()}
        self.last = epoch
        self.trace.append({"epoch": epoch, "rows": n, "loss": float(-self.model.objective(whole, self.params) / self.model.scale(total)), "k": len(part["N"])})
        self._save(df.sparkSession)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class OnlineTopics(_Kept):
    """Stochastic VB of a topic model as a foreachBatch sink over documents as rows (ids, counts)."""

    def __init__(self, model, params: dict, *, n_total: float | None = None, delay: float = 1.0, power: float = 0.5):
        self.model, self.params, self.n_total, self.delay, self.power = model, params, n_total, delay, power
        self.seen, self.step, self.last, self.trace = 0.0, 0, -1, []

    def __call__(self, df: DataFrame, epoch: int) -> None:
        if epoch <= self.last:
            return
        part = self.model.lap(df, self.params)
        if part is None or part["nDoc"][0] == 0:
            return
        n = float(part["nDoc"][0])
        self.seen += n
        whole = {k: v * ((self.n_total or self.seen) / n) for k, v in part.items()}
        new, rate = self.model.global_step(whole, self.params), learning_rate(self.step, delay=self.delay, power=self.power)
        self.params = {k: (1 - rate) * self.params[k] + rate * new[k] for k in new}
        self.step += 1
        self.last = epoch
        self.trace.append({"epoch": epoch, "docs": n, "loss": float(-self.model.objective(whole, self.params) / whole["tokens"][0])})
        self._save(df.sparkSession)

    start = OnlineFit.start


def running_stats(stream: DataFrame, state: str, value: str) -> DataFrame:
    """A streaming aggregate (state, n, sx, sxx), for complete or update mode."""
    v = F.col(value).cast("double")
    return stream.groupBy(state).agg(F.count("*").alias("n"), F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"))


def windowed_stats(stream: DataFrame, time: str, state: str, value: str, *, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per event-time window (state, n, sx), with a watermark for late rows; an extension for append mode."""
    v = F.col(value).cast("double")
    out = stream.withWatermark(time, late).groupBy(F.window(time, window), state).agg(F.count("*").alias("n"), F.sum(v).alias("sx"))
    return out.select(F.col("window.start").alias("since"), state, "n", "sx")
