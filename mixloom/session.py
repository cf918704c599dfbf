"""Session helpers: lineage cuts in the shared folder, and size-checked driver reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``, if it names one.

    Only a local session without that setting gets a temporary folder of its own;
    on a cluster a machine-local folder would be lost with the machine, so the
    missing setting is an error there.
    """
    sc = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    have = sc.getCheckpointDir()
    if have:
        return have
    if wanted:
        sc.setCheckpointDir(wanted)
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="mixloom-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Materialises ``df`` in at least as many partitions as there are cores, for what is
    much work per row (fits, mining): rows that are few in bytes would else share few tasks."""
    n, df = df.sparkSession.sparkContext.defaultParallelism, cut(df)  # cut first: counting partitions would run the plan
    return df if df.rdd.getNumPartitions() >= n else cut(df.repartition(n, *keys))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_mixloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="mixloom-package-"))
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    with zipfile.ZipFile(at / "mixloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("mixloom") / f.relative_to(root))
    sc.addPyFile(str(at / "mixloom.zip"))
    sc._mixloom_shipped = True


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Brings at most ``most`` rows to the driver; more than that is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows, too many for the driver")
    return rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Reads ``folder/name.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
