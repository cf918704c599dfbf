"""Readers of the four dataset shapes: vectors, grouped vectors, bags of words, graphs.

Schemas are explicit; nothing is inferred by scanning. Files are split by Spark, so one large
file is read by many tasks without byte-range bookkeeping here.
"""

from __future__ import annotations

import io
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of a directory of batches, in the order in which they are looked for.
BATCH_KINDS = (".ldac", ".npz", ".csv", ".parquet")


def vectors_from_columns(df: DataFrame, *, row_id: str | None = None) -> DataFrame:
    """(row_id, x[, y][, z_true]) by column names: ``y_*`` are responses, the first ``z_*`` is the true
    label, every other column belongs to x in its order. One response gives y DOUBLE, several an array."""
    ys, zs = [c for c in df.columns if c.startswith("y_")], [c for c in df.columns if c.startswith("z_")]
    xs = [c for c in df.columns if c not in ys and c not in zs and c != row_id]
    out = [F.col(row_id).cast("bigint").alias("row_id") if row_id else F.monotonically_increasing_id().alias("row_id")]
    out.append(F.array(*[F.col(f"`{c}`").cast("double") for c in xs]).alias("x"))
    if len(ys) == 1:
        out.append(F.col(ys[0]).cast("double").alias("y"))
    elif ys:
        out.append(F.array(*[F.col(c).cast("double") for c in ys]).alias("y"))
    if zs:
        out.append(F.col(zs[0]).cast("int").alias("z_true"))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, roles by column prefix (``vectors_from_columns``)."""
    return vectors_from_columns(spark.read.csv(path, header=True))


def _npz(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    def step(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    yield pd.DataFrame(rows(name, z))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(step, schema)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_id, x[, y]) from .npz files with key X (and Y); a file is one task."""

    def rows(name, z):
        return {"file": name, "row_id": range(len(z["X"])), "x": z["X"].astype(float).tolist(), "y": z["Y"].ravel().astype(float) if "Y" in z else None}

    return _npz(spark, path, "file string, row_id bigint, x array<double>, y double", rows)


def read_grouped_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, group_id, pos, x) from .npz files with keys X and doc_range."""

    def rows(name, z):
        import numpy as np

        size = np.diff(z["doc_range"])
        return {"file": name, "group_id": np.repeat(np.arange(len(size)), size), "pos": np.concatenate([np.arange(s) for s in size] or [np.zeros(0, int)]), "x": z["X"].astype(float).tolist()}

    return _npz(spark, path, "file string, group_id bigint, pos int, x array<double>", rows)


def read_bow_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, word_id, word_count) from .npz files with word_id, word_count and doc_range."""

    def rows(name, z):
        import numpy as np

        size = np.diff(z["doc_range"])
        return {"file": name, "doc_id": np.repeat(np.arange(len(size)), size), "word_id": z["word_id"].astype(int), "word_count": z["word_count"].astype(float)}

    return _npz(spark, path, "file string, doc_id bigint, word_id int, word_count double", rows)


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """MATLAB files need a library that is not here; convert them to Parquet once."""
    raise NotImplementedError("MATLAB files are not read; convert them to Parquet or .npz")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the extension: .csv, .npz, .mat, else Parquet."""
    kind = os.path.splitext(path)[1]
    return {".csv": read_csv, ".npz": read_npz, ".mat": read_mat}.get(kind, lambda s, p: s.read.parquet(p))(spark, path)


def parse_ldac(line: Column) -> Column:
    """ARRAY<STRUCT<word_id INT, word_count DOUBLE>> of a line ``U id:count ...``."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda p: p.contains(":"))
    return F.transform(parts, lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("word_id"), F.split(p, ":")[1].cast("double").alias("word_count")))


def read_ldac(spark: SparkSession, path: str, *, n_batches: int | None = None) -> DataFrame:
    """(file, doc_id, word_id, word_count); one document per line, ids ascending in file order.

    The first number of a line must equal its entries; a line that differs is an error when read."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("doc_id"), "value").where("trim(value) <> ''")
    entries = parse_ldac(F.col("value"))
    said = F.split(F.trim("value"), r"\s+")[0].cast("int")
    checked = F.when(F.size(entries) == said, entries).otherwise(F.raise_error(F.concat(F.lit("bad ldac line: "), "value")))
    return lines.select("file", "doc_id", F.inline(checked))


def read_tokenlist(spark: SparkSession, path: str, *, first_index: int = 1) -> DataFrame:
    """(doc_id, word_id, word_count) from lines of token ids, repeats counted."""
    lines = spark.read.text(path).withColumn("doc_id", F.monotonically_increasing_id())  # before the lines are taken apart
    lines = lines.select("doc_id", F.explode(F.split(F.trim("value"), r"\s+")).alias("t")).where("t <> ''")
    return lines.groupBy("doc_id", (F.col("t").cast("int") - first_index).alias("word_id")).agg(F.count("*").cast("double").alias("word_count"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, x): ``.graph`` files have four columns with the edge in the second and third and x in
    the fourth; other files have ``src dst x...`` per line. Lines that begin with # are comments."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(parts.alias("p"))
    at = 1 if path.endswith(".graph") else 0
    values = F.transform(F.slice("p", at + 3, F.greatest(F.size("p") - at - 2, F.lit(0))), lambda v: v.cast("double"))
    return lines.select(F.col("p")[at].cast("bigint").alias("src"), F.col("p")[at + 1].cast("bigint").alias("dst"), values.alias("x"))


def batch_files(path: str, spark: SparkSession | None = None) -> list[str]:
    """The batch files of a directory, sorted by name: all of the first kind that is there.

    The listing goes through Hadoop's file systems, so the directory may be on any store."""
    spark = spark or SparkSession.getActiveSession()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = sorted(str(f.getPath().getName()) for f in found if f.isFile())
    for kind in BATCH_KINDS:
        own = [f"{path.rstrip('/')}/{n}" for n in names if n.endswith(kind)]
        if own:
            return own
    raise FileNotFoundError(f"no batch files in {path}")


def with_file_batches(df: DataFrame, file: str = "file") -> DataFrame:
    """Adds ``batch_id``: one per file, 0-based by file name. The list of files has one row per file."""
    from pyspark.sql import Window

    files = df.select(file).distinct().withColumn("batch_id", F.row_number().over(Window.orderBy(file)) - 1)
    return df.join(F.broadcast(files), file)


def dataset_info(df: DataFrame, unit: str) -> DataFrame:
    """(n_batches, n_total, median_batch) of a dataset with ``batch_id``; ``unit`` names what is counted."""
    per = df.groupBy("batch_id").agg(F.count_distinct(unit).alias("n"))
    return per.agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_total"), F.percentile("n", F.lit(0.5)).alias("median_batch"))


def fill_missing(df: DataFrame, x: str) -> DataFrame:
    """NaN and null entries of an array column replaced by the mean of their dimension."""
    seen = df.select(F.posexplode(F.col(x).cast("array<double>")).alias("dim", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    means = seen.groupBy("dim").agg(F.avg("v").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("dim", "m"))).alias("_m"))
    filled = F.transform(F.col(x).cast("array<double>"), lambda v, i: F.when(v.isNull() | F.isnan(v), F.coalesce(F.col("_m")[i], F.lit(0.0))).otherwise(v))
    return df.join(F.broadcast(means)).withColumn(x, filled).drop("_m")  # one row of D means
