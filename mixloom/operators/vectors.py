"""Dense vectors: hard-label statistics, posteriors, scores, responsibilities, centroids.

Parameters of all K components travel as one broadcast row of arrays (K * D numbers, checked
by ``MAX_PARAMETERS``); rows are scored by array expressions inside the projection, so no
K-fold copy of the data and no shuffle arises before the K-row aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.functions.numeric import argmax_col, array_total, entropy_col, exp_normalise_col
from mixloom.functions.special import digamma_col

MAX_PARAMETERS = 20_000_000


def doubles(x: str) -> Column:
    return F.col(x).cast("array<double>")


def by_dimension(df: DataFrame, x: str, *keep: str) -> DataFrame:
    """One row per entry: (*keep, dim, v)."""
    return df.select(*keep, F.posexplode(doubles(x)).alias("dim", "v"))


def _matrices(rows):
    """(places, values, known) of the rows of an Arrow list column, per length of row; nulls are 0 and not known."""
    import numpy as np

    ends, flat = rows.offsets.to_numpy() - rows.offsets[0].as_py(), rows.flatten()
    values, known = flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(ends)
    for d in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == d)
        places = ends[own][:, None] + np.arange(d)
        yield own, values[places], known[places]


def diag_stats(df: DataFrame, label: str, x: str) -> DataFrame:
    """(label, dim, n, sx, sxx): additive. Sums are taken per label in each batch of rows, so no row
    is taken apart; null entries count for nothing."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            coded = batch.column("label").dictionary_encode()
            codes = coded.indices.to_numpy()
            for own, v, w in _matrices(batch.column("x")):
                order = np.argsort(codes[own], kind="stable")
                mine = codes[own][order]
                first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                n, sx, sxx = (np.add.reduceat(m[order], first, axis=0) for m in (w, v, v * v))
                d = v.shape[1]
                names = coded.dictionary.take(pa.array(np.repeat(mine[first], d)))
                yield pa.record_batch({"label": names, "dim": pa.array(np.tile(np.arange(d, dtype=np.int32), len(first))), "n": pa.array(n.ravel().astype(np.int64)), "sx": pa.array(sx.ravel()), "sxx": pa.array(sxx.ravel())})

    rows = df.where(F.col(label).isNotNull() & F.col(x).isNotNull()).select(F.col(label).alias("label"), doubles(x).alias("x"))
    parts = rows.mapInArrow(sums, f"label {df.schema[label].dataType.simpleString()}, dim int, n bigint, sx double, sxx double")
    return parts.groupBy(F.col("label").alias(label), "dim").agg(F.sum("n").alias("n"), F.when(F.sum("n") > 0, F.sum("sx")).alias("sx"), F.when(F.sum("n") > 0, F.sum("sxx")).alias("sxx"))


def full_stats(df: DataFrame, label: str, x: str, block: int = 4_000_000) -> DataFrame:
    """(label, i, j, n, sxx) for all i <= j: entries of sum x x^T.

    Outer products are summed per label in each partition, by matrix products of its batches, so one
    matrix per label and partition is shuffled. Entries with a null count for no pair."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            labels, rows = batch.column("label"), batch.column("x")
            ends, flat = rows.offsets.to_numpy() - rows.offsets[0].as_py(), rows.flatten()
            values, known = flat.fill_null(0.0).to_numpy(), flat.is_valid().to_numpy(zero_copy_only=False).astype(float)
            size, coded = np.diff(ends), labels.dictionary_encode()
            codes = coded.indices.to_numpy()
            for k, d in {(int(k), int(d)) for k, d in zip(codes, size) if d}:
                own = np.flatnonzero((codes == k) & (size == d))
                for at in np.array_split(own, -(-len(own) * d // block)):
                    places = ends[at][:, None] + np.arange(d)
                    v, w = values[places], known[places]
                    n, sxx = total.get((coded.dictionary[k].as_py(), d), (0.0, 0.0))
                    total[coded.dictionary[k].as_py(), d] = n + w.T @ w, sxx + v.T @ v
        for (name, d), (n, sxx) in total.items():
            i, j = np.triu_indices(d)
            yield pa.record_batch({"label": pa.array([name] * len(i), kind), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(n[i, j].astype(np.int64)), "sxx": pa.array(sxx[i, j])})

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[label].dataType)
    rows = df.where(F.col(label).isNotNull() & F.col(x).isNotNull()).select(F.col(label).alias("label"), doubles(x).alias("x"))
    parts = rows.mapInArrow(sums, f"label {df.schema[label].dataType.simpleString()}, i int, j int, n bigint, sxx double")
    return parts.where("n > 0").groupBy(F.col("label").alias(label), "i", "j").agg(F.sum("n").alias("n"), F.sum("sxx").alias("sxx"))


def diag_posterior(stats: DataFrame, label: str, *, nu0: float, kappa0: float, m0: float, beta0: float) -> DataFrame:
    """Normal-Gamma posterior per label and dimension: (label, dim, nu, kappa, m, beta)."""
    kappa = F.col("n") + kappa0
    m = (F.col("sx") + kappa0 * m0) / kappa
    beta = F.lit(beta0) + F.col("sxx") + kappa0 * m0 * m0 - kappa * m * m
    return stats.select(label, "dim", (F.col("n") + nu0).alias("nu"), kappa.alias("kappa"), m.alias("m"), beta.alias("beta"))


def as_arrays(params: DataFrame, label: str, *columns: str) -> DataFrame:
    """Per label one array per column, by dimension."""
    rows = F.array_sort(F.collect_list(F.struct("dim", *columns)))
    packed = params.groupBy(label).agg(rows.alias("_p"))
    return packed.select(label, *[F.col("_p").getField(c).alias(c) for c in columns])


def diag_components(post: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """Per label (label, m, prec, const): E[log w] plus the row-independent part of the score.

    ``weights`` is (label, log_w); prec is nu / beta per dimension.
    """
    arrays = as_arrays(post.withColumn("prec", F.col("nu") / F.col("beta")).withColumn("elog", F.lit(math.log(2.0)) - F.ln("beta") + digamma_col(F.col("nu") / 2)), label, "m", "prec", "elog", "kappa")
    flat = F.lit(-0.5 * math.log(2 * math.pi)) * F.size("m") + 0.5 * array_total(F.col("elog")) - 0.5 * array_total(F.transform("kappa", lambda k: 1.0 / k))
    return arrays.join(weights, label).select(label, "m", "prec", (flat + F.col("log_w")).alias("const"))


def one_row(components: DataFrame, label: str) -> DataFrame:
    """All components as a single row of an array, ordered by label."""
    return components.agg(F.array_sort(F.collect_list(F.struct(label, *[c for c in components.columns if c != label]))).alias("comps"))


def scored(df: DataFrame, x: str, components: DataFrame, label: str, *, keep: list[str]) -> DataFrame:
    """(*keep, labels, score): scores of each row under all components, aligned with ``labels``.

    The components form one broadcast row, so this is a projection of the scan."""
    dist = lambda c: F.aggregate(F.arrays_zip(F.col("_x"), c["m"].alias("m"), c["prec"].alias("prec")), F.lit(0.0), lambda s, e: s + e["prec"] * (e["_x"] - e["m"]) * (e["_x"] - e["m"]))
    rows = df.select(*keep, doubles(x).alias("_x")).join(F.broadcast(one_row(components, label)))
    return rows.select(*keep, F.transform("comps", lambda c: c[label]).alias("labels"), F.transform("comps", lambda c: c["const"] - 0.5 * dist(c)).alias("score"))


def responsibilities(scores: DataFrame) -> DataFrame:
    return scores.withColumn("resp", exp_normalise_col(F.col("score")))


def long_form(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """One row per (row, component): (*keep, label, value)."""
    return df.select(*keep, F.inline(F.arrays_zip(F.col("labels").alias("k"), F.col(value).alias("v")))).select(*keep, F.col("k").alias("label"), F.col("v").alias(value))


def centroids(df: DataFrame, label: str, x: str) -> DataFrame:
    """(label, m): mean vector per label."""
    mean = by_dimension(df.where(F.col(label).isNotNull()), x, label).groupBy(label, "dim").agg(F.avg("v").alias("m"))
    return as_arrays(mean, label, "m")


def nearest(df: DataFrame, x: str, centres: DataFrame, label: str, *, keep: list[str]) -> DataFrame:
    """(*keep, nearest, distance): closest centre by squared distance, lowest label on ties."""
    sq = lambda c: F.aggregate(F.zip_with("_x", c["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    rows = df.select(*keep, doubles(x).alias("_x")).join(F.broadcast(one_row(centres, label)))
    d = rows.withColumn("_d", F.transform("comps", lambda c: -sq(c)))
    return d.select(*keep, F.get(F.transform("comps", lambda c: c[label]), argmax_col(F.col("_d"))).alias("nearest"), (-F.array_max("_d")).alias("distance"))


def soft_stats(resp: DataFrame, x: str) -> DataFrame:
    """(label, dim, n, sx, sxx) weighted by responsibilities; ``resp`` has labels (the same in every
    row), resp and ``x``. Sums are matrix products of batches; null entries of x add to n only."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("labels").slice(0, 1).flatten()
            r = batch.column("resp").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names))
            for own, v, _ in _matrices(batch.column("x")):
                d, k = v.shape[1], len(names)
                n, sx, sxx = np.repeat(r[own].sum(0), d), r[own].T @ v, r[own].T @ (v * v)
                yield pa.record_batch({"label": names.take(pa.array(np.repeat(np.arange(k), d))), "dim": pa.array(np.tile(np.arange(d, dtype=np.int32), k)), "n": pa.array(n), "sx": pa.array(sx.ravel()), "sxx": pa.array(sxx.ravel())})

    kind = resp.schema["labels"].dataType.elementType.simpleString()
    parts = resp.where(F.col(x).isNotNull()).select("labels", "resp", doubles(x).alias("x")).mapInArrow(sums, f"label {kind}, dim int, n double, sx double, sxx double")
    return parts.groupBy("label", "dim").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx")])


def resp_entropy(resp: DataFrame) -> DataFrame:
    """(label, n, entropy): sums of r and of -r ln r."""
    return long_form(resp, "resp").groupBy("label").agg(F.sum("resp").alias("n"), F.sum(entropy_col(F.col("resp"))).alias("entropy"))


def regression_stats(df: DataFrame, label: str, xs: list[Column], y: Column) -> DataFrame:
    """(label, i, j, xx) of sum x x^T over x with a trailing 1, and (label, i, yx), (label, yy), as one
    long table (label, part, i, j, value)."""
    x = [c.cast("double") for c in xs] + [F.lit(1.0)]
    cells = [("xx", i, j, x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))] + [("yx", i, -1, y * x[i]) for i in range(len(x))] + [("yy", -1, -1, y * y)]
    sums = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.sum(v).alias(f"{p}_{i}_{j}") for p, i, j, v in cells])
    rows = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{p}_{i}_{j}").alias("value")) for p, i, j, _ in cells])
    return sums.select(label, F.inline(rows))
