"""Normalisation, entropy, sigmoid and stick-breaking: Column forms over arrays, and numpy forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RESP_FLOOR = 1e-40
SIGMOID_EDGE = 1e-8


def array_total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def log_sum_exp_col(scores: Column) -> Column:
    """log(sum(exp(scores))) of an ARRAY<DOUBLE>, safe for large values."""
    top = F.array_max(scores)
    return top + F.ln(F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def exp_normalise_col(scores: Column, floor: float = RESP_FLOOR) -> Column:
    """Softmax of an ARRAY<DOUBLE>; values below ``floor`` are raised to it after normalising."""
    norm = log_sum_exp_col(scores)
    return F.transform(scores, lambda v: F.greatest(F.exp(v - norm), F.lit(floor)))


def argmax_col(a: Column) -> Column:
    """0-based place of the largest value; the first on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_l_col(resp: Column, n: int) -> Column:
    """The ``n`` largest entries as ARRAY<STRUCT<k, r>>, renormalised, largest first, lower k first on ties."""
    pairs = F.transform(resp, lambda v, i: F.struct((-v).alias("neg"), i.alias("k")))
    top = F.slice(F.array_sort(pairs), 1, n)
    total = F.aggregate(top, F.lit(0.0), lambda s, e: s - e["neg"])
    return F.transform(top, lambda e: F.struct(e["k"].cast("int").alias("k"), (-e["neg"] / total).alias("r")))


def entropy_col(r: Column) -> Column:
    """-r ln r, 0 at 0."""
    return F.when(r > 0, -r * F.ln(r)).otherwise(F.lit(0.0))


def sigmoid_col(x: Column) -> Column:
    """Logistic function, kept inside [1e-8, 1 - 1e-8]."""
    return F.least(F.greatest(1.0 / (1.0 + F.exp(-x)), F.lit(SIGMOID_EDGE)), F.lit(1 - SIGMOID_EDGE))


def log_sum_exp(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=1, keepdims=True)
    return top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))


def exp_normalise(scores: np.ndarray, floor: float = RESP_FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """(responsibilities, log evidence) of each row."""
    norm = log_sum_exp(scores)
    return np.maximum(np.exp(scores - norm[:, None]), floor), norm


def top_l(resp: np.ndarray, n: int) -> np.ndarray:
    """Rows with all but the ``n`` largest entries zeroed, renormalised; lower index first on ties."""
    if n >= resp.shape[1]:
        return resp
    keep = np.argsort(-resp, axis=1, kind="stable")[:, :n]
    out = np.zeros_like(resp)
    np.put_along_axis(out, keep, np.take_along_axis(resp, keep, 1), 1)
    return out / out.sum(axis=1, keepdims=True)


def r_log_r(resp: np.ndarray) -> np.ndarray:
    """Column sums of -r ln r."""
    safe = np.where(resp > 0, resp, 1.0)
    return -(resp * np.log(safe)).sum(axis=0)


def sigmoid(x):
    return np.clip(1 / (1 + np.exp(-np.asarray(x, float))), SIGMOID_EDGE, 1 - SIGMOID_EDGE)


def inv_sigmoid(p):
    p = np.clip(np.asarray(p, float), SIGMOID_EDGE, 1 - SIGMOID_EDGE)
    return np.log(p) - np.log1p(-p)


def stick_to_weights(rho: np.ndarray) -> np.ndarray:
    """K sticks to K + 1 weights, the last being what is left."""
    rho = np.asarray(rho, float)
    left = np.concatenate(([1.0], np.cumprod(1 - rho)))
    return np.append(rho, 1.0) * left


def weights_to_stick(beta: np.ndarray) -> np.ndarray:
    """The inverse of ``stick_to_weights`` for K + 1 weights."""
    beta = np.asarray(beta, float)
    left = 1 - np.concatenate(([0.0], np.cumsum(beta[:-1])[:-1]))
    return np.clip(beta[:-1] / np.maximum(left, 1e-300), SIGMOID_EDGE, 1 - SIGMOID_EDGE)


def greater_than_counts(n: np.ndarray) -> np.ndarray:
    """For each component the count of all later components."""
    n = np.asarray(n, float)
    return np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)


def big_to_small(*keys) -> np.ndarray:
    """Order by descending keys, the first being the major; stable on ties."""
    return np.lexsort([-np.asarray(k, float) for k in reversed(keys)])
