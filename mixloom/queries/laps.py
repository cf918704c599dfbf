"""Single laps of the fits from the true labels, and decodings under fixed weights: what SQL can follow."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from mixloom.functions.special import digamma_sql
from mixloom.models.hmm import paths, posteriors, sequences_as_rows
from mixloom.models.likelihoods import Bern, DiagGauss, Gauss
from mixloom.models.mixtures import DPMixture, FiniteMixture, Mixture
from mixloom.plans import fit as P
from mixloom.session import table

K, DIM, VAR, KAPPA, LAM, RATE = 10, 64, 0.02, 1e-4, 0.1, 2**-0.5
NU0, BETA0 = DIM + 2.0, VAR * DIM


def _rows(spark, d, dims=None):
    x = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", (x if dims is None else F.slice(x, 1, dims)).alias("x"), "label", F.lit(0).alias("batch_id"))


def _moments(spark, stats):
    rows = [(k, i, float(stats["N"][k]), float(stats["x"][k, i]), float(stats["xx"][k, i])) for k in range(len(stats["N"])) for i in range(stats["x"].shape[1])]
    df = spark.createDataFrame(rows, "component int, dim int, n double, sx double, sxx double")
    return df.withColumns({c: F.round(c, 4) for c in ("n", "sx", "sxx")})


def _dp():
    return Mixture(DPMixture(), DiagGauss(DIM, var=VAR, kappa=KAPPA))


def q_vb_lap(spark, d):
    return _moments(spark, P.fit_vb(_rows(spark, d), "vec_id", _dp(), K, laps=1, how="truth").stats)


def q_vb_lap_finite(spark, d):
    return _moments(spark, P.fit_vb(_rows(spark, d), "vec_id", Mixture(FiniteMixture(2.0), DiagGauss(DIM, var=VAR, kappa=KAPPA)), K, laps=1, how="truth").stats)


def q_memovb_lap(spark, d):
    """A memoized lap of one batch, which is a lap of VB."""
    return _moments(spark, P.fit_memovb(_rows(spark, d), "vec_id", _dp(), K, n_batches=1, laps=1, how="truth").stats)


def q_sovb_lap(spark, d):
    """The natural parameters after one stochastic step: (component, dim, kappa, x, xx)."""
    nat = P.fit_sovb(_rows(spark, d), "vec_id", _dp(), K, n_batches=1, laps=1, how="truth").params["obs"]
    rows = [(k, i, float(nat["kappa"][k]), float(nat["x"][k, i]), float(nat["xx"][k, i])) for k in range(K) for i in range(DIM)]
    return spark.createDataFrame(rows, "component int, dim int, kappa double, x double, xx double").withColumns({c: F.round(c, 4) for c in ("kappa", "x", "xx")})


def q_em_lap(spark, d):
    """One E step under the maximum-likelihood components of the true labels."""
    return _moments(spark, P.fit_em(_rows(spark, d), "vec_id", Mixture(FiniteMixture(1.0), DiagGauss(DIM, var=VAR)), K, laps=1, how="truth").stats)


def q_bern_lap(spark, d):
    signs = _rows(spark, d).withColumn("x", F.transform("x", lambda v: (v > 0).cast("double")))
    s = P.fit_vb(signs, "vec_id", Mixture(FiniteMixture(2.0), Bern(DIM, lam1=LAM, lam0=LAM)), K, laps=1, how="truth").stats
    rows = [(k, i, float(s["N"][k]), float(s["Count1"][k, i])) for k in range(K) for i in range(DIM)]
    return spark.createDataFrame(rows, "component int, dim int, n double, count1 double").withColumns({c: F.round(c, 4) for c in ("n", "count1")})


def q_gauss_stats_lap(spark, d):
    """Statistics of full-covariance components under the true labels: (component, i, j, sxx)."""
    s = P.init_stats(_rows(spark, d), "vec_id", Mixture(FiniteMixture(), Gauss(DIM)), K, how="truth")
    rows = [(k, i, j, float(s["xxT"][k, i, j])) for k in range(K) for i in range(DIM) for j in range(i, DIM)]
    return spark.createDataFrame(rows, "component int, i int, j int, sxx double").withColumn("sxx", F.round("sxx", 6))


MEANS, SPREAD, STAY = (20.0, 50.0, 80.0), 15.0, 0.8
START, TRANS = np.full(3, math.log(1 / 3)), np.log(np.where(np.eye(3) > 0, STAY, (1 - STAY) / 2))


def _score(batch):
    return -0.5 * ((batch["x"] - np.array(MEANS)) / SPREAD) ** 2


def _lines(spark, d):
    e = table(spark, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").select("user_id", "ts", "event_id", F.array("value").alias("x"))
    return sequences_as_rows(e, "user_id", ["ts", "event_id"], "x")


def q_viterbi_fixed(spark, d):
    return paths(_lines(spark, d), START, TRANS, _score)


def q_forward_backward(spark, d):
    got = posteriors(_lines(spark, d), START, TRANS, _score)
    return got.select("seq_id", "pos", *[F.round(F.get("resp", F.lit(k)), 6).alias(f"p{k}") for k in range(3)])


_E = f"WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL), l AS (SELECT vec_id, label, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS v FROM e), s AS (SELECT label AS component, dim, count(*) AS n, sum(v) AS sx, sum(v * v) AS sxx FROM l WHERE label BETWEEN 0 AND {K - 1} GROUP BY ALL), nk AS (SELECT component, max(n) AS n FROM s GROUP BY component)"
_DP = ", later AS (SELECT component, n, coalesce(sum(n) OVER (ORDER BY component ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS more FROM nk)"
_DP += f", el AS (SELECT component, {digamma_sql('(1 + n)::DOUBLE')} - {digamma_sql('(2 + n + more)::DOUBLE')} AS e1, {digamma_sql('(1 + more)::DOUBLE')} - {digamma_sql('(2 + n + more)::DOUBLE')} AS e0 FROM later)"
_DP += ", w AS (SELECT component, e1 + coalesce(sum(e0) OVER (ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS log_w FROM el)"
_FIN = f", w AS (SELECT component, {digamma_sql(f'n + {2.0 / K}')} - {digamma_sql('(SELECT sum(n) FROM nk) + 2.0::DOUBLE')} AS log_w FROM nk)"
_PO = f", p AS (SELECT component, dim, n + {NU0}::DOUBLE AS nu, n + {KAPPA}::DOUBLE AS kappa, sx / (n + {KAPPA}) AS m, {BETA0} + sxx - sx * sx / (n + {KAPPA}) AS beta FROM s)"
_PO += f", c AS (SELECT component, sum(0.5 * ({math.log(2)} - ln(beta) + {digamma_sql('nu / 2')}) - 0.5 / kappa) AS flat FROM p GROUP BY component)"
_PO += ", sc AS (SELECT l.vec_id, p.component, any_value(flat + log_w) - 0.5 * sum(nu / beta * (v - m) * (v - m)) AS score FROM l JOIN p ON p.dim = l.dim JOIN c ON c.component = p.component JOIN w ON w.component = p.component GROUP BY ALL)"
_R = ", t AS (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top FROM sc), r AS (SELECT vec_id, component, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY vec_id) AS resp FROM t)"
_Z = ", z AS (SELECT r.component, l.dim, sum(resp) AS n, sum(resp * v) AS sx, sum(resp * v * v) AS sxx FROM r JOIN l ON l.vec_id = r.vec_id GROUP BY ALL)"
_OUT = " SELECT component, dim, round(n, 4) AS n, round(sx, 4) AS sx, round(sxx, 4) AS sxx FROM z"
_EM = ", w AS (SELECT component, ln(n / (SELECT sum(n) FROM nk)::DOUBLE) AS log_w FROM nk), p AS (SELECT component, dim, sx / n AS m, greatest(sxx / n - power(sx / n, 2), 0) + 1e-8 AS var FROM s), sc AS (SELECT l.vec_id, p.component, any_value(log_w) - 0.5 * sum(ln(var) + (v - m) * (v - m) / var) AS score FROM l JOIN p ON p.dim = l.dim JOIN w ON w.component = p.component GROUP BY ALL)"
_BE = f", b AS (SELECT component, dim, n, n1 FROM (SELECT label AS component, dim, count(*) AS n, count(*) FILTER (WHERE v > 0) AS n1 FROM l WHERE label BETWEEN 0 AND {K - 1} GROUP BY ALL))"
_BE += f", p AS (SELECT component, dim, {digamma_sql(f'n1 + {LAM}')} - {digamma_sql(f'n + {2 * LAM}')} AS on_, {digamma_sql(f'n - n1 + {LAM}')} - {digamma_sql(f'n + {2 * LAM}')} AS off_ FROM b), sc AS (SELECT l.vec_id, p.component, any_value(log_w) + sum(CASE WHEN v > 0 THEN on_ ELSE off_ END) AS score FROM l JOIN p ON p.dim = l.dim JOIN w ON w.component = p.component GROUP BY ALL)"
_O = f"WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n, {', '.join(f'-0.5 * power((value - {m}) / {SPREAD}, 2) AS b{k}' for k, m in enumerate(MEANS))} FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)"
_A = TRANS.tolist()
_V = _O + f", f AS (SELECT user_id, t, {', '.join(f'b{k} + {float(START[0])!r} AS d{k}, 0 AS p{k}' for k in range(3))} FROM o WHERE t = 0 UNION ALL SELECT o.user_id, o.t, "
_V += ", ".join(f"greatest({', '.join(f'd{j} + {_A[j][k]!r}' for j in range(3))}) + b{k}, CASE WHEN d0 + {_A[0][k]!r} >= greatest(d1 + {_A[1][k]!r}, d2 + {_A[2][k]!r}) THEN 0 WHEN d1 + {_A[1][k]!r} >= d2 + {_A[2][k]!r} THEN 1 ELSE 2 END" for k in range(3))
_V += " FROM f JOIN o ON o.user_id = f.user_id AND o.t = f.t + 1), g AS (SELECT f.user_id, f.t, CASE WHEN d0 >= greatest(d1, d2) THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS state FROM f JOIN o USING (user_id, t) WHERE f.t = o.n - 1"
_V += " UNION ALL SELECT f.user_id, f.t - 1, CASE g.state WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END FROM g JOIN f ON f.user_id = g.user_id AND f.t = g.t WHERE f.t > 0) SELECT user_id AS seq_id, t::INT AS pos, state::INT AS state FROM g"
_T = [[STAY if j == k else (1 - STAY) / 2 for k in range(3)] for j in range(3)]
_F = _O + f", a AS (SELECT user_id, t, {', '.join(f'exp(b{k}) / (exp(b0) + exp(b1) + exp(b2)) AS f{k}' for k in range(3))} FROM o WHERE t = 0 UNION ALL SELECT user_id, t, u0 / (u0 + u1 + u2), u1 / (u0 + u1 + u2), u2 / (u0 + u1 + u2) FROM (SELECT o.user_id, o.t, "
_F += ", ".join(f"({' + '.join(f'f{j} * {_T[j][k]!r}' for j in range(3))}) * exp(b{k}) AS u{k}" for k in range(3)) + " FROM a JOIN o ON o.user_id = a.user_id AND o.t = a.t + 1))"
_F += ", b AS (SELECT user_id, t, 1.0::DOUBLE AS g0, 1.0::DOUBLE AS g1, 1.0::DOUBLE AS g2 FROM o WHERE t = n - 1 UNION ALL SELECT user_id, t, u0 / (u0 + u1 + u2), u1 / (u0 + u1 + u2), u2 / (u0 + u1 + u2) FROM (SELECT o.user_id, o.t - 1 AS t, "
_F += ", ".join(f"({' + '.join(f'{_T[j][k]!r} * exp(b{k}) * g{k}' for k in range(3))}) AS u{j}" for j in range(3)) + " FROM b JOIN o ON o.user_id = b.user_id AND o.t = b.t WHERE o.t > 0))"
_F += " SELECT a.user_id AS seq_id, a.t::INT AS pos, " + ", ".join(f"round(f{k} * g{k} / (f0 * g0 + f1 * g1 + f2 * g2), 6) AS p{k}" for k in range(3)) + " FROM a JOIN b USING (user_id, t)"

SQL = {
    "q_vb_lap": _E + _DP + _PO + _R + _Z + _OUT,
    "q_vb_lap_finite": _E + _FIN + _PO + _R + _Z + _OUT,
    "q_memovb_lap": _E + _DP + _PO + _R + _Z + _OUT,
    "q_sovb_lap": _E + _DP + _PO + _R + _Z + f" SELECT component, dim, round({KAPPA} + (1 - {RATE!r}) * s.n + {RATE!r} * z.n, 4) AS kappa, round((1 - {RATE!r}) * s.sx + {RATE!r} * z.sx, 4) AS x, round({BETA0} + (1 - {RATE!r}) * s.sxx + {RATE!r} * z.sxx, 4) AS xx FROM s JOIN z USING (component, dim)",
    "q_em_lap": _E + _EM + _R + _Z + _OUT,
    "q_bern_lap": _E + _FIN + _BE + _R + ", z AS (SELECT r.component, l.dim, sum(resp) AS n, sum(CASE WHEN v > 0 THEN resp ELSE 0 END) AS count1 FROM r JOIN l ON l.vec_id = r.vec_id GROUP BY ALL) SELECT component, dim, round(n, 4) AS n, round(count1, 4) AS count1 FROM z",
    "q_gauss_stats_lap": _E + f" SELECT a.label AS component, a.dim AS i, b.dim AS j, round(sum(a.v * b.v), 6) AS sxx FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.dim <= b.dim WHERE a.label BETWEEN 0 AND {K - 1} GROUP BY ALL",
    "q_viterbi_fixed": _V,
    "q_forward_backward": _F,
}
QUERIES = {k: globals()[k] for k in SQL}
