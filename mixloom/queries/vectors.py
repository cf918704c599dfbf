"""Queries over dense vectors (``embeddings``) and regression rows (``lineitem``)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from mixloom.functions import numeric
from mixloom.functions.special import digamma_sql
from mixloom.operators import vectors as V
from mixloom.session import table

NU0, KAPPA0, M0, BETA0 = 66.0, 1e-4, 0.0, 1.0
COLS = {"nu0": NU0, "kappa0": KAPPA0, "m0": M0, "beta0": BETA0}


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _rounded(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _post(spark, d):
    return V.diag_posterior(V.diag_stats(_emb(spark, d), "label", "embedding"), "label", **COLS)


def _weights(spark, d):
    emb = _emb(spark, d)
    n = emb.agg(F.count("label").alias("t"))
    return emb.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(n)).select("label", F.ln(F.col("n") / F.col("t")).alias("log_w"))


def _scores(spark, d):
    comps = V.diag_components(_post(spark, d), "label", _weights(spark, d))
    return V.scored(_emb(spark, d), "embedding", comps, "label", keep=["vec_id"])


def q_diag_suffstats(spark, d):
    return _rounded(V.diag_stats(_emb(spark, d), "label", "embedding"), "sx", "sxx")


def q_gauss_full_suffstats(spark, d):
    return _rounded(V.full_stats(_emb(spark, d), "label", "embedding"), "sxx")


def q_diag_posterior(spark, d):
    return _rounded(_post(spark, d), "kappa", "m", "beta")


def q_diag_score(spark, d):
    return _rounded(V.long_form(_scores(spark, d), "score", "vec_id"), "score", n=4)


def q_diag_resp(spark, d):
    return _rounded(V.long_form(V.responsibilities(_scores(spark, d)), "resp", "vec_id"), "resp")


def q_log_evidence(spark, d):
    return _scores(spark, d).select("vec_id", F.round(numeric.log_sum_exp_col(F.col("score")), 4).alias("evidence"))


def q_topL_resp(spark, d):
    top = V.responsibilities(_scores(spark, d)).select("vec_id", "labels", F.posexplode(numeric.top_l_col(F.col("resp"), 3)).alias("rank", "e"))
    return top.select("vec_id", "rank", F.get("labels", F.col("e.k")).alias("label"), F.round("e.r", 6).alias("r"))


def q_resp_entropy(spark, d):
    return _rounded(V.resp_entropy(V.responsibilities(_scores(spark, d))), "n", "entropy")


def q_em_one_lap(spark, d):
    comps = V.diag_components(_post(spark, d), "label", _weights(spark, d))
    resp = V.responsibilities(V.scored(_emb(spark, d), "embedding", comps, "label", keep=["vec_id", "embedding"]))
    s = V.soft_stats(resp, "embedding")
    return s.select("label", "dim", F.round("n", 6).alias("n"), F.round(F.col("sx") / F.col("n"), 6).alias("mu"), F.round(F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2), 6).alias("var"))


def q_nearest_centroid(spark, d):
    emb = _emb(spark, d)
    return _rounded(V.nearest(emb, "embedding", V.centroids(emb, "label", "embedding"), "label", keep=["vec_id"]), "distance")


def q_kmeans_step(spark, d):
    emb = _emb(spark, d)
    near = V.nearest(emb, "embedding", V.centroids(emb, "label", "embedding"), "label", keep=["vec_id", "embedding"])
    s = V.diag_stats(near, "nearest", "embedding")
    return s.select(F.col("nearest").alias("label"), "dim", "n", F.round(F.col("sx") / F.col("n"), 6).alias("mean"))


def q_bregman_diag(spark, d):
    emb = _emb(spark, d)
    s = V.diag_stats(emb, "label", "embedding")
    smooth = s.select("label", "dim", ((F.col("sx") + KAPPA0 * M0) / (F.col("n") + KAPPA0)).alias("m"), ((F.col("sxx") + BETA0) / (F.col("n") + 1) - F.pow((F.col("sx") + KAPPA0 * M0) / (F.col("n") + KAPPA0), 2)).alias("var"))
    arr = V.as_arrays(smooth.withColumn("prec", 1 / F.col("var")).withColumn("half", 0.5 * F.ln("var")), "label", "m", "prec", "half")
    comps = arr.select("label", "m", "prec", (-numeric.array_total(F.col("half"))).alias("const"))
    div = V.scored(emb, "embedding", comps, "label", keep=["vec_id"])
    return V.long_form(div, "score", "vec_id").select("vec_id", "label", F.round(-F.col("score"), 4).alias("divergence"))


def q_regress_suffstats(spark, d):
    s = V.regression_stats(table(spark, d, "lineitem"), "l_returnflag", [F.col("l_quantity") / 10, F.col("l_discount")], F.col("l_extendedprice") / 1e5)
    return _rounded(s, "value", n=4)


def q_sigmoid(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(numeric.sigmoid_col((F.col("value") - 50) / 10), 6).alias("p"))


_E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), l AS (SELECT vec_id, label, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS v FROM e), s AS (SELECT label, dim, count(v) AS n, sum(v) AS sx, sum(v * v) AS sxx FROM l WHERE label IS NOT NULL GROUP BY label, dim)"
_P = _E + f", p AS (SELECT label, dim, n + {NU0}::DOUBLE AS nu, n + {KAPPA0}::DOUBLE AS kappa, (sx + {KAPPA0 * M0}) / (n + {KAPPA0}) AS m, {BETA0} + sxx + {KAPPA0 * M0 * M0} - (n + {KAPPA0}) * power((sx + {KAPPA0 * M0}) / (n + {KAPPA0}), 2) AS beta FROM s)"
_SC = _P + f""", w AS (SELECT label, ln(count(*) / (SELECT count(label) FROM embeddings)::DOUBLE) AS log_w FROM embeddings WHERE label IS NOT NULL GROUP BY label),
 k AS (SELECT p.label, any_value(log_w) AS log_w, sum({-0.5 * math.log(2 * math.pi)} + 0.5 * ({math.log(2.0)} - ln(beta) + {digamma_sql('nu / 2')}) - 0.5 / kappa) AS flat FROM p JOIN w USING (label) GROUP BY p.label),
 sc AS (SELECT l.vec_id, p.label, any_value(flat + log_w) - 0.5 * sum(nu / beta * (v - m) * (v - m)) AS score FROM l JOIN p ON p.dim = l.dim JOIN k ON k.label = p.label GROUP BY l.vec_id, p.label),
 ev AS (SELECT vec_id, max(score) + ln(sum(exp(score - top))) AS evidence FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top FROM sc) GROUP BY vec_id),
 r AS (SELECT vec_id, label, greatest(exp(score - evidence), 1e-40) AS resp FROM sc JOIN ev USING (vec_id))"""
_C = _E + ", c AS (SELECT label, dim, avg(v) AS m FROM l WHERE label IS NOT NULL GROUP BY label, dim), dd AS (SELECT l.vec_id, c.label, sum((v - m) * (v - m)) AS distance FROM l JOIN c USING (dim) GROUP BY l.vec_id, c.label), nr AS (SELECT vec_id, label AS nearest, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS k FROM dd) WHERE k = 1)"
_C = _C.replace("l JOIN c USING (dim)", "l JOIN c ON c.dim = l.dim")
_REG = "SELECT l_returnflag, l_quantity / 10 AS a, l_discount AS b, 1.0::DOUBLE AS c, l_extendedprice / 1e5 AS y FROM lineitem WHERE l_returnflag IS NOT NULL"
_REG_CELLS = [("xx", i, j, f"{p} * {q}") for i, p in enumerate("abc") for j, q in enumerate("abc") if j >= i] + [("yx", i, -1, f"y * {p}") for i, p in enumerate("abc")] + [("yy", -1, -1, "y * y")]

SQL = {
    "q_diag_suffstats": _E + " SELECT label, dim, n, round(sx, 6) AS sx, round(sxx, 6) AS sxx FROM s",
    "q_gauss_full_suffstats": _E + " SELECT a.label, a.dim AS i, b.dim AS j, count(*) AS n, round(sum(a.v * b.v), 6) AS sxx FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.dim <= b.dim WHERE a.label IS NOT NULL GROUP BY ALL",
    "q_diag_posterior": _P + " SELECT label, dim, nu, round(kappa, 6) AS kappa, round(m, 6) AS m, round(beta, 6) AS beta FROM p",
    "q_diag_score": _SC + " SELECT vec_id, label, round(score, 4) AS score FROM sc",
    "q_diag_resp": _SC + " SELECT vec_id, label, round(resp, 6) AS resp FROM r",
    "q_log_evidence": _SC + " SELECT vec_id, round(evidence, 4) AS evidence FROM ev",
    "q_topL_resp": _SC + ", t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY resp DESC, label) - 1 AS rank FROM r) SELECT vec_id, rank, label, round(resp / sum(resp) OVER (PARTITION BY vec_id), 6) AS r FROM t WHERE rank < 3",
    "q_resp_entropy": _SC + " SELECT label, round(sum(resp), 6) AS n, round(sum(-resp * ln(resp)), 6) AS entropy FROM r GROUP BY label",
    "q_em_one_lap": _SC + ", z AS (SELECT r.label, l.dim, sum(resp) AS n, sum(resp * v) AS sx, sum(resp * v * v) AS sxx FROM r JOIN l ON l.vec_id = r.vec_id GROUP BY r.label, l.dim) SELECT label, dim, round(n, 6) AS n, round(sx / n, 6) AS mu, round(sxx / n - power(sx / n, 2), 6) AS var FROM z",
    "q_nearest_centroid": _C + " SELECT vec_id, nearest, round(distance, 6) AS distance FROM nr",
    "q_kmeans_step": _C + " SELECT nearest AS label, l.dim, count(*) AS n, round(sum(v) / count(*), 6) AS mean FROM l JOIN nr ON nr.vec_id = l.vec_id GROUP BY nearest, l.dim",
    "q_bregman_diag": _E + f", b AS (SELECT label, dim, (sx + {KAPPA0 * M0}) / (n + {KAPPA0}) AS m, (sxx + {BETA0}) / (n + 1) - power((sx + {KAPPA0 * M0}) / (n + {KAPPA0}), 2) AS var FROM s) SELECT l.vec_id, b.label, round(sum(0.5 * ln(var) + 0.5 * (v - m) * (v - m) / var), 4) AS divergence FROM l JOIN b ON b.dim = l.dim GROUP BY l.vec_id, b.label",
    "q_regress_suffstats": f"WITH r AS ({_REG}) " + " UNION ALL ".join(f"SELECT l_returnflag, '{p}' AS part, {i} AS i, {j} AS j, round(sum({v}), 4) AS value FROM r GROUP BY l_returnflag" for p, i, j, v in _REG_CELLS),
    "q_sigmoid": "SELECT event_id, round(least(greatest(1 / (1 + exp(-(value - 50) / 10)), 1e-8), 1 - 1e-8), 6) AS p FROM events",
}
QUERIES = {k: globals()[k] for k in SQL}
