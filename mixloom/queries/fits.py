"""Iterative fits as queries: one row per lap, component, or item. SQL follows single laps only (``laps``); tests hold the rest."""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
from pyspark.sql import functions as F

from mixloom.functions.optimize import hungarian
from mixloom.models.hmm import HMM, decode, fit_hmm, sequences_as_rows
from mixloom.models.likelihoods import AutoRegGauss, Bern, DiagGauss, Gauss, GaussRegress, Joint, ZeroMeanGauss
from mixloom.models.mixtures import DPMixture, FiniteMixture, Mixture
from mixloom.models.relational import BlockModel, fit_blocks
from mixloom.models.topics import GroupTopicModel, TopicModel, documents_as_rows, fit_group_topics, fit_topics, heldout_scores, topic_correlations
from mixloom.operators import datasets as D
from mixloom.operators import graph as G
from mixloom.operators.bow import owner_by_range
from mixloom.plans import fit as P
from mixloom.plans.grow import fit_grow
from mixloom.queries.structure import _edges
from mixloom.sources.readers import fill_missing
from mixloom.session import bounded_rows, checkpoint_dir, cut, spread, table


def _vectors(spark, d, batches=4):
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return spread(D.with_batches(e, "vec_id", batches), "vec_id")


def _trace(spark, result):
    rows = [(i, float(t["lap"]), round(float(t["loss"]), 8), int(t["k"])) for i, t in enumerate(result.trace)]
    return spark.createDataFrame(rows, "step int, lap double, loss double, k int")


def _dp():
    return Mixture(DPMixture(), DiagGauss(64, var=0.02))


def q_dp_vb_fit(spark, d):
    return _trace(spark, P.fit_vb(_vectors(spark, d), "vec_id", _dp(), 6, laps=8, how="randexamplesbydist"))


def q_em_fit(spark, d):
    return _trace(spark, P.fit_em(_vectors(spark, d), "vec_id", Mixture(FiniteMixture(10.0), DiagGauss(64, var=0.02)), 6, laps=6))


def q_gauss_vb_fit(spark, d):
    return _trace(spark, P.fit_vb(_vectors(spark, d), "vec_id", Mixture(FiniteMixture(), Gauss(64, cov=0.02)), 4, laps=5, how="kmeans"))


def q_zero_mean_fit(spark, d):
    return _trace(spark, P.fit_vb(_vectors(spark, d), "vec_id", Mixture(DPMixture(), ZeroMeanGauss(64, cov=0.02)), 4, laps=5, how="contigblocks"))


def q_bern_fit(spark, d):
    signs = _vectors(spark, d).withColumn("x", F.transform("x", lambda v: (v > 0).cast("double")))
    return _trace(spark, P.fit_vb(signs, "vec_id", Mixture(DPMixture(), Bern(64)), 5, laps=6))


def q_sovb_fit(spark, d):
    return _trace(spark, P.fit_sovb(D.stored_batches(_vectors(spark, d)), "vec_id", _dp(), 6, n_batches=4, laps=2))


def q_memovb_fit(spark, d):
    return _trace(spark, P.fit_memovb(D.stored_batches(_vectors(spark, d)), "vec_id", _dp(), 6, n_batches=4, laps=3))


def q_memovb_moves(spark, d):
    r = P.fit_memovb(_vectors(spark, d), "vec_id", _dp(), 8, n_batches=4, laps=4, moves=P.Moves(merge=True, delete=True, birth=True, shuffle=True))
    rows = [(int(m["lap"]), m["move"], bool(m["accepted"]), ",".join(map(str, m.get("uids", ())))) for m in r.moves]
    return spark.createDataFrame(rows, "lap int, move string, accepted boolean, uids string")


def q_mixture_assign(spark, d):
    e, model = _vectors(spark, d), _dp()
    return P.assign(e, "vec_id", model, P.fit_vb(e, "vec_id", model, 6, laps=4, how="kmeans").params)


def _regress_rows(spark, d):
    li = table(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), F.array((F.col("l_quantity") - 25) / 15, (F.col("l_discount") - 0.05) * 30).alias("x"), (F.col("l_extendedprice") / 5e4 - 1).alias("y"))
    return spread(li, "id"), Mixture(DPMixture(), Joint(x=DiagGauss(2), y=GaussRegress(2)))


def q_regress_fit(spark, d):
    rows, model = _regress_rows(spark, d)
    return _trace(spark, P.fit_vb(rows, "id", model, 4, laps=4))


def q_regress_predict(spark, d):
    """Mean squared error of the prediction, next to that of the mean, over all rows."""
    rows, model = _regress_rows(spark, d)
    found = P.predict(rows, "id", model, P.fit_vb(rows, "id", model, 4, laps=3).params)
    both = rows.select("id", "y").join(found.select("id", "y_hat"), "id")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("y") - F.col("y_hat")) ** 2).alias("mse"), F.var_pop("y").alias("mse_of_mean"))


def q_topic_correlations(spark, d):
    docs, v = _bag_rows(spark, d)
    c = topic_correlations(fit_topics(docs, TopicModel(v), 5, laps=3).stats)
    return spark.createDataFrame([(a, b, float(c[a, b])) for a in range(5) for b in range(a + 1, 5)], "topic_a int, topic_b int, correlation double")


def _bag_rows(spark, d):
    good = table(spark, d, "bow_tokens").where("token_pos IS NOT NULL AND word_id IS NOT NULL AND word_count > 0 AND NOT isnan(word_count)")
    b = cut(good.groupBy("token_pos").agg(*[F.min(c).alias(c) for c in ("doc_id", "word_id", "word_count")]))
    lost = b.where("doc_id IS NULL").drop("doc_id")  # an entry without its document is that of the range that holds it
    owned = lost.join(owner_by_range(lost, table(spark, d, "bow_docs")), "token_pos").withColumnRenamed("owner", "doc_id")
    b = b.where("doc_id IS NOT NULL").unionByName(owned)
    b = b.join(table(spark, d, "vocab").select("word_id").distinct(), "word_id", "left_semi")
    v = table(spark, d, "vocab").agg(F.max("word_id")).first()[0] + 1
    bag = b.groupBy("doc_id", "word_id").agg(F.sum("word_count").alias("word_count"))
    return spread(D.with_batches(documents_as_rows(bag), "doc_id", 3), "doc_id"), v


def q_mult_mixture_fit(spark, d):
    from mixloom.models.likelihoods import Mult

    docs, v = _bag_rows(spark, d)
    return _trace(spark, P.fit_vb(docs, "doc_id", Mixture(DPMixture(), Mult(v)), 5, laps=4))


def q_gibbs_fit(spark, d):
    return _trace(spark, P.fit_gibbs(_vectors(spark, d), "vec_id", _dp(), 5, sweeps=3))


def q_group_topics_fit(spark, d):
    groups = _sequences(spark, d)
    return _trace(spark, fit_group_topics(groups, GroupTopicModel(DiagGauss(12, var=4.0), hdp=True), 5, laps=4))


def q_lda_fit(spark, d):
    docs, v = _bag_rows(spark, d)
    return _trace(spark, fit_topics(docs, TopicModel(v), 6, laps=4))


def q_hdp_topic_fit(spark, d):
    docs, v = _bag_rows(spark, d)
    return _trace(spark, fit_topics(docs, TopicModel(v, hdp=True, restarts=1), 6, alg="memovb", laps=2, n_batches=3))


def q_sovb_topics(spark, d):
    docs, v = _bag_rows(spark, d)
    return _trace(spark, fit_topics(docs, TopicModel(v), 6, alg="sovb", laps=1, n_batches=3))


def q_heldout_topics(spark, d):
    docs, v = _bag_rows(spark, d)
    model = TopicModel(v, hdp=True)
    params = fit_topics(docs, model, 6, laps=3).params
    odd = lambda c: F.filter(c, lambda _, i: i % 2 == 1)
    even = lambda c: F.filter(c, lambda _, i: i % 2 == 0)
    halves = docs.select("doc_id", even(F.col("ids")).alias("ids"), even(F.col("counts")).alias("counts"), odd(F.col("ids")).alias("test_ids"), odd(F.col("counts")).alias("test_counts"))
    s = heldout_scores(halves, model, params)
    return s.agg(F.count("*").alias("n_docs"), F.avg("loglik").alias("loglik"), F.avg("auc").alias("auc"), F.avg("r_precision").alias("r_precision"), F.percentile("k_active", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("k_active"))


def _sequences(spark, d, history=False):
    b = table(spark, d, "blocks_per_seq").where("seq_id IS NOT NULL AND pos IS NOT NULL AND x IS NOT NULL")
    one = b.groupBy("seq_id", "pos").agg(F.max_by("x", "received_at").alias("x"))
    return spread(D.with_batches(sequences_as_rows(fill_missing(one, "x"), "seq_id", ["pos"], "x", history=history), "seq_id", 3), "seq_id")


def q_hmm_fit(spark, d):
    return _trace(spark, fit_hmm(_sequences(spark, d), HMM(DiagGauss(12, var=4.0), kappa=1.0), 5, laps=5))


def q_hdphmm_fit(spark, d):
    return _trace(spark, fit_hmm(_sequences(spark, d), HMM(Gauss(12, cov=4.0), hdp=True), 5, alg="memovb", laps=2, n_batches=3))


def q_ar_hmm_fit(spark, d):
    return _trace(spark, fit_hmm(_sequences(spark, d, True), HMM(AutoRegGauss(12, cov=4.0)), 4, laps=4))


def _moves(spark, result):
    rows = [(int(m["lap"]), m["move"], m["accepted"], ",".join(map(str, m["uids"]))) for m in result.moves]
    return spark.createDataFrame(rows, "lap int, move string, accepted boolean, uids string")


def q_topic_moves(spark, d):
    docs, v = _bag_rows(spark, d)
    model = TopicModel(v, hdp=True)
    return _moves(spark, fit_grow(docs, model, fit_topics(docs, model, 4, laps=2), laps=2))


def q_hmm_moves(spark, d):
    seqs, model = _sequences(spark, d), HMM(DiagGauss(12, var=4.0), hdp=True)
    return _moves(spark, fit_grow(seqs, model, fit_hmm(seqs, model, 4, laps=2), laps=2))


def q_viterbi(spark, d):
    seqs, model = _sequences(spark, d), HMM(DiagGauss(12, var=4.0), kappa=1.0)
    return decode(seqs, model, fit_hmm(seqs, model, 5, laps=3).params)


def q_hungarian(spark, d):
    e, model = _vectors(spark, d), _dp()
    found = P.assign(e, "vec_id", model, P.fit_vb(e, "vec_id", model, 8, laps=4, how="kmeans").params)
    pairs = found.join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").where("label IS NOT NULL").groupBy("label", "component").agg(F.count("*").alias("n"))
    rows = bounded_rows(pairs, 1_000_000, "confusion table")
    labels, comps = sorted({r["label"] for r in rows}), sorted({r["component"] for r in rows})
    grid = np.zeros((len(labels), len(comps)))
    for r in rows:
        grid[labels.index(r["label"]), comps.index(r["component"])] = r["n"]
    return spark.createDataFrame([(int(labels[i]), int(comps[j]), int(grid[i, j])) for i, j in hungarian(-grid)], "label int, component int, n int")


def _graph(spark, d):
    e = G.unique_edges(_edges(spark, d))
    return spread(e.select("src", "dst", (F.col("n") > 1).cast("double").alias("x")), "src", "dst")


def _block_query(**kw):
    def q(spark, d):
        *_, losses = fit_blocks(_graph(spark, d), BlockModel(**kw), 3, laps=4)
        return spark.createDataFrame(list(enumerate(losses)), "lap int, loss double")

    return q


def q_stream_sovb(spark, d):
    """The events table as a stream of single-row vectors, one pass of stochastic VB."""
    from mixloom.streaming.online import OnlineFit

    path = f"{d}/events.parquet"
    whole = spark.read.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    vec = lambda df: df.select(F.col("event_id"), F.array((F.col("value") / 50).cast("double"), F.hour("ts") / 12.0).alias("x"))
    model = Mixture(DPMixture(), DiagGauss(2))
    fit = OnlineFit(model, P.init_stats(vec(whole), "event_id", model, 4), n_total=float(whole.count()))
    reader = spark.readStream.schema(whole.schema)
    src = vec(reader.parquet(path) if folder else reader.parquet(d, pathGlobFilter="events.parquet"))
    fit.start(src, posixpath.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")).awaitTermination()
    return spark.createDataFrame([(t["epoch"], t["rows"], round(t["loss"], 8), t["k"]) for t in fit.trace], "epoch int, rows double, loss double, k int")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")} | {
    "q_mmsb_fit": _block_query(),
    "q_assortative_fit": _block_query(assortative=True),
    "q_hdp_mmsb_fit": _block_query(hdp=True),
    "q_hdp_assortative_fit": _block_query(hdp=True, assortative=True),
    "q_smsb_fit": _block_query(single=True),
}
SQL: dict[str, str] = {}
