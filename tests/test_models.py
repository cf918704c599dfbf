import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.functions.special import digamma
from mixloom.models import hmm as H
from mixloom.models import likelihoods as L
from mixloom.models import topics as T
from mixloom.models.mixtures import DPMixture, FiniteMixture, Mixture, merge_components
from mixloom.models.relational import BlockModel, fit_blocks
from mixloom.operators.datasets import with_batches
from mixloom.plans import fit as P
from mixloom.sources import toys


def falls(losses, tol=1e-7):
    return all(b <= a + tol for a, b in zip(losses, losses[1:]))


def families():
    rng = np.random.default_rng(0)
    b = {"x": rng.normal(size=(40, 3)), "xprev": rng.normal(size=(40, 3)), "y": rng.normal(size=40)}
    counts, bits = {"x": rng.poisson(1.0, (40, 7)).astype(float)}, {"x": (rng.random((40, 5)) > 0.5).astype(float)}
    return [(L.DiagGauss(3), b), (L.Gauss(3), b), (L.ZeroMeanGauss(3), b), (L.AutoRegGauss(3), b), (L.GaussRegress(3), b), (L.Joint(a=L.DiagGauss(3), b=L.GaussRegress(3)), b), (L.Mult(7), counts), (L.Bern(5), bits)]


@pytest.mark.parametrize("case", range(8))
def test_likelihood_identities(case):
    obs, batch = families()[case]
    resp = np.random.default_rng(1).dirichlet(np.ones(3), 40)
    s = obs.stats(batch, resp)
    nat = obs.nat(s)
    post, inc = obs.post(nat), obs.increments(s)
    eta = obs.eta(post)
    assert float((resp * obs.score(batch, post)).sum()) == pytest.approx(sum(float((inc[k] * eta[k]).sum()) for k in inc) + obs.base(s))
    assert obs.objective(s) >= obs.objective(s, {k: v * 1.03 for k, v in nat.items()})
    merged = {k: np.concatenate([v[:1] + v[1:2], v[2:]]) for k, v in s.items()}
    assert obs.objective(merged) - obs.objective(s) == pytest.approx(obs.merge_gap(s, 0, 1))
    parts = [obs.stats({k: v[i::2] for k, v in batch.items()}, resp[i::2]) for i in range(2)]
    assert all(np.allclose(parts[0][k] + parts[1][k], s[k]) for k in s)


def vectors(spark, n=300, batches=3):
    x, _ = toys.asterisk(n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    return with_batches(df, "id", batches).cache()


@pytest.mark.parametrize("alloc", [FiniteMixture(2.0), DPMixture(2.0)])
@pytest.mark.parametrize("obs", [L.DiagGauss(2, var=0.1), L.Gauss(2, cov=0.1), L.ZeroMeanGauss(2, cov=0.1)])
def test_mixtures_never_get_worse_and_repeat(spark, alloc, obs):
    df, model = vectors(spark), Mixture(alloc, obs)
    a = P.fit_vb(df, "id", model, 6, laps=6, how="randexamplesbydist")
    b = P.fit_vb(df, "id", model, 6, laps=6, how="randexamplesbydist")
    assert falls(a.losses) and np.allclose(a.losses, b.losses)
    m = P.fit_memovb(df, "id", model, 6, n_batches=3, laps=3)
    assert falls(m.losses)
    assert m.stats["N"].sum() == pytest.approx(300)


def test_memoized_with_one_batch_is_vb(spark):
    df, model = vectors(spark), Mixture(DPMixture(), L.DiagGauss(2, var=0.1))
    one = P.fit_memovb(df.withColumn("batch_id", F.lit(0)), "id", model, 5, n_batches=1, laps=4, tol=0)
    assert np.allclose(one.losses, P.fit_vb(df, "id", model, 5, laps=4, tol=0).losses)


def test_em_improves(spark):
    r = P.fit_em(vectors(spark), "id", Mixture(FiniteMixture(10.0), L.Gauss(2, cov=0.1)), 5, laps=6)
    assert falls(r.losses, 1e-6) and r.params["weights"].sum() == pytest.approx(1)


def test_moves_lower_the_loss_and_keep_the_mass(spark):
    df, model = vectors(spark), Mixture(DPMixture(), L.Gauss(2, cov=0.05))
    r = P.fit_memovb(df, "id", model, 4, n_batches=3, laps=5, moves=P.Moves(merge=True, delete=True, birth=True, shuffle=True))
    assert falls(r.losses) and r.moves
    assert r.stats["N"].sum() == pytest.approx(300) and len(r.uids) == len(r.stats["N"]) == len(set(r.uids))
    seen = P.one_pass(df, model.scorer(r.params), model)
    assert -model.objective(seen) / model.scale(300) <= r.losses[-1] + 1e-7


def test_merge_uses_exact_pair_entropy(spark):
    df, model = vectors(spark), Mixture(DPMixture(), L.DiagGauss(2, var=0.1))
    params = model.global_step(P.init_stats(df, "id", model, 4))
    s = P.one_pass(df, model.scorer(params), model, pairs=[(0, 2)])
    m = merge_components(s, 0, 2, float(s["pair_entropy"][0]))
    assert m["entropy"][0] <= s["entropy"][0] + s["entropy"][2] + 1e-9
    assert m["N"][0] == pytest.approx(s["N"][0] + s["N"][2]) and len(m["N"]) == 3


def test_stochastic_reaches_about_the_same(spark):
    df, model = vectors(spark), Mixture(DPMixture(), L.DiagGauss(2, var=0.1))
    r = P.fit_sovb(df, "id", model, 5, n_batches=3, laps=3)
    assert len(r.trace) == 9 and min(r.losses) < r.losses[0] + 1e-9


@pytest.mark.parametrize("how", ["randexamples", "kmeans", "bregman", "contigblocks"])
def test_initialisations(spark, how):
    df, model = vectors(spark), Mixture(DPMixture(), L.DiagGauss(2, var=0.1))
    assert falls(P.fit_vb(df, "id", model, 4, laps=3, how=how).losses)


def test_assign(spark):
    df, model = vectors(spark), Mixture(DPMixture(), L.DiagGauss(2, var=0.1))
    r = P.fit_vb(df, "id", model, 8, laps=5, how="kmeans")
    assert P.assign(df, "id", model, r.params).where("component BETWEEN 0 AND 7").count() == 300


def test_checkpoint_schedule():
    assert [lap for lap in range(1, 13) if P.should_save(lap, 99)] == [1, 2, 4, 5, 8, 10]
    assert P.should_save(0.3, 2) and not P.should_save(0.3, 3)
    assert P.merge_shortlist(np.array([5.0, 1, 9]), 1) == [(0, 2)]


def enumerate_paths(log_start, log_trans, scores):
    t, k = scores.shape
    paths = list(itertools.product(range(k), repeat=t))
    lp = np.array([log_start[p[0]] + sum(scores[i, s] for i, s in enumerate(p)) + sum(log_trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
    return paths, lp


def test_forward_backward_and_viterbi_against_enumeration():
    rng = np.random.default_rng(3)
    for t in (1, 2, 5):
        a, b, s = np.log(rng.dirichlet(np.ones(3))), np.log(rng.dirichlet(np.ones(3), 3)) - 0.1, rng.normal(size=(t, 3))
        paths, lp = enumerate_paths(a, b, s)
        w = np.exp(lp - lp.max())
        w /= w.sum()
        resp, pairs, h, first, ev = H.forward_backward(a, b, s)
        assert ev == pytest.approx(lp.max() + np.log(np.exp(lp - lp.max()).sum()))
        want = np.array([[sum(x for x, p in zip(w, paths) if p[i] == k) for k in range(3)] for i in range(t)])
        assert np.allclose(resp, want)
        assert h.sum() + first.sum() == pytest.approx(-(w * np.log(w + 1e-300)).sum())
        assert pairs.sum() == pytest.approx(t - 1)
        assert tuple(H.viterbi(a, b, s)) == paths[int(lp.argmax())]


@pytest.mark.parametrize("hdp", [False, True])
def test_hmm_fits(spark, hdp):
    rows = toys.sequences(6, 3, 2, 20) + [(99, 0, [0.0, 0.0], 0)]  # one sequence of a single step
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows], "g bigint, pos int, x array<double>")
    seqs = with_batches(H.sequences_as_rows(df, "g", ["pos"], "x"), "seq_id", 2).cache()
    model = H.HMM(L.DiagGauss(2, var=1.0), hdp=hdp)
    a, b = H.fit_hmm(seqs, model, 4, laps=5), H.fit_hmm(seqs, model, 4, laps=5)
    assert falls(a.losses) and np.allclose(a.losses, b.losses)
    assert falls(H.fit_hmm(seqs, model, 4, alg="memovb", laps=3, n_batches=2).losses)
    assert H.decode(seqs, model, a.params).count() == len(rows)


@pytest.mark.parametrize("hdp", [False, True])
def test_topics(spark, hdp):
    bag = spark.createDataFrame(toys.bars(40, side=4, words=30), "doc_id bigint, word_id int, word_count double")
    docs = with_batches(T.documents_as_rows(bag), "doc_id", 2).cache()
    for alg in ("vb", "memovb"):
        r = T.fit_topics(docs, T.TopicModel(16, hdp=hdp, restarts=1), 4, alg=alg, laps=4, n_batches=2)
        assert falls(r.losses, 1e-6) and r.stats["N"].sum() == pytest.approx(40 * 30)
    held = docs.select("doc_id", "ids", "counts", F.col("ids").alias("test_ids"), F.col("counts").alias("test_counts"))
    assert T.heldout_scores(held, T.TopicModel(16, hdp=hdp), r.params).where("loglik < 0").count() == 40


def test_doc_step_conserves_tokens():
    rng = np.random.default_rng(0)
    lik, counts = rng.random((9, 3)), rng.integers(1, 5, 9).astype(float)
    count, resp = T.doc_step(lik, counts, np.full(3, 0.2))
    assert count.sum() == pytest.approx(counts.sum()) and np.allclose(resp.sum(1), 1)
    assert digamma(2.0) == pytest.approx(0.42278433509846713)


@pytest.mark.parametrize("kw", [{}, {"assortative": True}, {"hdp": True}, {"hdp": True, "assortative": True}, {"single": True}])
def test_block_models(spark, kw):
    edges = spark.createDataFrame(toys.blocks(14, 2), "src bigint, dst bigint, x double")
    nodes, params, losses = fit_blocks(edges, BlockModel(**kw), 2, laps=4)
    assert falls(losses) and nodes.count() == 14


@pytest.mark.parametrize("kind", ["topics", "states"])
@pytest.mark.parametrize("hdp", [False, True])
def test_moves_of_topics_and_states(spark, kind, hdp):
    from mixloom.plans.grow import Grow, fit_grow

    if kind == "topics":
        bag = spark.createDataFrame(toys.bars(40, side=4, words=30), "doc_id bigint, word_id int, word_count double")
        rows, model = T.documents_as_rows(bag).cache(), T.TopicModel(16, hdp=hdp)
        first = T.fit_topics(rows, model, 3, laps=2)
    else:
        df = spark.createDataFrame([(a, b, c) for a, b, c, _ in toys.sequences(6, 3, 2, 15)], "g bigint, pos int, x array<double>")
        rows, model = H.sequences_as_rows(df, "g", ["pos"], "x").cache(), H.HMM(L.DiagGauss(2, var=1.0), hdp=hdp)
        first = H.fit_hmm(rows, model, 2, laps=2)
    r = fit_grow(rows, model, first, laps=3, moves=Grow(merge=2))
    assert falls(r.losses) and {m["move"] for m in r.moves} >= {"birth", "delete", "merge"}
    assert len(r.uids) == len(set(r.uids)) == len(r.stats["N"]) == r.trace[-1]["k"]
    assert r.losses[-1] <= first.losses[-1] + 1e-6


def test_heldout_callback_and_correlations(spark):
    bag = spark.createDataFrame(toys.bars(30, side=4, words=30, mixed=True), "doc_id bigint, word_id int, word_count double")
    docs, model, seen = T.documents_as_rows(bag).cache(), T.TopicModel(16), []
    held = docs.select("doc_id", "ids", "counts", F.col("ids").alias("test_ids"), F.col("counts").alias("test_counts"))
    r = T.fit_topics(docs, model, 3, laps=3, tol=0, callbacks=[T.heldout_callback(held, model, seen)])
    assert [s["lap"] for s in seen] == [1, 2, 3] and all(s["n_docs"] == 30 for s in seen)
    c = T.topic_correlations(r.stats)
    assert np.allclose(np.diag(c), 1) and np.abs(c).max() <= 1 + 1e-9


def test_predictions_follow_the_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 2 * x[:, 0] - x[:, 1] + 3
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id bigint, x array<double>, y double")
    model = Mixture(DPMixture(), L.Joint(x=L.DiagGauss(2), y=L.GaussRegress(2)))
    fit = P.fit_vb(df, "id", model, 2, laps=4)
    out = {r.id: (r.y_hat, r.by_component) for r in P.predict(df, "id", model, fit.params).collect()}
    assert max(abs(out[i][0] - y[i]) for i in range(200)) < 0.05 and len(out[0][1]) == 2


def test_gibbs_query_fits_whole_vectors(spark, tmp_path):
    from mixloom.queries import fits

    x = np.random.default_rng(5).normal(scale=0.1, size=(30, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [r.loss for r in fits.q_gibbs_fit(spark, str(tmp_path)).collect()]
    model = fits._dp()
    want = fits.P.fit_gibbs(fits._vectors(spark, str(tmp_path)), "vec_id", model, 5, sweeps=3)
    assert got == pytest.approx([t["loss"] for t in want.trace], abs=1e-7) and model.obs.post(model.obs.nat(want.stats))["m"].shape == (5, 64)


@pytest.mark.parametrize("alloc,obs,alg", [
    ("FiniteTopicModel", "Mult", "VB"), ("HDPTopic", "Mult", "memoVB"), ("FiniteTopic", "DiagGauss", "VB"), ("FiniteHMM", "DiagGauss", "VB"), ("HDPHMM", "Gauss", "memoVB"),
    ("FiniteSMSB", "Bern", "VB"), ("FiniteMMSB", "Bern", "VB"), ("FiniteAssortativeMMSB", "Bern", "VB"), ("HDPMMSB", "Bern", "VB"), ("HDPAssortativeMMSB", "Bern", "VB"),
])
def test_run_takes_every_allocation_model(spark, alloc, obs, alg):
    from mixloom.run import family, run
    from mixloom.models.topics import documents_as_rows

    kind = family(alloc)[0]
    if kind == "blocks":
        df = spark.createDataFrame([(a, b, float((a < 5) == (b < 5))) for a in range(10) for b in range(10) if a != b], "src bigint, dst bigint, x double")
    elif obs == "Mult":
        df = documents_as_rows(spark.createDataFrame(toys.bars(20, side=4, words=20), "doc_id bigint, word_id int, word_count double"))
    else:
        rng = np.random.default_rng(0)
        df = spark.createDataFrame([(i, 8, rng.normal(size=16).tolist()) for i in range(6)], "seq_id bigint, n int, x array<double>")
    model, best, losses = run(df, alloc, obs, alg, k=2, laps=2, batches=2)
    assert np.isfinite(losses[0]) and len(best.uids) == 2 and model.name
    with pytest.raises(ValueError):
        run(df, alloc, obs, "EM", k=2)


def test_a_run_goes_on_from_a_saved_one(spark, tmp_path):
    from mixloom.run import run

    df = vectors(spark).withColumnRenamed("id", "row_id")
    _, first, _ = run(df, "DPMixture", "DiagGauss", "VB", k=4, laps=3, tol=0, output=str(tmp_path), job="a")
    _, more, _ = run(df, "DPMixture", "DiagGauss", "VB", k=4, laps=1, tol=0, init=str(tmp_path / "a" / "1"))
    _, whole, _ = run(df, "DPMixture", "DiagGauss", "VB", k=4, laps=4, tol=0, job="a")
    assert more.losses[0] == pytest.approx(whole.losses[3]) and more.trace[0]["rows"] == 300


def test_starts_from_truth_and_responsibilities(spark):
    df, model = vectors(spark), Mixture(DPMixture(), L.DiagGauss(2, var=0.1))
    labelled = df.withColumn("label", F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("int")))
    truth = P.init_stats(labelled, "id", model, 3, how="truth")
    one_hot = F.array(*[(F.col("label") == k).cast("double") for k in range(3)])
    resp = P.init_stats(labelled.where("label IS NOT NULL").withColumn("resp", one_hot), "id", model, 3, how="resp")
    assert truth["N"].sum() == labelled.where("label IS NOT NULL").count()
    assert all(np.allclose(truth[n], resp[n]) for n in ("N", "x", "xx", "entropy"))


def test_delete_takes_the_component_that_the_query_names(spark):
    from mixloom.operators import runs as R

    for sizes, most in (([5.0, 900.0, 30.0, 30.0], 600), ([3.0, 2.0], 1)):
        df = spark.createDataFrame(list(enumerate(sizes)), "k int, n double")
        row = R.delete_target(df, "k", "n", most).first()
        assert P.delete_target(sizes, most) == (row["k"] if row else None)
    assert P.delete_target([5.0, 900.0, 30.0, 30.0], 600, barred={2, 3}) == 0
