import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom import run as R
from mixloom.models.hmm import sequences_as_rows
from mixloom.models.likelihoods import Bern, DiagGauss, Mult
from mixloom.models.mixtures import DPMixture, FiniteMixture, Mixture
from mixloom.models.topics import GroupTopicModel, documents_as_rows, fit_group_topics
from mixloom.operators import starts as S
from mixloom.plans import fit as P
from mixloom.sources import toys


def test_first_assignments(spark):
    df = spark.createDataFrame([(0, 0.1), (2, 0.7), (-1, 0.2)], "z int, u double")
    resp = S.resp_from_labels(F.col("z"), 3)
    rows = df.select(resp.alias("r"), S.with_duplicates(resp, 2, F.col("u")).alias("d"), S.with_junk(resp, 1, 0.15, F.col("u")).alias("j")).collect()
    assert [r.r for r in rows] == [[1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    assert rows[0].d == [1, 0, 0, 0] + [0] * 4 and rows[1].d == [0] * 4 + [0, 0, 1, 0]
    assert rows[0].j[-1] == 0.99 and sum(rows[0].j) == pytest.approx(1) and rows[1].j == [0, 0, 1, 0, 0]


def test_restricted_step_keeps_the_targets_mass(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], [-1.0, -1.0, -2.0], 0.4)], "s array<double>, p array<double>, t double")
    r = df.select(S.restricted_resp(F.col("s"), F.col("p"), F.col("t")).alias("r")).first().r
    assert sum(r) == pytest.approx(0.4)


def test_words_taken_from_a_topic(spark):
    m = spark.createDataFrame([(1, "a", 0, 5.0), (1, "b", 0, 1.0), (1, "a", 1, 2.0)], "doc_id bigint, word string, topic int, mass double")
    assert {(r.word, r.topic) for r in S.without_words(m, "topic", 0, 1).collect()} == {("b", 0), ("a", 1)}


def test_adjacency(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "src bigint, dst bigint, x double")
    assert {r.src: r["values"] for r in S.adjacency(e, [0, 1]).collect()} == {0: [None, 2.0], 1: [3.0, None]}


@pytest.mark.parametrize("n_seen,vocab,want", [(100, 1000, (80, 20, 200)), (100, 213, (80, 11, 110)), (30, 1000, (20, 10, 100)), (100, 111, None), (19, 1000, None)])
def test_heldout_plan(spark, n_seen, vocab, want):
    df = spark.createDataFrame([(n_seen,)], "n bigint").select(S.heldout_plan(F.col("n"), vocab, share=0.2, ratio=0.1).alias("p"))
    if want is None:
        with pytest.raises(Exception, match="too few"):
            df.collect()
    else:
        assert tuple(df.first()["p"]) == want


def test_vocab_split(spark):
    vocab = spark.range(300).select(F.col("id").cast("string").alias("word"))
    bag = vocab.limit(40).withColumn("doc_id", F.lit(1).cast("bigint")).unionByName(vocab.where("word >= '2'").limit(60).withColumn("doc_id", F.lit(2).cast("bigint")))
    parts = S.vocab_split(bag, vocab)
    n = {(r.doc_id, r.part): r["count"] for r in parts.groupBy("doc_id", "part").count().collect()}
    assert n == {(1, "train_seen"): 30, (1, "heldout_seen"): 10, (1, "heldout_unseen"): 90, (2, "train_seen"): 48, (2, "heldout_seen"): 12, (2, "heldout_unseen"): 108}
    assert parts.select("doc_id", "word").distinct().count() == parts.count()
    assert parts.where("part = 'heldout_unseen'").join(bag, ["doc_id", "word"], "left_semi").count() == 0


def test_sparse_documents_in_mixtures(spark):
    bag = spark.createDataFrame(toys.bars(60, side=4, words=40), "doc_id bigint, word_id int, word_count double")
    docs = documents_as_rows(bag).cache()
    r = P.fit_vb(docs, "doc_id", Mixture(DPMixture(), Mult(16)), 4, laps=5, how="bregman")
    assert all(b <= a + 1e-9 for a, b in zip(r.losses, r.losses[1:])) and r.stats["WordCounts"].sum() == pytest.approx(2400)
    bits = docs.withColumn("counts", F.transform("counts", lambda _: F.lit(1.0)))
    assert P.fit_vb(bits, "doc_id", Mixture(FiniteMixture(), Bern(16)), 4, laps=3).stats["N"].sum() == pytest.approx(60)


def test_gibbs(spark):
    x, z = toys.mixture(80, 3, 2, spread=20.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    model = Mixture(DPMixture(), DiagGauss(2))
    a, b = (P.fit_gibbs(df, "id", model, 4, sweeps=6) for _ in range(2))
    assert a.losses == b.losses and a.losses[-1] <= a.losses[0] and a.stats["N"].sum() == 80
    with pytest.raises(ValueError):
        P.fit_gibbs(df, "id", model, 4, most=10)
    assert len(set(z)) == 3


@pytest.mark.parametrize("hdp", [False, True])
def test_topics_over_vectors(spark, hdp):
    x = np.random.RandomState(0).rand(100, 2)
    ends = [0, 20, 40, 50, 100]
    rows = [(g, i, x[i].tolist()) for g in range(4) for i in range(ends[g], ends[g + 1])]
    groups = sequences_as_rows(spark.createDataFrame(rows, "g bigint, pos int, x array<double>"), "g", ["pos"], "x").cache()
    losses = fit_group_topics(groups, GroupTopicModel(DiagGauss(2, var=0.1), hdp=hdp), 3, laps=4).losses
    assert all(b <= a + 1e-6 for a, b in zip(losses, losses[1:]))


def test_run(spark, tmp_path):
    x, _ = toys.asterisk(120)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, x array<double>")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        model, best, losses = R.run(df, "DPMixtureModel", "DiagGauss", "VB", k="4", laps=3, tasks=2, var=0.1, strange=1, output=str(tmp_path))
    assert any("strange" in str(w.message) for w in seen)
    assert best.losses[-1] == min(losses.values()) and len(losses) == 2
    assert spark.read.parquet(f"{tmp_path}/default/1/trace").count() == 3
    assert R.run(df, "DPMixture", "Gauss", "memoVB", k=3, laps=2, batches=2, moves="merge,shuffle")[1].trace
    with pytest.raises(ValueError):
        R.run(df, "DPMixture", "Gauss", "nothing")
    assert R.unique_seed("abcdefgh-x", 1) == R.unique_seed("abcde", 1) < 10_000_000
