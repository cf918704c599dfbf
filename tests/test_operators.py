import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.operators import bow, datasets, graph, runs, sequences
from mixloom.operators import vectors as V


def test_bag_of_words_skips_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "A b a"), (2, None), (3, ""), (4, "é9 a")], "doc_id bigint, text string")
    assert {tuple(r) for r in bow.count_words(docs).collect()} == {(1, "a", 2.0), (1, "b", 1.0), (4, "a", 1.0)}


def test_threshold_tokens(spark):
    ids, counts, w = [0, 1, 2, 0, 1, 2, 5, 6, 7], [1, 7, 8, 1, 7, 8, 1, 1, 1], [0, 1, 1, 0, 1, 1, 0, 0, 0]
    rows = [(i // 3, str(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(ids, counts, w))]
    out = bow.threshold_tokens(spark.createDataFrame(rows, "doc_id bigint, word string, word_count double, w double"), 0.1)
    assert sorted(map(tuple, out.collect())) == [(0, "1", 7.0), (0, "2", 8.0), (1, "1", 7.0), (1, "2", 8.0)]


def test_dense_ids_and_ldac(spark):
    df = spark.createDataFrame([(c,) for c in "zebra apple mango apple".split()] + [(None,)], "w string")
    assert {r.w: r.i for r in bow.dense_ids(df, "w", "i").collect()} == {"apple": 0, "mango": 1, "zebra": 2}
    bag = spark.createDataFrame([(1, 5, 2.0), (1, 3, 1.0), (2, 0, 4.0)], "doc_id bigint, word_id int, word_count double")
    assert {r.doc_id: r.line for r in bow.ldac_lines(bag).collect()} == {1: "2 3:1 5:2", 2: "1 0:4"}


def test_blocks(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([0, 0, 0, 1, 1])], "g string, i int, s int")
    assert [(r["size"], r.start) for r in sequences.contiguous_blocks(df, "g", ["i"], "s").orderBy("block").collect()] == [(3, 0), (2, 3)]
    long = spark.range(20).select(F.lit("g").alias("g"), F.col("id").alias("i"))
    assert [r.start for r in sequences.even_blocks(long, "g", ["i"], 3).orderBy("block").collect()] == [0, 7, 14]


def test_hamming(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "t int, f int")
    assert tuple(runs.hamming(df, F.col("t"), F.col("f")).first()) == (4, 0.25)
    neg = spark.createDataFrame([(-1, 1), (-1, 2), (0, 0), (1, 1)], "t int, f int")
    assert tuple(runs.hamming(neg, F.col("t"), F.col("f")).first()) == (2, 0.0)


def test_graph_rules(spark):
    twice = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "src bigint, dst bigint")
    with pytest.raises(ValueError):
        graph.clean_edges(twice)
    assert graph.clean_edges(twice.distinct()).count() == 1
    adj = spark.createDataFrame([(0, [0.0, 1.0, 1.0]), (1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0])], "src bigint, values array<double>")
    assert graph.adjacency_to_edges(adj).count() == 6
    assert graph.dense_edges(spark.range(3).withColumnRenamed("id", "node")).count() == 6


def test_ranking_and_checkpoints(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([3.0, 1.0, 1.0, 5.0])] + [("b", 9, 2.0)], "job string, task int, loss double")
    got = {(r.job, r.task): r.place for r in runs.ranked(df, "job", "task", "loss").collect()}
    assert got == {("a", 1): "best", ("a", 2): "median", ("a", 0): None, ("a", 3): "worst", ("b", 9): "best"}
    laps = spark.createDataFrame([("r", 2.0), ("r", 4.0), ("r", 9.0)], "run string, lap double")
    assert runs.nearest_lap(laps, "run", 3.0).first().lap == 2.0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, p boolean")
    assert runs.auc(df, "s", F.col("p")).first().auc == pytest.approx(0.875)


def test_nearest_and_soft_statistics(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [9.0, 9.0], 1), (3, [0.5, 0.1], None)], "id bigint, v array<double>, z int")
    c = V.centroids(df, "z", "v")
    assert {r.id: r.nearest for r in V.nearest(df, "v", c, "z", keep=["id"]).collect()} == {0: 0, 1: 0, 2: 1, 3: 0}
    s = {(r.z, r.dim): (r.n, r.sx, r.sxx) for r in V.diag_stats(df, "z", "v").collect()}
    assert s[(0, 0)] == (2, 1.0, 1.0) and s[(1, 1)] == (1, 9.0, 81.0)


def test_samples_and_appends(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in datasets.random_rows(df, "k", 7, 1).collect()]
    assert a == [r.k for r in datasets.random_rows(df.repartition(9), "k", 7, 1).collect()] and len(set(a)) == 7
    assert datasets.append(df, df, "k").agg(F.count_distinct("k")).first()[0] == 200
    assert datasets.append(df, df.where("k < 0"), "k").count() == 100
    assert datasets.append(df.where("k < 0"), df, "k").count() == 100
    with pytest.raises(ValueError):
        datasets.append(df, df.withColumnRenamed("k", "z"))
    sizes = datasets.batch_sizes(datasets.with_batches(df, "k", 4)).first()
    assert sizes.n_batches == 4 and sizes.total == 100


def test_dirichlet_cumulant_counts_absent_words(spark):
    import math

    counts = spark.createDataFrame([("t", "a", 3.0), ("t", "b", 1.0)], "topic string, word string, word_count double")
    got = bow.dirichlet_cumulants(counts, "topic", 0.5, F.lit(4)).first().cumulant
    want = math.lgamma(6.0) - math.lgamma(3.5) - math.lgamma(1.5) - 2 * math.lgamma(0.5)
    assert got == pytest.approx(want) and np.isfinite(got)


def test_stored_batches_prune(spark, tmp_path):
    df = datasets.with_batches(spark.range(60).withColumnRenamed("id", "k"), "k", 3)
    back = datasets.stored_batches(df, str(tmp_path / "b"))
    assert back.count() == 60 and sorted(back.columns) == ["batch_id", "k"]
    one = back.where("batch_id = 1")
    assert one.count() == df.where("batch_id = 1").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan


def test_cooccurrence_takes_every_word(spark):
    from collections import Counter

    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(list("abcdefghijklmnopqrstuvw"), rng.integers(0, 12))) for i in range(50)} | {50: "once only", 51: None, 52: "the " * 1100 + "of " * 1000}
    n, product = Counter(), Counter()
    for t in texts.values():
        c = Counter((t or "").split())
        for pair in ((a, b) for a in c for b in c if a < b):
            n[pair] += 1
            product[pair] += c[pair[0]] * c[pair[1]]
    bag = bow.count_words(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    for size in (50_000_000, 100):
        got = bow.cooccurrence(bag, size).collect()
        assert len(got) == len(n) and {(r.word_a, r.word_b): (r.n_docs, r.product) for r in got} == {p: (n[p], product[p]) for p in n}
    assert bow.cooccurrence(bag.where("doc_id < 0")).count() == 0


def test_full_statistics_take_every_dimension(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(90, 9)), rng.integers(0, 3, 90)
    rows = [(v.tolist(), int(k)) for v, k in zip(x, z)] + [([1.0] * 9, None), (None, 1), ([None, 2.0] + [0.0] * 7, 2), ([3.0, 1.0], 0), ([], 0)]
    df = spark.createDataFrame(rows, "v array<double>, z int").repartition(4)
    want, n = np.stack([x[z == k].T @ x[z == k] for k in range(3)]), np.stack([np.full((9, 9), (z == k).sum()) for k in range(3)])
    want[2, 1, 1] += 4.0
    n[2, 1:, 1:] += 1
    want[0, :2, :2] += [[9.0, 3.0], [3.0, 1.0]]
    n[0, :2, :2] += 1
    for block in (4_000_000, 20):
        got = {(r.z, r.i, r.j): r for r in V.full_stats(df, "z", "v", block).collect()}
        assert set(got) == {(k, i, j) for k in range(3) for i in range(9) for j in range(i, 9)}
        assert all(r.n == n[k] and r.sxx == pytest.approx(want[k]) for k, r in got.items())
