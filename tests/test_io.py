import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.models.likelihoods import DiagGauss
from mixloom.models.mixtures import DPMixture, Mixture
from mixloom.plans import fit as P
from mixloom.sources import readers, store, toys
from mixloom.streaming.online import OnlineFit, running_stats, windowed_stats


def test_csv_roles(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b,y_out,z_true\n1,2,3,0\n4,5,6,1\n")
    rows = readers.read_vectors(spark, str(p)).orderBy("y").collect()
    assert [(r.x, r.y, r.z_true) for r in rows] == [([1.0, 2.0], 3.0, 0), ([4.0, 5.0], 6.0, 1)]


def test_npz_and_mat(spark, tmp_path):
    np.savez(tmp_path / "a.npz", X=np.arange(6).reshape(3, 2), doc_range=[0, 1, 3], word_id=[1, 2, 3], word_count=[1.0, 2, 3])
    p = str(tmp_path / "a.npz")
    assert readers.read_vectors(spark, p).count() == 3
    assert [(r.group_id, r.pos) for r in readers.read_grouped_npz(spark, p).orderBy("group_id", "pos").collect()] == [(0, 0), (1, 0), (1, 1)]
    assert readers.read_bow_npz(spark, p).agg(F.sum("word_count")).first()[0] == 6
    with pytest.raises(NotImplementedError):
        readers.read_vectors(spark, "x.mat")


def test_ldac_round_trip(spark, tmp_path):
    bag = spark.createDataFrame(toys.bars(5), "doc_id bigint, word_id int, word_count double")
    store.write_ldac(bag, str(tmp_path / "l"))
    back = readers.read_ldac(spark, str(tmp_path / "l"))
    key = lambda df: sorted(tuple(sorted((r.w, r.c) for r in x[1])) for x in df.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("word_id").alias("w"), F.col("word_count").alias("c")))).collect())
    assert key(back) == key(bag)
    (tmp_path / "bad.ldac").write_text("3 1:1\n")
    with pytest.raises(Exception, match="bad ldac line"):
        readers.read_ldac(spark, str(tmp_path / "bad.ldac")).collect()


def test_token_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 1 3\n\n2\n")
    assert sorted((r.word_id, r.word_count) for r in readers.read_tokenlist(spark, str(tmp_path / "t.txt")).collect()) == [(0, 2.0), (1, 1.0), (2, 1.0)]
    bag = spark.createDataFrame([(1, 0, 2.0), (1, 4, 1.0)], "doc_id bigint, word_id int, word_count double")
    store.write_tokenlist(bag, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1 1 5"
    store.write_info(bag, str(tmp_path / "info"), 9)
    assert spark.read.json(str(tmp_path / "info")).first().nTokensTotal == 3


def test_edges(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n1 2 0.5\n2 3 1\n")
    (tmp_path / "e.graph").write_text("0 1 2 7\n")
    assert sorted(tuple(r) for r in readers.read_edges(spark, str(tmp_path / "e.txt")).collect()) == [(1, 2, [0.5]), (2, 3, [1.0])]
    assert tuple(readers.read_edges(spark, str(tmp_path / "e.graph")).first()) == (1, 2, [7.0])


def test_batches_of_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"b{i}.ldac").write_text("1 0:1\n" * i)
    (tmp_path / "x.csv").write_text("a\n1\n")
    files = readers.batch_files(str(tmp_path))
    assert [f[-7:] for f in files] == ["b1.ldac", "b2.ldac"]
    df = readers.with_file_batches(readers.read_ldac(spark, str(tmp_path / "*.ldac")))
    assert tuple(readers.dataset_info(df, "doc_id").first()) == (2, 3, 1.5)


def test_fill_missing(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([3.0, 4.0],)], "x array<double>")
    assert sorted(r.x for r in readers.fill_missing(df, "x").collect()) == [[1.0, 4.0], [3.0, 4.0]]


def test_run_store(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "run"))
    for lap in (1, 4):
        s.save(lap, {"alloc": {"eta1": np.arange(3.0) * lap}, "obs": {"x": np.ones((2, 2))}})
    assert s.load(2.5)[0] == 1.0 and s.load()[0] == 4.0
    assert s.load(9)[1]["alloc"]["eta1"].tolist() == [0, 4, 8] and s.load()[1]["obs"]["x"].shape == (2, 2)
    s.log_trace([{"lap": 1, "loss": 0.5, "k": 3}])
    s.log_moves([{"lap": 1, "move": "merge", "accepted": True, "uids": (1, 2)}])
    s.start("local")
    s.stop("local", 1)
    assert s.table("trace").count() == s.table("moves").count() == s.table("timings").count() == 1


def test_callback_saves(spark, tmp_path):
    x, _ = toys.mixture(60, 2, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    s = store.RunStore(spark, str(tmp_path / "run"))
    P.fit_vb(df, "id", Mixture(DPMixture(), DiagGauss(2)), 2, laps=2, callbacks=[s.callback()])
    assert s.laps() and s.table("counts").count() >= 2


def test_streams(spark, tmp_path):
    x, _ = toys.mixture(90, 2, 2)
    src = tmp_path / "in"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    df.repartition(3).write.parquet(str(src))
    model = Mixture(DPMixture(), DiagGauss(2))
    fit = OnlineFit(model, P.init_stats(df, "id", model, 2), n_total=90)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    fit.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert sum(t["rows"] for t in fit.trace) == 90 and len(fit.trace) == 3
    fit(df, fit.last)  # an epoch that was seen
    assert len(fit.trace) == 3


def test_a_restarted_stream_keeps_its_parameters(spark, tmp_path):
    x, _ = toys.mixture(90, 2, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    model, src = Mixture(DPMixture(), DiagGauss(2)), tmp_path / "in"
    stats = P.init_stats(df, "id", model, 2)
    parts = [df.where(f"id % 3 = {k}") for k in range(3)]
    whole = OnlineFit(model, stats, n_total=90)
    for epoch, part in enumerate(parts):
        whole(part, epoch)
        part.coalesce(1).write.mode("append").parquet(str(src)) if epoch == 0 else None
        fit = OnlineFit(model, stats, n_total=90)
        assert fit.resume(spark, str(tmp_path / "state")) == (epoch > 0)
        if epoch > 0:
            part.coalesce(1).write.mode("append").parquet(str(src))
        fit.start(spark.readStream.schema(df.schema).parquet(str(src)), str(tmp_path / "cp")).awaitTermination()
    assert fit.seen == 90 and [t["epoch"] for t in fit.trace] == [0, 1, 2]
    assert np.allclose(fit.params["obs"]["x"], whole.params["obs"]["x"])
    fit(parts[0], 2)  # handed out again
    assert fit.seen == 90 and len(list((tmp_path / "state").glob("epoch-*.json"))) == 2


def test_streaming_aggregates(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 2).alias("s"), F.col("id").cast("double").alias("v"), F.timestamp_seconds(F.col("id") * 40000).alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_stats(stream, "s", "v").writeStream.outputMode("complete").format("memory").queryName("rs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM rs").first()[0] == 20
    assert windowed_stats(rows, "t", "s", "v").agg(F.sum("n")).first()[0] == 20


def test_topics_from_a_stream(spark, tmp_path):
    from mixloom.models import topics as T
    from mixloom.streaming.online import OnlineTopics

    bag = spark.createDataFrame(toys.bars(30, side=4, words=20), "doc_id bigint, word_id int, word_count double")
    docs = T.documents_as_rows(bag)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    model = T.TopicModel(16, hdp=True)
    fit = OnlineTopics(model, model.start(T.first_topics(docs, model, 4, 0), 30), n_total=30)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fit.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert sum(t["docs"] for t in fit.trace) == 30 and fit.params["lam"].shape == (4, 16)
