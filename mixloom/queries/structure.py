"""Queries over sequences, graphs, subsets, run logs and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mixloom.operators import datasets as D
from mixloom.operators import graph as G
from mixloom.operators import runs as R
from mixloom.operators import sequences as S
from mixloom.operators import starts as T
from mixloom.operators import vectors as V
from mixloom.session import table

ORDER = ["ts", "event_id"]
SUPPLIER_OFFSET = 10_000_000


def _events(spark, d):
    return table(spark, d, "events").select("user_id", *ORDER, "event_type", "value")


def q_ar_suffstats(spark, d):
    s = S.ar_stats(_events(spark, d).withColumn("value", F.col("value") / 100), "user_id", ORDER, "event_type", "value")
    return s.withColumns({c: F.round(c, 4) for c in ("xx", "pp", "px")})


def q_hmm_start_counts(spark, d):
    return S.start_counts(_events(spark, d), "user_id", ORDER, "event_type")


def q_hmm_trans_counts(spark, d):
    return S.transition_counts(_events(spark, d), "user_id", ORDER, "event_type")


def q_contig_blocks(spark, d):
    return S.contiguous_blocks(_events(spark, d), "user_id", ORDER, "event_type")


def q_ntile_blocks(spark, d):
    return S.even_blocks(_events(spark, d), "user_id", ORDER, 6)


def q_state_changes(spark, d):
    rows = S.with_previous(_events(spark, d), "user_id", ORDER, "event_type", "before")
    return rows.groupBy("user_id").agg(F.sum((F.col("before") != F.col("event_type")).cast("bigint")).alias("n_changes"))


def _edges(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("dst"))


def q_graph_clean(spark, d):
    return G.unique_edges(_edges(spark, d))


def q_node_degree(spark, d):
    return G.node_degrees(G.unique_edges(_edges(spark, d)))


def _states(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("state"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + SUPPLIER_OFFSET).alias("node"), F.col("s_nationkey").alias("state"))
    return c.unionByName(s)


def q_node_state_counts(spark, d):
    return G.node_state_counts(G.unique_edges(_edges(spark, d)), _states(spark, d))


def q_edge_block_counts(spark, d):
    return G.block_counts(G.unique_edges(_edges(spark, d)), _states(spark, d))


def q_dense_graph(spark, d):
    return G.dense_edges(table(spark, d, "nation").select(F.col("n_nationkey").alias("node")))


def q_subset_semi(spark, d):
    users = _events(spark, d).where("event_type = 'purchase' AND value > 90").select("user_id")
    return D.subset_by_ids(_events(spark, d), "user_id", users)


def q_union_all(spark, d):
    e = _events(spark, d)
    return D.append(e.where("event_type = 'click'"), e.where("event_type = 'error'"), "user_id")


def q_random_sample(spark, d):
    return D.random_rows(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 50, 7)


def q_weighted_sample(spark, d):
    return D.random_rows(_events(spark, d).select("event_id", "value"), "event_id", 50, 7, F.col("value")).select("event_id")


def q_batch_sizes(spark, d):
    return D.batch_sizes(D.with_batches(table(spark, d, "embeddings"), "vec_id", 10))


def q_batch_assign(spark, d):
    return D.with_batches(table(spark, d, "embeddings").select("vec_id"), "vec_id", 10)


def q_birth_targets(spark, d):
    e = _events(spark, d)
    r = F.col("value") / F.lit(100.0)
    return D.birth_targets(e, "user_id", r, 0.5, 20.0).select("user_id", F.round("mass", 6).alias("mass"))


def _comps(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 25).alias("k")).agg(F.count("*").alias("n"))


def q_merge_pairs_total_size(spark, d):
    w = Window.orderBy(F.desc("total"), "k_a", "k_b")
    return R.pair_sizes(_comps(spark, d), "k", "n").withColumn("rank", F.row_number().over(w))  # 300 pairs


def q_delete_target(spark, d):
    return R.delete_target(_comps(spark, d), "k", "n", 600)


def q_stick_counts(spark, d):
    return S.later_counts(_comps(spark, d), "k", "n")


def q_stick_probs(spark, d):
    c = S.later_counts(_comps(spark, d), "k", "n")
    rho = c.select("k", ((F.col("n") + 1) / (F.col("n") + F.col("n_later") + 6)).alias("rho"))
    return S.stick_weights(rho, "k", "rho").select("k", F.round("rho", 6).alias("rho"), F.round("weight", 6).alias("weight"))


def q_two_tier_sort(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    w = Window.orderBy(F.desc("n"), F.desc("first"), "c_nationkey")
    return c.withColumn("place", F.row_number().over(w))  # 25 rows


def q_active_vs_eliminated(spark, d):
    o = table(spark, d, "orders")
    early = o.where("o_orderdate < '1996-01-01'").select("o_custkey").distinct()
    late = o.where("o_orderdate >= '1996-01-01'").select("o_custkey").distinct()
    both = early.intersect(late).select("o_custkey", F.lit("active").alias("status"))
    return both.unionByName(early.exceptAll(late).select("o_custkey", F.lit("eliminated").alias("status")))


def _log(spark, d):
    """A run log from events: job and task by user, lap by order of time, loss by value."""
    e = _events(spark, d)
    lap = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    return e.select((F.col("user_id") % 7).alias("job"), F.col("user_id").alias("task"), lap.alias("lap"), F.col("value").alias("loss"), F.concat(F.lit("K="), (F.col("user_id") % 7).cast("string"), F.lit("-alg="), F.when(F.col("user_id") % 2 == 0, "VB").otherwise("EM")).alias("path"))


def q_run_filter(spark, d):
    return R.jobs_with(_log(spark, d), "path", K="3", alg="VB").select("job", "task", "lap", "loss")


def q_option_diffs(spark, d):
    return R.differing_options(_log(spark, d), "path")


def q_rank_runs(spark, d):
    return R.ranked(R.final_losses(_log(spark, d), "job", "task"), "job", "task", "loss")


def q_best_job(spark, d):
    final = R.final_losses(_log(spark, d), "job", "task").withColumn("grid", F.col("job") % 3)
    return R.best_jobs(final, "grid", "job", F.round(-F.min("loss"), 6))


def q_keff_per_lap(spark, d):
    log = _log(spark, d).groupBy("lap", F.col("job").alias("k")).agg(F.sum("loss").alias("n"))
    return R.effective_k(log, 800.0)


def q_nearest_checkpoint(spark, d):
    return R.nearest_lap(_log(spark, d).where("lap % 5 = 0"), "task", 17.5)


def q_loss_delta(spark, d):
    return R.loss_deltas(_log(spark, d).select("task", "lap", "loss"), "task").withColumn("delta", F.round("delta", 6))


def _found(spark, d):
    emb = table(spark, d, "embeddings")
    return V.nearest(emb, "embedding", V.centroids(emb, "label", "embedding"), "label", keep=["vec_id", "label"])


def q_confusion(spark, d):
    return R.confusion(_found(spark, d), "label", "nearest")


def q_hamming(spark, d):
    return R.hamming(_found(spark, d), F.col("label"), F.col("nearest")).withColumn("distance", F.round("distance", 6))


def q_auc_ranksum(spark, d):
    return R.auc(_events(spark, d), "value", F.col("event_type") == "purchase").withColumn("auc", F.round("auc", 6))


def q_misaligned(spark, d):
    return T.misaligned(_found(spark, d), "label", "nearest").withColumn("share", F.round("share", 6))


def q_label_resp(spark, d):
    resp = T.resp_from_labels(F.col("label"), 4)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(T.with_empty(resp, 1)).alias("k", "r"))


def q_subdivided_blocks(spark, d):
    e = _events(spark, d).withColumn("z", F.when(F.col("event_type") == "click", 0).otherwise(1))
    return T.subdivided(e, "user_id", ORDER, "z", 2).select("event_id", F.col("sub").cast("bigint").alias("sub"))


def q_word_matrix(spark, d):
    from mixloom.operators import bow

    return T.doc_word_matrix(bow.count_words(table(spark, d, "documents")), ["the", "this", "our", "die"])


def _token_resp(spark, d):
    """Soft assignments of words by their first letter: a share of 0.75 for its class, 0.25 for the next."""
    from mixloom.operators import bow

    bag = bow.count_words(table(spark, d, "documents"))
    k = (F.ascii("word") % 3).cast("int")
    pairs = F.array(F.struct(k.alias("k"), F.lit(0.75).alias("r")), F.struct(((k + 1) % 3).alias("k"), F.lit(0.25).alias("r")))
    return bag.select("doc_id", "word", F.inline(pairs))


def q_doc_resp(spark, d):
    return T.doc_resp(_token_resp(spark, d)).select("doc_id", "k", F.round("r", 6).alias("r"))


def q_word_resp(spark, d):
    from mixloom.operators import bow

    back = T.token_resp(bow.count_words(table(spark, d, "documents")), T.doc_resp(_token_resp(spark, d)))
    return T.word_resp(back).select("word", "k", F.round("r", 6).alias("r"))


def q_move_budget(spark, d):
    c = _comps(spark, d)
    w = Window.orderBy(F.desc("n"), "k")
    return T.within_budget(c.withColumn("tier", F.row_number().over(w)), "tier", "n", 5000)


def q_fill_subset(spark, d):
    e = _events(spark, d).select("event_id", "value")
    part = e.where("value > 50").withColumn("value", -F.col("value"))
    return T.filled(e, part, "event_id", "value")


_EV = "WITH e AS (SELECT user_id, ts, event_id, event_type, value FROM events), p AS (SELECT *, lag(value) OVER w AS pv, lag(event_type) OVER w AS pt, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_ED = f"WITH u AS (SELECT src, dst, count(*) AS n FROM (SELECT o_custkey AS src, l_suppkey + {SUPPLIER_OFFSET} AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE src <> dst GROUP BY ALL), st AS (SELECT c_custkey AS node, c_nationkey AS state FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER_OFFSET}, s_nationkey FROM supplier)"
_K = "WITH c AS (SELECT o_custkey % 25 AS k, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS n_later FROM c)"
_LG = "WITH lg AS (SELECT user_id % 7 AS job, user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lap, value AS loss FROM events), fin AS (SELECT job, task, arg_max(loss, lap) AS loss FROM lg GROUP BY job, task)"
_NC = "WITH l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, dim, avg(v) AS m FROM l WHERE label IS NOT NULL GROUP BY label, dim), dd AS (SELECT l.vec_id, any_value(l.label) AS label, c.label AS found, sum((v - m) * (v - m)) AS dist FROM l JOIN c ON c.dim = l.dim GROUP BY l.vec_id, c.label), nr AS (SELECT vec_id, label, found FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, found) AS k FROM dd) WHERE k = 1)"
_TR = "WITH b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), t AS (SELECT doc_id, word, ascii(word) % 3 AS k, 0.75::DOUBLE AS r FROM b UNION ALL SELECT doc_id, word, (ascii(word) % 3 + 1) % 3, 0.25::DOUBLE FROM b), dr AS (SELECT t.doc_id, t.k, sum(t.r) / any_value(n.n) AS r FROM t JOIN (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id) n USING (doc_id) GROUP BY t.doc_id, t.k)"
_HEX = "(('0x' || md5({0} || '|{1}')[1:8])::BIGINT)"

SQL = {
    "q_ar_suffstats": _EV + " SELECT event_type, count(*) AS n, round(sum(value / 100 * (value / 100)), 4) AS xx, round(sum(pv / 100 * (pv / 100)), 4) AS pp, round(sum(pv / 100 * (value / 100)), 4) AS px FROM p WHERE pv IS NOT NULL GROUP BY event_type",
    "q_hmm_start_counts": _EV + " SELECT event_type, count(*) AS n FROM p WHERE i = 1 GROUP BY event_type",
    "q_hmm_trans_counts": _EV + " SELECT pt AS state_from, event_type AS state_to, count(*) AS n FROM p WHERE i > 1 GROUP BY ALL",
    "q_contig_blocks": _EV + ", b AS (SELECT *, sum(CASE WHEN pt IS NULL OR pt <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS block FROM p) SELECT user_id, block::BIGINT AS block, any_value(event_type) AS event_type, min(i) - 1 AS start, count(*) AS size FROM b GROUP BY user_id, block",
    "q_ntile_blocks": _EV + ", b AS (SELECT *, ntile(6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM p) SELECT user_id, block, min(i) - 1 AS start, count(*) AS size FROM b GROUP BY ALL",
    "q_state_changes": _EV + " SELECT user_id, sum(CASE WHEN pt <> event_type THEN 1 WHEN pt IS NULL THEN NULL ELSE 0 END)::BIGINT AS n_changes FROM p GROUP BY user_id",
    "q_graph_clean": _ED + " SELECT * FROM u",
    "q_node_degree": _ED + " SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, count(*) AS n_edges FROM (SELECT src AS node, 1 AS o, 0 AS i FROM u UNION ALL SELECT dst, 0, 1 FROM u) GROUP BY node",
    "q_node_state_counts": _ED + " SELECT x.node, st.state, count(*) AS n FROM (SELECT src AS node, dst AS other FROM u UNION ALL SELECT dst, src FROM u) x JOIN st ON st.node = x.other GROUP BY ALL",
    "q_edge_block_counts": _ED + " SELECT a.state AS state_src, b.state AS state_dst, count(*) AS n FROM u JOIN st a ON a.node = src JOIN st b ON b.node = dst GROUP BY ALL",
    "q_dense_graph": "SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey",
    "q_subset_semi": "SELECT user_id, ts, event_id, event_type, value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)",
    "q_union_all": "SELECT user_id, ts, event_id, event_type, value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id + (SELECT max(user_id) + 1 FROM events WHERE event_type = 'click'), ts, event_id, event_type, value FROM events WHERE event_type = 'error'",
    "q_random_sample": "SELECT vec_id, label FROM embeddings ORDER BY md5(vec_id || '|7'), vec_id LIMIT 50",
    "q_weighted_sample": "SELECT event_id FROM events WHERE value > 0 ORDER BY -ln((('0x' || md5(event_id || '|7')[1:12])::BIGINT::DOUBLE + 1) / 281474976710657.0) / value, event_id LIMIT 50",
    "q_batch_sizes": f"SELECT count(*) AS n_batches, sum(n)::BIGINT AS total, median(n)::DOUBLE AS median FROM (SELECT {_HEX.format('vec_id', 0)} % 10 AS b, count(*) AS n FROM embeddings GROUP BY 1)",
    "q_batch_assign": f"SELECT vec_id, ({_HEX.format('vec_id', 0)} % 10)::INT AS batch_id FROM embeddings",
    "q_birth_targets": "SELECT user_id, round(sum(value / 100), 6) AS mass FROM events WHERE value / 100 > 0.5 GROUP BY user_id HAVING sum(value / 100) >= 20",
    "q_merge_pairs_total_size": _K + " SELECT *, row_number() OVER (ORDER BY total DESC, k_a, k_b) AS rank FROM (SELECT a.k AS k_a, b.k AS k_b, a.n + b.n AS total FROM c a JOIN c b ON a.k < b.k)",
    "q_delete_target": _K + " SELECT k, n FROM c WHERE n <= 600 ORDER BY n DESC, k LIMIT 1",
    "q_stick_counts": _K + " SELECT k, n, n_later FROM l",
    "q_stick_probs": _K + ", r AS (SELECT k, (n + 1) / (n + n_later + 6)::DOUBLE AS rho FROM l) SELECT k, round(rho, 6) AS rho, round(rho * exp(coalesce(sum(ln(1 - rho)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS weight FROM r",
    "q_two_tier_sort": "SELECT *, row_number() OVER (ORDER BY n DESC, first DESC, c_nationkey) AS place FROM (SELECT c_nationkey, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1)",
    "q_active_vs_eliminated": "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < '1996-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1996-01-01') SELECT o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM b) THEN 'active' ELSE 'eliminated' END AS status FROM a",
    "q_run_filter": _LG + " SELECT job, task, lap, loss FROM lg WHERE job = 3 AND task % 2 = 0",
    "q_option_diffs": _LG + " SELECT * FROM (SELECT 'K' AS key, count(DISTINCT job) AS n_values FROM lg UNION ALL SELECT 'alg', count(DISTINCT task % 2) FROM lg) WHERE n_values > 1",
    "q_rank_runs": _LG + ", r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY loss, task) AS rank, count(*) OVER (PARTITION BY job) AS n FROM fin) SELECT job, task, loss, rank, n, CASE WHEN rank = 1 THEN 'best' WHEN rank = n THEN 'worst' WHEN n > 3 AND rank = ceil(n / 2.0) THEN 'median' END AS place FROM r",
    "q_best_job": _LG + ", s AS (SELECT job % 3 AS grid, job, round(-min(loss), 6) AS score FROM fin GROUP BY ALL) SELECT grid, job, score FROM (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY score DESC, job) AS k FROM s) WHERE k = 1",
    "q_keff_per_lap": _LG + ", c AS (SELECT lap, job, sum(loss) AS n FROM lg GROUP BY ALL) SELECT lap, count(*) AS k_trained, count(*) FILTER (WHERE n > 800) AS k_effective FROM c GROUP BY lap",
    "q_nearest_checkpoint": _LG + " SELECT task, lap FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY abs(lap - 17.5), lap) AS k FROM lg WHERE lap % 5 = 0) WHERE k = 1",
    "q_loss_delta": _LG + " SELECT task, lap, loss, round(loss - lag(loss) OVER (PARTITION BY task ORDER BY lap), 6) AS delta FROM lg",
    "q_misaligned": _NC + ", m AS (SELECT found, label, count(*) AS c FROM nr GROUP BY ALL) SELECT found AS nearest, sum(c)::BIGINT AS n, round((sum(c) - max(c)) / sum(c)::DOUBLE, 6) AS share FROM m GROUP BY found",
    "q_label_resp": "SELECT vec_id, k, CASE WHEN k = (CASE WHEN label BETWEEN 0 AND 3 THEN label ELSE 4 END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM embeddings, range(6) t(k)",
    "q_subdivided_blocks": _EV + ", z AS (SELECT *, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS z, CASE WHEN pt = 'click' THEN 0 WHEN pt IS NOT NULL THEN 1 END AS pz FROM p), b AS (SELECT *, sum((z IS DISTINCT FROM pz)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM z) SELECT event_id, z * 2 + ntile(2) OVER (PARTITION BY user_id, b ORDER BY ts, event_id) - 1 AS sub FROM b",
    "q_word_matrix": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE word = '{w}')::DOUBLE AS {w}" for w in ("the", "this", "our", "die")) + " FROM w WHERE word IN ('the', 'this', 'our', 'die') GROUP BY doc_id",
    "q_doc_resp": _TR + " SELECT doc_id, k, round(r, 6) AS r FROM dr",
    "q_word_resp": _TR + " SELECT b.word, dr.k, round(avg(dr.r), 6) AS r FROM b JOIN dr USING (doc_id) GROUP BY ALL",
    "q_move_budget": _K + ", t AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS tier FROM c) SELECT k, n, tier FROM (SELECT *, sum(n) OVER (ORDER BY tier) AS run FROM t) WHERE run <= 5000",
    "q_fill_subset": "SELECT event_id, CASE WHEN value > 50 THEN -value ELSE value END AS value FROM events",
    "q_confusion": _NC + " SELECT label, found AS nearest, count(*) AS n FROM nr GROUP BY ALL",
    "q_hamming": _NC + " SELECT count(*) AS n, round(avg((label IS DISTINCT FROM found)::INT), 6) AS distance FROM nr WHERE label >= 0",
    "q_auc_ranksum": "WITH r AS (SELECT event_type = 'purchase' AS pos, avg(i) OVER (PARTITION BY value) AS mid FROM (SELECT *, row_number() OVER (ORDER BY value) AS i FROM events)), t AS (SELECT count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, sum(mid) FILTER (WHERE pos) AS s FROM r) SELECT n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM t",
}
QUERIES = {k: globals()[k] for k in SQL}
