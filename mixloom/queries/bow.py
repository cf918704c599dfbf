"""Queries over bags of words, from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixloom.functions.special import digamma_sql
from mixloom.operators import bow
from mixloom.session import table

LAM = 0.1
COUNT_EDGES = [1, 2, 3, 4, 10, 100]
DF_EDGES = [0, 1, 2, 3, 5, 10, 50, 100, 1000]


def _bag(spark, d, *keep):
    return bow.count_words(table(spark, d, "documents"), *keep)


def _r(c, n=6):
    return F.round(c, n).alias(c)


def _topics(spark, d):
    bag = _bag(spark, d, "source")
    n_vocab = F.lit(bag.agg(F.count_distinct("word")).first()[0])
    return bow.topic_word_counts(bag.where("source IS NOT NULL"), "source"), n_vocab


def q_bow_counts(spark, d):
    return _bag(spark, d)


def q_vocab_df(spark, d):
    return bow.vocabulary(_bag(spark, d))


def q_doc_freq_hist(spark, d):
    vocab = table(spark, d, "vocab").where("term IS NOT NULL").select(F.col("term").alias("word"))
    words = _bag(spark, d)
    return bow.doc_frequency_histogram(words, DF_EDGES, words.select("word").unionByName(vocab))


def q_wordcount_hist(spark, d):
    return bow.histogram(_bag(spark, d), F.col("word_count"), COUNT_EDGES, "n_entries")


def q_doc_stats_percentiles(spark, d):
    return bow.doc_size_percentiles(_bag(spark, d))


def q_ldac_lines(spark, d):
    bag = _bag(spark, d)
    return bow.ldac_lines(bag.join(bow.dense_ids(bag, "word", "word_id"), "word"))


def q_docs_min_tokens(spark, d):
    return bow.docs_with_tokens(_bag(spark, d), 100)


def q_threshold_tokens(spark, d):
    from pyspark.sql import Window

    bag = _bag(spark, d)
    most = F.max("word_count").over(Window.partitionBy("doc_id"))
    return bow.threshold_tokens(bag.withColumn("w", F.col("word_count") / most), 0.25)


def q_topic_word_counts(spark, d):
    return _topics(spark, d)[0]


def q_top_words(spark, d):
    return bow.top_words(_topics(spark, d)[0], "source", 10)


def q_dirichlet_cumulant(spark, d):
    counts, v = _topics(spark, d)
    return bow.dirichlet_cumulants(counts, "source", LAM, v).select("source", "n_words", "total", F.round("cumulant", 4).alias("cumulant"))


def q_doc_topic_loglik(spark, d):
    bag = _bag(spark, d, "lang")
    v = F.lit(bag.agg(F.count_distinct("word")).first()[0])
    counts = bow.topic_word_counts(bag.where("lang IS NOT NULL"), "lang")
    return bow.doc_topic_loglik(bag.drop("lang"), bow.topic_log_probs(counts, "lang", LAM, v), "lang").select("doc_id", "lang", F.round("loglik", 3).alias("loglik"))


def q_merge_gap_mult(spark, d):
    bag = _bag(spark, d, "lang")
    v = F.lit(bag.agg(F.count_distinct("word")).first()[0])
    gaps = bow.merge_gaps(bow.topic_word_counts(bag.where("lang IS NOT NULL"), "lang"), "lang", LAM, v)
    return gaps.select("topic_a", "topic_b", F.round("gap", 3).alias("gap"))


def q_unseen_vocab_counts(spark, d):
    return bow.unseen_vocabulary(_bag(spark, d))


def q_word_cooccur(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")  # then the bag needs no shuffle of words
    return bow.cooccurrence(bow.count_words(docs))


def q_doc_usage(spark, d):
    bag = _bag(spark, d, "lang").where("lang IS NOT NULL")
    counts = bow.topic_word_counts(bag, "lang")
    from pyspark.sql import Window

    order = Window.partitionBy("word").orderBy(F.desc("word_count"), "lang")
    home = counts.withColumn("k", F.row_number().over(order)).where("k = 1").select("word", F.col("lang").alias("topic"))
    mass = bag.join(home, "word").groupBy("doc_id", "topic").agg(F.sum("word_count").alias("mass"))
    return bow.doc_usage(mass, "topic")


def q_doc_token_split(spark, d):
    parts = bow.token_split(_bag(spark, d))
    return parts.groupBy("doc_id", "part").agg(F.count("*").alias("n_unique"), F.sum("word_count").alias("n_tokens"))


def q_bern_suffstats(spark, d):
    return bow.bernoulli_counts(_bag(spark, d, "lang").where("lang IS NOT NULL"), "lang")


def _bag_sql(keep=""):
    k = f", {keep}" if keep else ""
    return f"(SELECT doc_id{k}, word, count(*)::DOUBLE AS word_count FROM (SELECT doc_id{k}, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY doc_id{k}, word)"


def _bins_sql(edges):
    return "(VALUES " + ", ".join(f"({i}, {float(e)}, {float(edges[i + 1]) if i + 1 < len(edges) else '1e300'})" for i, e in enumerate(edges)) + ") AS b(bin, lower, upper)"


_W = f"WITH bag AS {_bag_sql()} "
_S = f"WITH bag AS {_bag_sql('source')}, c AS (SELECT source, word, sum(word_count) AS word_count FROM bag WHERE source IS NOT NULL GROUP BY ALL), v AS (SELECT count(DISTINCT word) AS n FROM bag) "
_L = f"WITH bag AS {_bag_sql('lang')}, c AS (SELECT lang, word, sum(word_count) AS word_count FROM bag WHERE lang IS NOT NULL GROUP BY ALL), v AS (SELECT count(DISTINCT word) AS n FROM bag) "

SQL = {
    "q_bow_counts": _W + "SELECT * FROM bag",
    "q_vocab_df": _W + "SELECT word, count(*) AS n_docs, sum(word_count) AS total FROM bag GROUP BY word",
    "q_doc_freq_hist": _W + f", f AS (SELECT w.word, count(bag.doc_id) AS n_docs FROM (SELECT word FROM bag UNION SELECT term FROM vocab WHERE term IS NOT NULL) w LEFT JOIN bag USING (word) GROUP BY w.word) SELECT bin, lower, count(f.word) AS n_words FROM {_bins_sql(DF_EDGES)} LEFT JOIN f ON f.n_docs >= lower AND f.n_docs < upper GROUP BY ALL",
    "q_wordcount_hist": _W + f"SELECT bin, lower, count(word) AS n_entries FROM {_bins_sql(COUNT_EDGES)} LEFT JOIN bag ON word_count >= lower AND word_count < upper GROUP BY ALL",
    "q_doc_stats_percentiles": _W + ", s AS (SELECT count(*) AS u, sum(word_count) AS t FROM bag GROUP BY doc_id) SELECT p AS percent, (SELECT quantile_cont(u::DOUBLE, [0.0, 0.05, 0.5, 0.95, 1.0]) FROM s)[i] AS n_unique, (SELECT quantile_cont(t, [0.0, 0.05, 0.5, 0.95, 1.0]) FROM s)[i] AS n_tokens FROM (VALUES (1, 0), (2, 5), (3, 50), (4, 95), (5, 100)) x(i, p)",
    "q_ldac_lines": _W + ", ids AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM bag)) SELECT doc_id, count(*) || ' ' || string_agg(word_id || ':' || word_count::BIGINT, ' ' ORDER BY word_id) AS line FROM bag JOIN ids USING (word) GROUP BY doc_id",
    "q_docs_min_tokens": _W + "SELECT doc_id, sum(word_count) AS n_tokens FROM bag GROUP BY doc_id HAVING sum(word_count) >= 100",
    "q_threshold_tokens": _W + ", w AS (SELECT *, word_count / max(word_count) OVER (PARTITION BY doc_id) AS w FROM bag) SELECT doc_id, word, ceil(word_count * w) AS word_count FROM w WHERE w >= 0.25",
    "q_topic_word_counts": _S + "SELECT * FROM c",
    "q_top_words": _S + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY word_count DESC, word) AS rank FROM c) WHERE rank <= 10",
    "q_dirichlet_cumulant": _S + f"SELECT source, count(*) AS n_words, sum(word_count) AS total, round(lgamma(sum(word_count) + any_value(n) * {LAM}) - sum(lgamma(word_count + {LAM})) - (any_value(n) - count(*)) * lgamma({LAM}), 4) AS cumulant FROM c, v GROUP BY source",
    "q_doc_topic_loglik": _L + f", t AS (SELECT lang, sum(word_count) + any_value(n) * {LAM} AS total FROM c, v GROUP BY lang), docs AS (SELECT doc_id, word, sum(word_count) AS ct FROM bag GROUP BY ALL) SELECT doc_id, t.lang, round(sum(ct * ({digamma_sql(f'coalesce(c.word_count, 0) + {LAM}')} - {digamma_sql('t.total')})), 3) AS loglik FROM docs CROSS JOIN t LEFT JOIN c ON c.lang = t.lang AND c.word = docs.word GROUP BY doc_id, t.lang",
    "q_merge_gap_mult": _L + f", p AS (SELECT a.lang AS topic_a, b.lang AS topic_b FROM (SELECT DISTINCT lang FROM c) a, (SELECT DISTINCT lang FROM c) b WHERE a.lang < b.lang), words AS (SELECT DISTINCT word FROM bag), full_ AS (SELECT p.*, w.word, coalesce(ca.word_count, 0) AS na, coalesce(cb.word_count, 0) AS nb FROM p CROSS JOIN words w LEFT JOIN c ca ON ca.lang = topic_a AND ca.word = w.word LEFT JOIN c cb ON cb.lang = topic_b AND cb.word = w.word) SELECT topic_a, topic_b, round((lgamma(sum(na + {LAM})) - sum(lgamma(na + {LAM}))) + (lgamma(sum(nb + {LAM})) - sum(lgamma(nb + {LAM}))) - (lgamma(count(*) * {LAM}) - count(*) * lgamma({LAM})) - (lgamma(sum(na + nb + {LAM})) - sum(lgamma(na + nb + {LAM}))), 3) AS gap FROM full_ GROUP BY ALL",
    "q_unseen_vocab_counts": _W + "SELECT doc_id, (SELECT count(DISTINCT word) FROM bag) - count(*) AS n_unseen FROM bag GROUP BY doc_id",
    "q_word_cooccur": _W + "SELECT a.word AS word_a, b.word AS word_b, count(*) AS n_docs, sum(a.word_count * b.word_count) AS product FROM bag a JOIN bag b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY ALL",
    "q_doc_usage": _L + ", home AS (SELECT word, lang AS topic FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY word_count DESC, lang) AS k FROM c) WHERE k = 1), m AS (SELECT doc_id, topic, sum(word_count) AS mass FROM bag JOIN home USING (word) WHERE lang IS NOT NULL GROUP BY ALL), s AS (SELECT topic, mass / sum(mass) OVER (PARTITION BY doc_id) AS share FROM m) SELECT topic, count(*) FILTER (WHERE share > 0.01) AS n_docs FROM s GROUP BY topic",
    "q_doc_token_split": _W + "SELECT doc_id, CASE WHEN md5(doc_id || '|' || word)[1] IN ('0', '1', '2', '3') THEN 'heldout' ELSE 'train' END AS part, count(*) AS n_unique, sum(word_count) AS n_tokens FROM bag GROUP BY ALL",
    "q_bern_suffstats": _L + ", n AS (SELECT lang, count(DISTINCT doc_id) AS n FROM bag WHERE lang IS NOT NULL GROUP BY lang), h AS (SELECT lang, word, count(*) AS count1 FROM bag WHERE lang IS NOT NULL GROUP BY ALL) SELECT lang, word, count1, n - count1 AS count0 FROM h JOIN n USING (lang)",
}
QUERIES = {k: globals()[k] for k in SQL}
