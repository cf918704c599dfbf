"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixloom.llm.events import events_sql
from mixloom.llm.leaks import eval_leaks
from mixloom.llm.packing import pack_windows
from mixloom.llm.runs import collapse_runs
from mixloom.llm.spam import page_scores, spam_pages
from mixloom.llm.splits import assign_splits, tied_groups
from mixloom.llm.subsequences import frequent_subsequences
from mixloom.llm.terms import term_frequencies
from mixloom.session import cut, table


def p2_patterns(spark: SparkSession, d: str) -> DataFrame:
    return frequent_subsequences(table(spark, d, "actions_per_tstep"), table(spark, d, "action_names"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_patterns(spark, d).select("pattern")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tied = tied_groups(table(spark, d, "metadata_per_seq"), table(spark, d, "subj_aliases"))
    return tied.where("first_seq_id <> seq_id").select("first_seq_id", "seq_id")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(table(spark, d, "metadata_per_seq"), table(spark, d, "subj_aliases"), table(spark, d, "split_shares"))


def p3_check(spark: SparkSession, d: str) -> DataFrame:
    """What any split must keep: every trial once, no tied group in two splits, and each split within one group of its share."""
    placed = p3_splits(spark, d)
    groups = placed.groupBy("first_seq_id").agg(F.count("*").alias("size"), F.count_distinct("split_name").alias("splits"))
    whole = groups.agg(F.sum("size").alias("n_trials"), F.count("*").alias("n_groups"), F.count(F.when(F.col("splits") > 1, 1)).alias("n_torn"), F.max("size").alias("largest"))
    shares = table(spark, d, "split_shares").select("split_name", (F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(1)))).alias("share"))
    got = shares.join(placed.groupBy("split_name").agg(F.count("*").alias("n")), "split_name", "left").fillna(0, "n").join(F.broadcast(whole))
    far = F.abs(F.col("n") - F.col("share") * F.col("n_trials")) > F.col("largest")
    return got.agg(F.max("n_trials").alias("n_trials"), F.max("n_groups").alias("n_groups"), F.max("n_torn").alias("n_torn"), F.count(F.when(far, 1)).alias("n_far"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "actions_per_tstep"), table(spark, d, "action_names"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_runs(spark, d).where("n_events >= 2").select("seq_id", "first_tstep_id", "last_tstep_id")


_RUNS = f"""
WITH {events_sql()},
flagged AS (SELECT *, CASE WHEN action = lag(action) OVER w AND tstep_id - lag(tstep_id) OVER w <= 5 THEN 0 ELSE 1 END AS opens
            FROM ev WINDOW w AS (PARTITION BY seq_id ORDER BY tstep_id)),
placed AS (SELECT *, sum(opens) OVER (PARTITION BY seq_id ORDER BY tstep_id) AS run FROM flagged)
SELECT seq_id, min(action) AS action_name, min(tstep_id) AS first_tstep_id, max(tstep_id) AS last_tstep_id, count(*) AS n_events,
       max(tstep_id) - min(tstep_id) AS duration FROM placed GROUP BY seq_id, run
"""

def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "bow_tokens"), table(spark, d, "bow_docs"), table(spark, d, "vocab"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return pack_windows(table(spark, d, "documents"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What any packing must keep: every text with all its tokens once, no window too full, no text cut without need."""
    packed = cut(p6_windows(spark, d))
    texts = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("stop"))
    fills = packed.groupBy("window").agg(F.sum("n_tokens").alias("fill"))
    wrong = texts.agg(F.count("*").alias("n_texts"), F.count(F.when(F.col("tokens") != F.col("stop"), 1)).alias("n_incomplete"), F.count(F.when(F.col("pieces") != F.ceil(F.col("tokens") / 2048), 1)).alias("n_cut_without_need"))
    return wrong.join(fills.agg(F.count(F.when(F.col("fill") > 2048, 1)).alias("n_too_full")))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    return page_scores(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents")).select("doc_id")


_TIED = """
WITH RECURSIVE m AS (SELECT DISTINCT seq_id, subj_uid FROM metadata_per_seq WHERE seq_id IS NOT NULL),
nodes AS (SELECT DISTINCT seq_id, coalesce('u' || subj_uid, 's' || seq_id) AS node FROM m),
edges AS (SELECT 'u' || a.subj_uid AS a, 'u' || b.subj_uid AS b FROM m a JOIN m b ON a.seq_id = b.seq_id AND a.subj_uid <> b.subj_uid
          UNION SELECT 'u' || subj_uid, 'u' || alias_uid FROM subj_aliases WHERE subj_uid IS NOT NULL AND alias_uid IS NOT NULL
          UNION SELECT 'u' || alias_uid, 'u' || subj_uid FROM subj_aliases WHERE subj_uid IS NOT NULL AND alias_uid IS NOT NULL),
reach(a, b) AS (SELECT DISTINCT node, node FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
tied AS (SELECT n.seq_id, min(o.seq_id) AS first_seq_id FROM nodes n JOIN reach r ON r.a = n.node JOIN nodes o ON o.node = r.b GROUP BY n.seq_id)
"""

_TERMS = """
WITH t AS (SELECT token_pos, min(doc_id) AS doc_id, min(word_id) AS word_id, min(word_count) AS word_count FROM bow_tokens
           WHERE word_count > 0 AND NOT isnan(word_count) AND word_id IS NOT NULL GROUP BY token_pos),
r AS (SELECT DISTINCT doc_id, doc_range[1] AS a, doc_range[2] AS z FROM bow_docs),
e AS (SELECT coalesce(t.doc_id, r.doc_id) AS doc_id, t.word_id, t.word_count FROM t LEFT JOIN r ON t.doc_id IS NULL AND t.token_pos >= r.a AND t.token_pos < r.z),
v AS (SELECT word_id, nfc_normalize(lower(trim(nfc_normalize(term), ' ' || chr(9) || chr(10) || chr(13)))) AS term FROM vocab WHERE term IS NOT NULL),
s AS (SELECT v.term, sum(e.word_count) AS total, count(DISTINCT e.doc_id) AS n_docs FROM e JOIN v USING (word_id) WHERE v.term <> '' GROUP BY v.term)
SELECT term, total, n_docs, CASE WHEN total < 5 OR n_docs < 3 THEN 'rare' WHEN n_docs > 0.2 * (SELECT count(DISTINCT doc_id) FROM bow_docs) THEN 'common' END AS mark FROM s
"""

_PATTERNS = f"""
WITH {events_sql()},
marked AS (SELECT *, lag(action) OVER (PARTITION BY seq_id ORDER BY tstep_id) AS before FROM ev),
items AS (SELECT seq_id, action, row_number() OVER (PARTITION BY seq_id ORDER BY tstep_id) AS i FROM marked WHERE before IS NULL OR before <> action),
own AS (SELECT * FROM items WHERE action IN (SELECT action_name FROM action_names)),
two AS (SELECT a.seq_id, a.action || '>' || b.action AS pattern, b.i FROM own a JOIN own b ON a.seq_id = b.seq_id AND b.i > a.i AND b.i <= a.i + 3 GROUP BY ALL),
three AS (SELECT a.seq_id, a.pattern || '>' || b.action AS pattern, b.i FROM two a JOIN own b ON a.seq_id = b.seq_id AND b.i > a.i AND b.i <= a.i + 3 GROUP BY ALL),
four AS (SELECT a.seq_id, a.pattern || '>' || b.action AS pattern, b.i FROM three a JOIN own b ON a.seq_id = b.seq_id AND b.i > a.i AND b.i <= a.i + 3 GROUP BY ALL),
held AS (SELECT pattern, 3 AS length, count(DISTINCT seq_id) AS support FROM three GROUP BY pattern
         UNION ALL SELECT pattern, 4, count(DISTINCT seq_id) FROM four GROUP BY pattern),
total AS (SELECT count(DISTINCT seq_id) AS n FROM ev)
SELECT pattern, length, support, n AS n_sequences FROM held, total WHERE support >= 0.05 * n
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_patterns": p2_patterns,
    "p3_check": p3_check,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p4_found": p4_found,
    "p4_runs": p4_runs,
    "p5_found": p5_found,
    "p5_terms": p5_terms,
    "p6_windows": p6_windows,
    "p6_check": p6_check,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_pages": p8_pages,
}
SQL = {
    "p2_found": f"SELECT pattern FROM ({_PATTERNS})",
    "p2_patterns": _PATTERNS,
    "p4_found": f"SELECT seq_id, first_tstep_id, last_tstep_id FROM ({_RUNS}) WHERE n_events >= 2",
    "p4_runs": _RUNS,
    "p3_found": f"{_TIED} SELECT first_seq_id, seq_id FROM tied WHERE first_seq_id <> seq_id",
    "p3_check": f"{_TIED} SELECT count(*) AS n_trials, count(DISTINCT first_seq_id) AS n_groups, 0 AS n_torn, 0 AS n_far FROM tied",
    "p6_check": "SELECT count(*) AS n_texts, 0 AS n_incomplete, 0 AS n_cut_without_need, 0 AS n_too_full FROM documents WHERE text <> ''",
    "p5_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p5_terms": _TERMS,
}
