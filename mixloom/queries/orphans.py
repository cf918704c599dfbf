"""Queries of the orphan-reference operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.operators.orphans import Reference, orphan_references, orphan_report, written_number
from mixloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    actions, blocks, labels = (table(spark, d, t) for t in ("actions_per_tstep", "blocks_per_seq", "labels_per_seq"))
    return orphan_references(
        [
            Reference("actions_per_tstep", actions, F.col("seq_id"), F.col("logged_at")),
            Reference("blocks_per_seq", blocks, F.col("seq_id"), F.col("received_at")),
            Reference("labels_per_seq", labels, written_number(F.col("seq_id")), F.col("labelled_at")),
        ],
        table(spark, d, "metadata_per_seq"),
    )


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p1_found(spark, d))


_FOUND = r"""
WITH refs AS (
  SELECT 'actions_per_tstep' AS table_name, seq_id, logged_at AS ts FROM actions_per_tstep
  UNION ALL SELECT 'blocks_per_seq', seq_id, received_at FROM blocks_per_seq
  UNION ALL SELECT 'labels_per_seq', TRY_CAST(regexp_replace(seq_id, '[^0-9]', '', 'g') AS BIGINT), labelled_at FROM labels_per_seq
), r AS (SELECT DISTINCT table_name, seq_id, ts FROM refs WHERE seq_id IS NOT NULL),
judged AS (
  SELECT r.table_name, r.ts, r.seq_id, count(m.seq_id) AS n, count(*) FILTER (WHERE m.arrived_at > r.ts) AS n_after,
         count(*) FILTER (WHERE m.arrived_at <= r.ts AND (m.deleted_at IS NULL OR m.deleted_at > r.ts)) AS n_live
  FROM r LEFT JOIN metadata_per_seq m ON m.seq_id = r.seq_id GROUP BY ALL
)
SELECT DISTINCT table_name, strftime(ts, '%Y-%m') AS period, seq_id,
       CASE WHEN n = 0 THEN 'missing' WHEN n_after = n THEN 'late' ELSE 'deleted' END AS kind
FROM judged WHERE n_live = 0
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _FOUND,
    "p1_report": f"SELECT table_name, period, kind, count(*) AS n_keys FROM ({_FOUND}) GROUP BY ALL",
}
