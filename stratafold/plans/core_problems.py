"""Queries of the general problems 3 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators.changes import snapshot_changes
from stratafold.operators.middle import middle_entries
from stratafold.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_snapshots").select("snapshot_no", "path", "mtime_ns", "ino", "seen_at", "received_at")
    out = snapshot_changes(rows, "path", "snapshot_no", ["mtime_ns", "ino"], ["seen_at", "received_at"])
    return out.select(F.col("snapshot_no").cast("bigint").alias("snapshot_no"), "path", "change_kind")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    files = middle_entries(table(spark, d, "files"), "size", "mtime_ns", "file_id")
    groups = table(spark, d, "file_groups").withColumn("at", F.unix_micros(F.col("found_at").cast("timestamp")))
    groups = middle_entries(groups.withColumn("at", F.coalesce("at", F.lit(-(2**63)))), "size", "at", "group_id")
    return files.select(F.lit("files").alias("tbl"), "size", F.col("file_id").alias("id")).unionByName(
        groups.select(F.lit("file_groups").alias("tbl"), "size", F.col("group_id").alias("id"))
    )


QUERIES = {"p3_found": p3_found, "p4_found": p4_found}

SQL = {
    "p3_found": """
WITH one AS (
  SELECT snapshot_no, path, mtime_ns, ino FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY seen_at DESC NULLS LAST, received_at DESC NULLS LAST,
      mtime_ns DESC NULLS LAST, ino DESC NULLS LAST) AS r
    FROM file_snapshots WHERE path IS NOT NULL) WHERE r = 1),
pairs AS (
  SELECT coalesce(n.snapshot_no, o.snapshot_no + 1) AS snapshot_no, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
      WHEN n.mtime_ns IS DISTINCT FROM o.mtime_ns OR n.ino IS DISTINCT FROM o.ino THEN 'changed' END AS change_kind
  FROM one n FULL JOIN one o ON n.path = o.path AND n.snapshot_no = o.snapshot_no + 1)
SELECT CAST(snapshot_no AS BIGINT) AS snapshot_no, path, change_kind FROM pairs
WHERE change_kind IS NOT NULL AND snapshot_no BETWEEN (SELECT min(snapshot_no) + 1 FROM one) AND (SELECT max(snapshot_no) FROM one)""",
    "p4_found": """
WITH f AS (SELECT DISTINCT size, mtime_ns, file_id FROM files WHERE size IS NOT NULL AND mtime_ns IS NOT NULL AND file_id IS NOT NULL),
g AS (SELECT DISTINCT size, found_at, group_id FROM file_groups WHERE size IS NOT NULL AND group_id IS NOT NULL),
r AS (
  SELECT 'files' AS tbl, size, file_id AS id, row_number() OVER (PARTITION BY size ORDER BY mtime_ns, file_id) AS k, count(*) OVER (PARTITION BY size) AS n FROM f
  UNION ALL
  SELECT 'file_groups', size, group_id, row_number() OVER (PARTITION BY size ORDER BY found_at NULLS FIRST, group_id), count(*) OVER (PARTITION BY size) FROM g)
SELECT tbl, size, id FROM r WHERE n >= 2 AND k = (n + 1) // 2""",
}
