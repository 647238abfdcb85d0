"""Queries on content classes and groups (families C and D) and on names and messages (B and M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import hashing as H
from stratafold.functions import paths as P
from stratafold.functions import text as X
from stratafold.operators import funnel, groups
from stratafold.plans.sqlviews import DUP, INV, category, problem
from stratafold.sources import inventory as I
from stratafold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "c_funnel_classes",
    """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, count(*) OVER (PARTITION BY size, h) AS k FROM d)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CASE WHEN k > 1 OR size = 0 THEN size || ':' || h ELSE 'u:' || doc_id END AS class_id FROM n""",
)
def c_funnel_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    inventory = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    content = docs.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return funnel.classify(inventory, content, "doc_id").select("doc_id", "size", "class_id")


@query(
    "c_cache_hits",
    """WITH c AS (SELECT path, size, mtime_ns, ctime_ns, dev, ino FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC, size DESC NULLS LAST, mtime_ns DESC NULLS LAST, ctime_ns DESC NULLS LAST, dev DESC NULLS LAST, ino DESC NULLS LAST) AS r FROM file_snapshots WHERE path IS NOT NULL AND snapshot_no = (SELECT max(snapshot_no) FROM file_snapshots) - 1) WHERE r = 1),
    n AS (SELECT path, size, mtime_ns, ctime_ns, dev, ino FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC, size DESC NULLS LAST, mtime_ns DESC NULLS LAST, ctime_ns DESC NULLS LAST, dev DESC NULLS LAST, ino DESC NULLS LAST) AS r FROM file_snapshots WHERE path IS NOT NULL AND snapshot_no = (SELECT max(snapshot_no) FROM file_snapshots)) WHERE r = 1)
    SELECT n.path, coalesce(c.path IS NOT NULL AND n.size IS NOT DISTINCT FROM c.size AND n.mtime_ns IS NOT DISTINCT FROM c.mtime_ns AND (c.dev = 0 OR
      (n.ctime_ns IS NOT DISTINCT FROM c.ctime_ns AND n.dev IS NOT DISTINCT FROM c.dev AND n.ino IS NOT DISTINCT FROM c.ino)), false) AS hit FROM n LEFT JOIN c ON n.path = c.path""",
)
def c_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.plans.state_queries import snapshot

    cache = snapshot(spark, d, 1).withColumn("kind", F.lit("f")).withColumn("digest", F.sha2("path", 256))
    hits, misses = funnel.cached_digests(snapshot(spark, d, 0), cache)
    return hits.select("path", F.lit(True).alias("hit")).unionByName(misses.select("path", F.lit(False).alias("hit")))


@query(
    "d_dup_groups",
    f"WITH {DUP} SELECT class_id, max(size) AS size, count(*) AS copies, max(size) * (count(*) - 1) AS wasted FROM dup GROUP BY class_id HAVING count(*) >= 2 ORDER BY wasted DESC, class_id",
)
def d_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.duplicate_groups(I.duplicates(I.files(spark, d))).orderBy(F.desc("wasted"), "class_id")


@query(
    "d_storage_families",
    f"""WITH {DUP},
    f AS (SELECT class_id, CASE WHEN storage_dev IS NOT NULL AND storage_off IS NOT NULL THEN 's:' || storage_dev || ':' || storage_off ELSE 'p:' || path END AS fam,
      max(least(coalesce(alloc, size), size)) AS a, count(*) AS n, max(size) AS size FROM dup GROUP BY 1, 2),
    g AS (SELECT class_id, max(size) AS size, CAST(sum(n) AS BIGINT) AS copies, count(*) AS families, CAST(CASE WHEN count(*) > 1 THEN sum(a) - min(a) ELSE 0 END AS BIGINT) AS freeable FROM f GROUP BY 1)
    SELECT *, freeable AS wasted FROM g WHERE copies >= 2""",
)
def d_storage_families(spark: SparkSession, d: str) -> DataFrame:
    return groups.storage_families(I.duplicates(I.files(spark, d)))


@query(
    "d_group_waste",
    """WITH g AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY found_at DESC) AS r FROM file_groups) WHERE r = 1),
    n AS (SELECT group_id, size, len(list_distinct(list_filter(paths, lambda p: p IS NOT NULL))) AS copies, families, freeable FROM g)
    SELECT group_id, CASE WHEN freeable >= 0 THEN freeable ELSE size * (greatest(1, CASE WHEN families IS NULL OR families = 0 THEN copies ELSE families END) - 1) END AS wasted,
      coalesce(families > 0 AND families < copies, false) AS clones FROM n""",
)
def d_group_waste(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.operators.changes import latest_rows

    g = latest_rows(table(spark, d, "file_groups"), ["group_id"], ["found_at"], ["size", "paths", "families", "freeable"])
    g = g.withColumn("copies", F.size(F.array_distinct(F.array_compact("paths"))).cast("bigint"))
    n = F.col("families").cast("bigint")
    return g.select(
        "group_id",
        groups.group_waste(F.col("size"), F.col("copies"), n, F.col("freeable")).alias("wasted"),
        F.coalesce((n > 0) & (n < F.col("copies")), F.lit(False)).alias("clones"),
    )


@query("d_category_rollup", f"WITH {INV} SELECT {category('path')} AS category, count(*) AS files, CAST(sum(greatest(0, coalesce(size, 0))) AS BIGINT) AS bytes FROM inv GROUP BY 1")
def d_category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return groups.category_summary(I.files(spark, d))


_ENTRIES = """e AS (SELECT DISTINCT row_id, CASE status WHEN 'identical' THEN 'ready' WHEN 'different_content' THEN 'changed' WHEN 'shared_elsewhere' THEN 'offline' ELSE status END AS status,
  CASE WHEN path_a IS NULL THEN size_b ELSE size_a END AS size, compare_id AS group_id FROM folder_compare)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    named = F.when(s == "identical", "ready").when(s == "different_content", "changed").when(s == "shared_elsewhere", "offline").otherwise(s)
    size = F.when(F.col("path_a").isNull(), F.col("size_b")).otherwise(F.col("size_a"))
    return table(spark, d, "folder_compare").select("row_id", named.alias("status"), size.alias("size"), F.col("compare_id").alias("group_id")).distinct()


@query(
    "d_batch_summary",
    f"""WITH {_ENTRIES} SELECT count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT group_id) AS groups, count(*) FILTER (status = 'ready') AS ready_items,
    CAST(coalesce(sum(size) FILTER (status = 'ready'), 0) AS BIGINT) AS ready_bytes, count(DISTINCT group_id) FILTER (status = 'ready') AS ready_groups FROM e WHERE size >= 0 AND group_id IS NOT NULL""",
)
def d_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return groups.batch_summary(_entries(spark, d))


@query(
    "d_skipped_status",
    f"""WITH {_ENTRIES}, s AS (SELECT CASE WHEN size >= 0 AND group_id IS NOT NULL AND status IN ('ready', 'changed', 'offline') THEN status ELSE 'unknown' END AS status FROM e)
    SELECT status, count(*) AS items FROM s WHERE status <> 'ready' GROUP BY status""",
)
def d_skipped_status(spark: SparkSession, d: str) -> DataFrame:
    return groups.skipped_by_status(_entries(spark, d), ["ready", "changed", "offline"])


@query(
    "d_compare_counts",
    """WITH f AS (SELECT DISTINCT * FROM folder_compare)
    SELECT compare_id, coalesce(status, 'unknown') AS status, count(*) AS items, CAST(sum(CASE WHEN status = 'identical' THEN size_a ELSE 0 END) AS BIGINT) AS shared_bytes FROM f GROUP BY 1, 2""",
)
def d_compare_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "folder_compare").distinct()
    shared = F.sum(F.when(F.col("status") == "identical", F.col("size_a")).otherwise(0))
    return rows.groupBy("compare_id", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("items"), shared.alias("shared_bytes"))


@query("d_problem_rollup", f"SELECT {problem('text')} AS title, count(*) AS problems FROM documents WHERE text IS NOT NULL GROUP BY 1")
def d_problem_rollup(spark: SparkSession, d: str) -> DataFrame:
    return groups.problem_summary(table(spark, d, "documents"), "text")


@query("d_independent_copies", f"WITH {DUP} SELECT class_id, count(*) AS copies, count(DISTINCT (dev, ino)) AS inodes FROM dup WHERE dev IS NOT NULL AND ino IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (dev, ino)) >= 2")
def d_independent_copies(spark: SparkSession, d: str) -> DataFrame:
    return groups.independent_copies(I.duplicates(I.files(spark, d)).where("dev IS NOT NULL AND ino IS NOT NULL"))


@query("d_scan_totals", f"WITH {INV} SELECT count(*) AS files_seen, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes_seen, count(DISTINCT dir) AS folders FROM inv")
def d_scan_totals(spark: SparkSession, d: str) -> DataFrame:
    return I.files(spark, d).agg(F.count("*").alias("files_seen"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes_seen"), F.countDistinct("dir").alias("folders"))


@query(
    "b_aliases",
    f"""WITH {INV}, m AS (SELECT dev, ino, min(path) AS canonical FROM inv WHERE dev IS NOT NULL AND ino IS NOT NULL AND ino <> 0 GROUP BY 1, 2)
    SELECT dir, path AS alias, canonical FROM inv JOIN m USING (dev, ino) WHERE path <> canonical""",
)
def b_aliases(spark: SparkSession, d: str) -> DataFrame:
    return I.admit(I.files(spark, d))[1]


@query(
    "b_excluded",
    f"""WITH {INV} SELECT path FROM inv WHERE name IN ({", ".join(f"'{n}'" for n in I.EXCLUDED_NAMES)}) OR {" OR ".join(f"path = '{p}' OR starts_with(path, '{p}/')" for p in I.EXCLUDED_PREFIXES)}
    OR starts_with(name, '._') OR regexp_matches(lower(name), '({"|".join(s.replace(".", chr(92) + ".") for s in I.BUNDLE_SUFFIXES)})$')""",
)
def b_excluded(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return I.files(spark, d).where(I.excluded(F.col("path"), name) | I.companion(name) | I.is_bundle(name)).select("path")


@query(
    "m_names",
    f"""WITH {INV} SELECT path, {category('path')} AS category, {category('path', True)} AS report_category, lower(regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS extension,
    len(string_split(path, '/')) - 1 AS depth, nfc_normalize(name) AS nfc_name FROM inv""",
)
def m_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return I.files(spark, d).select(
        "path", X.category(p).alias("category"), X.report_category(p).alias("report_category"), P.extension(p).alias("extension"), P.depth(p).cast("bigint").alias("depth"), P.nfc(F.col("name")).alias("nfc_name")
    )


@query(
    "m_sizes",
    f"""WITH {INV}, s AS (SELECT DISTINCT size, CAST(size AS DOUBLE) AS x FROM inv WHERE size IS NOT NULL)
    SELECT size, CASE WHEN x < 1024 THEN printf('%d B', size) WHEN x < 1048576 THEN printf('%.2f KB', x / 1024) WHEN x < 1073741824 THEN printf('%.2f MB', x / 1048576) WHEN x < 1099511627776 THEN printf('%.2f GB', x / 1073741824) ELSE printf('%.2f TB', x / 1099511627776) END AS report,
    CASE WHEN x < 1024 THEN printf('%d Б', size) WHEN x < 1048576 THEN printf('%.1f КБ', x / 1024) WHEN x < 1073741824 THEN printf('%.1f МБ', x / 1048576) WHEN x < 1099511627776 THEN printf('%.1f ГБ', x / 1073741824) ELSE printf('%.1f ТБ', x / 1099511627776) END AS human,
    replace(format('{{:,}}', size), ',', ' ') AS exact FROM s""",
)
def m_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("size")
    rows = I.files(spark, d).where("size IS NOT NULL").select("size").distinct()
    return rows.select("size", X.report_bytes(n).alias("report"), X.human_bytes(n).alias("human"), X.exact_amount(n).alias("exact"))


@query("m_csv_guard", """SELECT doc_id, CASE WHEN regexp_matches(text, '^[ \\t\\r]*[=+\\-@]') THEN '''' || text ELSE text END AS safe FROM documents""")
def m_csv_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.csv_safe(F.col("text")).alias("safe"))


@query("m_html", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM documents""")
def m_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.html_escape(F.col("text")).alias("html"))


@query("m_redact")
def m_redact(spark: SparkSession, d: str) -> DataFrame:
    """Java's expressions look behind, DuckDB's can't: tested on fixed cases."""
    return table(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("redacted"))


@query("m_first_path", """SELECT doc_id, nullif(regexp_replace(regexp_extract(text, '(?m)(/[^''"]*?)(: |[''"]|$)', 1), '[.,;:)\\]}»]+$', ''), '') AS first FROM documents""")
def m_first_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.first_path(F.col("text")).alias("first"))


@query(
    "m_storage_level",
    """WITH v AS (SELECT CASE WHEN starts_with(path, '/Volumes/') THEN array_to_string(string_split(path, '/')[1:3], '/') ELSE '/' END AS volume, size FROM files),
    t AS (SELECT volume, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total, CAST(max(coalesce(size, 0)) AS BIGINT) AS free FROM v GROUP BY 1),
    c AS (SELECT *, greatest(536870912, least(2147483648, CAST(floor(total * 0.002) AS BIGINT))) AS critical, greatest(5368709120, least(10737418240, CAST(floor(total * 0.02) AS BIGINT))) AS l FROM t)
    SELECT volume, critical, greatest(critical + 1, l) AS low, CASE WHEN free < critical THEN 'critical' WHEN free < greatest(critical + 1, l) THEN 'low' ELSE 'sufficient' END AS level FROM c""",
)
def m_storage_level(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "files").where("path IS NOT NULL").groupBy(P.volume(F.col("path")).alias("volume"))
    t = v.agg(F.sum(F.coalesce("size", F.lit(0))).alias("total"), F.max(F.coalesce("size", F.lit(0))).alias("free"))
    critical, low = X.storage_thresholds(F.col("total"))
    return t.select("volume", critical.alias("critical"), low.alias("low"), X.storage_level(F.col("total"), F.col("free")).alias("level"))


@query(
    "m_dhash",
    """WITH e AS (SELECT vec_id, embedding FROM embeddings)
    SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda k: CASE WHEN embedding[k] > embedding[k + 1] THEN CAST(1 AS BIGINT) << (63 - k) ELSE 0 END)) AS BIGINT) AS hash FROM e""",
)
def m_dhash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", H.dhash(F.col("embedding"), 64, 1).alias("hash"))
