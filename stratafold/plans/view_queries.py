"""Queries on filters and views (B17-B19, P), names (M26), mounts (A8) and transfers (N3, N4, N7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.text import category
from stratafold.operators import removal, similar, tree, views
from stratafold.plans.folder_queries import _SIDES, _compare_pairs
from stratafold.plans.sqlviews import DUP, INV
from stratafold.plans.sqlviews import category as sql_category
from stratafold.session import cut
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
    "b_profile",
    f"""WITH {INV} SELECT path FROM inv WHERE coalesce(size, 0) >= 4096 AND NOT starts_with(name, '.') AND NOT starts_with(path, '/mnt/')
    AND NOT regexp_matches(replace(lower(nfc_normalize(name)), 'ß', 'ss'), '\\.(jpg|tar\\.gz)$')""",
)
def b_profile(spark: SparkSession, d: str) -> DataFrame:
    p = views.Profile(min_size=4096, hidden=False, excluded_paths=["/mnt"], excluded_extensions=["JPG", ".tar.gz"])
    rows = I.files(spark, d).withColumn("is_bundle", F.lit(False)).withColumn("is_symlink", F.lit(False))
    return rows.where(views.should_include(p)).select("path")


@query(
    "b_group_filter",
    f"""WITH {DUP}, g AS (SELECT class_id FROM dup GROUP BY 1 HAVING bool_or(mtime_ns IS NULL OR mtime_ns <= 0) OR bool_or(starts_with(path, '/Volumes/')))
    SELECT class_id, path FROM dup WHERE class_id IN (SELECT class_id FROM g) AND contains(replace(lower(nfc_normalize(path)), 'ß', 'ss'), 'größe'.replace('ß', 'ss')) AND {sql_category('path')} = 'document'""",
)
def b_group_filter(spark: SparkSession, d: str) -> DataFrame:
    return views.visible_copies(cut(I.duplicates(I.files(spark, d))), "Größe", "document", "review").select("class_id", "path")


@query(
    "b_pair_filter",
    "SELECT DISTINCT dir_a, dir_b, percent FROM sim_pairs WHERE percent >= 50 AND (contains(lower(nfc_normalize(dir_a)), 'foto') OR contains(lower(nfc_normalize(dir_b)), 'foto'))",
)
def b_pair_filter(spark: SparkSession, d: str) -> DataFrame:
    return views.visible_pairs(table(spark, d, "sim_pairs").select("dir_a", "dir_b", "percent").distinct(), "Foto", 50)


@query(
    "p_tags",
    """WITH c AS (SELECT least(dir_a, dir_b) AS a, greatest(dir_a, dir_b) AS b, CASE status WHEN 'identical' THEN 'approved' WHEN 'shared_elsewhere' THEN '' ELSE status END AS tag, row_id AS ord
      FROM (SELECT DISTINCT row_id, dir_a, dir_b, status FROM folder_compare) WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL AND status IS NOT NULL),
    l AS (SELECT a, b, max_by(tag, ord) AS tag FROM c GROUP BY 1, 2), t AS (SELECT DISTINCT least(dir_a, dir_b) AS a, greatest(dir_a, dir_b) AS b FROM sim_pairs WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL)
    SELECT a, b, 'pending' AS tag FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.a = t.a AND l.b = t.b) UNION ALL SELECT * FROM l WHERE tag <> ''""",
)
def p_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of similar pairs, all pending at first, after the changes that comparisons bring."""
    key = [F.least("dir_a", "dir_b").alias("a"), F.greatest("dir_a", "dir_b").alias("b")]
    known = "dir_a IS NOT NULL AND dir_b IS NOT NULL"
    tags = table(spark, d, "sim_pairs").where(known).select(*key).distinct().withColumn("tag", F.lit("pending"))
    s = F.col("status")
    tag = F.when(s == "identical", "approved").when(s == "shared_elsewhere", "").otherwise(s)
    changes = table(spark, d, "folder_compare").where(known + " AND status IS NOT NULL").select(*key, tag.alias("tag"), F.col("row_id").alias("at")).distinct()
    return views.put_tags(tags, changes, ["a", "b"])


@query(
    "p_pair_rows",
    f"""WITH {_SIDES},
    fa AS (SELECT compare_id, class_id, max(size) AS size, min(path) AS path FROM sa WHERE class_id IS NOT NULL GROUP BY 1, 2), fb AS (SELECT compare_id, class_id, min(path) AS path FROM sb WHERE class_id IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT compare_id, fa.size, fa.path AS path_a, fb.path AS path_b, CAST(row_number() OVER (PARTITION BY compare_id ORDER BY fa.size DESC, class_id) AS INT) AS place, count(*) OVER (PARTITION BY compare_id) AS total FROM fa JOIN fb USING (compare_id, class_id)),
    o AS (SELECT compare_id, 'a' AS side, path, size FROM sa WHERE NOT EXISTS (SELECT 1 FROM sb x WHERE x.compare_id = sa.compare_id AND x.class_id IS NOT DISTINCT FROM sa.class_id)
      UNION ALL SELECT compare_id, 'b', path, size FROM sb WHERE NOT EXISTS (SELECT 1 FROM sa x WHERE x.compare_id = sb.compare_id AND x.class_id IS NOT DISTINCT FROM sb.class_id)),
    r AS (SELECT *, count(*) OVER (PARTITION BY compare_id, side) AS total, CAST(row_number() OVER (PARTITION BY compare_id, side ORDER BY size DESC NULLS LAST, path DESC) AS INT) AS place FROM o)
    SELECT compare_id, 's' AS kind, place, size, path_a, path_b, CAST(NULL AS BIGINT) AS more FROM s WHERE place <= 5
    UNION ALL SELECT compare_id, 'ts', NULL, NULL, NULL, NULL, max(total) - 5 FROM s GROUP BY compare_id HAVING max(total) > 5
    UNION ALL SELECT compare_id, side, place, size, CASE WHEN side = 'a' THEN path END, CASE WHEN side = 'b' THEN path END, NULL FROM r WHERE place <= 5
    UNION ALL SELECT compare_id, 't' || side, NULL, NULL, NULL, NULL, max(total) - 5 FROM r GROUP BY compare_id, side HAVING max(total) > 5""",
)
def p_pair_rows(spark: SparkSession, d: str) -> DataFrame:
    """Detail rows of each compared pair, five of a kind: the bound is the view's."""
    pairs, rows = cut(_compare_pairs(spark, d)), cut(I.files(spark, d))
    a, b = similar._sides(pairs, rows, ["compare_id"])
    first = lambda x: x.where("class_id IS NOT NULL").groupBy("compare_id", "class_id").agg(F.max("size").alias("size"), F.min("path").alias("path"))
    both = first(a).withColumnRenamed("path", "path_a").join(first(b).select("compare_id", "class_id", F.col("path").alias("path_b")), ["compare_id", "class_id"])
    from pyspark.sql import Window as W

    ranked = both.withColumn("place", F.row_number().over(W.partitionBy("compare_id").orderBy(F.desc("size"), "class_id")))
    totals = both.groupBy("compare_id").agg(F.count("*").alias("shared_total"))
    return views.pair_rows(ranked.where("place <= 5"), totals, similar.pair_difference(pairs, rows, ["compare_id"], 5), ["compare_id"])


@query(
    "f_error_match",
    f"WITH {INV}, e AS (SELECT path || ': permission denied: now' AS message FROM inv WHERE size IS NULL UNION ALL SELECT dir FROM inv WHERE class_id IS NULL) SELECT path FROM inv WHERE EXISTS (SELECT 1 FROM e WHERE message = path OR starts_with(message, path || ': '))",
)
def f_error_match(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(I.files(spark, d))
    errors = rows.where("size IS NULL").select(F.concat("path", F.lit(": permission denied: now")).alias("message")).union(rows.where("class_id IS NULL").select("dir"))
    return views.failed_candidates(errors, rows.select("path"))


@query(
    "m_nfc_verdict",
    f"""WITH {INV}, t AS (SELECT DISTINCT dir, name FROM inv)
    SELECT path, CASE WHEN nfc_normalize(i.name) = i.name THEN 'already-nfc' WHEN starts_with(path, '/srv/mirror/') THEN 'protected' WHEN size IS NULL THEN 'phantom' WHEN t.name IS NOT NULL THEN 'exists' ELSE 'fixed' END AS verdict
    FROM inv i LEFT JOIN t ON t.dir = i.dir AND t.name = nfc_normalize(i.name)""",
)
def m_nfc_verdict(spark: SparkSession, d: str) -> DataFrame:
    return views.nfc_verdicts(I.files(spark, d).withColumn("found", F.col("size").isNotNull()), ["/srv/mirror"])


_MOUNTS = [("/Volumes", "apfs"), ("/Volumes/Sklad", "smbfs"), ("/mnt", "nfs"), ("/srv/mirror", "hfs")]


@query(
    "a_mount_types",
    f"""WITH {INV}, m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _MOUNTS)}) v(mount, fs_type)), b AS (SELECT path, max_by(mount, length(mount)) AS mount FROM inv LEFT JOIN m ON starts_with(path, mount || '/') GROUP BY path)
    SELECT path, mount, fs_type, coalesce(fs_type IN ('smbfs', 'nfs', 'afpfs', 'webdav', 'cifs', 'ftp'), false) AS network, coalesce(fs_type IN ('apfs', 'hfs'), false) AS trusted FROM b LEFT JOIN m USING (mount)""",
)
def a_mount_types(spark: SparkSession, d: str) -> DataFrame:
    return views.mount_types(I.files(spark, d).select("path"), spark.createDataFrame(_MOUNTS, "mount string, fs_type string"))


@query(
    "n_unproven",
    f"""WITH {_SIDES}, p AS (SELECT DISTINCT dir_a AS root FROM pairs), u AS (SELECT DISTINCT file_id, path, name, dir, class_id, root FROM anc JOIN p ON above = root)
    SELECT DISTINCT path FROM u WHERE NOT EXISTS (SELECT 1 FROM inv o WHERE o.class_id = u.class_id AND NOT starts_with(o.class_id, 'u:') AND o.path NOT IN (SELECT path FROM u))""",
)
def n_unproven(spark: SparkSession, d: str) -> DataFrame:
    """Files of the first folders of all comparisons that have no proven copy outside these folders."""
    rows = cut(I.files(spark, d))
    roots = _compare_pairs(spark, d).select(F.col("dir_a").alias("root"))
    inside = cut(tree.files_under(rows, roots).drop("root").distinct())
    return removal.unproven(inside, rows.join(inside.select("path"), "path", "left_anti"))


@query("n_transfer_names")
def n_transfer_names(spark: SparkSession, d: str) -> DataFrame:
    """Final names of all merges; suffixes are taken in source order (tested by hand)."""
    rows = cut(I.files(spark, d))
    plan = similar.merge_plan(_compare_pairs(spark, d), rows, None, ["compare_id"]).join(rows.select(F.col("path").alias("source"), "class_id"), "source")
    return removal.final_names(plan.select("source", "target", "class_id").distinct(), rows.select("path", "class_id"))


@query(
    "n_restorable",
    f"""WITH {INV}, s AS (SELECT path, size, class_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY file_id) AS r FROM inv) WHERE r = 1),
    i AS (SELECT '/restored' || path AS original_path, path AS trashed_path, size, CASE WHEN class_id IS NOT NULL AND NOT starts_with(class_id, 'u:') THEN string_split(class_id, ':')[2] END AS digest, CASE WHEN {sql_category('path')} = 'image' THEN 'trashed' ELSE 'restored' END AS status FROM s)
    SELECT original_path, CASE WHEN status <> 'trashed' THEN 'done' WHEN starts_with(original_path, '/restored/Volumes/') THEN 'ready' ELSE 'outside' END AS verdict FROM i""",
)
def n_restorable(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(I.files(spark, d).dropDuplicates(["path"]))
    digest = F.when(I.shared_class(F.col("class_id")), F.split("class_id", ":")[1])
    status = F.when(category(F.col("path")) == "image", "trashed").otherwise("restored")
    items = rows.select(F.concat(F.lit("/restored"), "path").alias("original_path"), F.col("path").alias("trashed_path"), "size", digest.alias("digest"), status.alias("status"))
    return removal.restorable(items, rows, spark.createDataFrame([("/restored/Volumes",)], "root string"))


@query(
    "e_order_folders",
    """WITH l AS (SELECT o_custkey, o_orderkey, l_linenumber, max(l_returnflag || l_linestatus) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
    t AS (SELECT o_custkey, '/c' || o_custkey || '/' || o_orderkey AS dir, string_agg(l_linenumber || '=' || c, ',' ORDER BY l_linenumber) AS tree, count(*) AS n FROM l GROUP BY o_custkey, o_orderkey),
    u AS (SELECT '/c' || o_custkey AS dir, string_agg(o_orderkey || ':' || tree, ';' ORDER BY o_orderkey) AS tree FROM (SELECT o_custkey, split_part(dir, '/', 3) AS o_orderkey, tree FROM t) GROUP BY o_custkey),
    g AS (SELECT dir, n, min(dir) OVER (PARTITION BY tree) AS first, count(*) OVER (PARTITION BY tree) AS copies FROM t)
    SELECT first, dir, n AS n_files, copies FROM g WHERE copies >= 2""",
)
def e_order_folders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the same lines, as folders of a two-level tree of customers and orders."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.groupBy("o_custkey", "l_orderkey", "l_linenumber").agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("class_id"))
    folder = F.concat(F.lit("/c"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"))
    rows = lines.select(folder.alias("dir"), F.col("l_linenumber").cast("string").alias("name"), "class_id", F.lit(1).cast("bigint").alias("size"))
    rows = cut(rows.withColumn("path", F.concat_ws("/", "dir", "name")))
    groups = tree.identical_folders(tree.folder_digests(I.folders(rows), rows), tree.subtree_sums(rows))
    first = groups.groupBy("digest").agg(F.min("dir").alias("first"))
    return groups.join(first, "digest").select("first", "dir", "n_files", "copies")


@query("m_sanitize")
def m_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events and texts of documents without sensitive parts (tested on fixed cases)."""
    from stratafold.functions.sanitize import sanitize_json

    events = table(spark, d, "events").select(F.lit("events").alias("tbl"), F.col("event_id").alias("id"), "props")
    docs = table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), F.col("text").alias("props"))
    return events.unionByName(docs).select("tbl", "id", sanitize_json(F.col("props")).alias("clean"))


@query(
    "e_state_digests",
    f"""WITH {INV}, a AS (SELECT above AS dir, string_agg(substr(path, length(above) + 2) || '|' || coalesce(CAST(dev AS VARCHAR), '') || '|' || coalesce(CAST(ino AS VARCHAR), '') || '|' || coalesce(CAST(size AS VARCHAR), '') || '|' || coalesce(CAST(mtime_ns AS VARCHAR), '') || '|' || coalesce(CAST(ctime_ns AS VARCHAR), ''), chr(10) ORDER BY path) AS t
      FROM (SELECT i.*, array_to_string(parts[1:k], '/') AS above FROM (SELECT *, string_split(path, '/') AS parts FROM inv) i, unnest(range(2, len(parts))) AS t(k)) GROUP BY 1)
    SELECT dir, min(dir) OVER (PARTITION BY t) AS first FROM a""",
)
def e_state_digests(spark: SparkSession, d: str) -> DataFrame:
    """Each folder with the first of the same state."""
    rows = cut(I.files(spark, d))
    folders = I.folders(rows).where("dir <> '' AND dir <> '/'").withColumn("ok", F.lit(True))
    states = cut(tree.state_digests(folders, rows))
    return states.join(states.groupBy("digest").agg(F.min("dir").alias("first")), "digest").select("dir", "first")
