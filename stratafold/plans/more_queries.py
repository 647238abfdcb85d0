"""Queries on checks of saved scans, view preparation, selection guards and decisions before removals (S-VAL, P, H6, I2-I4, N, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import paths as P
from stratafold.functions.text import category
from stratafold.operators import checks, ranking, removal, similar, views
from stratafold.operators.changes import latest_rows
from stratafold.operators.groups import duplicate_groups
from stratafold.operators.removal import IDENTITY
from stratafold.plans.sqlviews import ANC, DUP, INV
from stratafold.plans.sqlviews import category as sql_category
from stratafold.plans.sqlviews import problem as sql_problem
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


_IMAGE = f"{sql_category('path')} = 'image'"
_FOLDS = "replace(lower(nfc_normalize({})), 'ß', 'ss')"
_FOLDERS = f"""{INV}, fo AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS dir FROM (SELECT DISTINCT string_split(dir, '/') AS parts FROM inv), unnest(range(2, len(parts) + 1)) AS t(k))"""
_PAIRS = "pr AS (SELECT DISTINCT dir_a, dir_b, percent, shared_bytes FROM sim_pairs WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL AND percent IS NOT NULL AND shared_bytes IS NOT NULL)"


def _image() -> object:
    return category(F.col("path")) == "image"


def _dups(spark: SparkSession, d: str) -> DataFrame:
    return I.duplicates(I.files(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sim_pairs").select("dir_a", "dir_b", "percent", "shared_bytes").dropna().distinct()


@query(
    "j_relation_checks",
    f"""WITH {_FOLDERS}, {_PAIRS}, cl AS (SELECT dir_b AS path, dir_a AS canonical FROM (SELECT DISTINCT least(dir_a, dir_b) AS dir_a, greatest(dir_a, dir_b) AS dir_b FROM pr))
    SELECT 'pairs' AS relation, 'folder is there' AS rule, dir AS path FROM (SELECT dir_a AS dir FROM pr UNION SELECT dir_b FROM pr) WHERE dir NOT IN (SELECT dir FROM fo)
    UNION ALL SELECT 'aliases', 'lies in its folder', path FROM cl WHERE regexp_replace(path, '/[^/]*$', '') <> canonical
    UNION ALL SELECT 'aliases', 'canonical file is there', path FROM cl WHERE canonical NOT IN (SELECT path FROM inv)
    UNION ALL SELECT 'groups', 'copies are the class''s files', digest FROM (SELECT DISTINCT group_id, digest, CAST(len(list_distinct(list_filter(paths, lambda p: p IS NOT NULL))) AS BIGINT) AS copies FROM file_groups) g LEFT JOIN (SELECT class_id, count(*) AS n FROM inv GROUP BY 1) c ON c.class_id = g.digest WHERE n IS DISTINCT FROM copies""",
)
def j_relation_checks(spark: SparkSession, d: str) -> DataFrame:
    """The rules between relations, on relations that break them: the reported pairs and groups, and pairs taken for aliases."""
    rows = cut(I.files(spark, d))
    pairs = _pairs(spark, d)
    lo, hi = F.least("dir_a", "dir_b"), F.greatest("dir_a", "dir_b")
    aliases = pairs.select(lo.alias("dir"), lo.alias("canonical"), hi.alias("alias")).distinct()
    copies = F.size(F.array_distinct(F.array_compact("paths"))).cast("bigint")
    groups = table(spark, d, "file_groups").select("group_id", F.col("digest").alias("class_id"), copies.alias("copies")).distinct()
    found = checks.scan_violations({"files": rows, "folders": I.folders(rows), "pairs": pairs, "aliases": aliases, "groups": groups})
    return found.where("relation <> 'files'")


@query(
    "j_derived_sections",
    f"""WITH {_FOLDERS}, f AS (SELECT fo.dir, count(path) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM fo LEFT JOIN inv USING (dir) GROUP BY 1)
    SELECT 'folder' AS section, dir AS key, files AS n, bytes FROM f
    UNION ALL SELECT 'class', class_id, count(*), CAST(split_part(class_id, ':', 1) AS BIGINT) FROM inv WHERE regexp_matches(class_id, '^\\d{{1,18}}:') GROUP BY class_id HAVING count(*) >= 2""",
)
def j_derived_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(I.files(spark, d))
    s = checks.derived_sections(rows, I.folders(rows))
    members = s["class_members"].join(s["class_sizes"], "class_id").select(F.lit("class").alias("section"), F.col("class_id").alias("key"), F.col("copies").alias("n"), F.col("size").alias("bytes"))
    return s["folder_files"].select(F.lit("folder").alias("section"), F.col("dir").alias("key"), F.col("files").alias("n"), "bytes").unionByName(members)


_PRIVATE = f"{INV}, pv AS (SELECT CASE WHEN starts_with(path, '/mnt/') THEN '/private/var' || substr(path, 5) WHEN starts_with(path, '/srv/') THEN '/tmp' || substr(path, 5) ELSE path END AS path FROM inv)"


@query("j_allowed_roots", f"WITH {_PRIVATE} SELECT path, starts_with(path, '/private/var/arkiv/') OR starts_with(path, '/tmp/') OR starts_with(path, '/Users/studio/') AS allowed FROM pv")
def j_allowed_roots(spark: SparkSession, d: str) -> DataFrame:
    """Paths under folders with two names, against roots that use the other one."""
    p = F.col("path")
    moved = F.when(p.startswith("/mnt/"), F.concat(F.lit("/private/var"), F.expr("substr(path, 5)"))).when(p.startswith("/srv/"), F.concat(F.lit("/tmp"), F.expr("substr(path, 5)"))).otherwise(p)
    roots = spark.createDataFrame([("/var/arkiv",), ("/private/tmp",), ("/Users/studio",)], "root string")
    return checks.in_allowed_roots(I.files(spark, d).select(moved.alias("path")), roots)


@query(
    "j_probes",
    f"""WITH {_FOLDERS}, a AS (SELECT path FROM file_snapshots WHERE path IS NOT NULL UNION SELECT dir_a FROM sim_pairs WHERE dir_a IS NOT NULL),
    s AS (SELECT a.path, CASE WHEN i.path IS NOT NULL THEN 'file' WHEN fo.dir IS NOT NULL THEN 'dir' ELSE 'unknown' END AS kind, i.size FROM a LEFT JOIN (SELECT path, min(size) AS size FROM inv GROUP BY 1) i USING (path) LEFT JOIN fo ON fo.dir = a.path),
    l AS (SELECT path, max_by(size, (seen_at, received_at, size)) AS size FROM file_snapshots WHERE path IS NOT NULL GROUP BY 1)
    SELECT s.path, kind, s.size, coalesce(CASE kind WHEN 'unknown' THEN l.path IS NOT NULL WHEN 'dir' THEN false ELSE l.path IS NOT NULL AND l.size IS NOT DISTINCT FROM s.size END, false) AS matches FROM s LEFT JOIN l USING (path)""",
)
def j_probes(spark: SparkSession, d: str) -> DataFrame:
    """What the inventory expects at the paths of the snapshots and pairs, and whether the newest readings match it."""
    rows = cut(I.files(spark, d))
    snaps = table(spark, d, "file_snapshots").where("path IS NOT NULL")
    asked = snaps.select("path").union(table(spark, d, "sim_pairs").where("dir_a IS NOT NULL").select("dir_a")).distinct()
    specs = cut(checks.probe_specs(asked, rows.groupBy("path").agg(F.min("size").alias("size")), I.folders(rows)))
    found = latest_rows(snaps, ["path"], ["seen_at", "received_at"], ["size"]).withColumn("kind", F.lit("file"))
    return specs.join(checks.probe_matches(specs, found), "path")


@query(
    "f_merge_roots",
    """WITH p AS (SELECT DISTINCT dir_a AS src, dir_b AS dst FROM sim_pairs UNION SELECT DISTINCT dir_a, regexp_replace(dir_a, '/[^/]*$', '') FROM sim_pairs UNION SELECT DISTINCT dir_b, substr(dir_b, 2) FROM sim_pairs)
    SELECT src, dst, CASE WHEN NOT coalesce(starts_with(src, '/') AND starts_with(dst, '/'), false) THEN 'relative' WHEN src = dst THEN 'same' WHEN starts_with(src, dst || '/') OR starts_with(dst, src || '/') THEN 'nested' ELSE 'ready' END AS verdict FROM p""",
)
def f_merge_roots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sim_pairs")
    up = s.select("dir_a", F.regexp_replace("dir_a", r"/[^/]*$", ""))
    pairs = s.select(F.col("dir_a").alias("src"), F.col("dir_b").alias("dst")).union(up).union(s.select("dir_b", F.expr("substr(dir_b, 2)"))).distinct()
    return checks.merge_root_verdicts(pairs)


@query(
    "p_nearest_existing",
    f"""WITH {_FOLDERS}, w AS (SELECT DISTINCT dir || '/new/part' AS path FROM fo), v AS (SELECT path, CASE WHEN starts_with(path, '/Volumes/') THEN array_to_string(string_split(path, '/')[1:3], '/') ELSE '/' END AS volume FROM w)
    SELECT path, substr(path, 1, length(path) - 9) AS nearest, CASE WHEN volume NOT IN ('/', '/Volumes/Sklad', '/Volumes/Backup-Mai') THEN 'not mounted' END AS problem FROM v""",
)
def p_nearest_existing(spark: SparkSession, d: str) -> DataFrame:
    """Where paths that don't exist yet would begin, two volumes being mounted."""
    folders = cut(I.folders(I.files(spark, d)).select("dir").where("dir <> '' AND dir <> '/'"))
    wanted = folders.select(F.concat("dir", F.lit("/new/part")).alias("path"))
    mounted = spark.createDataFrame([("/Volumes/Sklad",), ("/Volumes/Backup-Mai",)], "volume string")
    return checks.nearest_existing(wanted, folders.select(F.col("dir").alias("path")), mounted)


@query("p_path_list", f"WITH {INV} SELECT path FROM inv ORDER BY path LIMIT 2000")
def p_path_list(spark: SparkSession, d: str) -> DataFrame:
    """The first 2,000 paths for a report: the bound is the feature."""
    return checks.bounded_paths(I.files(spark, d).select("path"))[0]


@query("p_bounded_json", "SELECT event_id, CASE WHEN octet_length(encode(props)) <= 40 THEN props WHEN props IS NOT NULL THEN '{\"truncated\":true}' END AS props FROM events")
def p_bounded_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", checks.bounded_json(F.col("props"), 40).alias("props"))


@query(
    "a_manifests",
    """WITH v AS (SELECT p_partkey AS id, p_size || '.' || (p_partkey % 30) || '.0' AS version FROM part)
    SELECT id, CASE WHEN id % 5 < 3 THEN version END AS version, CASE WHEN id % 5 < 3 THEN (CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT)) > (25, 10) END AS newer FROM v""",
)
def a_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests made of the parts: three of five are sound, one has an unknown field, one no https address."""
    k = F.col("p_partkey")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (k % 30).cast("string"), F.lit("0"))
    url = F.when(k % 5 == 4, "http://x.org/r").otherwise("https://x.org/r")
    more = F.when(k % 5 == 3, ',"other":1').when(k % 5 == 2, ',"published_at":"2025-01-01T00:00:00Z","summary":"s"').otherwise("")
    text = F.concat(F.lit('{"schema_version":1,"version":"'), version, F.lit('","release_url":"'), url, F.lit('"'), more, F.lit("}"))
    m = table(spark, d, "part").select(k.alias("id"), checks.parse_manifest(text).alias("m"))
    return m.select("id", F.col("m.version").alias("version"), checks.update_available(F.col("m"), F.lit("25.10.0")).alias("newer"))


_MINUTE = "CASE WHEN {0} > 0 THEN strftime(make_timestamp(CAST(floor({0} / 1000) AS BIGINT)), '%Y-%m-%d %H:%M') END"


@query("p_group_view", f"WITH {DUP} SELECT class_id, path, {_FOLDS.format('path')} AS sort_path, {sql_category('path')} AS category, {_MINUTE.format('btime_ns')} AS born, {_MINUTE.format('mtime_ns')} AS changed, NOT coalesce(btime_ns > 0, false) AND NOT coalesce(mtime_ns > 0, false) AS undated FROM dup")
def p_group_view(spark: SparkSession, d: str) -> DataFrame:
    return views.group_view(_dups(spark, d)).drop("size_text")


@query("p_pair_view", f"WITH {_PAIRS} SELECT dir_a, dir_b, regexp_extract(dir_a, '[^/]*$') AS name_a, regexp_extract(dir_b, '[^/]*$') AS name_b, {_FOLDS.format('dir_a')} AS sort_a, {_FOLDS.format('dir_b')} AS sort_b, printf('%.1f%%', percent) AS percent_text FROM pr")
def p_pair_view(spark: SparkSession, d: str) -> DataFrame:
    return views.pair_view(_pairs(spark, d)).drop("bytes_text")


_PLACED = f"""{DUP}, g AS (SELECT class_id, max(size) * (count(*) - 1) AS wasted FROM dup GROUP BY 1 HAVING count(*) >= 2), gp AS (SELECT class_id, row_number() OVER (ORDER BY {{}}) AS group_place FROM g)"""


@query("i_sorted_copies", f"WITH {_PLACED.format('class_id')} SELECT class_id, path, group_place, CAST(row_number() OVER (PARTITION BY class_id ORDER BY coalesce(mtime_ns, 0) DESC, path) AS INT) AS place FROM dup JOIN gp USING (class_id)")
def i_sorted_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies by time of change, newest first, in unchanged groups."""
    return views.sorted_copies(cut(_dups(spark, d)), "changed", True).select("class_id", "path", "group_place", "place")


@query("i_largest_groups", f"WITH {_PLACED.format('wasted DESC, class_id')} SELECT class_id, path, group_place, CAST(row_number() OVER (PARTITION BY class_id ORDER BY {_FOLDS.format('path')}, path) AS INT) AS place FROM dup JOIN gp USING (class_id)")
def i_largest_groups(spark: SparkSession, d: str) -> DataFrame:
    """Copies by path, the groups of the greatest waste first."""
    return views.sorted_copies(cut(_dups(spark, d)), preset="largest").select("class_id", "path", "group_place", "place")


@query("i_sorted_pairs", f"WITH {_PAIRS} SELECT *, row_number() OVER (ORDER BY percent DESC, dir_a, dir_b, shared_bytes) AS k FROM pr")
def i_sorted_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d)
    out = ranking.running(rows, [ranking.Order(F.col("percent"), True), ranking.Order(F.col("dir_a")), ranking.Order(F.col("dir_b")), ranking.Order(F.col("shared_bytes"))])
    return out.select("dir_a", "dir_b", "percent", "shared_bytes", "k")


@query("p_cleared", f"WITH {DUP} SELECT path FROM dup WHERE {_IMAGE} AND NOT starts_with(path, '/Volumes/')")
def p_cleared(spark: SparkSession, d: str) -> DataFrame:
    """Selected images after those shown, on volumes, were cleared."""
    chosen = _dups(spark, d).where(_image()).select("path")
    return views.cleared(chosen, chosen.where("startswith(path, '/Volumes/')"))


@query(
    "h_check_one",
    f"""WITH {DUP}, o AS (SELECT class_id, count(*) FILTER (NOT {_IMAGE}) AS open FROM dup GROUP BY 1)
    SELECT path, ({_IMAGE} OR open > 1) AND NOT starts_with(path, '/srv/mirror/') AS allowed FROM dup JOIN o USING (class_id)""",
)
def h_check_one(spark: SparkSession, d: str) -> DataFrame:
    """Whether each copy could be selected next, all images being selected."""
    rows = cut(_dups(spark, d))
    return views.check_one(rows, rows.where(_image()).select("path"), rows.select("path"), ["/srv/mirror"])


@query(
    "h_check_sides",
    """WITH r AS (SELECT compare_id AS row_id, max(CASE WHEN path_a IS NOT NULL THEN row_id END) AS ta, max(CASE WHEN path_b IS NOT NULL THEN row_id END) AS tb FROM folder_compare GROUP BY 1)
    SELECT row_id, CASE WHEN tb IS NULL OR ta >= tb THEN 'a' ELSE 'b' END AS side FROM r WHERE ta IS NOT NULL OR tb IS NOT NULL""",
)
def h_check_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "folder_compare").select(F.col("compare_id").alias("row_id"), F.col("path_a").isNotNull().alias("a"), F.col("path_b").isNotNull().alias("b"), F.col("row_id").alias("at"))
    return views.check_sides(rows)


@query(
    "p_pair_selection",
    f"""WITH {INV}, {_PAIRS}, s AS (SELECT DISTINCT path FROM inv WHERE {_IMAGE}), c AS (SELECT DISTINCT dir_a, dir_b, path_a AS path FROM folder_compare WHERE status = 'identical' AND path_a IS NOT NULL),
    t AS (SELECT dir_a, dir_b FROM c WHERE path IN (SELECT path FROM s) UNION SELECT dir_a, dir_b FROM pr WHERE dir_a IN (SELECT path FROM s) OR dir_b IN (SELECT path FROM s))
    SELECT (SELECT CAST(sum(size) AS BIGINT) FROM (SELECT path, max(size) AS size FROM inv WHERE {_IMAGE} GROUP BY 1)) AS bytes, count(*) AS pairs FROM t""",
)
def p_pair_selection(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the selected images, and pairs whose common files are among them."""
    chosen = I.files(spark, d).where(_image()).groupBy("path").agg(F.max("size").alias("size"))
    shared = table(spark, d, "folder_compare").where("status = 'identical' AND path_a IS NOT NULL").select("dir_a", "dir_b", F.col("path_a").alias("path")).distinct()
    return views.pair_selection_stats(cut(chosen), _pairs(spark, d).select("dir_a", "dir_b"), shared)


@query(
    "f_pair_of_folder",
    f"""WITH {_PAIRS}, e AS (SELECT dir_a AS dir, * FROM pr UNION ALL SELECT dir_b, * FROM pr), k AS (SELECT DISTINCT unnest(dirs) AS dir FROM dir_clusters)
    SELECT dir, dir_a, dir_b FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY shared_bytes DESC, percent DESC, dir_a DESC, dir_b DESC) AS r FROM e) WHERE r = 1 AND dir IN (SELECT dir FROM k WHERE dir IS NOT NULL)""",
)
def f_pair_of_folder(spark: SparkSession, d: str) -> DataFrame:
    """The similar pair that best shows why a folder is in a cluster."""
    return views.pairs_of_folders(table(spark, d, "dir_clusters").select(F.explode("dirs").alias("dir")), _pairs(spark, d))


@query(
    "f_dates",
    f"""WITH {INV}, a AS (SELECT dir AS path FROM inv UNION SELECT dir_a FROM sim_pairs WHERE dir_a IS NOT NULL), t AS (SELECT path, btime_ns, mtime_ns FROM inv UNION ALL SELECT dir, btime_ns, mtime_ns FROM inv)
    SELECT a.path, max(CASE WHEN btime_ns > 0 THEN btime_ns END) AS born, max(CASE WHEN mtime_ns > 0 THEN mtime_ns END) AS changed FROM a LEFT JOIN t USING (path) GROUP BY 1""",
)
def f_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(I.files(spark, d))
    asked = rows.select(F.col("dir").alias("path")).union(table(spark, d, "sim_pairs").where("dir_a IS NOT NULL").select("dir_a"))
    return views.with_dates(asked, rows)


@query("h_candidates", f"WITH {INV}, c AS (SELECT path, size, 1 AS n FROM inv UNION ALL SELECT replace(dir, '/', '//') || '/./' || name, size, 2 FROM inv) SELECT path, min(size) AS size FROM c WHERE n = 1 GROUP BY path")
def h_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every path in two spellings: the plain one is kept."""
    rows = I.files(spark, d).select("path", "dir", "name", "size")
    odd = rows.select(F.concat(F.regexp_replace("dir", "/", "//"), F.lit("/./"), "name").alias("path"), "size", F.lit(2).alias("n"))
    both = rows.select("path", "size", F.lit(1).alias("n")).unionByName(odd)
    return views.candidate_paths(both, [F.col("n"), F.col("size"), F.col("path")]).select("path", "size")


_MESSAGES = "ms AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'fskit: ' || text WHEN 'uk' THEN 'no such file: ' || text ELSE text END AS message FROM documents WHERE text IS NOT NULL)"


@query("b_fixable_names", f"WITH {_MESSAGES} SELECT doc_id, message FROM ms WHERE {sql_problem('message')} IN ('Драйвер не відкриває файл', 'Елемент зник')")
def b_fixable_names(spark: SparkSession, d: str) -> DataFrame:
    """Texts as messages, those of two languages with a problem put before them."""
    prefix = F.when(F.col("lang") == "en", "fskit: ").when(F.col("lang") == "uk", "no such file: ").otherwise("")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.coalesce(prefix, F.lit("")), "text").alias("message"))
    return views.name_fix_candidates(rows)


@query("b_review_kinds", f"WITH {_MESSAGES} SELECT title, count(*) AS messages FROM (SELECT {sql_problem('message')} AS title FROM ms) WHERE title <> 'Помилка читання' GROUP BY 1")
def b_review_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The review list of all kinds but one."""
    from stratafold.functions.text import OTHER_PROBLEM, problem_title

    prefix = F.when(F.col("lang") == "en", "fskit: ").when(F.col("lang") == "uk", "no such file: ").otherwise("")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(problem_title(F.concat(prefix, "text")).alias("title"))
    return rows.where(F.col("title") != OTHER_PROBLEM).groupBy("title").agg(F.count("*").alias("messages"))


@query(
    "m_outcomes",
    """SELECT row_id, CASE status WHEN 'fixed' THEN '' WHEN 'identical' THEN 'Ім''я вже канонічне — причина не в кодуванні.' WHEN 'only_a' THEN 'Ім''я полагоджено: ' || relative_path || '. Повторіть сканування.' WHEN 'only_b' THEN 'Шлях у теці-еталоні — перейменування заборонено.'
      ELSE CASE WHEN coalesce(relative_path, '') <> '' THEN 'Помилка перейменування: ' || relative_path ELSE 'Помилка перейменування.' END END AS text FROM (SELECT DISTINCT row_id, status, relative_path FROM folder_compare WHERE status IS NOT NULL)""",
)
def m_outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    verdict = F.when(s == "identical", "already-nfc").when(s == "only_a", "fixed").when(s == "only_b", "protected").otherwise("failed")
    rows = table(spark, d, "folder_compare").where("status IS NOT NULL").select("row_id", "status", "relative_path").distinct()
    return rows.select("row_id", views.outcome_text(verdict, F.col("relative_path")).alias("text"))


@query("b_read_only", "SELECT compare_id, bool_or(status = 'identical') AND NOT bool_or(status IS NULL) AS ready FROM folder_compare GROUP BY 1")
def b_read_only(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons that can be acted on: live if something is identical, partial if a status is missing."""
    g = table(spark, d, "folder_compare").groupBy("compare_id").agg(F.bool_or(F.col("status") == "identical").alias("live"), F.bool_or(F.col("status").isNull()).alias("partial"))
    return g.select("compare_id", views.ready_to_act(F.col("live"), F.col("partial")).alias("ready"))


@query("d_workflow", f"WITH {DUP}, g AS (SELECT count(*) AS n, max(size) * (count(*) - 1) AS w FROM dup GROUP BY class_id HAVING count(*) >= 2), {_PAIRS} SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS copies, CAST(sum(greatest(0, w)) AS BIGINT) AS wasted, (SELECT count(*) FROM pr) AS pairs, (SELECT count(*) FROM inv WHERE size IS NULL) AS problems FROM g")
def d_workflow(spark: SparkSession, d: str) -> DataFrame:
    """What the start page says of a result."""
    rows = cut(I.files(spark, d))
    g = duplicate_groups(I.duplicates(rows)).agg(F.count("*").alias("groups"), F.sum("copies").alias("copies"), F.sum(F.greatest(F.lit(0), "wasted")).alias("wasted"))
    pairs = _pairs(spark, d).agg(F.count("*").alias("pairs"))
    return g.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(rows.agg(F.count_if(F.col("size").isNull()).alias("problems"))))


_SNAP2 = """lo AS (SELECT path, size, mtime_ns, ctime_ns, dev, ino FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC, size DESC NULLS LAST, mtime_ns DESC NULLS LAST, ctime_ns DESC NULLS LAST, dev DESC NULLS LAST, ino DESC NULLS LAST) AS r FROM file_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM file_snapshots) - 1 AND path IS NOT NULL) WHERE r = 1),
hi AS (SELECT path, size, mtime_ns, ctime_ns, dev, ino FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC, size DESC NULLS LAST, mtime_ns DESC NULLS LAST, ctime_ns DESC NULLS LAST, dev DESC NULLS LAST, ino DESC NULLS LAST) AS r FROM file_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM file_snapshots) AND path IS NOT NULL) WHERE r = 1)"""


def _last_two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "file_snapshots").where("path IS NOT NULL")
    last = rows.agg(F.max("snapshot_no")).head()[0]
    order = ["size", "mtime_ns", "ctime_ns", "dev", "ino"]
    one = lambda n: latest_rows(rows.where(F.col("snapshot_no") == n), ["path"], ["seen_at", "received_at"], order)
    return (one(last - 1), one(last)) if last is not None else (one(0), one(0))


@query(
    "n_paranoid",
    f"""WITH {_SNAP2}, s AS (SELECT lo.path, md5(concat_ws('|', lo.size, lo.mtime_ns)) AS expected, CASE WHEN hi.path IS NULL THEN 'fail' WHEN (lo.size, lo.mtime_ns, lo.ctime_ns, lo.dev, lo.ino) IS NOT DISTINCT FROM (hi.size, hi.mtime_ns, hi.ctime_ns, hi.dev, hi.ino) THEN 'trusted' ELSE 'reread' END AS state, md5(concat_ws('|', hi.size, hi.mtime_ns)) AS fresh FROM lo LEFT JOIN hi USING (path))
    SELECT path, CASE WHEN state = 'fail' THEN 'fail' WHEN expected = fresh THEN 'reread_ok' ELSE 'fail' END AS paranoid, CASE WHEN state <> 'reread' THEN state WHEN expected = fresh THEN 'reread_ok' ELSE 'fail' END AS usual FROM s""",
)
def n_paranoid(spark: SparkSession, d: str) -> DataFrame:
    """Proofs of the last two snapshots with and without trust in metadata; size and time stand for the content read again."""
    old, new = _last_two(spark, d)
    digest = F.md5(F.concat_ws("|", F.col("size").cast("string"), F.col("mtime_ns").cast("string")))
    now = new.select("path", F.struct(*IDENTITY).alias("n"))
    same = F.when(F.col("n").isNull(), "fail").when(F.col("n").eqNullSafe(F.struct(*IDENTITY)), "trusted").otherwise("reread")
    states = cut(old.join(now, "path", "left").select("path", digest.alias("expected"), same.alias("state")))
    fresh = cut(new.select("path", digest.alias("digest")))
    strict = removal.paranoid_state(states, fresh, True).withColumnRenamed("state", "paranoid")
    return strict.join(removal.paranoid_state(states, fresh).withColumnRenamed("state", "usual"), "path")


@query(
    "n_claimed",
    f"""WITH {DUP}, k AS (SELECT class_id, min(path) AS claim FROM dup GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT dup.path, dup.class_id, dup.dev, dup.ino, claim FROM dup JOIN k USING (class_id) WHERE path <> claim)
    SELECT v.path, NOT starts_with(claim, '/Users/') AND NOT starts_with(claim, '/mnt/arkiv/') AND coalesce((c.dev, c.ino) <> (v.dev, v.ino), false) AS safe FROM v JOIN (SELECT path, min((dev, ino))[1] AS dev, min((dev, ino))[2] AS ino FROM dup GROUP BY 1) c ON c.path = claim""",
)
def n_claimed(spark: SparkSession, d: str) -> DataFrame:
    """Copies that name the first path of their class as the one that stays; two trees are to be removed."""
    rows = cut(_dups(spark, d).select("path", F.col("class_id").alias("digest"), "dev", "ino"))
    first = rows.groupBy("digest").agg(F.min("path").alias("claim"), F.count("*").alias("n")).where("n >= 2").drop("n")
    victims = rows.join(first, "digest").where("path <> claim")
    claimed = rows.groupBy("path", "digest").agg(F.min(F.struct("dev", "ino")).alias("i")).select("path", "digest", "i.dev", "i.ino")
    return removal.claimed_survivors(victims, claimed, spark.createDataFrame([("/Users",), ("/mnt/arkiv",)], "path string"))


@query(
    "n_folder_removal",
    f"""WITH {INV}, {ANC}, {_SNAP2}, f AS (SELECT DISTINCT dir FROM inv), b AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, string_agg(path || '|' || coalesce(CAST(mtime_ns AS VARCHAR), ''), ',' ORDER BY path) AS t FROM lo GROUP BY 1), a AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, string_agg(path || '|' || coalesce(CAST(mtime_ns AS VARCHAR), ''), ',' ORDER BY path) AS t FROM hi GROUP BY 1),
    m AS (SELECT dir, count(*) AS n FROM inv WHERE class_id IS NULL OR starts_with(class_id, 'u:') GROUP BY 1)
    SELECT f.dir, CASE WHEN coalesce(a.t <> b.t, true) THEN 'changed' WHEN coalesce(n, 0) > 0 THEN 'abort' ELSE 'ok' END AS result, coalesce(n, 0) AS unproven FROM f LEFT JOIN a USING (dir) LEFT JOIN b USING (dir) LEFT JOIN m USING (dir)""",
)
def n_folder_removal(spark: SparkSession, d: str) -> DataFrame:
    """Folders by the state of their files in the last two snapshots and by files without a proven class."""
    old, new = _last_two(spark, d)
    part = F.concat_ws("|", "path", F.coalesce(F.col("mtime_ns").cast("string"), F.lit("")))

    def state(df: DataFrame) -> DataFrame:
        h = df.select(P.dirname(F.col("path")).alias("dir"), F.xxhash64(part).alias("h"), F.xxhash64(F.lit("g"), part).alias("g"))
        sums = [F.sum(F.shiftrightunsigned(c, 32)).alias(f"{c}1") for c in ("h", "g")] + [F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{c}0") for c in ("h", "g")]
        return h.groupBy("dir").agg(F.count("*").alias("n"), *sums).select("dir", F.concat_ws(":", "n", "h1", "h0", "g1", "g0").alias("digest"))

    rows = cut(I.files(spark, d))
    missing = rows.where(~I.shared_class(F.col("class_id"))).select("dir", "path")
    return removal.folder_removal(rows.select("dir").distinct(), state(old), state(new), missing)


_MERGE = """WITH {inv}, pairs AS (SELECT DISTINCT compare_id, dir_a, dir_b FROM folder_compare WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL), {anc},
sa AS (SELECT compare_id, path, size, class_id, substr(path, length(above) + 2) AS rel FROM anc JOIN pairs ON above = dir_a), sb AS (SELECT compare_id, class_id FROM anc JOIN pairs ON above = dir_b),
pl AS (SELECT sa.compare_id, CASE WHEN class_id IS NULL THEN 'uncovered' ELSE 'unique' END AS bucket, size, path AS source, dir_b || '/' || rel AS target, class_id, dir_a, dir_b FROM sa JOIN pairs USING (compare_id)
  WHERE class_id IS NULL OR NOT EXISTS (SELECT 1 FROM sb x WHERE x.compare_id = sa.compare_id AND x.class_id = sa.class_id))"""


@query(
    "n_prepared_merge",
    _MERGE.format(inv=INV, anc=ANC) + """, r AS (SELECT DISTINCT dir FROM inv) SELECT compare_id, bucket, size, source, target, class_id AS digest, class_id IS NOT NULL AND dir_a IN (SELECT dir FROM r) AND dir_b IN (SELECT dir FROM r) AND dir_a <> dir_b AS ready FROM pl""",
)
def n_prepared_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merge plans with the digests of their sources (the known classes) and the identities of the folders, numbered by name."""
    from stratafold.plans.folder_queries import _compare_pairs

    rows = cut(I.files(spark, d))
    pairs = cut(_compare_pairs(spark, d))
    plan = similar.merge_plan(pairs, rows, None, ["compare_id"]).join(pairs, "compare_id")
    roots = rows.select(F.col("dir").alias("root")).distinct().select("root", F.lit(1).cast("bigint").alias("dev"), F.xxhash64("root").alias("ino"))
    fresh = rows.select("path", F.col("class_id").alias("digest")).distinct()
    return removal.prepared_merge(plan, fresh, roots).drop("dir_a", "dir_b")


_NAMES = _MERGE.format(inv=INV, anc=ANC) + r""", ex AS (SELECT DISTINCT path, class_id FROM inv), pn AS (SELECT DISTINCT source, target, class_id FROM pl),
us AS (SELECT regexp_extract(s, '^((?s).*) \((\d{1,9})\)$', 1) || x AS target, CAST(regexp_extract(s, '^((?s).*) \((\d{1,9})\)$', 2) AS BIGINT) AS n FROM
  (SELECT substr(path, 1, length(path) - e) AS s, substr(path, length(path) - e + 1) AS x FROM (SELECT path, length(regexp_extract(regexp_extract(path, '[^/]*$'), '^\.*[^.].*(\.[^.]*)$', 1)) AS e FROM ex)) WHERE regexp_matches(s, '^(?s).* \(\d{1,9}\)$')),
um AS (SELECT target, n - 2 - row_number() OVER (PARTITION BY target ORDER BY n) + 1 AS gap FROM (SELECT DISTINCT target, n FROM us WHERE n BETWEEN 2 AND 10000)),
jn AS (SELECT pn.*, ex.path IS NOT NULL AS taken, coalesce(pn.class_id = ex.class_id, false) AS skip FROM pn LEFT JOIN ex ON ex.path = target),
kn AS (SELECT *, row_number() OVER (PARTITION BY target, skip ORDER BY source) - CASE WHEN taken THEN 0 ELSE 1 END AS m, length(regexp_extract(regexp_extract(target, '[^/]*$'), '^\.*[^.].*(\.[^.]*)$', 1)) AS e FROM jn),
fn AS (SELECT source, target, CASE WHEN skip THEN 'skip' ELSE 'transfer' END AS action, CASE WHEN NOT skip THEN CASE WHEN m < 1 THEN target ELSE substr(target, 1, length(target) - e) || ' (' || (m + 1 + (SELECT count(*) FROM um WHERE um.target = kn.target AND gap < m)) || ')' || substr(target, length(target) - e + 1) END END AS final, class_id FROM kn)"""


@query(
    "n_transfer_status",
    _NAMES + """ SELECT source, CASE WHEN action = 'transfer' AND class_id IS NOT NULL THEN final END AS final, CASE WHEN action = 'skip' THEN 'skipped' WHEN class_id IS NULL THEN 'error' ELSE 'transferred' END AS status FROM fn""",
)
def n_transfer_status(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each row of the merges; files of unknown class can't be read."""
    from stratafold.plans.view_queries import n_transfer_names

    named = n_transfer_names(spark, d)
    known = I.files(spark, d).where("class_id IS NOT NULL").select("path", F.col("class_id").alias("digest")).distinct()
    return removal.transfer_status(named, known, known)


# Comparisons as operations of a removal journal, their rows as items; some break the journal's rules.
_OPS = """it AS (SELECT DISTINCT row_id, compare_id, coalesce(path_a, path_b) AS p, CASE WHEN path_a IS NULL THEN size_b ELSE size_a END AS size, status AS s FROM folder_compare),
op AS (SELECT md5(CAST(compare_id AS VARCHAR)) AS id, compare_id, min(row_id) AS created, max(row_id) AS updated, count(*) AS n, bool_or(s IS NULL) AS odd FROM it GROUP BY 2)"""


def _operations(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.operators.journal import ITEM

    s = F.col("status")
    status = F.when(s == "identical", "trashed").when(s == "different_content", "failed").when(s == "only_a", "missing").when(s == "only_b", "restored").when(s == "shared_elsewhere", "skipped").otherwise("odd")
    path = F.coalesce("path_a", "path_b")
    values = {
        "original_path": path, "size": F.when(F.col("path_a").isNull(), F.col("size_b")).otherwise(F.col("size_a")), "kind": F.lit("file"), "status": status, "trashed_path": F.when(s == "identical", path),
        "digest": F.when(F.col("row_id") % 2 == 0, F.sha2(path, 256)),
    }
    kinds = dict(x.split(":", 1) for x in ITEM[7:-1].split(","))
    item = F.struct(*[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
    rows = table(spark, d, "folder_compare").select("row_id", "compare_id", "status", "path_a", "path_b", "size_a", "size_b").distinct()
    g = rows.groupBy("compare_id").agg(F.min("row_id").alias("created_ns"), F.max("row_id").alias("updated_ns"), F.bool_or(s.isNull()).alias("odd"), F.collect_list(item).alias("items"))
    return g.select(
        F.md5(F.col("compare_id").cast("string")).alias("id"), "created_ns", "updated_ns", F.when(F.col("odd"), "odd").otherwise("completed").alias("status"), F.array().cast("array<string>").alias("errors"), "items"
    )


@query(
    "j_journal_rules",
    f"""WITH {_OPS}, r AS (SELECT op.id, op.odd, op.created, op.updated, count(DISTINCT p) < count(*) AS twice, bool_or(p IS NULL OR NOT starts_with(p, '/')) AS rel, bool_or(s IS NULL) AS unknown, bool_or(size IS NULL OR size < 0) AS neg, bool_or(s = 'only_b') AS back FROM it JOIN op USING (compare_id) GROUP BY 1, 2, 3, 4)
    SELECT rule, id FROM (SELECT id, unnest([CASE WHEN created <= 0 OR updated < created THEN 'times are positive and in order' END, CASE WHEN odd THEN 'operation has a known status' END, CASE WHEN twice THEN 'original paths come once' END, CASE WHEN rel THEN 'paths are absolute' END,
      CASE WHEN unknown THEN 'item has a known status and kind' END, CASE WHEN neg THEN 'size is known and not negative' END, CASE WHEN back THEN 'restored items and only they say where and when' END]) AS rule FROM r) WHERE rule IS NOT NULL""",
)
def j_journal_rules(spark: SparkSession, d: str) -> DataFrame:
    """An operation is one journal entry of at most 10,000 items by its definition."""
    from stratafold.operators.journal import journal_violations

    return journal_violations(cut(_operations(spark, d)))


@query("j_journal_bounds", f"WITH {_OPS}, u AS (SELECT id, row_number() OVER w AS k, sum(n) OVER w AS upto FROM op WINDOW w AS (ORDER BY created DESC, id DESC ROWS UNBOUNDED PRECEDING)) SELECT id FROM u WHERE k = 1 OR (k <= 30 AND upto <= 500)")
def j_journal_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The newest operations within 30 operations and 500 items: the store's bounds."""
    from stratafold.operators.journal import bounded_journal

    return bounded_journal(cut(_operations(spark, d)), 30, 500).select("id")


@query("n_auto_restorable", f"WITH {_OPS} SELECT p AS original_path, s = 'identical' AND row_id % 2 = 0 AS automatic, count(*) AS items FROM it WHERE s IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2")
def n_auto_restorable(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.operators.journal import auto_restorable

    items = _operations(spark, d).select(F.explode("items").alias("x")).where("x.status <> 'odd' AND x.original_path IS NOT NULL")
    return items.groupBy(F.col("x.original_path").alias("original_path"), auto_restorable(F.col("x")).alias("automatic")).agg(F.count("*").alias("items"))


@query("n_with_digests", f"WITH {_OPS}, {INV}, k AS (SELECT path, min(string_split(class_id, ':')[2]) AS digest FROM inv WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:') GROUP BY 1) SELECT row_id, p AS original_path, k.digest FROM it LEFT JOIN k ON k.path = p")
def n_with_digests(spark: SparkSession, d: str) -> DataFrame:
    """Items with the proven digest of their file."""
    from stratafold.operators.journal import with_digests

    size = F.when(F.col("path_a").isNull(), F.col("size_b")).otherwise(F.col("size_a"))
    items = table(spark, d, "folder_compare").select("row_id", F.coalesce("path_a", "path_b").alias("original_path"), size.alias("size"), "status", "compare_id").distinct()
    known = I.files(spark, d).where(I.shared_class(F.col("class_id"))).groupBy("path").agg(F.min("class_id").alias("class_id"))
    return with_digests(items, known).select("row_id", "original_path", "digest")


@query(
    "m_remaining",
    """SELECT event_id, CASE WHEN s < 60 THEN printf('~%d с', greatest(1, CAST(round_even(s, 0) AS INT))) WHEN s < 3600 THEN printf('~%d хв', greatest(1, CAST(round_even(s / 60, 0) AS INT))) ELSE printf('~%.1f год', s / 3600) END AS text
    FROM (SELECT event_id, greatest(0, value * 100) AS s FROM events WHERE value IS NOT NULL)""",
)
def m_remaining(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.functions.text import remaining_text

    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", remaining_text(F.col("value") * 100).alias("text"))


@query("m_phases", "SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS label FROM documents WHERE source IS NOT NULL AND NOT contains(source, ' · ')")
def m_phases(spark: SparkSession, d: str) -> DataFrame:
    """Sources as phases, those of one language counting bytes."""
    from stratafold.functions.text import phase_label

    rows = table(spark, d, "documents").where("source IS NOT NULL AND NOT contains(source, ' · ')")
    unit = F.when(F.col("lang") == "en", "МіБ").otherwise("3")
    return rows.select("doc_id", phase_label(F.concat_ws(" · ", "source", F.lit("/x"), unit)).alias("label"))


@query(
    "m_truncated",
    "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 60 THEN text ELSE substr(text, 1, list_max(list_filter(range(0, 58), lambda k: octet_length(encode(substr(text, 1, k))) <= 57))) || '…' END AS text FROM documents WHERE text IS NOT NULL",
)
def m_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Texts within 60 bytes, whole characters only: the bound is the feature."""
    from stratafold.functions.text import truncate_utf8

    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", truncate_utf8(F.col("text"), 60).alias("text"))


@query(
    "m_versions",
    """WITH v AS (SELECT p_partkey AS id, p_size AS a, p_partkey % 30 AS b, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 12 END AS pre FROM part)
    SELECT id, row_number() OVER (ORDER BY a, b, pre IS NULL, pre, id) AS k FROM v""",
)
def m_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions made of the parts, in order of precedence."""
    from stratafold.functions.text import semver_key

    k = F.col("p_partkey")
    pre = F.when(k % 3 == 0, F.concat(F.lit("-rc."), (k % 12).cast("string"))).otherwise("")
    version = F.concat(F.concat_ws(".", F.col("p_size").cast("string"), (k % 30).cast("string"), F.lit("0")), pre)
    rows = table(spark, d, "part").select(k.alias("id"), semver_key(version).alias("v"))
    flat = [F.col("v.major"), F.col("v.minor"), F.col("v.patch"), F.col("v.released"), F.col("v.pre"), F.col("id")]
    return ranking.running(rows, flat).select("id", "k")


@query("m_addresses", "SELECT p_partkey AS id, p_partkey % 5 = 0 AS fine FROM part")
def m_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of the parts; one form of five is acceptable."""
    from stratafold.functions.text import https_url

    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    forms = [("https://x.org/", ""), ("http://x.org/", ""), ("https://u@x.org/", ""), ("https://x.org/", "#f"), ("https://x.org/a b", "")]
    url = F.lit(None).cast("string")
    for i, (head, tail) in enumerate(forms):
        url = F.when(k % 5 == i, F.concat(F.lit(head), n, F.lit(tail))).otherwise(url)
    return table(spark, d, "part").select(k.alias("id"), https_url(url).alias("fine"))


@query(
    "n_restore_names",
    f"""WITH {INV}, ex AS (SELECT DISTINCT path FROM inv), i AS (SELECT DISTINCT path, 1 AS t FROM inv WHERE {_IMAGE} UNION ALL SELECT DISTINCT path, 2 FROM inv WHERE {_IMAGE})
    SELECT path AS original_path, substr(path, 1, length(path) - e) || ' (restored ' || t || ')' || substr(path, length(path) - e + 1) AS final
    FROM (SELECT *, length(regexp_extract(regexp_extract(path, '[^/]*$'), '^\\.*[^.].*(\\.[^.]*)$', 1)) AS e FROM i)""",
)
def n_restore_names(spark: SparkSession, d: str) -> DataFrame:
    """Every image twice in the trash, its name being taken."""
    rows = cut(I.files(spark, d).select("path").distinct())
    images = rows.where(_image()).select(F.col("path").alias("original_path"))
    twice = images.withColumn("trashed_path", F.lit("/t/1")).union(images.withColumn("trashed_path", F.lit("/t/2")))
    return removal.restore_names(twice, rows).select("original_path", "final")


def _preset(name: str, rule: str) -> None:
    sql = f"WITH {DUP}, g AS (SELECT class_id FROM dup GROUP BY 1 HAVING {rule}) SELECT class_id, path FROM dup JOIN g USING (class_id)"
    query(f"b_preset_{name}", sql)(lambda spark, d: views.visible_copies(cut(_dups(spark, d)), preset=name).select("class_id", "path"))


_preset("safe", "count(*) > 1 AND NOT bool_or(mtime_ns IS NULL OR mtime_ns <= 0)")
_preset("network", "bool_or(starts_with(path, '/Volumes/'))")


@query(
    "h_scoped_selection",
    f"""WITH {DUP}, m AS (SELECT *, {_IMAGE} OR {sql_category('path')} = 'document' AS want, starts_with(path, '/Volumes/') AS prior FROM dup),
    g AS (SELECT class_id, count(*) AS n, count(*) FILTER (want OR prior) AS s, min({{'t': coalesce(mtime_ns, 0), 'p': path}}) FILTER (want) AS a FROM m GROUP BY 1 HAVING count(*) >= 2)
    SELECT class_id, path, (want OR prior) AND NOT coalesce(s = n AND path = a.p, false) AS selected FROM m JOIN g USING (class_id)""",
)
def h_scoped_selection(spark: SparkSession, d: str) -> DataFrame:
    """Images and documents are selected, copies on volumes were before and are hidden now."""
    kind = category(F.col("path"))
    return ranking.safe_selection(cut(_dups(spark, d)), (kind == "image") | (kind == "document"), F.col("path").startswith("/Volumes/"))


@query("h_times", f"WITH {INV} SELECT path, CASE WHEN coalesce(CAST(mtime_ns AS DOUBLE), CAST(btime_ns AS DOUBLE)) >= 0 THEN coalesce(CAST(mtime_ns AS DOUBLE), CAST(btime_ns AS DOUBLE)) END AS t FROM inv")
def h_times(spark: SparkSession, d: str) -> DataFrame:
    rows = I.files(spark, d).select("path", "mtime_ns", "btime_ns")
    return rows.select("path", ranking.time_of(rows).alias("t"))


@query(
    "i_legacy_cut",
    f"""WITH s AS (SELECT CAST(cluster_id AS VARCHAR) AS path, epoch_us(built_at) * 1000 AS t, coalesce(size, 0) AS size, class_count % 2 = 0 AS legacy FROM (SELECT DISTINCT cluster_id, built_at, size, class_count FROM dir_clusters)),
    o AS (SELECT path FROM s WHERE legacy AND t < (SELECT max(t) FROM s) - 86400000000000 AND path <> (SELECT max({{'t': t, 'p': path}}).p FROM s))
    SELECT count(*) FILTER (path IN (SELECT path FROM o)) AS removed, CAST(coalesce(sum(size) FILTER (path IN (SELECT path FROM o)), 0) AS BIGINT) AS freed_bytes, CAST(coalesce(sum(size) FILTER (path NOT IN (SELECT path FROM o)), 0) AS BIGINT) AS store_bytes FROM s""",
)
def i_legacy_cut(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as saved scans, those of an even number of classes in the legacy form, cut at a day before the newest."""
    from stratafold.operators.retention import legacy_cut

    rows = table(spark, d, "dir_clusters").select("cluster_id", "built_at", "size", "class_count").distinct()
    at = F.unix_micros(F.col("built_at").cast("timestamp")) * 1000
    scans = cut(rows.select(F.col("cluster_id").cast("string").alias("path"), at.alias("created_ns"), F.coalesce("size", F.lit(0)).alias("size"), (F.col("class_count") % 2 == 0).alias("legacy")))
    newest = scans.agg(F.max("created_ns")).head()[0] or 0
    return legacy_cut(scans, newest, 1)[1]


@query(
    "p_review_total",
    f"""WITH {INV}, t AS (SELECT least(dir_a, dir_b) AS a, greatest(dir_a, dir_b) AS b, max_by(status, row_id) AS tag FROM folder_compare WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT DISTINCT least(dir_a, dir_b) AS a, greatest(dir_a, dir_b) AS b FROM sim_pairs WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL),
    c AS (SELECT (SELECT count(*) FROM inv WHERE size IS NULL) AS problems, (SELECT count(*) FROM p LEFT JOIN t USING (a, b) WHERE coalesce(tag <> 'identical', true)) AS pairs, (SELECT count(*) FROM inv WHERE {_IMAGE}) AS selected, (SELECT count(*) FROM inv WHERE {_IMAGE} AND starts_with(path, '/Volumes/')) AS external)
    SELECT *, problems + pairs + selected + 1 AS total FROM c""",
)
def p_review_total(spark: SparkSession, d: str) -> DataFrame:
    """Everything that waits for a look, all images being selected in a result that is read only."""
    key = [F.least("dir_a", "dir_b").alias("a"), F.greatest("dir_a", "dir_b").alias("b")]
    both = "dir_a IS NOT NULL AND dir_b IS NOT NULL"
    tags = table(spark, d, "folder_compare").where(both + " AND status IS NOT NULL").groupBy(*key).agg(F.max_by("status", "row_id").alias("tag"))
    rows = cut(I.files(spark, d))
    return views.review_queue(rows.where("size IS NULL"), table(spark, d, "sim_pairs").where(both).select(*key).distinct(), tags, rows.where(_image()).select("path"), True, "identical")


@query("m_advice", f"WITH {_MESSAGES} SELECT title, count(*) AS messages, min(length(title)) AS n FROM (SELECT {sql_problem('message')} AS title FROM ms) GROUP BY 1")
def m_advice(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of problems that have an advice, which is all of them."""
    from stratafold.functions.text import problem_advice, problem_title

    prefix = F.when(F.col("lang") == "en", "fskit: ").when(F.col("lang") == "uk", "no such file: ").otherwise("")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(prefix, "text").alias("m"))
    rows = rows.select(problem_title(F.col("m")).alias("title"), problem_advice(F.col("m")).alias("advice")).where("advice IS NOT NULL")
    return rows.groupBy("title").agg(F.count("*").alias("messages"), F.min(F.length("title")).cast("bigint").alias("n"))


@query("m_labels", f"WITH {INV} SELECT {sql_category('path')} AS category, CASE {sql_category('path')} WHEN 'image' THEN 'Зображення' WHEN 'video' THEN 'Відео' WHEN 'audio' THEN 'Аудіо' WHEN 'document' THEN 'Документи' WHEN 'archive' THEN 'Архіви' WHEN 'application' THEN 'Програми й пакети' ELSE 'Інше' END AS label, count(*) AS files FROM inv GROUP BY 1, 2")
def m_labels(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.functions.text import category_label

    kinds = I.files(spark, d).groupBy(category(F.col("path")).alias("category")).agg(F.count("*").alias("files"))
    return kinds.select("category", category_label(F.col("category"), "uk").alias("label"), "files")


@query(
    "n_restore_verdicts",
    f"""WITH {INV}, s AS (SELECT path, size, class_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY file_id) AS r FROM inv) WHERE r = 1 AND size IS NOT NULL),
    i AS (SELECT *, {sql_category('path')} AS kind FROM s)
    SELECT path AS trashed_path, CASE kind WHEN 'image' THEN 'done' WHEN 'audio' THEN 'gone' WHEN 'video' THEN 'changed' WHEN 'archive' THEN 'outside' WHEN 'document' THEN 'occupied' ELSE 'ready' END AS verdict FROM i""",
)
def n_restore_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Journal items whose verdict follows from their category: restored, gone, of another size, from outside, taken, or ready."""
    rows = cut(I.files(spark, d).where("size IS NOT NULL").groupBy("path").agg(F.min("size").alias("size"), F.min("class_id").alias("class_id")))
    kind = category(F.col("path"))
    place = F.when(kind == "archive", F.concat(F.lit("/other"), "path")).when(kind == "document", F.col("path")).otherwise(F.concat(F.lit("/Users/back"), "path"))
    trashed = F.when(kind == "audio", F.concat(F.lit("/gone"), "path")).otherwise(F.col("path"))
    size = F.when(kind == "video", F.col("size") + 1).otherwise(F.col("size"))
    status = F.when(kind == "image", "restored").otherwise("trashed")
    items = cut(rows.select(place.alias("original_path"), trashed.alias("trashed_path"), size.alias("size"), F.lit(None).cast("string").alias("digest"), status.alias("status"), F.col("path").alias("own")))
    roots = spark.createDataFrame([("/Users",), ("/Volumes",), ("/mnt",), ("/srv",)], "root string")
    found = removal.restorable(items.drop("own"), rows, roots)
    return items.join(found, "original_path").select(F.col("own").alias("trashed_path"), "verdict")


SQL["n_transfer_names"] = _NAMES + " SELECT source, target, final, action FROM fn"
