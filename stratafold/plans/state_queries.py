"""Queries on keepers and selections (H), retention (I), saved scans and reports (J), streams (K), removals (N) and views (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.text import category
from stratafold.operators import ranking as R
from stratafold.operators import removal, reports, retention, snapshots, tree
from stratafold.operators.changes import latest_rows
from stratafold.plans.sqlviews import DUP, INV
from stratafold.plans.sqlviews import category as sql_category
from stratafold.session import cut
from stratafold.sources import inventory as I
from stratafold.sources.tables import table
from stratafold.streaming import folds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_ID = ["size", "mtime_ns", "ctime_ns", "dev", "ino"]


def snapshot(spark: SparkSession, d: str, back: int) -> DataFrame:
    """The newest readings of the last snapshot (``back`` 0) or of one before it."""
    rows = table(spark, d, "file_snapshots").where("path IS NOT NULL")
    last = rows.agg(F.max("snapshot_no")).head()[0]
    rows = rows.where(F.col("snapshot_no") == (last or 0) - back)
    return latest_rows(rows, ["path"], ["seen_at", "received_at"], _ID)


def _snap(back: int) -> str:
    last = ", ".join(f"{c} DESC NULLS LAST" for c in _ID)
    return f"(SELECT path, {', '.join(_ID)} FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC, {last}) AS r FROM file_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM file_snapshots) - {back} AND path IS NOT NULL) WHERE r = 1)"


_IMAGE = f"{sql_category('path')} = 'image'"


def _dups(spark: SparkSession, d: str) -> DataFrame:
    return I.duplicates(I.files(spark, d))


_FOLD = "replace(lower(nfc_normalize(path)), 'ß', 'ss'), nfc_normalize(path)"


def _keeper(name: str, rules: R.KeepRules, order: str) -> None:
    sql = f"""WITH {DUP}, r AS (SELECT class_id, path, row_number() OVER (PARTITION BY class_id ORDER BY {order}{_FOLD}) AS k, count(*) OVER (PARTITION BY class_id) AS n FROM dup)
    SELECT class_id, path AS keeper FROM r WHERE k = 1 AND n >= 2"""
    query(name, sql)(lambda spark, d: R.choose_keepers(_dups(spark, d), rules))


_keeper("h_keeper_newest", R.KeepRules("newest"), "mtime_ns IS NULL, CAST(mtime_ns AS DOUBLE) DESC, ")
_keeper("h_keeper_oldest", R.KeepRules("oldest"), "mtime_ns IS NULL, CAST(mtime_ns AS DOUBLE), ")
_keeper("h_keeper_lexical", R.KeepRules("lexical"), "")
_RULES = R.KeepRules("newest", always_keep=["/srv/mirror"], prefer_keep=["/Users/studio"], prefer_remove=["/mnt"], internal_first=True)
_ORDER = """CASE WHEN starts_with(path, '/srv/mirror/') THEN 0 WHEN starts_with(path, '/Users/studio/') THEN 1 ELSE 2 END, starts_with(path, '/mnt/'), starts_with(path, '/Volumes/'), mtime_ns IS NULL, CAST(mtime_ns AS DOUBLE) DESC, """
_keeper("h_keeper_rules", _RULES, _ORDER)


@query(
    "h_victims",
    f"""WITH {DUP}, r AS (SELECT class_id, path, first_value(path) OVER w AS keeper, count(*) OVER (PARTITION BY class_id) AS n FROM dup WINDOW w AS (PARTITION BY class_id ORDER BY {_ORDER}{_FOLD}))
    SELECT class_id, path, keeper FROM r WHERE n >= 2 AND path <> keeper AND NOT starts_with(path, '/srv/mirror/') AND NOT starts_with(path, '/Users/studio/')""",
)
def h_victims(spark: SparkSession, d: str) -> DataFrame:
    return R.removals(cut(_dups(spark, d)), _RULES, ["/Users/studio"])


@query(
    "h_safe_selection",
    f"""WITH {DUP}, g AS (SELECT *, {_IMAGE} AS want, count(*) OVER w AS n, count(*) FILTER ({_IMAGE}) OVER w AS s, row_number() OVER (PARTITION BY class_id ORDER BY coalesce(mtime_ns, 0), path) AS age FROM dup WINDOW w AS (PARTITION BY class_id))
    SELECT class_id, path, want AND NOT (s = n AND age = 1) AS selected FROM g WHERE n >= 2""",
)
def h_safe_selection(spark: SparkSession, d: str) -> DataFrame:
    return R.safe_selection(cut(_dups(spark, d)), category(F.col("path")) == "image")


@query(
    "h_reclaim_cap",
    f"""WITH {DUP}, g AS (SELECT *, {_IMAGE} AS want, count(*) OVER (PARTITION BY class_id) AS n FROM dup), r AS (SELECT *, sum(CASE WHEN want THEN 1 ELSE 0 END) OVER (PARTITION BY class_id ORDER BY path) AS upto FROM g)
    SELECT class_id, path, want AS selected, CASE WHEN want AND upto <= n - 1 THEN size ELSE 0 END AS reclaimable FROM r""",
)
def h_reclaim_cap(spark: SparkSession, d: str) -> DataFrame:
    return R.reclaimable(cut(_dups(spark, d)), category(F.col("path")) == "image")


@query("h_selection_stats", f"WITH {DUP} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(DISTINCT class_id) AS groups FROM dup WHERE {_IMAGE}")
def h_selection_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.selection_stats(_dups(spark, d), category(F.col("path")) == "image")


_GROUPS = f"{DUP}, g AS (SELECT class_id, max(size) * (count(*) - 1) AS wasted FROM dup GROUP BY 1 HAVING count(*) >= 2)"


@query("h_group_numbers", f"WITH {_GROUPS} SELECT class_id, wasted, 'F' || row_number() OVER (ORDER BY wasted DESC, class_id) AS label FROM g")
def h_group_numbers(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.operators.groups import duplicate_groups

    g = duplicate_groups(_dups(spark, d)).select("class_id", "wasted")
    return R.numbered(g, "F", [R.Order(F.col("wasted"), True), R.Order(F.col("class_id"))])


@query("i_page", f"WITH {_GROUPS} SELECT * FROM (SELECT class_id, wasted, row_number() OVER (ORDER BY wasted DESC, class_id) AS k FROM g) WHERE k BETWEEN 101 AND 200")
def i_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 100 groups: paging is the feature."""
    from stratafold.operators.groups import duplicate_groups

    g = duplicate_groups(_dups(spark, d)).select("class_id", "wasted")
    return R.running(g, [R.Order(F.col("wasted"), True), R.Order(F.col("class_id"))]).where("k BETWEEN 101 AND 200")


_PAIRS = "p AS (SELECT DISTINCT * FROM sim_pairs WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL AND percent IS NOT NULL AND shared_bytes IS NOT NULL)"


@query("h_topk_pairs", f"WITH {_PAIRS}, q AS (SELECT DISTINCT dir_a, dir_b, percent, shared_bytes FROM p) SELECT * FROM q ORDER BY shared_bytes DESC, percent DESC, dir_a DESC, dir_b DESC LIMIT 400")
def h_topk_pairs(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.operators.similar import top_pairs

    rows = table(spark, d, "sim_pairs").select("dir_a", "dir_b", "percent", "shared_bytes").dropna().distinct()
    return top_pairs(rows)


@query("h_bottomk_sample", f"WITH {INV}, r AS (SELECT dir, path, row_number() OVER (PARTITION BY dir ORDER BY sha256(path), path) AS place FROM inv) SELECT dir, path, CAST(place AS INT) AS place FROM r WHERE place <= 8")
def h_bottomk_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.bottom_sample(I.files(spark, d).select("dir", "path"), "dir", "path")


@query(
    "h_root_vote",
    f"""WITH {INV}, p AS (SELECT dir, path, array_to_string(string_split(path, '/')[1:3], '/') AS volume FROM inv WHERE starts_with(path, '/Volumes/')),
    s AS (SELECT DISTINCT volume AS root, substr(path, length(volume) + 1) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY sha256(path), path) AS place FROM p) WHERE place <= 8),
    z AS (SELECT root, count(*) AS n FROM s GROUP BY 1), c AS (SELECT DISTINCT volume AS candidate, substr(path, length(volume) + 1) AS rel FROM p),
    v AS (SELECT root, candidate, count(*) AS hits FROM s JOIN c USING (rel) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(hits) OVER w, 0) AS second FROM v JOIN z USING (root) WINDOW w AS (PARTITION BY root ORDER BY hits DESC, candidate))
    SELECT root, candidate, hits, r = 1 AND CASE WHEN n = 1 THEN hits = 1 AND second = 0 WHEN second = 0 THEN hits >= 2 ELSE hits * 4 >= n * 3 AND hits - second >= 2 END AS accepted FROM r""",
)
def h_root_vote(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.functions.paths import volume

    v = volume(F.col("path"))
    rows = cut(I.files(spark, d).where("startswith(path, '/Volumes/')").select("dir", "path", v.alias("volume"), F.substring("path", F.length(v) + 1, F.length("path")).alias("rel")))
    sample = R.bottom_sample(rows, "dir", "path").select(F.col("volume").alias("root"), "rel")
    return R.relocation_vote(sample, rows.select(F.col("volume").alias("candidate"), "rel"))


@query(
    "h_busy_union",
    """WITH i AS (SELECT event_type AS stream, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(abs(value) * 1000000) AS BIGINT) AS e, CAST(1 AS BIGINT) AS bytes FROM events WHERE value IS NOT NULL),
    c AS (SELECT *, greatest(s, coalesce(max(e) OVER (PARTITION BY stream ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS f FROM i)
    SELECT stream, CAST(sum(greatest(0, e - f)) AS BIGINT) AS busy, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY 1""",
)
def h_busy_union(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").where("value IS NOT NULL").select(
        F.col("event_type").alias("stream"), t.alias("start"), (t + F.floor(F.abs("value") * 1000000)).alias("end"), F.lit(1).cast("bigint").alias("bytes")
    )
    return R.busy_time(rows, "stream")


@query(
    "i_retention_count",
    f"WITH {INV} SELECT path FROM (SELECT path, row_number() OVER (ORDER BY scanned_at DESC, path DESC) AS k FROM (SELECT path, scanned_at FROM inv)) WHERE k <= 1000",
)
def i_retention_count(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_rows(table(spark, d, "files").where("path IS NOT NULL AND file_id IS NOT NULL"), ["file_id"], ["batch_no", "scanned_at"], ["path", "scanned_at"])
    return retention.keep_newest(rows.select("path", "scanned_at"), "scanned_at", "path", 1000).select("path")


@query(
    "i_retention_bytes",
    f"""WITH {INV}, r AS (SELECT path, size, coalesce(mtime_ns, 0) AS t, {_IMAGE} AS keep FROM inv WHERE size IS NOT NULL), s AS (SELECT sum(size) AS total FROM r),
    u AS (SELECT path, sum(size) OVER (ORDER BY t, path) - size AS older FROM r WHERE NOT keep)
    SELECT path, (SELECT total FROM s) - older <= 2000000000 AS kept FROM u UNION ALL SELECT path, true FROM r WHERE keep""",
)
def i_retention_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = I.files(spark, d).where("size IS NOT NULL").select("path", "size", F.coalesce("mtime_ns", F.lit(0)).alias("t"), (category(F.col("path")) == "image").alias("keep"))
    return retention.keep_within(cut(rows), "t", "path", "size", 2_000_000_000, "keep").select("path", "kept")


_NOW = 1_741_000_000_000_000_000


@query("i_stale", f"WITH {INV} SELECT path FROM inv WHERE coalesce(btime_ns = 0, true) OR coalesce(ctime_ns = 0, true) OR coalesce(dev = 0, true) OR coalesce(ino = 0, true) OR btime_ns < {_NOW - retention.STALE_NS}")
def i_stale(spark: SparkSession, d: str) -> DataFrame:
    return retention.stale(I.files(spark, d).withColumn("accessed_ns", F.col("btime_ns")), _NOW).select("path")


@query(
    "i_touch",
    f"""WITH {INV}, u AS (SELECT DISTINCT path FROM file_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM file_snapshots))
    SELECT path, CASE WHEN path IN (SELECT path FROM u WHERE path IS NOT NULL) AND btime_ns < {_NOW - retention.TOUCH_NS} THEN {_NOW} ELSE btime_ns END AS accessed_ns FROM inv""",
)
def i_touch(spark: SparkSession, d: str) -> DataFrame:
    rows = I.files(spark, d).select("path", F.lit("f").alias("kind"), F.col("btime_ns").alias("accessed_ns"))
    used = snapshot(spark, d, 0).select("path", F.lit("f").alias("kind"))
    return retention.touched(rows, used, _NOW).select("path", "accessed_ns")


@query(
    "d_refresh_stats",
    f"""SELECT count(*) FILTER (o.path IS NULL) AS added, count(*) FILTER (n.path IS NULL) AS removed,
    count(*) FILTER (o.path IS NOT NULL AND n.path IS NOT NULL AND ((o.size, o.mtime_ns, o.ctime_ns, o.dev, o.ino) IS DISTINCT FROM (n.size, n.mtime_ns, n.ctime_ns, n.dev, n.ino))) AS changed,
    count(*) FILTER (o.path IS NOT NULL AND n.path IS NOT NULL AND ((o.size, o.mtime_ns, o.ctime_ns, o.dev, o.ino) IS NOT DISTINCT FROM (n.size, n.mtime_ns, n.ctime_ns, n.dev, n.ino))) AS unchanged
    FROM {_snap(1)} o FULL JOIN {_snap(0)} n ON o.path = n.path""",
)
def d_refresh_stats(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.refresh_stats(snapshot(spark, d, 1), snapshot(spark, d, 0))


@query(
    "j_recompute",
    f"""WITH {INV}, r AS (SELECT path FROM inv WHERE {_IMAGE} UNION SELECT DISTINCT dir_b FROM folder_compare WHERE dir_b IS NOT NULL),
    k AS (SELECT * FROM inv WHERE path NOT IN (SELECT path FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE inv.dir = r.path OR starts_with(inv.dir, r.path || '/')))
    SELECT class_id, max(size) AS size, count(*) AS copies, max(size) * (count(*) - 1) AS wasted FROM k WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:') AND size IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""",
)
def j_recompute(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.operators.groups import duplicate_groups

    rows = I.files(spark, d)
    gone = rows.where(category(F.col("path")) == "image").select("path").union(table(spark, d, "folder_compare").where("dir_b IS NOT NULL").select("dir_b"))
    return duplicate_groups(I.duplicates(snapshots.remaining(rows, gone)))


@query(
    "j_violations",
    f"""WITH {INV} SELECT 'size is known and not negative' AS rule, path FROM inv WHERE size IS NULL OR size < 0
    UNION ALL SELECT 'class has the file''s size', path FROM inv WHERE regexp_matches(class_id, '^\\d{{1,18}}:') AND TRY_CAST(string_split(class_id, ':')[1] AS BIGINT) IS DISTINCT FROM size
    UNION ALL SELECT 'class has the right form', path FROM inv WHERE NOT regexp_matches(class_id, '^(\\d+:[0-9a-f]{{64}}|u:.+)$')
    UNION ALL SELECT 'name and folder are the path''s', path FROM inv WHERE dir || '/' || name IS DISTINCT FROM path
    UNION ALL SELECT 'path is absolute and normal', path FROM inv WHERE NOT starts_with(path, '/') OR regexp_matches(path, '//|/\\.{{1,2}}(/|$)|.+/$')
    UNION ALL SELECT 'identity is known', path FROM inv WHERE dev IS NULL OR ino IS NULL
    UNION ALL SELECT 'path comes once', path FROM inv GROUP BY path HAVING count(*) > 1""",
)
def j_violations(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.violations(cut(I.files(spark, d)))


@query(
    "j_seed_rows",
    f"""WITH {INV}, v AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:3], '/') AS old FROM inv WHERE starts_with(path, '/Volumes/')),
    g AS (SELECT *, array_to_string(string_split(path, '/')[1:3], '/') AS old FROM inv WHERE regexp_matches(class_id, '^\\d{{1,18}}:[0-9a-f]{{64}}$') AND string_split(class_id, ':')[1] = CAST(size AS VARCHAR) AND ctime_ns > 0 AND dev > 0 AND ino > 0)
    SELECT DISTINCT '/restored' || substr(old, 9) || substr(path, length(old) + 1) AS path, string_split(class_id, ':')[2] AS digest, size, mtime_ns, ctime_ns, dev, ino FROM g JOIN v USING (old)""",
)
def j_seed_rows(spark: SparkSession, d: str) -> DataFrame:
    from stratafold.functions.paths import volume

    rows = cut(I.files(spark, d))
    roots = rows.where("startswith(path, '/Volumes/')").select(volume(F.col("path")).alias("old")).distinct()
    return snapshots.seed_rows(rows, roots.withColumn("new", F.concat(F.lit("/restored"), F.expr("substr(old, 9)"))))


_REPORT = f"""{DUP},
fg AS (SELECT class_id, max(size) AS gsize, count(*) AS copies FROM dup GROUP BY 1 HAVING count(*) >= 2),
fl AS (SELECT *, 'F' || row_number() OVER (ORDER BY gsize * (copies - 1) DESC, class_id) AS label FROM fg),
fr AS (SELECT dup.class_id, path, {_IMAGE} AS sel, label, gsize, copies, sum(CASE WHEN {_IMAGE} THEN 1 ELSE 0 END) OVER (PARTITION BY dup.class_id ORDER BY path) AS upto FROM dup JOIN fl USING (class_id)),
pr AS (SELECT DISTINCT dir_a, dir_b, percent, shared_bytes FROM sim_pairs WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL AND percent IS NOT NULL AND shared_bytes IS NOT NULL),
report AS (SELECT 'exact_file' AS record_type, label AS "group", {sql_category('path', True)} AS category, path, '' AS counterpart, gsize AS size_bytes, copies, sel AS selected,
  CASE WHEN sel AND upto <= copies - 1 THEN gsize ELSE 0 END AS reclaimable_bytes, string_split(class_id, ':')[2] AS digest, CAST(NULL AS DOUBLE) AS similarity_percent, CAST(NULL AS BIGINT) AS shared_bytes FROM fr
  UNION ALL SELECT 'similar_directories', 'S' || row_number() OVER (ORDER BY shared_bytes DESC, percent DESC, dir_a DESC, dir_b DESC), 'folder', dir_a, dir_b, NULL, 2, false, 0, '', percent, shared_bytes FROM pr)"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(I.files(spark, d))
    known = rows.where("size IS NOT NULL")
    digests = tree.folder_digests(I.folders(rows), known.select("dir", "name", "class_id"))
    folders = tree.identical_folders(digests, tree.subtree_sums(rows))
    pairs = table(spark, d, "sim_pairs").select("dir_a", "dir_b", "percent", "shared_bytes").dropna().distinct()
    return reports.report_rows(I.duplicates(rows), folders, pairs, category(F.col("path")) == "image")


@query("j_report_union", f"WITH {_REPORT} SELECT * FROM report")
def j_report_union(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


@query(
    "d_report_summary",
    f"""WITH {_REPORT}, g AS (SELECT record_type, "group", count(*) AS items, coalesce(max(size_bytes), 0) AS size, count(*) FILTER (selected) AS chosen, sum(reclaimable_bytes) AS reclaim FROM report GROUP BY 1, 2)
    SELECT record_type, count(*) AS groups, CAST(sum(items) AS BIGINT) AS items, CAST(sum(size * items) AS BIGINT) AS bytes, CAST(sum(size * (items - 1)) AS BIGINT) AS potential, CAST(sum(chosen) AS BIGINT) AS selected_items, CAST(sum(reclaim) AS BIGINT) AS reclaimable_bytes FROM g GROUP BY 1""",
)
def d_report_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.report_summary(_report(spark, d))


@query(
    "d_report_categories",
    f"""WITH {_REPORT} SELECT category, count(*) AS items, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (selected) AS selected_items, CAST(coalesce(sum(size_bytes) FILTER (selected), 0) AS BIGINT) AS selected_bytes
    FROM report WHERE record_type <> 'similar_directories' GROUP BY 1""",
)
def d_report_categories(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_counters(_report(spark, d))


def _streams(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").where("event_type IS NOT NULL").select("event_type", "event_id", t.alias("t"), "value")


_EV = "e AS (SELECT event_type, event_id, epoch_us(ts) / 1e6 AS t, value FROM events WHERE event_type IS NOT NULL)"


@query(
    "k_progress",
    f"""WITH RECURSIVE {_EV}, f AS (SELECT event_type, min({{'t': t, 'i': event_id}}) AS x FROM e GROUP BY 1),
    r AS (SELECT event_type, x.t AS t, x.i AS event_id FROM f
      UNION ALL SELECT event_type, x.t, x.i FROM (SELECT r.event_type, min({{'t': e.t, 'i': e.event_id}}) AS x FROM r JOIN e ON e.event_type = r.event_type AND e.t - r.t >= 60.0 GROUP BY 1, r.t))
    SELECT event_type, event_id, t FROM r""",
)
def k_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = _streams(spark, d)
    out = folds.fold_streams(rows, "event_type", ["t", "event_id"], lambda: folds.ProgressLimiter(60.0), lambda s, r: s.step(r.t, r.event_id, -1), "emitted boolean")
    return out.where("emitted").select("event_type", "event_id", "t")


@query(
    "k_remaining_time",
    f"""WITH {_EV}, s AS (SELECT *, event_id < lag(event_id) OVER w OR lag(event_id) OVER w IS NULL AS begins, lag(event_id) OVER w AS d FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
    u AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY event_type ORDER BY t, event_id) AS run, begins OR event_id <> d AS sample FROM s),
    k AS (SELECT *, sum(CAST(sample AS INT)) OVER (PARTITION BY event_type, run ORDER BY t, event_id) AS k, first_value(t) OVER (PARTITION BY event_type, run ORDER BY t, event_id) AS t_first FROM u),
    c AS (SELECT event_type, run, k, t, event_id AS d FROM k WHERE sample),
    j AS (SELECT k.*, a.t AS t0, a.d AS d0, b.t AS t1 FROM k JOIN c a ON (a.event_type, a.run, a.k) = (k.event_type, k.run, greatest(1, k.k - 7)) JOIN c b ON (b.event_type, b.run, b.k) = (k.event_type, k.run, k.k))
    SELECT event_type, event_id, CASE WHEN k >= 3 AND t - t_first >= 1.5 AND event_id < 1000000000 AND t1 > t0 AND event_id > d0 THEN (1000000000 - event_id) * (t1 - t0) / (event_id - d0) END AS remaining FROM j""",
)
def k_remaining_time(spark: SparkSession, d: str) -> DataFrame:
    rows = _streams(spark, d).withColumn("all", F.lit(10**9))
    return folds.remaining_time(rows, "event_type", ["t", "event_id"], "t", "event_id", "all").select("event_type", "event_id", "remaining")


@query(
    "k_hysteresis",
    f"""WITH {_EV}, p AS (SELECT *, row_number() OVER w AS k, CASE WHEN value >= 60 THEN 1 WHEN value <= 57 THEN 0 END AS mark FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
    q AS (SELECT *, max(CASE WHEN mark IS NOT NULL THEN k * 2 + mark END) OVER w AS decided, max(CASE WHEN value IS NOT NULL THEN k END) OVER w AS seen FROM p WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id))
    SELECT event_type, event_id, coalesce(decided % 2 = 1, false) AND k - coalesce(seen, 0) <= 3 AS hot FROM q""",
)
def k_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return folds.hot_flags(_streams(spark, d), "event_type", ["t", "event_id"], "value", 60.0).select("event_type", "event_id", "hot")


@query(
    "k_concurrency",
    f"""WITH RECURSIVE {_EV}, v AS (SELECT event_type, event_id, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS k FROM e),
    r AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, 2 AS level, CAST(NULL AS DOUBLE) AS smooth, CAST(NULL AS DOUBLE) AS trial, 0 AS rest, 0 AS failures FROM e
      UNION ALL
      SELECT event_type, k, event_id,
        CASE WHEN v IS NULL THEN level WHEN trial IS NOT NULL THEN CASE WHEN trial = 0 OR s / trial >= 1.05 THEN level ELSE greatest(1, level - 1) END WHEN rest = 0 AND level < 16 THEN level + 1 ELSE level END,
        s, CASE WHEN v IS NULL THEN trial WHEN trial IS NULL AND rest = 0 AND level < 16 THEN s END,
        CASE WHEN v IS NULL THEN rest WHEN trial IS NOT NULL THEN CASE WHEN trial = 0 OR s / trial >= 1.05 THEN 0 ELSE least(32, 2 << least(10, failures + 1)) END ELSE greatest(0, rest - 1) END,
        CASE WHEN v IS NULL OR trial IS NULL THEN failures WHEN trial = 0 OR s / trial >= 1.05 THEN 0 ELSE failures + 1 END
      FROM (SELECT r.* EXCLUDE (k, event_id, smooth), v.k, v.event_id, v.v, CASE WHEN v.v IS NULL THEN r.smooth WHEN r.smooth IS NULL THEN v.v ELSE (r.smooth + v.v) / 2 END AS s FROM r JOIN v ON v.event_type = r.event_type AND v.k = r.k + 1))
    SELECT event_type, event_id, level FROM r WHERE k > 0""",
)
def k_concurrency(spark: SparkSession, d: str) -> DataFrame:
    out = folds.fold_streams(_streams(spark, d), "event_type", ["t", "event_id"], folds.HillClimb, lambda s, r: s.step(r.value), "level int")
    return out.select("event_type", "event_id", "level")


@query("k_adaptive_cap", "SELECT CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 4 WHEN count(*) FILTER (event_type NOT IN ('view', 'click')) > 0 THEN 8 ELSE 16 END AS cap, user_id FROM events GROUP BY user_id")
def k_adaptive_cap(spark: SparkSession, d: str) -> DataFrame:
    """The cap by kind of medium, on event types: an error as a rotating disk, a view or click as a solid one, others unknown."""
    kind = F.col("event_type")
    cap = F.min(F.when(kind == "error", 4).when(~kind.isin("view", "click"), 8).otherwise(16))
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(cap, F.lit(16)).alias("cap"))


@query(
    "n_authorised",
    f"""WITH o AS (SELECT * FROM {_snap(1)}), n AS (SELECT * FROM {_snap(0)})
    SELECT o.path, CASE WHEN starts_with(o.path, '/srv/mirror/') THEN 'protected' WHEN n.path IS NULL THEN 'missing' WHEN (o.dev, o.ino, o.size, o.mtime_ns, o.ctime_ns) IS DISTINCT FROM (n.dev, n.ino, n.size, n.mtime_ns, n.ctime_ns) THEN 'changed' ELSE 'authorised' END AS verdict
    FROM o LEFT JOIN n ON o.path = n.path""",
)
def n_authorised(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("/srv/mirror",)], "root string")
    return removal.authorised(snapshot(spark, d, 1), snapshot(spark, d, 0), roots)


@query(
    "n_proof_state",
    f"""WITH {INV}, n AS (SELECT * FROM {_snap(0)})
    SELECT i.path, CASE WHEN n.path IS NULL THEN 'fail' WHEN i.class_id IS NOT NULL AND NOT starts_with(i.class_id, 'u:') AND starts_with(i.path, '/Volumes/Sklad/') AND
      CASE WHEN i.dev = 0 THEN (i.size, i.mtime_ns) IS NOT DISTINCT FROM (n.size, n.mtime_ns) ELSE (i.size, i.mtime_ns, i.ctime_ns, i.dev, i.ino) IS NOT DISTINCT FROM (n.size, n.mtime_ns, n.ctime_ns, n.dev, n.ino) END THEN 'trusted' ELSE 'reread' END AS state
    FROM inv i LEFT JOIN n ON n.path = i.path""",
)
def n_proof_state(spark: SparkSession, d: str) -> DataFrame:
    trusted = spark.createDataFrame([("/Volumes/Sklad",)], "volume string")
    return removal.proof_state(I.files(spark, d), snapshot(spark, d, 0), trusted)


@query(
    "p_selection_refresh",
    f"WITH a AS (SELECT path FROM {_snap(1)} WHERE {_IMAGE}), b AS (SELECT path FROM {_snap(0)}) SELECT path FROM a WHERE path IN (SELECT path FROM b)",
)
def p_selection_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Selected files that are still there after a refresh."""
    chosen = snapshot(spark, d, 1).where(category(F.col("path")) == "image").select("path")
    return chosen.join(snapshot(spark, d, 0).select("path"), "path", "left_semi")


@query(
    "p_review_queue",
    f"""WITH t AS (SELECT least(dir_a, dir_b) AS a, greatest(dir_a, dir_b) AS b, max_by(status, row_id) AS tag FROM folder_compare WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT DISTINCT least(dir_a, dir_b) AS a, greatest(dir_a, dir_b) AS b FROM sim_pairs WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL),
    {INV} SELECT (SELECT count(*) FROM inv WHERE size IS NULL) AS problems, (SELECT count(*) FROM p LEFT JOIN t USING (a, b) WHERE coalesce(tag, 'pending') <> 'identical') AS pairs""",
)
def p_review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Open problems and similar pairs that aren't approved yet; a pair's newest tag counts, whichever way round it was set."""
    key = [F.least("dir_a", "dir_b").alias("a"), F.greatest("dir_a", "dir_b").alias("b")]
    both = "dir_a IS NOT NULL AND dir_b IS NOT NULL"
    tags = table(spark, d, "folder_compare").where(both + " AND status IS NOT NULL").groupBy(*key).agg(F.max_by("status", "row_id").alias("tag"))
    pairs = table(spark, d, "sim_pairs").where(both).select(*key).distinct().join(tags, ["a", "b"], "left")
    open_pairs = pairs.where(F.coalesce("tag", F.lit("pending")) != "identical").agg(F.count("*").alias("pairs"))
    return I.files(spark, d).agg(F.count_if(F.col("size").isNull()).alias("problems")).crossJoin(F.broadcast(open_pairs))


@query(
    "p_bounded_log",
    "WITH l AS (SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 THEN '<oversized-text-omitted>' ELSE text END AS text FROM documents WHERE text IS NOT NULL), u AS (SELECT *, sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id) AS upto FROM l) SELECT doc_id, text FROM u WHERE upto <= 200000",
)
def p_bounded_log(spark: SparkSession, d: str) -> DataFrame:
    """Messages in order within a budget of bytes: the bound is the feature."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return retention.bounded_log(rows, "doc_id", "text", 200_000, 2_000)
