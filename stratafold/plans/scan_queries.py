"""Queries on whole scans (C0, C6-C10, B6, B8, A2c, E10, F13) and on cases that the tables lack, derived from all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.text import category
from stratafold.operators import scan as S
from stratafold.operators import similar, tree
from stratafold.operators.views import Profile
from stratafold.plans.folder_queries import _SIDES, _compare_pairs
from stratafold.plans.sqlviews import INV
from stratafold.plans.sqlviews import category as sql_category
from stratafold.session import cut
from stratafold.sources import inventory as I

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The inventory as the entries of a walk: inodes shared by neighbours, classes of images in the cloud, sizes unknown where unreadable.
_IMAGE, _VIDEO = (f"{sql_category('path')} = '{k}'" for k in ("image", "video"))
_ENTRIES = f"""{INV},
ent AS (SELECT path, dir, name, size, mtime_ns, ctime_ns, dev, ino // 8 AS ino, class_id, storage_dev, storage_off, alloc, {_VIDEO} AND size >= 100000 AS cloud,
  NOT starts_with(name, '.') AND coalesce(size, 0) >= 4096 AND NOT starts_with(path, '/mnt/') AS profiled FROM inv),
adm AS (SELECT * FROM ent WHERE profiled AND NOT cloud AND size IS NOT NULL),
can AS (SELECT dev, ino, min(path) AS canonical FROM adm GROUP BY 1, 2),
fil AS (SELECT a.* FROM adm a JOIN can ON a.dev = can.dev AND a.ino = can.ino AND a.path = can.canonical),
ali AS (SELECT a.dir, a.name, a.path AS alias, canonical, f.class_id FROM adm a JOIN can ON a.dev = can.dev AND a.ino = can.ino AND a.path <> can.canonical JOIN fil f ON f.path = canonical)"""


def _scan(spark: SparkSession, d: str, complete: bool = True) -> S.Scan:
    rows = cut(I.files(spark, d))
    cloud = (category(F.col("path")) == "video") & (F.col("size") >= 100_000)
    file = rows.select(
        F.when(F.col("size").isNull(), "error").otherwise("file").alias("kind"), "path", "dir", "name", "size", "mtime_ns", "ctime_ns", "dev",
        F.expr("ino div 8").alias("ino"), "storage_dev", "storage_off", "alloc", F.lit(None).cast("string").alias("target"),
        F.when(F.col("size").isNull(), F.concat("path", F.lit(": unreadable"))).alias("error"), F.when(cloud, S.CLOUD_ONLY).otherwise(0).alias("flags"),
    )
    null = lambda c: F.lit(None).cast(file.schema[c].dataType).alias(c)
    dirs = rows.select("dir").distinct().select(F.explode(tree.ancestors(F.col("dir"), include_self=True)).alias("path")).distinct()
    named = {"kind": F.lit("dir"), "path": F.col("path"), "dir": F.regexp_replace("path", r"/[^/]*$", ""), "name": F.element_at(F.split("path", "/"), -1), "flags": F.lit(0)}
    folder = dirs.select(*[named[c].alias(c) if c in named else null(c) for c in file.columns])
    profile = Profile(min_size=4096, hidden=False, excluded_paths=["/mnt"])
    return S.scan(file.unionByName(folder), classes=rows.select("path", "class_id").distinct(), profile=profile, complete=complete)


@query(
    "c_scan_groups",
    f"""WITH {_ENTRIES}, dup AS (SELECT * FROM fil WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:')),
    f AS (SELECT class_id, CASE WHEN storage_dev IS NOT NULL AND storage_off IS NOT NULL THEN 's:' || storage_dev || ':' || storage_off ELSE 'p:' || path END AS fam,
      max(least(coalesce(alloc, size), size)) AS a, count(*) AS n, max(size) AS size FROM dup GROUP BY 1, 2),
    g AS (SELECT class_id, max(size) AS size, CAST(sum(n) AS BIGINT) AS copies, count(*) AS families, CAST(CASE WHEN count(*) > 1 THEN sum(a) - min(a) ELSE 0 END AS BIGINT) AS freeable FROM f GROUP BY 1)
    SELECT *, freeable AS wasted FROM g WHERE copies >= 2""",
)
def c_scan_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of a whole scan: profile, files in the cloud, hard links, errors, then classes and families."""
    return _scan(spark, d).file_groups()


@query("c_partial_groups", f"WITH {_ENTRIES} SELECT class_id, max(size) AS size, count(*) AS copies, max(size) * (count(*) - 1) AS wasted FROM fil WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:') GROUP BY 1 HAVING count(*) >= 2")
def c_partial_groups(spark: SparkSession, d: str) -> DataFrame:
    """What a scan that was stopped publishes: proven groups with plain waste, no folders and no pairs."""
    return _scan(spark, d, complete=False).file_groups().select("class_id", "size", "copies", "wasted")


@query("c_scan_errors", f"WITH {_ENTRIES} SELECT path, path || ': unreadable' AS message FROM ent WHERE size IS NULL AND NOT starts_with(path, '/mnt/') UNION ALL SELECT path, path || ': content could not be read' FROM fil WHERE class_id IS NULL")
def c_scan_errors(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).errors


@query("c_scan_aliases", f"WITH {_ENTRIES} SELECT dir, name, alias, canonical, coalesce(class_id, 'u:' || canonical) AS class_id FROM ali")
def c_scan_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The paths of inodes that are listed already; neighbours are given one inode."""
    return _scan(spark, d).aliases


@query(
    "c_scan_folders",
    f"""WITH {_ENTRIES}, e AS (SELECT dir, profiled AND NOT cloud AND size IS NOT NULL AS ok, size IS NULL AS failed FROM ent WHERE NOT starts_with(path, '/mnt/')
      UNION ALL SELECT dir, false, true FROM fil WHERE class_id IS NULL UNION ALL SELECT dir, false, true FROM ali WHERE class_id IS NULL),
    up AS (SELECT array_to_string(parts[1:k], '/') AS dir, k = len(parts) AS own, ok, failed FROM (SELECT *, string_split(dir, '/') AS parts FROM e), unnest(range(2, len(parts) + 1)) AS t(k))
    SELECT dir, bool_and(ok OR NOT own) AS ok, bool_or(failed AND own) AS read_failed FROM up GROUP BY 1""",
)
def c_scan_folders(spark: SparkSession, d: str) -> DataFrame:
    """All folders of the scan; the excluded tree isn't entered, and its parent would be incomplete if it were listed."""
    return _scan(spark, d).folders.where("dir <> '/' AND dir <> ''").select("dir", "ok", "read_failed")


@query(
    "e_alias_counts",
    f"""WITH {_ENTRIES}, un AS (SELECT path, dir FROM fil WHERE class_id IS NULL UNION ALL SELECT path, dir FROM ent WHERE NOT starts_with(path, '/mnt/') AND NOT (profiled AND NOT cloud AND size IS NOT NULL)
      UNION ALL SELECT alias, dir FROM ali WHERE class_id IS NULL),
    r AS (SELECT dir, size, 'f' AS k FROM fil UNION ALL SELECT dir, 0, 'a' FROM ali), up AS (SELECT array_to_string(parts[1:k2], '/') AS dir, size, k FROM (SELECT *, string_split(dir, '/') AS parts FROM r), unnest(range(2, len(parts) + 1)) AS t(k2)),
    bad AS (SELECT DISTINCT array_to_string(parts[1:k2], '/') AS dir FROM (SELECT string_split(dir, '/') AS parts FROM un), unnest(range(2, len(parts) + 1)) AS t(k2))
    SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM up WHERE k = 'f' OR dir NOT IN (SELECT dir FROM bad) GROUP BY 1""",
)
def e_alias_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files below each folder with the hard links of provable folders, and bytes without them."""
    s = _scan(spark, d)
    return tree.subtree_sums(s.files, s.aliases, s.digests())


@query("c_scan_summary", f"""WITH {_ENTRIES}, dup AS (SELECT * FROM fil WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:')), g AS (SELECT max(size) * (count(*) - 1) AS wasted, count(*) AS copies FROM dup GROUP BY class_id HAVING count(*) >= 2)
    SELECT (SELECT count(*) FROM fil) AS files, (SELECT CAST(sum(size) AS BIGINT) FROM fil) AS bytes, count(*) AS groups, CAST(sum(copies) AS BIGINT) AS copies, CAST(sum(wasted) AS BIGINT) AS wasted,
    (SELECT count(*) FROM ent WHERE size IS NULL AND NOT starts_with(path, '/mnt/')) + (SELECT count(*) FROM fil WHERE class_id IS NULL) AS problems FROM g""")
def c_scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, complete=False).summary().select("files", "bytes", "groups", "copies", "wasted", "problems")


@query("c_write_back", f"WITH {_ENTRIES} SELECT path, 'f' AS kind, size, mtime_ns, ctime_ns, dev, ino, string_split(class_id, ':')[2] AS digest FROM fil WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:') AND NOT {_IMAGE}")
def c_write_back(spark: SparkSession, d: str) -> DataFrame:
    """New digests for the store; those of images came from it."""
    files = _scan(spark, d).files
    return S.settled_digests(files, files.where(category(F.col("path")) == "image").select("path"))


@query("c_parallelism", f"WITH {INV} SELECT CASE WHEN bool_and(starts_with(path, '/Volumes/')) THEN least(16, 2 * count(DISTINCT dev)) ELSE 8 END AS workers FROM inv WHERE starts_with(path, '/Volumes/')")
def c_parallelism(spark: SparkSession, d: str) -> DataFrame:
    return S.read_parallelism(I.files(spark, d).where("startswith(path, '/Volumes/')"))


# Every tree a second time under another root: all complete folders have a twin, only the topmost ones are reported.
_TWINS = f"""{INV}, two AS (SELECT path, dir, name, size, class_id FROM inv UNION ALL SELECT '/copy' || path, '/copy' || dir, name, size, class_id FROM inv),
anc AS (SELECT i.*, array_to_string(parts[1:k], '/') AS above FROM (SELECT *, string_split(path, '/') AS parts FROM two) i, unnest(range(2, len(parts))) AS t(k)),
sums AS (SELECT above AS dir, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM anc GROUP BY 1),
own AS (SELECT above AS dir, bool_and(class_id IS NOT NULL AND size IS NOT NULL) AS ok,
  string_agg(nfc_normalize(substr(path, length(above) + 2)) || '=' || coalesce(class_id, ''), chr(10) ORDER BY nfc_normalize(substr(path, length(above) + 2)), class_id) AS tree FROM anc GROUP BY 1),
trees AS (SELECT dir, md5(tree) AS digest FROM own WHERE ok),
many AS (SELECT dir, digest FROM (SELECT *, count(*) OVER (PARTITION BY digest) AS n FROM trees) WHERE n >= 2),
uncovered AS (SELECT m.* FROM many m WHERE NOT EXISTS (SELECT 1 FROM many u WHERE starts_with(m.dir, u.dir || '/'))),
grp AS (SELECT *, count(*) OVER (PARTITION BY digest) AS copies, min(dir) OVER (PARTITION BY digest) AS first FROM uncovered)"""


def _twins(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = I.files(spark, d)
    moved = rows.withColumn("path", F.concat(F.lit("/copy"), "path")).withColumn("dir", F.concat(F.lit("/copy"), "dir"))
    both = cut(rows.unionByName(moved))
    digests = tree.folder_digests(I.folders(both), both.where("size IS NOT NULL").select("dir", "name", "class_id"))
    return both, cut(tree.identical_folders(digests, tree.subtree_sums(both)))


@query("e_twin_folders", f"WITH {_TWINS} SELECT first, grp.dir, bytes AS size, files AS n_files, copies FROM grp JOIN sums USING (dir) WHERE copies >= 2")
def e_twin_folders(spark: SparkSession, d: str) -> DataFrame:
    found = _twins(spark, d)[1]
    first = found.groupBy("digest").agg(F.min("dir").alias("first"))
    return found.join(first, "digest").select("first", "dir", "size", "n_files", "copies")


@query(
    "d_folder_families",
    f"""WITH {_TWINS}, st AS (SELECT two.path, array_to_string(string_split(two.path, '/')[1:2], '/') = '/copy' AS moved, storage_dev, storage_off FROM two JOIN inv ON inv.path = CASE WHEN starts_with(two.path, '/copy/') THEN substr(two.path, 6) ELSE two.path END),
    sg AS (SELECT g.digest, g.dir, CASE WHEN bool_and(storage_dev IS NOT NULL AND storage_off IS NOT NULL) THEN md5(string_agg(storage_dev || ':' || storage_off, ',' ORDER BY storage_dev, storage_off)) END AS sig FROM grp g JOIN anc ON anc.above = g.dir JOIN st ON st.path = anc.path WHERE g.copies >= 2 GROUP BY 1, 2),
    fm AS (SELECT digest, min(dir) AS first, count(*) AS copies, least(count(*), greatest(1, count(DISTINCT sig) + count(*) FILTER (sig IS NULL))) AS families FROM sg GROUP BY 1)
    SELECT first, fm.copies, families, bytes AS size, bytes * (greatest(1, families) - 1) AS wasted FROM fm JOIN sums ON sums.dir = fm.first""",
)
def d_folder_families(spark: SparkSession, d: str) -> DataFrame:
    """Identical folders by shared storage: twins keep the places of their first."""
    rows, found = _twins(spark, d)
    one = tree.folder_families(found, tree.storage_signatures(rows, found))
    return one.join(found.groupBy("digest").agg(F.min("dir").alias("first")), "digest").select("first", "copies", "families", "size", "wasted")


_LINKED = f"""{INV}, lk AS (SELECT path, dir, name, coalesce(class_id, '?') AS target FROM inv WHERE {_IMAGE}), fi AS (SELECT * FROM inv WHERE NOT {_IMAGE})"""


@query(
    "e_links_and_aliases",
    f"""WITH {_LINKED}, en AS (SELECT dir, 'L' || name || '>' || target AS e, true AS ok FROM lk UNION ALL SELECT dir, 'F' || name || '>' || coalesce(class_id, ''), class_id IS NOT NULL FROM fi),
    t AS (SELECT dir, string_agg(e, chr(10) ORDER BY e) AS t, bool_and(ok) AS ok FROM en GROUP BY 1), leaf AS (SELECT dir FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE starts_with(u.dir, t.dir || '/')))
    SELECT count(*) AS folders, count(*) FILTER (ok) AS proven, count(DISTINCT t) FILTER (ok) AS trees FROM t JOIN leaf USING (dir)""",
)
def e_links_and_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Folders without sub-folders, images being links: how many there are, can be proven, and differ."""
    rows = cut(I.files(spark, d).withColumn("img", category(F.col("path")) == "image"))
    files = rows.where("NOT img")
    links = rows.where("img").select("dir", "name", F.coalesce("class_id", F.lit("?")).alias("target"))
    folders = rows.select("dir").distinct().withColumn("ok", F.lit(True))
    # names differ in NFC only where the table holds them so; the digests fold that, so plain names are compared as they are
    digests = tree.folder_digests(folders, files.select("dir", "name", "class_id"), links)
    inner = rows.select("dir").distinct().select(F.explode(tree.ancestors(F.col("dir"))).alias("dir")).distinct()
    return digests.join(inner, "dir", "left_anti").agg(F.count("*").alias("folders"), F.count("digest").alias("proven"), F.countDistinct("digest").alias("trees"))


@query(
    "f_merge_links",
    f"""WITH {_SIDES}, s AS (SELECT sa.*, {_IMAGE} AS link FROM sa)
    SELECT s.compare_id, CASE WHEN link THEN 'symlink' WHEN class_id IS NULL THEN 'uncovered' ELSE 'unique' END AS bucket, CASE WHEN link THEN 0 ELSE size END AS size, path AS source, dir_b || '/' || rel AS target FROM s JOIN pairs USING (compare_id)
    WHERE link OR class_id IS NULL OR NOT EXISTS (SELECT 1 FROM sb x WHERE x.compare_id = s.compare_id AND x.class_id = s.class_id AND NOT {_IMAGE.replace("path", "x.path")})""",
)
def f_merge_links(spark: SparkSession, d: str) -> DataFrame:
    """Merge plans in which images are links."""
    rows = cut(I.files(spark, d).withColumn("img", category(F.col("path")) == "image"))
    return similar.merge_plan(_compare_pairs(spark, d), rows.where("NOT img"), rows.where("img").select("dir", "path"), ["compare_id"])


@query(
    "f_ignored_pairs",
    """WITH p AS (SELECT DISTINCT least(dir_a, dir_b) AS dir_a, greatest(dir_a, dir_b) AS dir_b FROM folder_compare WHERE dir_a <> dir_b)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM sim_pairs s WHERE (least(s.dir_a, s.dir_b), greatest(s.dir_a, s.dir_b)) = (p.dir_a, p.dir_b))""",
)
def f_ignored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Compared pairs without those that an earlier scan reported, as ignored ones."""
    from stratafold.sources.tables import table

    key = [F.least("dir_a", "dir_b").alias("dir_a"), F.greatest("dir_a", "dir_b").alias("dir_b")]
    pairs = table(spark, d, "folder_compare").where("dir_a <> dir_b").select(*key).distinct()
    return similar.without_ignored(pairs, table(spark, d, "sim_pairs"))


_NAMED = f"""{INV}, nm AS (SELECT CASE WHEN starts_with(path, '/srv/') THEN '/System' || path ELSE dir || '/' || n END AS path, n AS name FROM
  (SELECT path, dir, CASE {sql_category('path')} WHEN 'image' THEN '._' || name WHEN 'video' THEN name || '.App' WHEN 'audio' THEN '.git' ELSE name END AS n FROM inv))"""


@query(
    "b_left_out",
    f"""WITH {_NAMED} SELECT path, CASE WHEN name IN ({", ".join(f"'{n}'" for n in I.EXCLUDED_NAMES)}) OR {" OR ".join(f"starts_with(path, '{p}/')" for p in I.EXCLUDED_PREFIXES)} THEN 'excluded' WHEN starts_with(name, '._') THEN 'companion' ELSE 'bundle' END AS reason FROM nm
    WHERE name IN ({", ".join(f"'{n}'" for n in I.EXCLUDED_NAMES)}) OR {" OR ".join(f"starts_with(path, '{p}/')" for p in I.EXCLUDED_PREFIXES)} OR starts_with(name, '._') OR regexp_matches(lower(name), '({"|".join(s.replace(".", chr(92) + ".") for s in I.BUNDLE_SUFFIXES)})$')""",
)
def b_left_out(spark: SparkSession, d: str) -> DataFrame:
    """What a scan leaves out, on names given by category: companions, bundles, excluded names and places."""
    kind = category(F.col("path"))
    name = F.when(kind == "image", F.concat(F.lit("._"), "name")).when(kind == "video", F.concat("name", F.lit(".App"))).when(kind == "audio", F.lit(".git")).otherwise(F.col("name"))
    rows = I.files(spark, d).select("path", "dir", name.alias("name"))
    rows = rows.select(F.when(F.col("path").startswith("/srv/"), F.concat(F.lit("/System"), "path")).otherwise(F.concat_ws("/", "dir", "name")).alias("path"), "name")
    out = I.excluded(F.col("path"), F.col("name"))
    reason = F.when(out, "excluded").when(I.companion(F.col("name")), "companion").when(I.is_bundle(F.col("name")), "bundle")
    return rows.select("path", reason.alias("reason")).where("reason IS NOT NULL")


@query("b_open_folders", f"WITH {INV}, f AS (SELECT DISTINCT dir FROM inv) SELECT dir FROM f WHERE NOT regexp_matches(dir, '/\\.[^/]*$') AND NOT (dir = '/mnt' OR starts_with(dir, '/mnt/'))")
def b_open_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders that a profile enters: the test for folders looks at names, bundles and excluded places only."""
    from stratafold.operators.views import should_include

    rows = I.files(spark, d).select("dir").distinct().select(F.col("dir").alias("path"), F.element_at(F.split("dir", "/"), -1).alias("name"))
    rows = rows.withColumn("is_bundle", I.is_bundle(F.col("name")))
    return rows.where(should_include(Profile(min_size=10**9, hidden=False, excluded_paths=["/mnt"]), directory=True)).select(F.col("path").alias("dir"))


def _canonical_sql() -> str:
    """The least of the hashes of all eight forms of a grid g of 9 x 9, as a signed number."""
    side, bits = 9, [(r, c) for r in range(8) for c in range(8)]
    turn = [lambda r, c: (r, c), lambda r, c: (8 - c, r), lambda r, c: (8 - r, 8 - c), lambda r, c: (c, 8 - r)]
    forms = []
    for mirrored in (False, True):
        for t in turn:
            at = lambda r, c: "g[{}]".format((lambda p: p[0] * side + p[1] + 1)(t(r, 8 - c if mirrored else c)))  # noqa: E731, B023
            forms.append(" + ".join(f"CASE WHEN {at(r, c)} > {at(r, c + 1)} THEN {1 << (63 - k)}::HUGEINT ELSE 0 END" for k, (r, c) in enumerate(bits)))
    return f"least({', '.join(forms)})"


@query(
    "g_image_hashes",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding || embedding[1:17], lambda x: CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 4) * 32))) AS INT)) AS g FROM embeddings),
    h AS (SELECT vec_id, {_canonical_sql()} AS h FROM v) SELECT vec_id, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS hash FROM h""",
)
def g_image_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings written as small grey images, decoded and hashed."""
    from stratafold.sources.images import with_image_hash
    from stratafold.sources.tables import table

    e = F.concat("embedding", F.slice("embedding", 1, 17))
    grey = F.transform(e, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 4) * 32))).cast("int").cast("string"))
    text = F.concat(F.lit("P2 9 9 255 "), F.array_join(grey, " "))
    images = table(spark, d, "embeddings").select("vec_id", F.encode(text, "UTF-8").alias("content"))
    return with_image_hash(images).select("vec_id", "hash")
