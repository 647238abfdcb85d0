"""Queries on folder trees, folder pairs, clusters and look-alikes (families E, F and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import paths as P
from stratafold.functions.hashing import dhash
from stratafold.operators import clusters, similar, tree
from stratafold.plans.sqlviews import ANC, DUP, INV
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


#: Look-alike radius on embeddings; the library's default for images is 10.
RADIUS = 16

_SUMS = f"""{INV},
{ANC},
sums AS (SELECT above AS dir, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM anc GROUP BY 1)"""

# the relative paths and classes of all that lies below a folder, instead of digests level by level
_TREES = f"""{_SUMS},
own AS (SELECT above AS dir, bool_and(class_id IS NOT NULL AND size IS NOT NULL) AS ok,
  string_agg(nfc_normalize(substr(path, length(above) + 2)) || '=' || coalesce(class_id, ''), chr(10) ORDER BY nfc_normalize(substr(path, length(above) + 2)), class_id) AS tree FROM anc GROUP BY 1),
trees AS (SELECT dir, md5(tree) AS digest FROM own WHERE ok),
many AS (SELECT dir, digest FROM (SELECT *, count(*) OVER (PARTITION BY digest) AS n FROM trees) WHERE n >= 2),
uncovered AS (SELECT m.* FROM many m WHERE NOT EXISTS (SELECT 1 FROM many u WHERE starts_with(m.dir, u.dir || '/')))"""


def _digests(rows: DataFrame) -> DataFrame:
    known = rows.where("size IS NOT NULL")
    return tree.folder_digests(I.folders(rows), known.select("dir", "name", "class_id"))


@query("e_tree_rollup", f"WITH {_SUMS} SELECT dir, files, bytes FROM sums")
def e_tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tree.subtree_sums(I.files(spark, d))


@query(
    "e_identical_folders",
    f"""WITH {_TREES}, g AS (SELECT *, count(*) OVER (PARTITION BY digest) AS copies, min(dir) OVER (PARTITION BY digest) AS first FROM uncovered)
    SELECT first, g.dir, bytes AS size, files AS n_files, copies FROM g JOIN sums USING (dir) WHERE copies >= 2""",
)
def e_identical_folders(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(I.files(spark, d))
    found = tree.identical_folders(_digests(rows), tree.subtree_sums(rows))
    first = found.groupBy("digest").agg(F.min("dir").alias("first"))
    return found.join(first, "digest").select("first", "dir", "size", "n_files", "copies")


@query(
    "e_tree_state",
    f"""WITH {INV},
    {ANC},
    f AS (SELECT dir, bool_and(class_id IS NOT NULL AND size IS NOT NULL) AS ok, bool_or(size IS NULL) AS failed FROM inv GROUP BY 1)
    SELECT above AS dir, bool_and(ok) AS complete, bool_and(ok OR NOT failed) AS mergeable FROM (SELECT DISTINCT above, dir FROM anc) JOIN f USING (dir) GROUP BY 1""",
)
def e_tree_state(spark: SparkSession, d: str) -> DataFrame:
    return tree.tree_state(I.folders(I.files(spark, d)))


@query(
    "f_longest_root",
    f"""WITH {INV},
    {ANC},
    roots AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:4], '/') AS root FROM inv WHERE len(string_split(path, '/')) > 4 UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:3], '/') FROM inv WHERE len(string_split(path, '/')) > 3)
    SELECT path, max_by(above, length(above)) AS root FROM anc JOIN roots ON above = root GROUP BY path""",
)
def f_longest_root(spark: SparkSession, d: str) -> DataFrame:
    rows = I.files(spark, d).select("path")
    top = rows.select(P.ancestors(F.col("path")).alias("a"))
    roots = top.where("size(a) >= 3").select(F.element_at("a", 3).alias("root")).union(top.where("size(a) >= 2").select(F.element_at("a", 2)))
    return tree.longest_root(rows, roots.distinct()).where("root IS NOT NULL")


_PAIRS = f"""{_TREES},
dup AS (SELECT * FROM inv WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:') AND size IS NOT NULL),
cd AS (SELECT class_id, dir, row_number() OVER (PARTITION BY class_id ORDER BY dir) - 1 AS k, count(*) OVER (PARTITION BY class_id) AS n FROM (SELECT DISTINCT class_id, dir FROM dup)),
cap AS (SELECT class_id, dir FROM cd WHERE n >= 2 AND (n <= 64 OR list_contains(list_transform(range(0, 64), lambda i: i * (n - 1) // 63), k))),
base AS (SELECT DISTINCT a.dir AS a, b.dir AS b FROM cap a JOIN cap b ON a.class_id = b.class_id AND a.dir < b.dir),
climb AS (SELECT array_to_string(string_split(a, '/')[1:len(string_split(a, '/')) - k], '/') AS a, array_to_string(string_split(b, '/')[1:len(string_split(b, '/')) - k], '/') AS b
  FROM base, unnest(range(0, least(len(string_split(a, '/')), len(string_split(b, '/'))) - 1)) AS t(k)),
cand AS (SELECT DISTINCT least(a, b) AS dir_a, greatest(a, b) AS dir_b FROM climb WHERE a <> b AND NOT starts_with(a, b || '/') AND NOT starts_with(b, a || '/')),
admitted AS (SELECT c.* FROM cand c LEFT JOIN trees x ON x.dir = dir_a LEFT JOIN trees y ON y.dir = dir_b WHERE x.digest IS NULL OR y.digest IS NULL OR x.digest <> y.digest),
danc AS (SELECT * FROM anc WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:') AND size IS NOT NULL),
cc AS (SELECT above AS dir, class_id, count(*) AS n, max(size) AS size FROM danc GROUP BY 1, 2),
shared AS (SELECT dir_a, dir_b, CAST(sum(l.size * least(l.n, r.n)) AS BIGINT) AS shared_bytes, count(*) AS shared_total FROM admitted JOIN cc l ON l.dir = dir_a JOIN cc r ON r.dir = dir_b AND r.class_id = l.class_id GROUP BY 1, 2),
scored AS (SELECT dir_a, dir_b, round(200 * shared_bytes / (x.bytes + y.bytes), 1) AS percent, shared_bytes, shared_total FROM shared JOIN sums x ON x.dir = dir_a JOIN sums y ON y.dir = dir_b WHERE shared_bytes > 0),
top AS (SELECT * FROM scored ORDER BY shared_bytes DESC, percent DESC, dir_a DESC, dir_b DESC LIMIT 400)"""


def _best(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The best pairs, and the files of proven classes. Digests are made of what lies below the folders asked for only."""
    rows = cut(I.files(spark, d, ["path", "dir", "name", "size", "class_id"]).sortWithinPartitions("path"))
    dup = I.duplicates(rows)

    def digests(dirs: DataFrame) -> DataFrame:
        below = tree.dirs_under(rows, dirs.select(F.col("dir").alias("root"))).select("dir").distinct()
        return _digests(rows.join(below, "dir", "left_semi")).join(dirs, "dir", "left_semi")

    return similar.best_overlaps(dup, tree.subtree_sums(rows), digests), dup


@query("f_similar_folders", f"WITH {_PAIRS} SELECT * FROM top")
def f_similar_folders(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d)[0]


@query("f_similar_folders_exact", f"WITH {_PAIRS.replace('cap AS (SELECT class_id, dir FROM cd WHERE n >= 2 AND (n <= 64 OR list_contains(list_transform(range(0, 64), lambda i: i * (n - 1) // 63), k))),', 'cap AS (SELECT class_id, dir FROM cd WHERE n >= 2),')} SELECT * FROM scored")
def f_similar_folders_exact(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of folders that share content: no bound on the folders of a class, none on the pairs."""
    rows = cut(I.files(spark, d, ["path", "dir", "name", "size", "class_id"]).sortWithinPartitions("path"))
    return similar.all_overlaps(I.duplicates(rows), tree.subtree_sums(rows), _digests(rows))


@query("f_fanout_sample", f"WITH {DUP}, cd AS (SELECT class_id, dir, row_number() OVER (PARTITION BY class_id ORDER BY dir) - 1 AS k, count(*) OVER (PARTITION BY class_id) AS n FROM (SELECT DISTINCT class_id, dir FROM dup)) SELECT class_id, dir FROM cd WHERE n >= 2 AND (n <= 64 OR list_contains(list_transform(range(0, 64), lambda i: i * (n - 1) // 63), k))")
def f_fanout_sample(spark: SparkSession, d: str) -> DataFrame:
    return similar.sampled_folders(I.duplicates(I.files(spark, d)))


@query(
    "f_evidence",
    f"""WITH {_PAIRS}, first AS (SELECT above AS dir, class_id, min(path) AS path, max(size) AS size FROM danc GROUP BY 1, 2),
    e AS (SELECT dir_a, dir_b, l.class_id, l.size, l.path AS path_a, r.path AS path_b, row_number() OVER (PARTITION BY dir_a, dir_b ORDER BY l.size DESC, l.class_id) AS k FROM top JOIN first l ON l.dir = dir_a JOIN first r ON r.dir = dir_b AND r.class_id = l.class_id)
    SELECT * EXCLUDE k FROM e WHERE k <= 60""",
)
def f_evidence(spark: SparkSession, d: str) -> DataFrame:
    pairs, dup = _best(spark, d)
    return similar.evidence(cut(pairs), dup)


_SIDES = f"""{INV},
pairs AS (SELECT DISTINCT compare_id, dir_a, dir_b FROM folder_compare WHERE dir_a IS NOT NULL AND dir_b IS NOT NULL),
{ANC},
sa AS (SELECT compare_id, path, size, class_id, substr(path, length(above) + 2) AS rel FROM anc JOIN pairs ON above = dir_a),
sb AS (SELECT compare_id, path, size, class_id, substr(path, length(above) + 2) AS rel FROM anc JOIN pairs ON above = dir_b)"""


def _compare_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "folder_compare").where("dir_a IS NOT NULL AND dir_b IS NOT NULL").select("compare_id", "dir_a", "dir_b").distinct()


@query(
    "f_folder_compare",
    f"""WITH {_SIDES}
    SELECT coalesce(a.compare_id, b.compare_id) AS compare_id, coalesce(a.rel, b.rel) AS relative_path,
      CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN CASE WHEN a.class_id IS NOT DISTINCT FROM b.class_id THEN 'identical' ELSE 'different_content' END
        WHEN a.path IS NOT NULL AND EXISTS (SELECT 1 FROM sb x WHERE x.compare_id = a.compare_id AND x.class_id IS NOT DISTINCT FROM a.class_id) THEN 'shared_elsewhere'
        WHEN b.path IS NOT NULL AND EXISTS (SELECT 1 FROM sa x WHERE x.compare_id = b.compare_id AND x.class_id IS NOT DISTINCT FROM b.class_id) THEN 'shared_elsewhere'
        WHEN b.path IS NULL THEN 'only_a' ELSE 'only_b' END AS status,
      a.path AS path_a, b.path AS path_b, CASE WHEN a.path IS NULL THEN 0 ELSE coalesce(a.size, 0) END AS size_a, CASE WHEN b.path IS NULL THEN 0 ELSE coalesce(b.size, 0) END AS size_b
    FROM sa a FULL JOIN sb b ON a.compare_id = b.compare_id AND a.rel = b.rel""",
)
def f_folder_compare(spark: SparkSession, d: str) -> DataFrame:
    return similar.compare_folders(_compare_pairs(spark, d), I.files(spark, d), ["compare_id"])


@query(
    "f_pair_diff",
    f"""WITH {_SIDES},
    o AS (SELECT compare_id, 'a' AS side, path, size FROM sa WHERE NOT EXISTS (SELECT 1 FROM sb x WHERE x.compare_id = sa.compare_id AND x.class_id IS NOT DISTINCT FROM sa.class_id)
      UNION ALL SELECT compare_id, 'b', path, size FROM sb WHERE NOT EXISTS (SELECT 1 FROM sa x WHERE x.compare_id = sb.compare_id AND x.class_id IS NOT DISTINCT FROM sb.class_id)),
    r AS (SELECT *, count(*) OVER (PARTITION BY compare_id, side) AS total, CAST(row_number() OVER (PARTITION BY compare_id, side ORDER BY size DESC NULLS LAST, path DESC) AS INT) AS place FROM o)
    SELECT compare_id, side, total, place, path, size FROM r WHERE place <= 60""",
)
def f_pair_diff(spark: SparkSession, d: str) -> DataFrame:
    return similar.pair_difference(_compare_pairs(spark, d), I.files(spark, d), ["compare_id"])


@query("f_shared_side", f"WITH {_SIDES} SELECT compare_id, path, size FROM sa WHERE class_id IS NOT NULL AND EXISTS (SELECT 1 FROM sb x WHERE x.compare_id = sa.compare_id AND x.class_id = sa.class_id)")
def f_shared_side(spark: SparkSession, d: str) -> DataFrame:
    return similar.shared_side(_compare_pairs(spark, d), I.files(spark, d), ["compare_id"])


@query(
    "f_merge_plan",
    f"""WITH {_SIDES}
    SELECT sa.compare_id, CASE WHEN class_id IS NULL THEN 'uncovered' ELSE 'unique' END AS bucket, size, path AS source, dir_b || '/' || rel AS target FROM sa JOIN pairs USING (compare_id)
    WHERE class_id IS NULL OR NOT EXISTS (SELECT 1 FROM sb x WHERE x.compare_id = sa.compare_id AND x.class_id = sa.class_id)""",
)
def f_merge_plan(spark: SparkSession, d: str) -> DataFrame:
    return similar.merge_plan(_compare_pairs(spark, d), I.files(spark, d), None, ["compare_id"])


@query(
    "g_folder_clusters",
    f"""WITH RECURSIVE {DUP},
    c AS (SELECT class_id, min(dir) AS lo FROM dup GROUP BY 1 HAVING count(DISTINCT dir) >= 2),
    l AS (SELECT DISTINCT lo, dir FROM dup JOIN c USING (class_id) WHERE dir <> lo),
    e AS (SELECT lo AS a, dir AS b FROM l UNION SELECT dir, lo FROM l),
    r AS (SELECT a AS dir, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.dir WHERE r.root < e.b),
    o AS (SELECT min(root) AS cluster, dir FROM (SELECT * FROM r UNION ALL SELECT a, a FROM e) GROUP BY dir),
    m AS (SELECT class_id FROM dup GROUP BY 1 HAVING count(*) >= 2),
    u AS (SELECT dir, count(*) AS dup_files, CAST(sum(size) AS BIGINT) AS dup_bytes FROM dup JOIN m USING (class_id) GROUP BY 1),
    t AS (SELECT dir, count(*) AS total_files FROM inv GROUP BY 1),
    p AS (SELECT o.cluster, o.dir, dup_files, total_files, dup_bytes FROM o LEFT JOIN u USING (dir) LEFT JOIN t USING (dir)),
    s AS (SELECT cluster, CAST(sum(dup_bytes) AS BIGINT) AS size, CAST(sum(dup_files) AS BIGINT) AS dup_file_count FROM p GROUP BY 1),
    k AS (SELECT cluster, count(DISTINCT class_id) AS class_count FROM dup JOIN c USING (class_id) JOIN o USING (dir) GROUP BY 1)
    SELECT cluster, dir, dup_files, total_files, dup_files * 100.0::DOUBLE / total_files AS percent, class_count, size, dup_file_count FROM p JOIN s USING (cluster) JOIN k USING (cluster)""",
)
def g_folder_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = I.files(spark, d)
    sized = F.when(F.col("size").isNotNull() & I.shared_class(F.col("class_id")), F.col("class_id"))
    return clusters.folder_clusters(cut(rows.select("dir", sized.alias("class_id"), "size")))


QUERIES["d_cluster_totals"] = lambda spark, d: clusters.cluster_totals(g_folder_clusters(spark, d))
SQL["d_cluster_totals"] = f"""SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS folders, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(dup_file_count) AS BIGINT) AS dup_files
FROM (SELECT cluster, count(*) AS n, max(size) AS size, max(dup_file_count) AS dup_file_count FROM ({SQL["g_folder_clusters"]}) GROUP BY 1)"""


_HASHES = "h AS (SELECT vec_id AS id, CAST(list_sum(list_transform(range(1, 64), lambda k: CASE WHEN embedding[k] > embedding[k + 1] THEN CAST(1 AS BIGINT) << (63 - k) ELSE 0 END)) AS BIGINT) AS hash FROM embeddings)"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), dhash(F.col("embedding"), 64, 1).alias("hash"))


@query("f_near_hashes", f"WITH {_HASHES}, c AS (SELECT hash, min(id) AS id FROM h GROUP BY 1) SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INT) AS distance FROM c x JOIN c y ON x.id < y.id WHERE bit_count(xor(x.hash, y.hash)) <= {RADIUS}")
def f_near_hashes(spark: SparkSession, d: str) -> DataFrame:
    return clusters.near_hashes(_hashes(spark, d), RADIUS)


@query(
    "g_lookalike_groups",
    f"""WITH RECURSIVE {_HASHES}, l AS (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.id <> y.id WHERE bit_count(xor(x.hash, y.hash)) <= {RADIUS}),
    r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b) SELECT min(root) AS group_id, id FROM r GROUP BY id""",
)
def g_lookalike_groups(spark: SparkSession, d: str) -> DataFrame:
    return clusters.lookalike_groups(_hashes(spark, d), RADIUS)


@query(
    "f_survivors",
    f"""WITH {DUP}, k AS (SELECT class_id, min(path) AS keeper FROM dup GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT dup.*, keeper FROM dup JOIN k USING (class_id) WHERE path <> keeper)
    SELECT v.path, EXISTS (SELECT 1 FROM dup s JOIN k ON s.path = k.keeper WHERE s.class_id = v.class_id AND (s.dev, s.ino) <> (v.dev, v.ino)) AS safe FROM v""",
)
def f_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Victims: every copy but the first path of its class; safe if a copy that stays has another inode."""
    from stratafold.operators.removal import survivors

    rows = cut(I.duplicates(I.files(spark, d)))
    first = rows.groupBy("class_id").agg(F.min("path").alias("keeper"), F.count("*").alias("n")).where("n >= 2")
    victims = rows.join(first, "class_id").where("path <> keeper").select(*rows.columns)
    return survivors(victims, rows)
