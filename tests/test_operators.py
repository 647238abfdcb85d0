"""Operators on groups, trees, pairs, keepers and saved scans, on small hand-made cases."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stratafold.operators import clusters, funnel, groups, ranking, removal, reports, retention, similar, snapshots, tree, views
from stratafold.operators.graph import number_vertices, propagate_minimum
from stratafold.sources import inventory as I

FILE = "path string, dir string, name string, size bigint, mtime_ns bigint, ctime_ns bigint, dev bigint, ino bigint, class_id string, storage_dev bigint, storage_off bigint, alloc bigint"


def files(spark, rows):
    """Rows from (path, size, class, changes...)."""
    out = []
    for k, (path, size, c, *more) in enumerate(rows):
        d, n = path.rsplit("/", 1)
        r = {"path": path, "dir": d or "/", "name": n, "size": size, "mtime_ns": 5, "ctime_ns": 5, "dev": 1, "ino": k + 1, "class_id": c, "storage_dev": None, "storage_off": None, "alloc": None}
        for m in more:
            r |= m
        out.append(tuple(r.values()))
    return spark.createDataFrame(out, FILE)


def c(size, x):
    return f"{size}:{x * 64}"


def test_funnel_against_full_digests(spark):
    r = random.Random(11)
    head = bytes(r.randrange(256) for _ in range(funnel.PROBE))
    pool = [b"", b"a", b"b", head, head + b"x", head + b"y", head[:-1]]
    rows = [(f"/f{k}", r.choice(pool)) for k in range(40)] + [("/t1", head + b"tail1"), ("/t2", head + b"tail2"), ("/only", b"single")]
    df = spark.createDataFrame([(p, len(b), b) for p, b in rows], "path string, size bigint, content binary")
    got = {x["path"]: x for x in funnel.classify(df.select("path", "size"), df.select("path", "content")).collect()}
    for (p, b), (q, e) in combinations(rows, 2):
        assert (got[p]["class_id"] == got[q]["class_id"]) == (b == e)
    assert got["/only"]["class_id"] == "u:/only" and got["/t1"]["digest"] is None
    lone = spark.createDataFrame([("/e", 0), ("/n", None)], "path string, size bigint")
    assert {x["path"]: x["class_id"] for x in funnel.classify(lone, df.select("path", "content")).collect()} == {"/e": f"0:{funnel.EMPTY}", "/n": "u:/n"}


def test_families_and_waste(spark):
    s = lambda off, alloc=None: {"storage_dev": 1, "storage_off": off, "alloc": alloc}
    df = files(spark, [("/a", 10, c(10, "a"), s(1, 8)), ("/b", 10, c(10, "a"), s(1, 6)), ("/c", 10, c(10, "a"), s(2, 99)), ("/d", 10, c(10, "a")), ("/e", 4, c(4, "b"), s(5)), ("/f", 4, c(4, "b"), s(5)), ("/g", 4, c(4, "c"))])
    got = {r["class_id"][-1]: (r["families"], r["freeable"], r["wasted"]) for r in groups.storage_families(df).collect()}
    assert got == {"a": (3, 20, 20), "b": (1, 0, 0)}
    one = spark.createDataFrame([(10, 3, None, -1), (10, 3, 0, -1), (10, 3, 2, -1), (10, 3, 2, 7)], "size bigint, n bigint, f bigint, free bigint")
    assert [r[0] for r in one.select(groups.group_waste(F.col("size"), F.col("n"), F.col("f"), F.col("free"))).collect()] == [20, 20, 10, 7]


def test_aliases_and_folders(spark):
    df = files(spark, [("/a/x", 1, "u:1", {"ino": 7}), ("/a/y", 1, "u:1", {"ino": 7}), ("/b/z", None, None), ("/b/w", 1, None, {"ino": 0}), ("/b/v", 1, None, {"ino": 0})])
    kept, aliases = I.admit(df)
    assert {r["path"] for r in kept.collect()} == {"/a/x", "/b/z", "/b/w", "/b/v"} and [tuple(r) for r in aliases.collect()] == [("/a", "/a/y", "/a/x")]
    assert {(r["dir"], r["parent"], r["ok"], r["read_failed"]) for r in I.folders(df).collect()} == {("/a", "/", True, False), ("/b", "/", False, True)}


def digests(spark, df):
    return tree.folder_digests(I.folders(df), df.where("size IS NOT NULL"))


def test_identical_folders_and_suppression(spark):
    twin = lambda top: [(f"{top}/in/f", 3, c(3, "a")), (f"{top}/in/g", 4, c(4, "b")), (f"{top}/h", 5, c(5, "c"))]
    df = files(spark, twin("/A") + twin("/B") + [("/C/f", 3, c(3, "a")), ("/C/g", 4, c(4, "b")), ("/D/f", 3, c(3, "a")), ("/D/g", 4, None), ("/E/é", 1, c(1, "d")), ("/F/é", 1, c(1, "d")), ("/G/u", 1, "u:1"), ("/H/u", 1, "u:2")])
    found = {r["dir"]: (r["size"], r["n_files"], r["copies"]) for r in tree.identical_folders(digests(spark, df), tree.subtree_sums(df)).collect()}
    # /C equals the two inner folders, which lie in folders that are in a group themselves: it is left alone
    assert found == {"/A": (12, 3, 2), "/B": (12, 3, 2), "/E": (1, 1, 2), "/F": (1, 1, 2)}


def brute_trees(rows):
    dirs = {}
    for path, size, cl in rows:
        parts = path.split("/")[1:-1]
        for k in range(1, len(parts) + 1):
            dirs.setdefault("/" + "/".join(parts[:k]), []).append((path, cl))
    out = {}
    for d, fs in dirs.items():
        if all(cl is not None for _, cl in fs):
            out.setdefault(tuple(sorted((p[len(d) :], cl) for p, cl in fs)), set()).add(d)
    return {frozenset(v) for v in out.values() if len(v) >= 2}


@pytest.mark.parametrize("seed", [3, 19])
def test_random_trees(spark, seed):
    r = random.Random(seed)
    rows = {}
    for _ in range(160):
        d = "/" + "/".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
        x = r.choice("xy")
        rows[f"{d}/{r.choice('fg')}.txt"] = (5, r.choice([c(5, x), c(5, x), None]) if r.random() < 0.1 else c(5, x))
    rows = [(p, s, cl) for p, (s, cl) in rows.items() if p.rsplit("/", 1)[0] not in rows]
    df = files(spark, rows)
    got = {}
    for x in digests(spark, df).where("digest IS NOT NULL").collect():
        got.setdefault(x["digest"], set()).add(x["dir"])
    assert {frozenset(v) for v in got.values() if len(v) >= 2} == brute_trees(rows)


def test_folder_families_and_state(spark):
    s = lambda off: {"storage_dev": 1, "storage_off": off}
    df = files(spark, [("/A/f", 3, c(3, "a"), s(1)), ("/B/f", 3, c(3, "a"), s(1)), ("/C/f", 3, c(3, "a"), s(2)), ("/D/f", 3, c(3, "a"))])
    g = tree.identical_folders(digests(spark, df), tree.subtree_sums(df))
    row = tree.folder_families(g, tree.storage_signatures(df, g)).collect()[0]
    assert (row["copies"], row["families"], row["wasted"]) == (4, 3, 6)
    df = files(spark, [("/A/x/f", 1, "u:1"), ("/A/y/f", 1, None), ("/B/f", None, None)])
    assert {(x["dir"], x["complete"], x["mergeable"]) for x in tree.tree_state(I.folders(df)).collect()} == {("/A", False, True), ("/A/x", True, True), ("/A/y", False, True), ("/B", False, False)}


def test_overlap_of_constructed_folders(spark):
    rows = [("/C/s", 4000, c(4000, "a")), ("/C/sub/t", 2500, c(2500, "b")), ("/C/own", 3000, "u:1"), ("/D/s", 4000, c(4000, "a")), ("/D/q", 2500, c(2500, "b")), ("/D/own", 5000, "u:2")]
    df = files(spark, rows)
    dup = I.duplicates(df)
    pairs = similar.candidate_pairs(dup, digests(spark, df))
    got = {(r["dir_a"], r["dir_b"]): (r["shared_bytes"], r["percent"]) for r in similar.score_pairs(pairs, similar.class_counts(dup), tree.subtree_sums(df)).collect()}
    assert got["/C", "/D"] == (6500, 61.9)
    e = similar.evidence(pairs, dup).where("dir_a = '/C' AND dir_b = '/D'").orderBy(F.desc("size")).collect()
    assert [(r["path_a"], r["path_b"]) for r in e] == [("/C/s", "/D/s"), ("/C/sub/t", "/D/q")]


def test_fan_out_is_bounded(spark):
    df = files(spark, [(f"/d{k:03}/f", 100, c(100, "a")) for k in range(76)])
    kept = sorted(r["dir"] for r in similar.sampled_folders(I.duplicates(df)).collect())
    assert kept == [f"/d{i * 75 // 63:03}" for i in range(64)]


def test_candidates_without_the_bound_are_all_pairs(spark):
    rows = [row for k in range(70) for row in ((f"/d{k:03}/f", 100, c(100, "a")), (f"/d{k:03}/own", 7, f"u:{k}"))]
    df = files(spark, rows)
    found = similar.candidate_pairs(I.duplicates(df), digests(spark, df), sampled=False)
    assert {(r["dir_a"], r["dir_b"]) for r in found.collect()} == {(f"/d{i:03}", f"/d{j:03}") for i in range(70) for j in range(i + 1, 70)}
    assert similar.candidate_pairs(I.duplicates(df), digests(spark, df)).count() == 64 * 63 // 2


def test_best_pairs_are_the_first_of_all_scored(spark):
    r = random.Random(5)
    rows = [(f"/{r.choice('ab')}/d{r.randrange(9)}/f{k}", 10 * x + 1, c(10 * x + 1, f"{x}")) for k, x in enumerate(r.randrange(14) for _ in range(120))]
    df = files(spark, rows)
    dup = I.duplicates(df)
    found = similar.candidate_pairs(dup, digests(spark, df)), similar.class_counts(dup), tree.subtree_sums(df)
    for k in (1, 5, 1000):
        want = [tuple(x) for x in similar.top_pairs(similar.score_pairs(*found), k).collect()]
        for few in (0, 10**6):
            assert [tuple(x) for x in similar.best_pairs(*found, k, few).collect()] == want


def best_of_all(spark, rows, k, fanout, first):
    """The best pairs of listing and scoring all, and those of the pruned search."""
    df = files(spark, rows)
    dup, sums = I.duplicates(df), tree.subtree_sums(df)
    pairs = similar.candidate_pairs(dup, digests(spark, df), sampled=fanout is not None)
    want = similar.top_pairs(similar.score_pairs(pairs, similar.class_counts(dup), sums), k).collect()
    got = similar.best_overlaps(dup, sums, lambda dirs: digests(spark, df).join(dirs, "dir", "left_semi"), k, fanout, first).collect()
    return [tuple(x) for x in want], [tuple(x) for x in got]


@pytest.mark.parametrize("k, fanout, first", [(5, similar.FANOUT, 1024), (3, similar.FANOUT, 4), (1000, None, 3)])
def test_best_overlaps_are_those_of_all_pairs(spark, k, fanout, first):
    r = random.Random(7)
    rows = [(f"/{r.choice('ab')}/d{r.randrange(9)}/{r.choice(['', 'x/', 'y/z/'])}f{i}", 10 * x + 1, c(10 * x + 1, f"{x}")) for i, x in enumerate(r.randrange(30) for _ in range(150))]
    rows += [(f"/{t}/same/f", 777, c(777, "s")) for t in "abc"] + [(f"/many/{i:03}/f", 100, c(100, "m")) for i in range(70)]
    deep = "/".join(f"n{i}" for i in range(70))
    rows += [(f"/{t}/{deep}/f", 300, c(300, "deep")) for t in "ef"] + [("/e/own", 5, "u:1")]
    want, got = best_of_all(spark, rows, k, fanout, first)
    assert got == want and (k > 100 or len(got) == k)


@pytest.mark.parametrize("block", [similar.BLOCK, 5])
def test_all_overlaps_are_those_of_all_pairs(spark, block):
    r = random.Random(9)
    rows = [(f"/{r.choice('ab')}/d{r.randrange(9)}/{r.choice(['', 'x/', 'y/z/'])}f{i}", 10 * x + 1, c(10 * x + 1, f"{x}")) for i, x in enumerate(r.randrange(30) for _ in range(120))]
    rows += [(f"/{t}/same/f", 777, c(777, "s")) for t in "abc"] + [(f"/many/{i:03}/f", 100, c(100, "m")) for i in range(70)] + [(f"/many/{i:03}/o", 7, f"u:{i}") for i in range(70)]
    df = files(spark, rows)
    dup, sums = I.duplicates(df), tree.subtree_sums(df)
    want = similar.score_pairs(similar.candidate_pairs(dup, digests(spark, df), sampled=False), similar.class_counts(dup), sums)
    plan = similar.all_overlaps(dup, sums, digests(spark, df), block)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, want.collect()))
    # pairs aren't exchanged once they are made
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange hashpartitioning" not in text[: text.index("Generate explode(r")]


def written_rows(spark, d, folders, classes):
    """A table of files: every class is in every folder."""
    i, x = F.expr(f"id div {classes}"), F.expr(f"id % {classes}")
    name = F.concat(F.lit("f"), x)
    rows = spark.range(folders * classes).select(F.col("id").alias("file_id"), F.concat(F.lit("/t"), i, F.lit("/s/"), name).alias("path"), F.concat(F.lit("/t"), i, F.lit("/s")).alias("dir"), name.alias("name"),
        (x + i * 0 + 10).alias("size"), F.concat(x + 10, F.lit(":"), F.sha2(x.cast("string"), 256)).alias("class_id"), F.lit(1).alias("batch_no"), F.current_timestamp().alias("scanned_at"))
    more = [F.lit(None).cast("bigint").alias(m) for m in ("mtime_ns", "btime_ns", "ctime_ns", "dev", "ino", "storage_dev", "storage_off", "alloc")]
    own = spark.range(folders).select(*[F.expr(e) for e in ("1000000 + id AS file_id", "concat('/t', id, '/own') AS path", "concat('/t', id) AS dir", "'own' AS name", "5L AS size", "concat('u:', id) AS class_id", "1 AS batch_no", "now() AS scanned_at")])
    rows.select("*", *more).unionByName(own.select("*", *more)).write.parquet(f"{d}/files.parquet")


def test_best_pairs_do_not_list_all_pairs_by_class(spark, tmp_path):
    """Folders near the root hold all classes: what is shuffled grows with the files, not with pairs times classes."""
    written_rows(spark, tmp_path, 60, 300)
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, *none)
        return {x.stageId(): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    from stratafold.plans.folder_queries import f_evidence, f_similar_folders

    for query, limit in ((f_similar_folders, 6_000_000), (f_evidence, 9_000_000)):
        before = max(written(), default=-1)
        query(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
        assert 0 < sum(n for stage, n in written().items() if stage > before) < limit


def test_evidence_is_the_largest_classes_of_a_pair(spark):
    r = random.Random(3)
    sizes = [r.choice([0, 1, 17, 900, 901, 5000, 70_000, 70_001, 1 << 40]) + r.randrange(3) for _ in range(60)]
    rows = [(f"/{t}/{i % 4}/f{i}.{n}", s, c(s, f"{i:02}")) for i, s in enumerate(sizes) for t in "ab" for n in range(1 + i % 2)]
    pairs = spark.createDataFrame([("/a", "/b"), ("/a/1", "/b/1"), ("/a/1", "/b/2")], "dir_a string, dir_b string")
    got = sorted(tuple(x) for x in similar.evidence(pairs, I.duplicates(files(spark, rows)), 7).collect())
    want = []
    for a, b in (("/a", "/b"), ("/a/1", "/b/1")):
        inside = {cl: (s, min(p for p, _, x in rows if x == cl and p.startswith(a + "/"))) for p, s, cl in rows if p.startswith(a + "/")}
        for cl, (s, path) in sorted(inside.items(), key=lambda x: (-x[1][0], x[0]))[:7]:
            want.append((a, b, cl, s, path, min(p for p, _, x in rows if x == cl and p.startswith(b + "/"))))
    assert got == sorted(want)


def test_empty_folders_links_and_aliases_count(spark):
    schema = "dir string, name string, class_id string"
    f = spark.createDataFrame([("/A", "x", "1:a"), ("/B", "x", "1:a"), ("/C", "x", "1:a"), ("/D", "x", "1:a")], schema)
    ok = [(d, True) for d in ("/A", "/A/e", "/B", "/B/e", "/C", "/D", "/D/e", "/E", "/F")]
    folders = spark.createDataFrame(ok, "dir string, ok boolean")
    links = spark.createDataFrame([("/A", "l", "x"), ("/B", "l", "x"), ("/D", "l", "y")], "dir string, name string, target string")
    aliases = spark.createDataFrame([("/E", "h", "1:a"), ("/F", "h", "1:a")], schema)
    by = {}
    for r in tree.folder_digests(folders, f, links, aliases).collect():
        by.setdefault(r["digest"], set()).add(r["dir"])
    assert {frozenset(v) for v in by.values()} == {frozenset(x) for x in ({"/A", "/B"}, {"/A/e", "/B/e", "/D/e"}, {"/C"}, {"/D"}, {"/E", "/F"})}
    assert tree.folder_digests(folders.limit(0), f.limit(0)).count() == 0


def test_compare_diff_share_and_merge(spark):
    a = [("/a/same", 10, c(10, "a")), ("/a/diff", 10, c(10, "b")), ("/a/moved", 7, c(7, "c")), ("/a/mine", 5, "u:1"), ("/a/unread", 1, None)]
    b = [("/b/same", 10, c(10, "a")), ("/b/diff", 10, c(10, "d")), ("/b/x/there", 7, c(7, "c")), ("/b/yours", 3, "u:2"), ("/b/unread", 1, None)]
    df = files(spark, a + b)
    pair = spark.createDataFrame([(1, "/a", "/b")], "k int, dir_a string, dir_b string")
    got = {r["relative_path"]: r["status"] for r in similar.compare_folders(pair, df, ["k"]).collect()}
    assert got == {"same": "identical", "diff": "different_content", "moved": "shared_elsewhere", "x/there": "shared_elsewhere", "mine": "only_a", "yours": "only_b", "unread": "identical"}
    diff = {(r["side"], r["path"], r["total"]) for r in similar.pair_difference(pair, df, ["k"]).collect()}
    assert diff == {("a", "/a/diff", 2), ("a", "/a/mine", 2), ("b", "/b/diff", 2), ("b", "/b/yours", 2)}
    assert {r["path"] for r in similar.shared_side(pair, df, ["k"]).collect()} == {"/a/same", "/a/moved"}
    links = spark.createDataFrame([("/a", "/a/ln", "t")], "dir string, path string, target string")
    plan = {r["source"]: (r["bucket"], r["target"]) for r in similar.merge_plan(pair, df, links, ["k"]).collect()}
    assert plan == {"/a/diff": ("unique", "/b/diff"), "/a/mine": ("unique", "/b/mine"), "/a/unread": ("uncovered", "/b/unread"), "/a/ln": ("symlink", "/b/ln")}
    named = removal.final_names(spark.createDataFrame([("/a/diff", "/b/diff", c(10, "b")), ("/z/diff", "/b/diff", c(10, "z")), ("/q/same", "/b/same", c(10, "a")), ("/n", "/b/new.tar", "u:9")], "source string, target string, class_id string"), df.select("path", "class_id"))
    assert {r["source"]: (r["final"], r["action"]) for r in named.collect()} == {"/a/diff": ("/b/diff (2)", "transfer"), "/z/diff": ("/b/diff (3)", "transfer"), "/q/same": (None, "skip"), "/n": ("/b/new.tar", "transfer")}


def test_clusters(spark):
    df = files(spark, [("/A/1", 5, c(5, "a")), ("/B/1", 5, c(5, "a")), ("/B/2", 6, c(6, "b")), ("/C/2", 6, c(6, "b")), ("/C/u", 1, "u:1"), ("/D/3", 2, c(2, "d")), ("/D/4", 2, c(2, "d"))])
    got = {r["dir"]: r for r in clusters.folder_clusters(df.select("dir", "class_id", "size")).collect()}
    assert set(got) == {"/A", "/B", "/C"} and {r["cluster"] for r in got.values()} == {"/A"}
    assert got["/C"]["percent"] == 50.0 and got["/A"]["class_count"] == 2 and got["/A"]["dup_file_count"] == 4 and got["/A"]["size"] == 22
    assert clusters.folder_clusters(df.select("dir", "class_id", "size"), min_files=5).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 10])
def test_near_hashes(spark, radius):
    check_near_hashes(spark, radius)


@pytest.mark.parametrize("radius,bands", [(16, None), (10, 3), (5, 6), (2, 1)])
def test_bands_of_any_width(spark, radius, bands, monkeypatch):
    find = clusters.near_hashes
    monkeypatch.setattr(clusters, "near_hashes", lambda h, r: find(h, r, bands=bands))
    check_near_hashes(spark, radius)
    assert sum(r + 1 for r in clusters.band_radii(radius, bands or 4)) == radius + 1


def check_near_hashes(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) - 2**63 for _ in range(25)]
    hashes = [(k, b ^ sum({1 << r.randrange(63) for _ in range(r.randrange(0, 6))})) for k, b in enumerate(base * 4)]
    df = spark.createDataFrame([*hashes, (900, None)], "id bigint, hash bigint")
    near = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= radius
    reps = {}
    for k, h in hashes:
        reps.setdefault(h, k)
    expected = {tuple(sorted((a, b))) for (x, a), (y, b) in combinations(reps.items(), 2) if near(x, y)}
    found = [(x["a"], x["b"]) for x in clusters.near_hashes(df, radius).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    groups_ = {}
    for x in clusters.lookalike_groups(df, radius).collect():
        groups_.setdefault(x["group_id"], set()).add(x["id"])
    linked = {i for (i, x), (j, y) in combinations(hashes, 2) if near(x, y)} | {j for (i, x), (j, y) in combinations(hashes, 2) if near(x, y)}
    assert all(len(v) >= 2 and min(v) == k for k, v in groups_.items()) and set().union(*groups_.values()) == linked
    by = dict(hashes)
    for (k, v), (m, w) in combinations(groups_.items(), 2):
        assert not any(near(by[a], by[b]) for a in v for b in w)


def test_propagation(spark):
    names = number_vertices(spark.createDataFrame([(x,) for x in ["b", "é", "a", "Z", None, "a", "漢"]], "v string"), "v")
    assert [r["name"] for r in names.orderBy("id").collect()] == sorted(["b", "é", "a", "Z", "漢"], key=str.encode)
    chain = [(k, k + 1) for k in range(100)] + [(200, 201)]
    edges = spark.createDataFrame(chain + [(b, a) for a, b in chain], "src bigint, dst bigint")
    assert {r["label"] for r in propagate_minimum(edges).where("id <= 100").collect()} == {0}
    assert propagate_minimum(edges.limit(0)).count() == 0


COPIES = [("/data/B.bin", 30), ("/data/a.bin", 50), ("/Volumes/x/c.bin", 70), ("/ref/d.bin", None)]


def keepers(spark, rules):
    df = files(spark, [(p, 9, c(9, "a"), {"mtime_ns": t}) for p, t in COPIES])
    return ranking.choose_keepers(df, rules).collect()[0]["keeper"], {r["path"] for r in ranking.removals(df, rules, ["/ref"]).collect()}


def test_keepers(spark):
    K = ranking.KeepRules
    assert keepers(spark, K("newest"))[0] == "/Volumes/x/c.bin" and keepers(spark, K("oldest"))[0] == "/data/B.bin"
    assert keepers(spark, K("lexical"))[0] == "/data/a.bin"
    assert keepers(spark, K("newest", internal_first=True)) == ("/data/a.bin", {"/data/B.bin", "/Volumes/x/c.bin"})
    assert keepers(spark, K("newest", always_keep=["/data"])) == ("/data/a.bin", {"/Volumes/x/c.bin"})
    assert keepers(spark, K("newest", prefer_keep=["/ref"]))[0] == "/ref/d.bin"
    assert keepers(spark, K("newest", prefer_remove=["/Volumes"]))[0] == "/data/a.bin"
    with pytest.raises(ValueError):
        K("other")


def test_selection_never_takes_all(spark):
    df = files(spark, [(p, 9, c(9, "a"), {"mtime_ns": t}) for p, t in COPIES[:3]] + [("/s", 1, c(1, "b"))])
    got = {r["path"]: r["selected"] for r in ranking.safe_selection(df, F.lit(True)).collect()}
    assert got == {"/data/B.bin": False, "/data/a.bin": True, "/Volumes/x/c.bin": True}
    cap = {r["path"]: r["reclaimable"] for r in ranking.reclaimable(df.where("size = 9"), F.lit(True)).collect()}
    assert sorted(cap.values()) == [0, 9, 9] and cap["/data/a.bin"] == 0
    assert ranking.selection_stats(df, F.col("size") == 9).collect()[0].asDict() == {"files": 3, "bytes": 27, "groups": 1}


def test_running_totals(spark):
    r = random.Random(4)
    rows = [(r.randrange(50), k, r.randrange(10)) for k in range(2000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, v bigint").repartition(6)
    got = {x["b"]: x["s"] for x in ranking.running(df, [ranking.Order(F.col("a"), True), F.col("b")], F.col("v"), "s").collect()}
    total = 0
    for _, b, v in sorted(rows, key=lambda x: (-x[0], x[1])):
        total += v
        assert got[b] == total
    assert ranking.running(df.limit(0), [F.col("a")]).count() == 0


def test_votes_and_busy_time(spark):
    for hits, n, winner in (({"a": 1, "b": 0}, 1, {"a"}), ({"a": 1, "b": 1}, 1, set()), ({"a": 1, "b": 0}, 4, set()), ({"a": 2, "b": 0}, 4, {"a"}), ({"a": 6, "b": 4}, 8, {"a"}), ({"a": 6, "b": 5}, 8, set()), ({"a": 5, "b": 1}, 8, set())):
        cur = spark.createDataFrame([(x, f"/f{k}") for x, h in hits.items() for k in range(h)] * 2 + [("z", "/else")], "candidate string, rel string")
        s = spark.createDataFrame([("r", f"/f{k}") for k in range(n)] * 2, "root string, rel string")
        assert {x["candidate"] for x in ranking.relocation_vote(s, cur).where("accepted").collect()} == winner
    i = spark.createDataFrame([("d", 0, 10, 1), ("d", 5, 12, 1), ("d", 20, 21, 1), ("d", 2, 3, 1), ("d", 9, 4, 1), ("e", None, 4, 1)], "g string, start bigint, end bigint, bytes bigint")
    assert {(x["g"], x["busy"], x["bytes"]) for x in ranking.busy_time(i, "g").collect()} == {("d", 13, 5)}


def test_retention(spark):
    df = spark.createDataFrame([(k, k * 10, 100, k == 1) for k in range(6)], "id bigint, t bigint, s bigint, p boolean")
    assert {r["id"] for r in retention.keep_newest(df, "t", "id", 2).collect()} == {4, 5}
    kept = {r["id"]: r["kept"] for r in retention.keep_within(df, "t", "id", "s", 350, "p").collect()}
    assert kept == {0: False, 1: True, 2: False, 3: False, 4: True, 5: True}
    assert {r["id"] for r in retention.keep_within(df, "t", "id", "s", 0, "p").where("kept").collect()} == {1}
    log = spark.createDataFrame([(1, "aa"), (2, "x" * 50), (3, "bb"), (4, "cc")], "k int, t string")
    assert [r["t"] for r in retention.bounded_log(log, "k", "t", 32, 10).orderBy("k").collect()] == ["aa", "<oversized-text-omitted>", "bb"]


def test_refresh_and_recompute(spark):
    old = files(spark, [("/a", 1, None), ("/b", 1, None), ("/c", None, None)])
    new = files(spark, [("/z", 1, None), ("/b", 1, None, {"ino": 2}), ("/c", None, None, {"ctime_ns": 9, "ino": 3})])
    assert snapshots.refresh_stats(old, new).collect()[0].asDict() == {"added": 1, "removed": 1, "changed": 1, "unchanged": 1}
    df = files(spark, [("/d/x/1", 4, c(4, "a")), ("/d/y/1", 4, c(4, "a")), ("/dd/1", 4, c(4, "a"))])
    gone = spark.createDataFrame([("/d",)], "path string")
    left = snapshots.remaining(df, gone).collect()
    assert [(r["path"], r["class_id"]) for r in left] == [("/dd/1", c(4, "a"))]


def test_content_with_two_copies_never_vanishes(spark):
    """Random safe removals leave a copy of everything."""
    r = random.Random(21)
    rows = [(f"/d{r.randrange(8)}/f{k}", 7, c(7, r.choice("abcdef"))) for k in range(60)]
    df = files(spark, rows)
    for _ in range(3):
        picked = [p for p, *_ in rows if r.random() < 0.5]
        selected = ranking.safe_selection(df, F.col("path").isin(picked)).where("selected").select("path")
        df = snapshots.remaining(df, selected)
    assert {x["class_id"] for x in df.select("class_id").distinct().collect()} == {cl for *_, cl in rows}


def test_violations_and_seeds(spark):
    good = [("/r/a", 3, c(3, "a")), ("/r/b", 0, "u:1")]
    assert snapshots.violations(files(spark, good), spark.createDataFrame([("/r",)], "root string")).count() == 0
    bad = [("/r//a", 3, c(3, "a")), ("/r/b", 4, c(3, "a")), ("/r/c", -1, "12:zz"), ("/r/d", 1, None, {"dev": None}), ("/r/e", 1, None, {"name": "f"}), ("/q/g", 1, None), ("/q/g", 1, None)]
    rules = {(x["rule"], x["path"]) for x in snapshots.violations(files(spark, bad), spark.createDataFrame([("/r",)], "root string")).collect()}
    assert {r for r, _ in rules} == {"path is absolute and normal", "class has the file's size", "class has the right form", "size is known and not negative", "identity is known", "name and folder are the path's", "path comes once", "path is under a root"}
    seeds = files(spark, [("/old/keep", 3, c(3, "a")), ("/old/uniq", 3, "u:11"), ("/old/bad", 12, "12:not-a-digest"), ("/old/size", 4, c(3, "a")), ("/else/x", 3, c(3, "a"))])
    moved = spark.createDataFrame([("/old", "/new")], "old string, new string")
    assert [(r["path"], r["digest"]) for r in snapshots.seed_rows(seeds, moved).collect()] == [("/new/keep", "a" * 64)]


def test_removal_verdicts(spark):
    old = files(spark, [("/a", 1, c(1, "a")), ("/b", 1, c(1, "a")), ("/p/c", 1, c(1, "a")), ("/d", 1, c(1, "a"))])
    new = files(spark, [("/a", 1, c(1, "a")), ("/b", 2, c(1, "a")), ("/p/c", 1, c(1, "a"), {"ino": 3})])
    roots = spark.createDataFrame([("/p",)], "root string")
    assert {r["path"]: r["verdict"] for r in removal.authorised(old, new, roots).collect()} == {"/a": "authorised", "/b": "changed", "/p/c": "protected", "/d": "missing"}
    assert {r["verdict"] for r in removal.authorised(old, new, None).collect()} == {"protected"}
    same_inode = files(spark, [("/a", 1, c(1, "a"), {"ino": 1}), ("/b", 1, c(1, "a"), {"ino": 1}), ("/x", 2, c(2, "b")), ("/y", 2, c(2, "b"))])
    v = same_inode.where("path IN ('/a', '/x')")
    assert {r["path"]: r["safe"] for r in removal.survivors(v, same_inode).collect()} == {"/a": False, "/x": True}
    folder = files(spark, [("/f/a", 1, c(1, "a")), ("/f/._a", 1, "u:1"), ("/f/._z", 1, "u:2"), ("/f/b", 1, "u:3")])
    assert {r["path"] for r in removal.unproven(folder, old).collect()} == {"/f/._z", "/f/b"}


def test_report(spark):
    df = files(spark, [("/x/=cmd.txt", 50, c(50, "a")), ("/y/b.txt", 50, c(50, "a")), ("/z/c.jpg", 25, c(25, "b")), ("/w/d.jpg", 25, c(25, "b"))])
    folders = spark.createDataFrame([("d1", "/A", 300), ("d1", "/B", 300)], "digest string, dir string, size bigint")
    pairs = spark.createDataFrame([("/P", "/Q", 82.5, 99)], "dir_a string, dir_b string, percent double, shared_bytes bigint")
    rows = reports.report_rows(df, folders, pairs, F.col("path").isin("/x/=cmd.txt", "/z/c.jpg", "/w/d.jpg"))
    assert rows.columns == reports.COLUMNS
    s = {r["record_type"]: r for r in reports.report_summary(rows).collect()}
    assert (s["exact_file"]["groups"], s["exact_file"]["potential"], s["exact_file"]["reclaimable_bytes"]) == (2, 75, 75)
    assert s["exact_directory"]["potential"] == 300 and s["similar_directories"]["items"] == 1
    assert {r["group"] for r in rows.where("path LIKE '/z%'").collect()} == {"F2"}
    cats = {r["category"]: r["items"] for r in reports.category_counters(rows).collect()}
    assert cats == {"document": 2, "image": 2, "folder": 2}


def test_views(spark):
    df = files(spark, [("/Volumes/a/Größe.jpg", 1, c(1, "a")), ("/b/x.jpg", 1, c(1, "a")), ("/c/y.txt", 2, c(2, "b"), {"mtime_ns": None}), ("/d/z.txt", 2, c(2, "b"))])
    paths = lambda d: {r["path"] for r in d.collect()}
    assert paths(views.visible_copies(df, text="GRÖSSE")) == {"/Volumes/a/Größe.jpg"}
    assert paths(views.visible_copies(df, preset="safe")) == {"/Volumes/a/Größe.jpg", "/b/x.jpg"} == paths(views.visible_copies(df, preset="network"))
    assert views.visible_copies(df, preset="review").count() == 4 and views.visible_copies(df, kind="image").count() == 2
    with pytest.raises(ValueError):
        views.visible_copies(df, preset="none")
    p = views.Profile(min_size=2, excluded_extensions=["JPG"], included_extensions=["txt"])
    entries = df.withColumn("is_bundle", F.lit(False)).withColumn("is_symlink", F.col("path") == "/d/z.txt")
    assert paths(entries.where(views.should_include(p))) == {"/c/y.txt"}
    with pytest.raises(ValueError):
        views.Profile(excluded_extensions=["a"], included_extensions=[".A"])
    tags = spark.createDataFrame([("k1", "old"), ("k2", "old")], "k string, tag string")
    ch = spark.createDataFrame([("k1", "new", 1), ("k1", "", 2), ("k3", "x", 1)], "k string, tag string, at int")
    assert {tuple(r) for r in views.put_tags(tags, ch, ["k"]).collect()} == {("k2", "old"), ("k3", "x")}
    e = spark.createDataFrame([("/a: b: gone",), ("/c",), (None,)], "message string")
    cand = spark.createDataFrame([("/a",), ("/a: b",), ("/c",), ("/ccc",)], "path string")
    assert paths(views.failed_candidates(e, cand)) == {"/a", "/a: b", "/c"}
