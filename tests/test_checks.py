"""Checks, guards and decisions on small cases: nulls, ties, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from stratafold.operators import checks, removal, views
from stratafold.operators.ranking import Order  # noqa: F401


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_relations(spark):
    files = spark.createDataFrame([("/a/x", "/a", "x", 1, "u:1", 1, 2), ("/a/y", "/a", "y", -1, "bad", 1, None)], "path string, dir string, name string, size bigint, class_id string, dev bigint, ino bigint")
    folders = spark.createDataFrame([("/a", "/", 1), ("/b/c", "/b", 2), ("/d", "/z", 1)], "dir string, parent string, depth int")
    links = spark.createDataFrame([("/a", "/a/l"), ("/a", "/b/l")], "dir string, path string")
    aliases = spark.createDataFrame([("/a", "/a/z", "/a/x"), ("/a", "/a/w", "/none")], "dir string, alias string, canonical string")
    found = {(r["relation"], r["rule"], r["path"]) for r in checks.scan_violations({"files": files, "folders": folders, "links": links, "aliases": aliases}).collect()}
    assert {("folders", "parent is there", "/b/c"), ("folders", "parent is the path's", "/d"), ("links", "lies in its folder", "/b/l"), ("aliases", "canonical file is there", "/a/w")} <= found
    assert ("files", "identity is known", "/a/y") in found and ("files", "size is known and not negative", "/a/y") in found and len(found) == 7
    with pytest.raises(ValueError):
        checks.scan_violations({})
    assert rows(checks.derived_sections(files.limit(0), folders)["folder_files"]) == [("/a", 0, 0), ("/b/c", 0, 0), ("/d", 0, 0)]


def test_merge_roots(spark):
    pairs = spark.createDataFrame([("/a", "/b"), ("/a", "/a/c"), ("a", "/b"), ("/a", None), ("/a", "/a"), ("/l", "/b"), ("/a", "/hard")], "src string, dst string")
    links = spark.createDataFrame([("/l",)], "path string")
    ids = spark.createDataFrame([("/a", 1, 5), ("/hard", 1, 5), ("/b", 1, 6)], "path string, dev bigint, ino bigint")
    got = {(r["src"], r["dst"]): r["verdict"] for r in checks.merge_root_verdicts(pairs, links, ids).collect()}
    assert got == {("/a", "/b"): "ready", ("/a", "/a/c"): "nested", ("a", "/b"): "relative", ("/a", None): "relative", ("/a", "/a"): "same", ("/l", "/b"): "link", ("/a", "/hard"): "same"}


def test_manifests(spark):
    good = '{"schema_version":1,"version":"2.0.0","release_url":"https://x.org/r"}'
    cases = {
        good: "2.0.0", good.replace("1,", "2,", 1): None, good.replace("1,", '"1",', 1): None, good.replace("1,", "true,", 1): None, good.replace("}", ',"version":"3.0.0"}'): None, good.replace("x.org", "localhost"): None,
        good.replace("2.0.0", "2.0"): None, good.replace("}", ',"published_at":"2025-02-30T00:00:00Z"}'): None, good.replace("}", ',"published_at":"2025-02-20T00:00:00Z","summary":"s"}'): "2.0.0",
        good.replace("}", f',"summary":"{"s" * 8001}"}}'): None, good.replace("}", ',"x":1}'): None, "[]": None, "": None, "no json": None,
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", checks.parse_manifest(F.col("t")).alias("m"))
    got = {r["t"]: r["m"] and r["m"]["version"] for r in df.collect()}
    assert got == cases | {None: None}
    newer = df.select("t", checks.update_available(F.col("m"), F.lit("1.9.9")).alias("n")).where("n").count()
    assert newer == 2


def test_aliases_lists_and_states(spark):
    df = spark.createDataFrame([("/var/x",), ("/private/tmp",), ("/varx",), (None,)], "path string")
    names = {r["path"]: r["n"] for r in df.select("path", checks.lexical_aliases(F.col("path")).alias("n")).collect()}
    assert names == {"/var/x": ["/var/x", "/private/var/x"], "/private/tmp": ["/private/tmp", "/tmp"], "/varx": ["/varx"], None: []}
    paths = spark.createDataFrame([("/b",), ("/a",), ("/a\0",), (None,), ("/" + "x" * 90,)], "path string")
    shown, counts = checks.bounded_paths(paths, 2, 50)
    assert rows(shown) == [("/a",), ("/b",)] and rows(counts) == [(5, 2)]
    assert checks.view_state("compact", "all_safe", "largest") and pytest.raises(ValueError, checks.view_state, "compact", "everything", "all")
    a = spark.createDataFrame([("x", 1), ("y", 0), ("z", None)], "k string, dev bigint")
    assert rows(checks.same_device(a, a, ["k"])) == [("x", True), ("y", False), ("z", False)]
    specs = spark.createDataFrame([("/f", "file", 3), ("/d", "dir", None), ("/u", "unknown", None), ("/n", "file", None)], "path string, kind string, size bigint")
    now = spark.createDataFrame([("/f", "file", 4), ("/d", "dir", None), ("/u", "link", None), ("/n", "file", None)], "path string, kind string, size bigint")
    assert rows(checks.probe_matches(specs, now)) == [("/d", True), ("/f", False), ("/n", True), ("/u", True)]


def test_guards(spark):
    c = spark.createDataFrame([("g", "/a"), ("g", "/b"), ("g", "/srv/c"), ("h", "/d"), ("h", "/e")], "class_id string, path string")
    chosen = spark.createDataFrame([("/a",), ("/d",), ("/d",)], "path string")
    asked = spark.createDataFrame([("/b",), ("/srv/c",), ("/e",), ("/a",), ("/x",)], "path string")
    assert rows(views.check_one(c, chosen, asked, ["/srv"])) == [("/a", True), ("/b", True), ("/e", False), ("/srv/c", False), ("/x", False)]
    sides = spark.createDataFrame([(1, True, True, 5), (1, False, True, 6), (2, True, False, 1), (3, False, False, 1), (4, True, True, 2)], "row_id int, a boolean, b boolean, at int")
    assert rows(views.check_sides(sides)) == [(1, "b"), (2, "a"), (4, "a")]
    assert rows(views.cleared(chosen)) == [] and rows(views.cleared(chosen, asked)) == [("/d",), ("/d",)]
    odd = spark.createDataFrame([("/a//b", 1), ("/a/./b/", 0), ("/c", 2)], "path string, n int")
    assert rows(views.candidate_paths(odd, [F.col("n"), F.col("path")])) == [("/a/./b/", 0), ("/c", 2)]
    live = spark.createDataFrame([(True, False), (True, None), (False, False), (None, False)], "l boolean, p boolean")
    assert [r[0] for r in live.select(views.ready_to_act(F.col("l"), F.col("p"))).collect()] == [True, False, False, False]


def test_views_sort(spark):
    c = spark.createDataFrame([("g", "/b", 5, 0, 9), ("g", "/A", 5, 0, None), ("h", "/x", 90, 3, 4), ("h", "/y", 90, 0, 0), ("one", "/z", 1, 1, 1)], "class_id string, path string, size bigint, btime_ns bigint, mtime_ns bigint")
    by = lambda **k: {r["path"]: (r["group_place"], r["place"]) for r in views.sorted_copies(c, **k).collect()}
    assert by() == {"/A": (1, 1), "/b": (1, 2), "/x": (2, 1), "/y": (2, 2)}
    assert by(key="changed", descending=True, preset="largest") == {"/b": (2, 1), "/A": (2, 2), "/x": (1, 1), "/y": (1, 2)}
    p = spark.createDataFrame([("/b", "/c", 50.0, 9), ("/B", "/a", 60.0, 9), ("/a", "/d", 10.0, 1)], "dir_a string, dir_b string, percent double, shared_bytes bigint")
    assert [r["dir_b"] for r in views.sorted_pairs(p).orderBy("k").collect()] == ["/a", "/c", "/d"]
    assert [r["dir_a"] for r in views.sorted_pairs(p, "percent").orderBy("k").collect()] == ["/B", "/b", "/a"]
    undated = {r["path"]: (r["born"], r["undated"]) for r in views.group_view(c).collect()}
    assert undated["/A"] == (None, True) and undated["/x"] == ("1970-01-01 00:00", False)
    stats = views.pair_selection_stats(c.select("path", "size").limit(0), p, p.select("dir_a", "dir_b", F.lit("/q").alias("path")))
    assert rows(stats) == [(0, 0)]


def test_decisions_before_removals(spark):
    s = spark.createDataFrame([("/t", "trusted", "d"), ("/r", "reread", "d"), ("/w", "reread", "d"), ("/f", "fail", "d"), ("/n", "reread", None)], "path string, state string, expected string")
    fresh = spark.createDataFrame([("/t", "d"), ("/r", "d"), ("/w", "e"), ("/n", None)], "path string, digest string")
    assert rows(removal.paranoid_state(s, fresh)) == [("/f", "fail"), ("/n", "fail"), ("/r", "reread_ok"), ("/t", "trusted"), ("/w", "fail")]
    assert dict(rows(removal.paranoid_state(s, fresh, True)))["/t"] == "reread_ok"
    v = spark.createDataFrame([("/v", "d", 1, 1, "/k"), ("/w", "d", 1, 2, "/k"), ("/x", "e", 1, 3, "/k"), ("/y", "d", 1, 4, "/gone/k"), ("/z", None, 1, 5, None)], "path string, digest string, dev bigint, ino bigint, claim string")
    claimed = spark.createDataFrame([("/k", "d", 1, 2), ("/gone/k", "d", 1, 9)], "path string, digest string, dev bigint, ino bigint")
    assert rows(removal.claimed_survivors(v, claimed, spark.createDataFrame([("/gone",)], "path string"))) == [("/v", True), ("/w", False), ("/x", False), ("/y", False), ("/z", False)]
    d = spark.createDataFrame([("/a", "1"), ("/b", "1"), ("/c", "1"), ("/e", None)], "dir string, digest string")
    after = spark.createDataFrame([("/a", "1"), ("/b", "2"), ("/c", "1")], "dir string, digest string")
    missing = spark.createDataFrame([("/c", "/c/x"), ("/c", "/c/y")], "dir string, path string")
    assert rows(removal.folder_removal(d, d, after, missing)) == [("/a", "ok", 0), ("/b", "changed", 0), ("/c", "abort", 2), ("/e", "changed", 0)]
    assert {r["result"] for r in removal.folder_removal(d, d, after, missing, cancelled=True).collect()} == {"cancelled"}
    named = spark.createDataFrame([("/s", "/t", "/t (2)", "transfer"), ("/q", "/t", None, "skip"), ("/p", "/u", "/u", "transfer")], "source string, target string, final string, action string")
    assert rows(removal.transfer_status(named, fresh.limit(0), fresh.limit(0))) == [("/p", None, "error"), ("/q", None, "skipped"), ("/s", None, "error")]


def test_a_pair_is_scanned_again(spark):
    e = [("file", f"{d}/{n}", d, n, s, k, i) for i, (d, n, s, k) in enumerate([("/a", "x", 10, "10:" + "a" * 64), ("/b", "x", 10, "10:" + "a" * 64), ("/b", "y", 5, "u:1"), ("/c", "x", 10, "10:" + "a" * 64)])]
    df = spark.createDataFrame([(k, p, d, n, s, None, i + 1, 1) for k, p, d, n, s, _, i in e], "kind string, path string, dir string, name string, size bigint, error string, ino bigint, dev bigint")
    df = df.withColumn("target", F.lit(None).cast("string"))
    classes = spark.createDataFrame([(p, k) for _, p, _, _, _, k, _ in e], "path string, class_id string")
    assert [tuple(r) for r in removal.fresh_pair(df, ("/b", "/a"), classes=classes).collect()] == [("/a", "/b", 80.0, 10, 1)]
    assert removal.fresh_pair(df, ("/a", "/none"), classes=classes).count() == 0


def test_names_after_collisions(spark):
    there = spark.createDataFrame([("/a/x.txt", "1:a"), ("/a/x (3).txt", "1:b"), ("/a/y (restored 2).z", None), ("/a/y.z", None), ("/n (restored)", None)], "path string, class_id string")
    plan = spark.createDataFrame([("/s1", "/a/x.txt", "u:1"), ("/s2", "/a/x.txt", "u:2"), ("/s3", "/a/x.txt", "1:a"), ("/s4", "/free", "u:4"), ("/s5", "/free", None)], "source string, target string, class_id string")
    assert [tuple(r) for r in removal.final_names(plan, there).orderBy("source").collect()] == [
        ("/s1", "/a/x.txt", "/a/x (2).txt", "transfer"), ("/s2", "/a/x.txt", "/a/x (4).txt", "transfer"), ("/s3", "/a/x.txt", None, "skip"), ("/s4", "/free", "/free", "transfer"), ("/s5", "/free", "/free (2)", "transfer"),
    ]
    assert [r["action"] for r in removal.final_names(plan, there, 3).orderBy("source").collect()] == ["transfer", "error", "skip", "transfer", "transfer"]
    items = spark.createDataFrame([("/a/y.z", "/t/1"), ("/a/y.z", "/t/2"), ("/n", "/t/1"), ("/n", "/t/2"), ("/free", "/t/1")], "original_path string, trashed_path string")
    got = [tuple(r) for r in removal.restore_names(items, there).orderBy("original_path", "trashed_path").collect()]
    assert got == [("/a/y.z", "/t/1", "/a/y (restored 1).z"), ("/a/y.z", "/t/2", "/a/y (restored 3).z"), ("/free", "/t/1", "/free"), ("/n", "/t/1", "/n"), ("/n", "/t/2", "/n (restored 1)")]


def test_legacy_cut_and_captions(spark):
    from stratafold.functions.text import redact_all
    from stratafold.operators.groups import problem_caption
    from stratafold.operators.ranking import safe_selection, time_of
    from stratafold.operators.retention import legacy_cut

    day = 86_400 * 10**9
    scans = spark.createDataFrame([("a", 0, 5, True), ("b", 0, 7, False), ("c", 3 * day, 9, True), ("d", day, 1, True)], "path string, created_ns bigint, size bigint, legacy boolean")
    old, totals = legacy_cut(scans, 100 * day, 2, spark.createDataFrame([("d",)], "path string"))
    assert rows(old.select("path")) == [("a",)] and rows(totals) == [(1, 5, 17)]
    assert rows(legacy_cut(scans.limit(0), 1, 1)[1]) == [(0, 0, 0)]
    df = spark.createDataFrame([(3, 1200), (5, 5)], "s int, t int")
    assert [r[0] for r in df.select(problem_caption(F.col("s"), F.col("t"))).collect()] == ["Показано 3 із 1,200", None]
    t = spark.createDataFrame([(None, 5.0, 7), (None, float("nan"), 7), (-1, 5.0, 7), (None, None, 7), (None, None, None)], "mtime_ns bigint, mtime double, btime_ns bigint")
    assert [r[0] for r in t.select(time_of(t)).collect()] == [5.0, None, None, 7.0, None]
    texts = spark.createDataFrame([(["a@b.org", None, "token=x"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in texts.select(redact_all(F.col("t"))).collect()] == [["<EMAIL>", None, "token=<REDACTED>"], None, []]
    c = spark.createDataFrame([("g", "/a", 2), ("g", "/b", 1), ("g", "/v", 0), ("h", "/c", 1), ("h", "/d", 1), ("p", "/v1", 1), ("p", "/v2", 1)], "class_id string, path string, mtime_ns bigint")
    got = dict((r["path"], r["selected"]) for r in safe_selection(c, ~F.col("path").startswith("/v"), F.col("path").startswith("/v")).collect())
    # the oldest wanted copy is let go; a group selected before as a whole isn't touched
    assert got == {"/a": True, "/b": False, "/v": True, "/c": False, "/d": True, "/v1": True, "/v2": True}


def test_cancelled_jobs_end(spark):
    import threading
    import time

    from stratafold.session import cancel, cancellable

    def later():
        time.sleep(3)
        cancel(spark, "stop-me")

    threading.Thread(target=later).start()
    with pytest.raises(Exception, match="(?i)cancel"), cancellable(spark, "stop-me"):
        spark.range(2).mapInArrow(lambda batches: (time.sleep(40) or b for b in batches), "id bigint").collect()
