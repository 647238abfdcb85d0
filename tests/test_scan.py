"""Whole scans of small trees."""

import os

import pytest
from pyspark.sql import functions as F

from stratafold.operators import scan as S
from stratafold.operators.views import Profile
from stratafold.sources.walk import read_classes, read_content, read_digests, read_tree, walk


@pytest.fixture
def disk(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "a/x.txt": "same", "a/in/z.txt": "deep", "b/x.txt": "same", "b/in/z.txt": "deep", "b/._x.txt": "meta", "c/x.txt": "same", "c/other.txt": "abcd", "c/App.app/f": "same", "d/x.txt": "same",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "e1").mkdir()
    (root / "e2").mkdir()
    (root / "c/ln").symlink_to("x.txt")
    os.link(root / "d/x.txt", root / "d/again.txt")
    return str(root)


def short(rows, root, *columns):
    return {tuple(r[c].replace(root, "") if isinstance(r[c], str) else r[c] for c in columns) for r in rows.collect()}


def test_scan_of_a_disk(spark, disk):
    s = S.scan(read_tree(spark, disk), read_content(spark, disk))
    g = s.file_groups().collect()
    assert sorted((r["size"], r["copies"]) for r in g) == [(4, 2), (4, 5)]
    assert short(s.aliases, disk, "alias", "canonical") == {("/d/x.txt", "/d/again.txt")}
    assert short(s.links, disk, "path", "target") == {("/c/ln", "x.txt")}
    assert s.errors.count() == 0 and s.folders.where("NOT ok").count() == 0
    found = {}
    for r in s.folder_groups().collect():
        found.setdefault(r["digest"], set()).add(r["dir"].replace(disk, ""))
    # empty folders are equal; /a and /b cover what lies in them
    assert sorted(map(sorted, found.values())) == [["/a", "/b"], ["/e1", "/e2"]]
    pairs = short(s.pairs(), disk, "dir_a", "dir_b")
    assert ("/a", "/c") in pairs and ("/a", "/b") not in pairs
    ignored = spark.createDataFrame([(f"{disk}/c", f"{disk}/a")], "dir_a string, dir_b string")
    assert short(s.pairs(ignored), disk, "dir_a", "dir_b") == pairs - {("/a", "/c")}
    assert s.summary().collect()[0]["problems"] == 0


def test_profile_cloud_and_errors(spark, disk):
    rows = read_tree(spark, disk).withColumn("flags", F.when(F.col("path").endswith("/a/in/z.txt"), S.CLOUD_ONLY).otherwise(0))
    s = S.scan(rows, read_content(spark, disk).where("NOT endswith(path, '/d/again.txt')"), profile=Profile(bundles=False, excluded_paths=[f"{disk}/b"]))
    assert short(s.errors, disk, "path", "message") == {("/d/again.txt", "/d/again.txt: content could not be read")}
    state = {r["dir"].replace(disk, ""): (r["ok"], r["read_failed"]) for r in s.folders.where(F.col("dir").startswith(disk)).collect()}
    assert state == {"": (False, False), "/a": (True, False), "/a/in": (False, False), "/c": (False, False), "/d": (False, True), "/e1": (True, False), "/e2": (True, False)}
    assert s.folder_groups().where("size > 0").count() == 0
    assert [r["copies"] for r in s.file_groups().collect()] == [2]


def test_stopped_scan_publishes_proven_groups_only(spark, disk):
    s = S.scan(read_tree(spark, disk), read_content(spark, disk), complete=False)
    g = s.file_groups().collect()
    assert sorted((r["copies"], r["families"], r["wasted"]) for r in g) == [(2, None, 4), (5, None, 16)]
    assert s.folder_groups().count() == 0 and s.pairs().count() == 0


def test_no_entries_and_few_errors(spark, disk):
    none = read_tree(spark, disk).limit(0)
    s = S.scan(none, classes=spark.createDataFrame([], "path string, class_id string"))
    assert s.file_groups().count() == 0 and s.folders.count() == 0 and s.summary().collect()[0]["files"] == 0
    with pytest.raises(ValueError):
        S.scan(none)
    e = spark.createDataFrame([(f"/{k}", "m") for k in range(9)], "path string, message string")
    first, total = S.kept_errors(e, 4)
    assert first.count() == 4 and total.collect()[0]["problems"] == 9 and S.kept_errors(e, None)[0].count() == 9


def test_walk_by_levels_equals_the_data_source(spark, disk):
    a, b = ({tuple(r) for r in f(spark, disk).drop("btime_ns").collect()} for f in (walk, read_tree))
    assert a == b and len(a) > 15
    assert walk(spark).count() == 0


def test_digests_piece_by_piece(spark, disk, tmp_path, monkeypatch):
    import hashlib

    big = tmp_path / "big"
    big.write_bytes(b"x" * 3_000_000)
    asked = [str(big), f"{disk}/c/ln", f"{disk}/none", disk, f"{disk}/a/x.txt", f"{disk}/a/x.txt", None]
    df = spark.createDataFrame([(p,) for p in asked], "path string")
    got = {r["path"]: (r["digest"], r["error"]) for r in read_digests(df).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {str(big): (sha(b"x" * 3_000_000), None), f"{disk}/c/ln": (sha(b"x.txt"), None), f"{disk}/none": (None, "No such file or directory"), disk: (None, "no regular file"), f"{disk}/a/x.txt": (sha(b"same"), None)}
    assert read_digests(df, 2).where(F.col("path") == str(big)).collect()[0]["digest"] == sha(b"xx")


def test_classes_of_files(spark, tmp_path):
    big = b"y" * 200_000
    for name, raw in {"a": big + b"1", "b": big + b"1", "c": big + b"2", "d": b"zz", "e": b"zy", "f": b"", "g": b"one"}.items():
        (tmp_path / name).write_bytes(raw)
    files = walk(spark, str(tmp_path)).where("kind = 'file'").select("path", "size")
    more = files.unionByName(spark.createDataFrame([(f"{tmp_path}/gone", 2)], files.schema))
    got = {r["path"].rsplit("/", 1)[1]: r["class_id"] for r in read_classes(more).collect()}
    assert got["a"] == got["b"] and got["a"].startswith("200001:") and got["gone"] is None and got["f"].startswith("0:e3b0c4")
    assert all(got[k].startswith("u:") for k in "cdeg")


def test_scan_of_roots_equals_the_scan_of_contents(spark, disk):
    s, t = S.scan_roots(spark, disk), S.scan(read_tree(spark, disk), read_content(spark, disk))
    for one, two in ((s.file_groups(), t.file_groups()), (s.folder_groups(), t.folder_groups()), (s.aliases, t.aliases), (s.folders, t.folders)):
        assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
