"""Folder trees, stores, reports and streams on temporary files."""

import csv
import random
import os
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratafold.operators import funnel, reports
from stratafold.sources import sinks, stores
from stratafold.sources.walk import read_content, read_tree, top_roots
from stratafold.streaming import folds, live


@pytest.fixture
def disk(tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a/x.txt": "same", "a/._x.txt": "meta", "b/deep/y.txt": "same", "b/z.txt": "", ".git/c": "no", "b/é.txt": "other"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "empty").mkdir()
    os.link(root / "a/x.txt", root / "b/hard.txt")
    (root / "ln").symlink_to("a/x.txt")
    (root / "dirlink").symlink_to("a")
    return str(root)


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_walk(spark, disk, depth):
    rows = read_tree(spark, disk, f"{disk}/a", "/no/such", depth=depth).collect()
    rel = lambda kind: sorted(os.path.relpath(r["path"], disk) for r in rows if r["kind"] == kind)
    assert rel("file") == ["a/x.txt", "b/deep/y.txt", "b/hard.txt", "b/z.txt", "b/é.txt"]
    assert rel("dir") == [".", "a", "b", "b/deep", "empty"] and rel("link") == ["dirlink", "ln"]
    by = {os.path.relpath(r["path"], disk): r for r in rows}
    assert by["a/x.txt"]["ino"] == by["b/hard.txt"]["ino"] and by["ln"]["target"] == "a/x.txt" and by["b/z.txt"]["size"] == 0


def test_roots(disk):
    assert top_roots([disk, f"{disk}/a", f"{disk}/../tree", "/no"]) == [disk]
    assert top_roots([f"{disk}/b", f"{disk}/a"]) == [f"{disk}/a", f"{disk}/b"]


def test_scan_of_a_disk(spark, disk):
    files = read_tree(spark, disk).where("kind = 'file'")
    got = {os.path.relpath(r["path"], disk): r["class_id"] for r in funnel.classify(files, read_content(spark, disk)).collect()}
    assert got["a/x.txt"] == got["b/hard.txt"] == got["b/deep/y.txt"] and got["b/z.txt"] == f"0:{funnel.EMPTY}" and got["b/é.txt"].startswith("u:")


def cache_rows(spark, rows):
    return spark.createDataFrame(rows, "path string, kind string, size bigint, mtime_ns bigint, ctime_ns bigint, dev bigint, ino bigint, accessed_ns bigint, digest string")


def test_cache_upsert_and_lookup(spark, tmp_path):
    folder = str(tmp_path / "cache")
    stores.upsert_cache(cache_rows(spark, [("/a", "f", 1, 2, 3, 4, 5, 9, "old"), ("/b", "f", 1, 2, 3, 0, 0, 9, "b"), ("/a", "p", 1, 2, 3, 4, 5, 9, "probe")]), folder)
    stores.upsert_cache(cache_rows(spark, [("/a", "f", 1, 2, 3, 4, 5, 1, "new")]), folder)
    store = stores.read_cache(spark, folder)
    assert {(r["path"], r["kind"]): r["digest"] for r in store.collect()} == {("/a", "f"): "new", ("/b", "f"): "b", ("/a", "p"): "probe"}
    cur = spark.createDataFrame([("/a", 1, 2, 3, 4, 5), ("/b", 1, 2, 99, 7, 7), ("/c", 1, 2, 3, 4, 5)], "path string, size bigint, mtime_ns bigint, ctime_ns bigint, dev bigint, ino bigint")
    hits, misses = funnel.cached_digests(cur, store)
    # of an old row without device only size and time are compared
    assert {(r["path"], r["digest"]) for r in hits.collect()} == {("/a", "new"), ("/b", "b")} and [r["path"] for r in misses.collect()] == ["/c"]
    changed = cur.withColumn("ino", F.lit(6).cast("bigint"))
    assert {r["path"] for r in funnel.cached_digests(changed, store)[0].collect()} == {"/b"}


def test_saved_scans(spark, tmp_path):
    folder = str(tmp_path / "scans")
    good = spark.createDataFrame([("/r/a", "/r", "a", 3, 1, 1, "3:" + "a" * 64)], "path string, dir string, name string, size bigint, dev bigint, ino bigint, class_id string")
    first = stores.save_scan({"files": good}, folder, {"roots": ["/r"]})
    second = stores.save_scan({"files": good.withColumn("size", F.lit(4).cast("bigint"))}, folder)
    os.makedirs(f"{folder}/scan-unfinished")
    Path(f"{folder}/scan-broken").mkdir()
    Path(f"{folder}/scan-broken/header.json").write_text("{")
    assert [h["path"] for h in stores.list_scans(spark, folder)] == [second, first]
    assert stores.load_scan(spark, first)["files"].collect() == good.collect()
    with pytest.raises(ValueError, match="class has the file's size"):
        stores.load_scan(spark, second)
    other = str(tmp_path / "other")
    copy = stores.import_scan(spark, first, other)
    assert stores.list_scans(spark, other)[0]["roots"] == ["/r"] and stores.load_scan(spark, stores.export_scan(spark, copy, folder))["files"].collect() == good.collect()
    with pytest.raises(ValueError):
        stores.import_scan(spark, second, other)
    with pytest.raises(ValueError):
        stores.delete_scan(spark, folder, copy)
    assert stores.delete_scan(spark, other, copy) and stores.list_scans(spark, other) == [] == stores.list_scans(spark, str(tmp_path / "none"))


def test_parts_of_the_digest_store_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PARTS", 2)
    folder = str(tmp_path / "cache")
    for k in range(5):
        stores.upsert_cache(cache_rows(spark, [("/a", "f", 1, 2, 3, 4, 5, 9 - k, f"a{k}"), (f"/b{k}", "f", 1, 2, 3, 4, 5, 9, "b")]), folder)
    got = {r["path"]: r["digest"] for r in stores.read_cache(spark, folder).collect()}
    assert got == {"/a": "a4"} | {f"/b{k}": "b" for k in range(5)}
    assert len(stores._parts(spark, folder)) <= 2
    with pytest.raises(FileNotFoundError):
        stores.read_cache(spark, str(tmp_path / "none"))


def test_settings(tmp_path):
    s = stores.SettingsStore(str(tmp_path / "s.json"), {"a": 1}, most=2)
    s.save("Zeta", {"a": 2})
    s.save("alpha", {"a": 3})
    s.save("ZETA", {"a": 4})
    assert s.names() == ["default", "alpha", "ZETA"] and s.load("zeta") == {"a": 4} and s.load("Default") == {"a": 1}
    with pytest.raises(ValueError):
        s.save("third", {})
    with pytest.raises(ValueError):
        s.delete("default")
    s.delete("Alpha")
    with pytest.raises(KeyError):
        s.load("alpha")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("/x/=cmd.txt", 50, "50:" + "a" * 64), ("/y/\"b\",<i>.txt", 50, "50:" + "a" * 64)], "path string, size bigint, class_id string")
    folders = spark.createDataFrame([], "digest string, dir string, size bigint")
    pairs = spark.createDataFrame([("=P", "/Q", 82.5, 99)], "dir_a string, dir_b string, percent double, shared_bytes bigint")
    rows = reports.report_rows(df, folders, pairs, F.lit(False))
    sinks.write_csv(rows, str(tmp_path / "csv"))
    lines = [x for p in (tmp_path / "csv").glob("part-*") for x in csv.DictReader(p.open(newline=""))]
    assert sorted(x["path"] for x in lines) == ["'=P", "/x/=cmd.txt", '/y/"b",<i>.txt'] and list(lines[0]) == reports.COLUMNS
    sinks.write_html(reports.report_summary(rows), rows, str(tmp_path / "r.html"), "R & D")
    page = (tmp_path / "r.html").read_text()
    assert "<i>" not in page and "&lt;i&gt;" in page and "R &amp; D" in page and "<script" not in page
    plan = spark.createDataFrame([(1, "/a", "/b", "symlink"), (2, "=c", "/d", "unique")], "size bigint, source string, target string, bucket string")
    sinks.write_merge_plan(plan, str(tmp_path / "plan"))
    assert {(x["source"], x["kind"]) for p in (tmp_path / "plan").glob("part-*") for x in csv.DictReader(p.open())} == {("/a", "symlink"), ("'=c", "")}


def test_folds_by_hand():
    p = folds.ProgressLimiter()
    assert [p.step(t, d, 9) for t, d in ((0, 1), (0.05, 2), (0.1, 3), (0.15, 4), (0.16, 9))] == [True, False, True, False, True]
    h = folds.Hysteresis(50)
    assert [h.step(v) for v in (49, 50, 48, None, None, None, None, 48, 47, 48)] == [False, True, True, True, True, True, False, True, False, False]
    k = folds.HillClimb(cap=4)
    assert [k.step(v) for v in (100, 200, 200, 200, 200, 200, None, 200, 200, 200, 400, 400)] == [3, 3, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4]
    k = folds.HillClimb(cap=9)
    assert [k.step(100.0) for _ in range(16)] == [3, 2, 2, 2, 2, 2, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2]  # rests of 4, then 8 readings
    k = folds.HillClimb(cap=9, plateau=0.9)
    assert [k.step(100.0) for _ in range(9)] == [3, 3, 3, 3, 4, 4, 4, 4, 5]


def remaining_by_hand(rows):
    """Straight from the definition, one stream."""
    out, run = {}, []
    for t, done, total in sorted(rows):
        if run and (done < run[-1][1] or total != run[-1][2]):
            run = []
        run.append((t, done, total))
        samples = [x for k, x in enumerate(run) if k == 0 or x[1] != run[k - 1][1]][-8:]
        (t0, d0, _), (t1, d1, _) = samples[0], samples[-1]
        if total > 0 and len(samples) >= 3 and t - run[0][0] >= 1.5 and done < total and t1 > t0 and d1 > d0:
            out[t] = pytest.approx((total - d1) * (t1 - t0) / (d1 - d0))
        else:
            out[t] = None
    return out


def streams_of_readings():
    r = random.Random(3)
    streams = {}
    for key in ("a", "b"):
        t = done = 0
        total, rows = 100, []
        for _ in range(120):
            t += r.choice([0.2, 0.5, 1.0])
            done = 0 if r.random() < 0.04 else min(total, done + r.choice([0, 0, 1, 3]))
            total = r.choice([80, 100, 0]) if r.random() < 0.03 else total
            rows.append((round(t, 3), done, total))
        streams[key] = rows
    return streams


def test_remaining_time(spark):
    streams = streams_of_readings()
    rows = [(k, *x) for k, xs in streams.items() for x in xs]
    df = spark.createDataFrame([*rows, ("a", 1.0, None, 5)], "key string, t double, done bigint, total bigint").repartition(3)
    got = folds.remaining_time(df, "key", ["t", "done"], "t", "done", "total").collect()
    assert len(got) == len(rows) + 1
    for k, xs in streams.items():
        assert {r["t"]: r["remaining"] for r in got if r["key"] == k and r["done"] is not None} == remaining_by_hand(xs)
    assert [r["remaining"] for r in got if r["done"] is None] == [None]
    assert folds.remaining_time(df.limit(0), "key", ["t"], "t", "done", "total").count() == 0


def test_remaining_time_of_a_stream(spark, tmp_path):
    streams = streams_of_readings()
    schema = "key string, t double, done bigint, total bigint"
    for n in range(4):
        part = [(k, *x) for k, xs in streams.items() for x in xs[n * 30 : n * 30 + 30]]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.remaining_stream(stream, "key", "t", "done", "total").writeStream.format("memory").queryName("remaining").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("remaining").collect()
    for k, xs in streams.items():
        assert {r["t"]: r["remaining"] for r in got if r["key"] == k} == remaining_by_hand(xs)


def test_hot_flags_equal_the_fold(spark):
    r = random.Random(5)
    rows = [(k, t, r.choice([None, 40.0, 46.0, 47.0, 48.0, 49.5, 50.0, 60.0, float("nan")])) for k in ("a", None) for t in range(200)]
    df = spark.createDataFrame(rows, "key string, t bigint, v double").repartition(3)
    got = {(r["key"], r["t"]): r["hot"] for r in folds.hot_flags(df, "key", ["t"], "v", 50.0).collect()}
    assert got == brute(rows, lambda s, r: s.step(r[2]), lambda: folds.Hysteresis(50.0))


def brute(rows, step, start):
    out, states = {}, {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out[r[0], r[1]] = step(states.setdefault(r[0], start()), r)
    return out


def test_fold_streams(spark):
    rows = [(k, t, (t * 37 + len(str(k))) % 70 * 1.0) for k in ("a", "b", None) for t in range(300)]
    df = spark.createDataFrame(rows, "key string, t bigint, v double").repartition(5)
    got = folds.fold_streams(df, "key", ["t"], lambda: folds.Hysteresis(50.0), lambda s, r: s.step(r.v), "hot boolean")
    assert {(r["key"], r["t"]): r["hot"] for r in got.collect()} == brute(rows, lambda s, r: s.step(r[2]), lambda: folds.Hysteresis(50.0))
    assert folds.fold_streams(df.limit(0), "key", ["t"], lambda: folds.Hysteresis(50.0), lambda s, r: s.step(r.v), "hot boolean").count() == 0


def test_state_is_kept_between_batches(spark, tmp_path):
    rows = [(k, t, float((t * 31) % 60)) for k in ("a", "b") for t in range(60)]
    source = tmp_path / "in"
    schema = "key string, t bigint, v double"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == n], schema).coalesce(1).write.mode("append").parquet(str(source / f"n{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    out = live.stateful_fold(stream, "key", ["t"], lambda: folds.Hysteresis(50.0), ["hot", "missed"], lambda s, r: s.step(r.v), "hot boolean")
    q = out.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["key"], r["t"]): r["hot"] for r in spark.table("folded").collect()} == brute(rows, lambda s, r: s.step(r[2]), lambda: folds.Hysteresis(50.0))


def test_incremental_rescan_digests_only_changes(spark, tmp_path):
    folder, cache, out = (str(tmp_path / n) for n in ("inv", "cache", "out"))
    schema = "path string, size bigint, mtime_ns bigint, ctime_ns bigint, dev bigint, ino bigint"
    inventory = [(f"/f{k}", 1, 1, 1, 1, k + 1) for k in range(10)]
    stores.upsert_cache(cache_rows(spark, [(p, "f", s, m, c, d, i, 0, "known") for p, s, m, c, d, i in inventory[:6]]), cache)
    spark.createDataFrame([*inventory[:5], ("/f5", 1, 2, 1, 1, 6), *inventory[6:]], schema).coalesce(1).write.parquet(folder)
    q = live.incremental_rescan(live.stream_inventory(spark, folder, schema), cache, lambda m: m.withColumn("digest", F.sha2("path", 256)), out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r["path"]: r["hit"] for r in spark.read.parquet(out).collect()}
    assert got == {f"/f{k}": k < 5 for k in range(10)}
    assert stores.read_cache(spark, cache).where("digest <> 'known'").count() == 5


def test_windows_close_by_watermark(spark, tmp_path):
    rows = pd.DataFrame({"at": pd.to_datetime(["2025-01-01 00:00", "2025-01-01 00:04", "2025-01-01 00:06", "2025-01-01 02:00"]), "k": ["a"] * 4, "v": [1.0, 2.0, 4.0, 8.0]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = live.windowed_activity(stream, "at", "k", "v").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["readings"], r["total"]) for r in spark.table("windows").collect()) == [(1, 4.0), (2, 3.0)]
