"""Journal constraints, sanitized documents, state and content digests."""

import json

from pyspark.sql import functions as F

from stratafold.functions.sanitize import clean_json, sanitize_json
from stratafold.operators import journal, tree
from stratafold.sources import inventory as I
from tests.test_operators import c, files

ID = "a" * 32


def item(**changes):
    base = {"original_path": "/a", "size": 1, "kind": "file", "status": "trashed", "trashed_path": "/t/a", "restored_path": None, "restored_ns": None, "digest": "b" * 64, "identity": [1, 2, 3, 4, 5, 6], "error": None}
    return tuple((base | changes).values())


def operations(spark, *rows):
    return spark.createDataFrame([(r.get("id", ID), r.get("created", 5), r.get("updated", 6), r.get("status", "completed"), r.get("errors", []), r.get("items", [item()])) for r in rows], journal.SCHEMA)


def rules(spark, **row):
    return {r["rule"] for r in journal.journal_violations(operations(spark, row)).collect()}


def test_constraints(spark):
    assert rules(spark) == set()
    assert rules(spark, items=[item(status="restored", restored_path="/a", restored_ns=9)], status="restored") == set()
    assert rules(spark, id="x") == {"id has the right form"}
    assert rules(spark, updated=4) == {"times are positive and in order"} and rules(spark, status="odd") == {"operation has a known status"}
    assert rules(spark, items=[]) == {"items are there and not too many"}
    assert rules(spark, items=[item(), item(size=2)]) == {"original paths come once"}
    assert rules(spark, items=[item(original_path="a")]) == {"paths are absolute"}
    assert rules(spark, items=[item(kind="pipe")]) == {"item has a known status and kind"}
    assert rules(spark, items=[item(size=-1)]) == {"size is known and not negative"}
    assert rules(spark, items=[item(digest="zz")]) == {"digest has the right form"}
    assert rules(spark, items=[item(identity=[1])]) == {"identity has six parts"}
    assert rules(spark, items=[item(restored_ns=4)]) == {"restored items and only they say where and when"}
    assert rules(spark, status="restored") == {"restored operation has no open items"}
    assert {r["rule"] for r in journal.journal_violations(operations(spark, {}, {})).collect()} == {"id comes once"}


def test_bounds_and_updates(spark):
    many = [item(original_path=f"/{k}") for k in range(4)]
    ops = operations(spark, *[{"id": f"{k:032x}", "created": k + 1, "updated": k + 1, "items": many} for k in range(6)])
    kept = lambda **k: sorted(int(r["id"], 16) for r in journal.bounded_journal(ops, **k).collect())
    assert kept(most=3) == [3, 4, 5] and kept(items=9) == [4, 5] and kept(items=1) == [5]
    change = operations(spark, {"id": f"{5:032x}", "updated": 99, "status": "partial"}, {"id": "f" * 32})
    got = {r["id"]: r["status"] for r in journal.update_operations(ops, change).collect()}
    assert len(got) == 7 and got[f"{5:032x}"] == "partial"


def test_items(spark):
    df = operations(spark, {"items": [item(), item(identity=None), item(identity=None, digest=None), item(trashed_path=None), item(kind="directory", identity=None)]})
    assert [r[0] for r in df.select(F.explode("items").alias("x")).select(journal.auto_restorable(F.col("x"))).collect()] == [True, True, False, False, False]
    cl = files(spark, [("/a", 1, c(1, "a")), ("/u", 1, "u:1")])
    rows = spark.createDataFrame([("/a", None), ("/u", "old"), ("/none", None)], "original_path string, digest string")
    assert {tuple(r) for r in journal.with_digests(rows, cl).collect()} == {("/a", "a" * 64), ("/u", None), ("/none", None)}
    v = spark.createDataFrame([("fixed",), ("phantom",), ("fixed",), ("weird",), (None,)], "verdict string")
    assert {tuple(r) for r in journal.outcome_counts(v, ["fixed", "phantom"]).collect()} == {("fixed", 2), ("phantom", 1), ("error", 2)}


def test_sanitized_documents(spark):
    doc = {"path": "/Users/me/x", "API-Key": 5, "n": [1, None, True, "mail a@b.org"], "deep": {"token_id": {"a": 1}}, "big": "x" * 20_000}
    out = json.loads(clean_json(json.dumps(doc)))
    assert out == {"path": "<PATH>", "API-Key": "<REDACTED>", "n": [1, None, True, "mail <EMAIL>"], "deep": {"token_id": "<REDACTED>"}, "big": "<oversized-text-omitted>"}
    nested = "[" * 30 + "]" * 30
    assert "<max-depth>" in clean_json(nested) and "<collection-truncated>" in clean_json(json.dumps(list(range(5000))))
    df = spark.createDataFrame([(json.dumps(doc),), ("no json, token=abc",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(sanitize_json(F.col("t"))).collect()]
    assert got == [clean_json(json.dumps(doc)), '"no json, token=<REDACTED>"', None, '""']


def test_sanitized_collections_of_up_to_2000_entries():
    for n in (1_001, 1_999):
        assert json.loads(clean_json(json.dumps(list(range(n))))) == list(range(n))
        names = {f"n{k}": k for k in range(n)}
        assert json.loads(clean_json(json.dumps(names))) == names
    assert json.loads(clean_json(json.dumps([0] * 2_001)))[-2:] == ["<collection-truncated>"] * 2
    assert json.loads(clean_json(json.dumps([0] * 2_000))) == [0] * 1_999 + ["<collection-truncated>"]


def test_state_and_content_digests(spark):
    a = files(spark, [("/A/f", 3, None), ("/A/s/g", 4, None), ("/B/f", 3, None)])
    ok = I.folders(a).withColumn("ok", F.lit(True))
    before = {r["dir"]: r["digest"] for r in tree.state_digests(ok, a).collect()}
    touched = a.withColumn("mtime_ns", F.when(F.col("path") == "/A/s/g", 9).otherwise(F.col("mtime_ns")))
    after = {r["dir"]: r["digest"] for r in tree.state_digests(ok, touched).collect()}
    assert {d for d in before if before[d] != after[d]} == {"/A", "/A/s"}
    moded = {r["dir"]: r["digest"] for r in tree.state_digests(ok, a.withColumn("mode", F.lit(7))).collect()}
    assert all(moded[k] != before[k] for k in before)
    e = a.withColumn("digest", F.sha2("name", 256)).unionByName(a.where("path = '/A/f'").select(*[F.col(x) for x in a.columns if x != "name"], F.lit("h").alias("name"), F.sha2("name", 256).alias("digest")).select(*a.columns, "digest"))
    got = {r["dir"]: (r["files"], r["bytes"], r["digest"] is None) for r in tree.content_digests(ok, e).collect()}
    assert got == {"/A": (3, 7, False), "/A/s": (1, 4, False), "/B": (1, 3, False)}
