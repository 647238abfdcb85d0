"""Changes between snapshots and middle entries, against plain Python."""

import random

from pyspark.sql import functions as F

from stratafold.operators import middle
from stratafold.operators.changes import snapshot_changes
from stratafold.operators.middle import middle_entries

SCHEMA = "n int, path string, m bigint, i bigint, seen bigint, extra string"


def brute(rows, last):
    best = {}
    for n, p, m, i, seen, _ in rows:
        if p is None or n is None:
            continue
        low = lambda x: (x is not None, x if x is not None else 0)
        k = (low(seen), low(m), low(i))
        if (n, p) not in best or k > best[n, p][0]:
            best[n, p] = (k, (m, i))
    out = set()
    for n in range(2, last + 1):
        old = {p: v[1] for (k, p), v in best.items() if k == n - 1}
        new = {p: v[1] for (k, p), v in best.items() if k == n}
        out |= {(n, p, "added") for p in new.keys() - old.keys()} | {(n, p, "removed") for p in old.keys() - new.keys()}
        out |= {(n, p, "changed") for p in new.keys() & old.keys() if new[p] != old[p]}
    return out


def changes(spark, rows, last=5):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in snapshot_changes(df, "path", "n", ["m", "i"], ["seen"], 1, last).collect()]


def test_random_snapshots(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3, 4, 5]), f"/p{r.randrange(40)}", r.choice([None, 1, 2]), r.choice([None, 7, 8]), r.randrange(3), "x") for _ in range(900)]
    rows += rows[:50] + [(1, None, 1, 1, 1, "x"), (None, "/p1", 1, 1, 1, "x")]
    # a hot path
    rows += [(3, "/hot", k % 5, 1, k, "y") for k in range(500)]
    found = changes(spark, rows)
    assert len(found) == len(set(found)) and set(found) == brute(rows, 5)


def test_null_equals_null_and_return(spark):
    rows = [(1, "/a", None, 1, 1, ""), (2, "/a", None, 1, 1, ""), (3, "/b", 1, 1, 1, ""), (4, "/a", None, 1, 1, ""), (4, "/b", 1, 1, 1, ""), (5, "/b", 1, None, 1, ""), (5, "/a", None, 1, 2, "")]
    assert set(changes(spark, rows)) == {(3, "/a", "removed"), (3, "/b", "added"), (4, "/a", "added"), (5, "/b", "changed")}


def test_no_rows(spark):
    assert changes(spark, []) == []
    assert set(changes(spark, [(1, "/a", 1, 1, 1, "")], 2)) == {(2, "/a", "removed")}


def test_one_exchange_and_one_sort(spark):
    df = spark.createDataFrame([(k % 3, f"/{k}", 1, 1, 1, "") for k in range(50)], SCHEMA)
    found = snapshot_changes(df, "path", "n", ["m", "i"], ["seen"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and plan.count("Sort ") == 1 and "SortAggregate" not in plan


def test_all_snapshots_by_default(spark):
    rows = [(n, f"/{k}", n, 1, 1, "") for n in (2, 3, 7) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in snapshot_changes(df, "path", "n", ["m", "i"], ["seen"]).collect()}
    assert got == {(n, f"/{k}", kind) for k in range(3) for n, kind in ((3, "changed"), (4, "removed"), (7, "added"))}
    assert snapshot_changes(df.limit(0), "path", "n", ["m", "i"], ["seen"]).count() == 0


def test_very_frequent_keys_are_combined_first(spark, monkeypatch):
    from stratafold.operators import changes as C

    r = random.Random(8)
    rows = [(r.randrange(1, 4), r.choice(["/hot"] * 3 + [f"/p{k}" for k in range(9)]), r.choice([None, 1, 2]), r.choice([None, 7]), r.randrange(5), "x") for _ in range(600)]
    plain = set(changes(spark, rows, 3))
    monkeypatch.setattr(C, "OFTEN", 0.2)
    assert set(changes(spark, rows, 3)) == plain == brute(rows, 3)


def test_kept_layout(spark, tmp_path):
    from stratafold.operators.changes import keep_snapshot, kept_changes

    r = random.Random(9)
    rows = [(n, f"/p{r.randrange(60)}", r.choice([None, 1]), r.choice([None, 7]), r.randrange(3), "x") for n in (1, 2) for _ in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [keep_snapshot(df.where(f"n = {n}"), "path", ["m", "i"], ["seen"], f"kept{n}", str(tmp_path / f"s{n}"), 3) for n in (1, 2)]
    found = kept_changes(*kept, "path", ["m", "i"])
    assert {(2, *t) for t in found.collect()} == brute(rows, 2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for n in (1, 2):
        spark.sql(f"DROP TABLE kept{n}")


def brute_middle(rows):
    groups = {}
    for k, o, i in set(rows):
        if None not in (k, o, i):
            groups.setdefault(k, []).append((o, i))
    return {(k, sorted(v)[(len(v) + 1) // 2 - 1][1]) for k, v in groups.items() if len(v) >= 2}


def run_middle(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "size bigint, t bigint, id bigint, k string")
    return [tuple(r) for r in middle_entries(df, "size", "t", "id").collect()]


def test_middle_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(middle, "DIRECT", 8)
    r = random.Random(7)
    rows = [(r.randrange(60), r.randrange(-(2**62), 2**62), k) for k in range(800)]
    rows += [(5, 1_700_000_000_000_000_000 + r.randrange(9), k) for k in range(1000, 1700)]  # many ties
    rows += [(6, 42, -k) for k in range(2000, 2300)]  # one time only
    rows += rows[:100] + [(None, 1, 1), (5, None, 1), (5, 1, None)]
    found = run_middle(spark, rows)
    assert len(found) == len(set(found)) and set(found) == brute_middle(rows)


def test_both_states_give_the_same(spark):
    r = random.Random(11)
    rows = [(r.randrange(5), r.randrange(40), r.randrange(90)) for _ in range(700)]
    df = spark.createDataFrame(rows, "size bigint, t bigint, id bigint")
    for direct in (0, 1, 30, 10_000):
        assert {tuple(x) for x in middle_entries(df, "size", "t", "id", direct).collect()} == brute_middle(rows)


def test_middle_small_cases(spark):
    assert run_middle(spark, []) == []
    assert run_middle(spark, [(1, 1, 1), (1, 1, 1)]) == []
    assert set(run_middle(spark, [(1, 5, 1), (1, 5, 2), (2, 1, 9)])) == {(1, 1)}


def test_result_does_not_depend_on_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("size"), (F.col("id") % 50).alias("t"), "id")
    a = {tuple(r) for r in middle_entries(rows.repartition(1), "size", "t", "id").collect()}
    assert a == {tuple(r) for r in middle_entries(rows.repartition(13), "size", "t", "id").collect()}
