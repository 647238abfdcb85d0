"""Groups expanded in blocks, and the layout of kept tables."""

import random
from itertools import combinations

from stratafold.operators.skew import expand_pairs
from stratafold.session import cut_by, release


def test_expansion_equals_all_pairs(spark):
    r = random.Random(4)
    groups = {g: {f"{g}{k}" for k in range(n)} for g, n in (("x", 40), ("y", 1), ("z", 17))}
    members = [(g, m) for g, ms in groups.items() for m in ms] + [("y", "y0")]
    r.shuffle(members)
    pairs = [("x", "y", 1), ("x", "z", 2), ("x", "x", 3), ("y", "y", 4), ("z", "none", 5)]
    got = [tuple(t) for t in expand_pairs(spark.createDataFrame(pairs, "a string, b string, w int"), spark.createDataFrame(members, "g string, m string"), 8).collect()]
    want = {("x", "y", 1, m, "y0") for m in groups["x"]} | {("x", "z", 2, m, n) for m in groups["x"] for n in groups["z"]}
    assert len(got) == len(set(got)) and {t for t in got if t[0] != t[1]} == want
    assert {(t[2], *sorted(t[3:])) for t in got if t[0] == t[1]} == {(3, *sorted(p)) for p in combinations(groups["x"], 2)} and sum(t[0] == t[1] for t in got) == 780


def test_kept_layout_joins_without_a_shuffle(spark):
    t = cut_by(spark.range(1000).selectExpr("id % 97 AS k", "id"), "k")
    u = cut_by(spark.range(97).selectExpr("id AS k", "id * 2 AS v"), "k")
    joined = t.hint("merge").join(u, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.count() == 1000
    release(t, u)
