"""Mixtures: budgets by hand, draws against their budgets."""

import random
from collections import defaultdict

import pandas as pd
import pytest

from stratafold.llm import mixing


def test_fill_redistributes_to_siblings():
    assert mixing.fill([1, 1, 2], [100, 100, 100], 80) == [20, 20, 40]
    assert mixing.fill([1, 1, 2], [5, 100, 100], 80) == pytest.approx([5, 25, 50])
    assert mixing.fill([1, 1], [10, 10], 80) == [10, 10]
    assert mixing.fill([0, 1], [10, 10], 80) == [0, 10]
    assert mixing.fill([-1, float("nan")], [10, 10], 5) == [0, 0]
    assert mixing.fill([], [], 5) == []


def tree(rows):
    return pd.DataFrame(rows, columns=["domain", "lang", "source", "w_domain", "w_lang", "w_source", "cap"])


def test_siblings_before_ancestors():
    t = tree([("web", "en", "a", 1, 1, 1, 10), ("web", "en", "b", 1, 1, 1, 1000), ("web", "de", "c", 1, 1, 1, 1000), ("books", "en", "d", 1, 1, 1, 1000)])
    # a's shortage of 15 goes to b, its sibling, alone
    assert list(mixing.budgets(t, ["domain", "lang", "source"], 200)) == pytest.approx([10, 40, 50, 100])
    t.loc[1, "cap"] = 15
    # en can't give its 50: de makes up for it, books keep theirs
    assert list(mixing.budgets(t, ["domain", "lang", "source"], 200)) == pytest.approx([10, 15, 75, 100])
    t.loc[2, "cap"] = 20
    assert list(mixing.budgets(t, ["domain", "lang", "source"], 200)) == pytest.approx([10, 15, 20, 155])
    assert list(mixing.budgets(t, ["domain", "lang", "source"], 200, fixed=["domain"])) == pytest.approx([10, 15, 20, 100])


def by_level(weights, caps, budget):
    """The budgets of siblings another way: the level at which all of them filled up to it take the budget, by bisection."""
    budget = min(budget, sum(c for w, c in zip(weights, caps) if w > 0))
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for w, c in zip(weights, caps)) < budget else (low, mid)
    return [min(c, high * w) for w, c in zip(weights, caps)]


def by_hand(rows, budget, depth=0):
    """{path: budget} of rows (path, weights, cap)."""
    if depth == 3:
        return {rows[0][0]: min(budget, rows[0][2])}
    parts = defaultdict(list)
    for row in rows:
        parts[row[0][depth]].append(row)
    capacity = lambda part, d: part[0][2] if d == 3 else sum(capacity(p, d + 1) for p in split(part, d) if p[0][1][d] > 0)
    split = lambda part, d: [[r for r in part if r[0][d] == v] for v in dict.fromkeys(r[0][d] for r in part)]
    out = {}
    for part, b in zip(parts.values(), by_level([p[0][1][depth] for p in parts.values()], [capacity(p, depth + 1) for p in parts.values()], budget)):
        out |= by_hand(part, b, depth + 1)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_random_trees_against_bisection(seed):
    r = random.Random(seed)
    weight, rows = {}, []
    for d in "abc":
        for k in "xyz":
            for s in "pqr":
                if r.random() < 0.8:
                    path = (d, d + k, d + k + s)
                    w = tuple(weight.setdefault(n, r.choice([1.0, 2.0, 5.0])) for n in path)
                    rows.append((path, w, float(r.choice([1, 10, 200, 1000]))))
    frame = tree([(*path, *w, cap) for path, w, cap in rows])
    for total in (5.0, 300.0, 1500.0, 1e6):
        own = list(mixing.budgets(frame, ["domain", "lang", "source"], total))
        hand = by_hand(rows, total)
        assert own == pytest.approx([hand[path] for path, _, _ in rows], abs=1e-3)


def test_tree_of_documents(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["/a"] * 6 + ["/b", None]), r.choice(["en"] * 5 + ["de"]), r.choice(["s", "t"]), r.choice([0, 20, 50])) for k in range(2000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, tokens bigint")
    mixes = spark.createDataFrame([("m", 0.8, 2), ("m", None, 1), (None, 1.0, 1), ("none", None, None)], "mix_name string, total_fraction double, max_repeats int")
    weights = spark.createDataFrame([("m", "source", "s", 3.0), ("m", "source", "t", 1.0), ("m", "domain", "/b", None), ("x", "lang", "en", 9.0)], "mix_name string, level string, value string, weight double")
    levels = ("domain", "lang", "source")
    plan = mixing.tree_budgets(sizes, mixes, weights, levels)
    held = defaultdict(float)
    for _, *path, n in rows:
        held[tuple(path)] += n
    w = lambda p: (0.0 if p[0] == "/b" else 1.0, 1.0, 3.0 if p[2] == "s" else 1.0)
    hand = by_hand([(p, w(p), 2 * n) for p, n in held.items() if n], 0.8 * sum(held.values()))
    got = {(x["domain"], x["lang"], x["source"]): x for x in plan.where("mix_name = 'm'").collect()}
    assert {p: pytest.approx(x["budget"], abs=1e-3) for p, x in got.items()} == hand
    assert any(abs(x["budget"] - x["share_tokens"]) > 100 for x in got.values())  # redistributed
    table = mixing.tree_shares(plan, mixing.draw(sizes, plan, levels=levels), levels).collect()
    assert all(abs(x["reached_tokens"] - x["budget_tokens"]) <= 50 and x["most_uses"] <= 2 for x in table if x["mix_name"] == "m")
    assert all(x["reached_tokens"] == 0 for x in table if x["mix_name"] == "none")
    assert mixing.tree_budgets(sizes.limit(0), mixes, weights, levels).count() == 0


SIZES = "doc_id bigint, source string, lang string, tokens bigint"
PLANS = "mix_name string, source string, weight double, max_repeats int, total_fraction double, extra string"


@pytest.fixture(scope="module")
def sizes(spark):
    r = random.Random(1)
    rows = [(k, r.choice(["big"] * 8 + ["small", None]), r.choice(["en", "de", None]), r.choice([0, 5, 20, 300])) for k in range(3000)]
    return spark.createDataFrame(rows, SIZES).cache(), rows


def draw(spark, sizes, plans, keep=True):
    plan = mixing.mixture_budgets(sizes, spark.createDataFrame(plans, PLANS), keep)
    return plan, mixing.draw(sizes, plan)


def test_each_source_reaches_its_share(spark, sizes):
    df, rows = sizes
    total = sum(x[3] for x in rows)
    held = defaultdict(int)
    for _, s, _, n in rows:
        held[s] += n
    plans = [("m", "big", 3.0, 2, 0.5, ""), ("m", "small", 1.0, 2, 0.5, ""), ("m", "absent", 1.0, 3, 0.5, ""), ("m", "zero", 0.0, 1, 0.5, ""), ("n", "small", None, 1, 0.1, ""), (None, "big", 1.0, 1, 1.0, "")]
    plan, drawn = draw(spark, df, plans)
    got, uses = defaultdict(int), {}
    for x in drawn.collect():
        got[x["mix_name"], x["source"]] += x["tokens"] * x["uses"]
        assert (x["mix_name"], x["doc_id"]) not in uses and 0 < x["uses"] <= 2
        uses[x["mix_name"], x["doc_id"]] = x["uses"]
    for source, w in (("big", 0.6), ("small", 0.2)):
        wanted = min(w * 0.5 * total, 2 * held[source])
        assert abs(got["m", source] - wanted) <= 3 * 300  # half a document a leaf
    assert set(got) == {("m", "big"), ("m", "small")}
    table = {(x["mix_name"], x["source"]): x for x in mixing.shares(plan, drawn).collect()}
    assert table["m", "absent"]["reached_tokens"] == 0 and table["m", "absent"]["wanted_share"] == pytest.approx(0.2)
    assert table["m", "big"]["reached_tokens"] == got["m", "big"]
    assert table["n", "small"]["wanted_share"] == 0


def test_short_sources_are_made_up_for_only_on_request(spark, sizes):
    df, rows = sizes
    total = sum(x[3] for x in rows)
    plans = [("m", "big", 1.0, 5, 0.4, ""), ("m", "absent", 1.0, 5, 0.4, "")]
    one = sum(x["tokens"] * x["uses"] for x in draw(spark, df, plans)[1].collect())
    two = sum(x["tokens"] * x["uses"] for x in draw(spark, df, plans, False)[1].collect())
    assert abs(one - 0.2 * total) < 900 and abs(two - 0.4 * total) < 900


def test_repeats_and_same_seed(spark, sizes):
    df, rows = sizes
    plans = [("m", "small", 1.0, 4, 9.0, "")]
    first = {(x["doc_id"], x["uses"]) for x in draw(spark, df, plans)[1].collect()}
    assert {u for _, u in first} == {4} and len(first) == sum(1 for x in rows if x[1] == "small" and x[3] > 0)
    part = [("m", "big", 1.0, 4, 0.3, "")]
    a = {(x["doc_id"], x["uses"]) for x in draw(spark, df, part)[1].collect()}
    assert a == {(x["doc_id"], x["uses"]) for x in draw(spark, df.repartition(7), part)[1].collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SIZES)
    plan, drawn = draw(spark, none, [("m", "big", 1.0, 1, 0.5, "")])
    assert drawn.count() == 0 and mixing.shares(plan, drawn).count() == 1
    plan, drawn = draw(spark, spark.createDataFrame([(1, "big", "en", 5)], SIZES), [])
    assert drawn.count() == 0 and mixing.shares(plan, drawn).count() == 0
