"""Similar sets against all pairs."""

import random
from itertools import combinations

import pytest

from stratafold.llm import setjoin
from stratafold.llm.setjoin import ChosenPath, folder_contents, similar_classes, similar_sets


def brute(items, percent):
    sets = {}
    for name, token, w in items:
        if name is not None and token is not None:
            tokens = sets.setdefault(name, {})
            tokens[token] = max(tokens.get(token, 0), w or 0)
    out = {}
    for a, b in combinations(sorted(sets, key=lambda s: s.encode()), 2):
        common = sets[a].keys() & sets[b].keys()
        p = 200.0 * len(common) / (len(sets[a]) + len(sets[b]))
        if p >= percent:
            out[a, b] = (round(p, 9), sum(sets[a][t] for t in common))
    return out


def run(spark, items, params=ChosenPath()):
    df = spark.createDataFrame([(*x, "n") for x in items], "record string, token string, weight bigint, id string")
    rows = similar_sets(df, "record", "token", "weight", params).collect()
    found = {(r["a"], r["b"]): (round(r["percent"], 9), r["shared_weight"]) for r in rows}
    assert len(found) == len(rows)
    return found


def make(seed, n=120, hot=True):
    r = random.Random(seed)
    items = []
    for k in range(n):
        size = r.choice([1, 1, 2, 3, 4, 6, 9, 15, 30])
        tokens = {f"t{r.randrange(900)}" for _ in range(size)} | ({"hot"} if hot and r.random() < 0.7 else set())
        items.append((f"r{k}", tokens))
        for c in range(r.choice([0, 0, 1, 2])):  # near copies
            near = set(tokens)
            for t in list(near):
                if r.random() < 0.12:
                    near.discard(t)
            if r.random() < 0.4:
                near.add(f"n{r.randrange(900)}")
            if near:
                items.append((f"r{k}~{c}", near))
    weight = lambda t: len(t) * 7
    return [(name, t, weight(t)) for name, tokens in items for t in tokens]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_sets(spark, seed):
    items = make(seed)
    items += items[:40] + [(None, "t1", 1), ("r1", None, 1), ("solo", "t1", None)]
    assert run(spark, items) == brute(items, 75)


def test_deep_trees(spark):
    """Thousands of records share some tokens: large nodes are split again."""
    r = random.Random(9)
    items = []
    for k in range(500):
        for t in {"p", "q", *(f"x{r.randrange(4000)}" for _ in range(r.choice([1, 3, 5, 8])))}:
            items.append((f"a{k}", t, 1))
    for k in range(60):  # pairs that only the common tokens make similar
        items += [(f"b{k}", t, 1) for t in ("p", "q", "s", f"y{k}")]
    assert run(spark, items, ChosenPath(leaf=16)) == brute(items, 75)


def test_copies_and_single_tokens(spark):
    items = [(f"c{k}", t, 5) for k in range(30) for t in ("u", "v")] + [(f"s{k}", "only", 3) for k in range(5)] + [("d", t, 5) for t in ("u", "v", "w")]
    assert run(spark, items) == brute(items, 75)


@pytest.mark.parametrize("percent", [50.0, 60.0, 200 / 3, 90.0])
@pytest.mark.parametrize("exact", [False, True])
def test_other_thresholds(spark, percent, exact):
    items = make(4, 70) + [("x", "a", 1), *(("y", t, 1) for t in "ab"), *(("z", t, 1) for t in "abc")]
    assert run(spark, items, ChosenPath(percent=percent, exact=exact)) == brute(items, percent)


def test_one_token_sets_and_empty(spark):
    items = [("x", "a", 1), *(("y", t, 1) for t in "ab"), *(("z", t, 1) for t in "abc")]
    assert set(run(spark, items, ChosenPath(percent=60))) == {("x", "y"), ("y", "z")}
    assert run(spark, []) == {} == run(spark, [], ChosenPath(exact=True))


def test_many_common_tokens_never_end_in_one_node(spark):
    """More tokens in all sets than any fixed depth: nodes are split on until they are small."""
    r = random.Random(12)
    common = [f"c{k}" for k in range(14)]
    items = []
    for k in range(150):
        own = {f"o{r.randrange(600)}" for _ in range(14)}
        items += [(f"a{k}", t, 1) for t in {*common, *own}]
        if k % 5 == 0:
            items += [(f"b{k}", t, 1) for t in {*common, *list(own)[:9], f"z{k}"}]
    assert run(spark, items, ChosenPath(leaf=12)) == brute(items, 75)


def test_sets_with_equal_signatures_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(setjoin, "_signature", lambda: [F.lit(0).alias("s1"), F.lit(0).alias("s2")])
    items = make(6, 30)
    assert run(spark, items) == brute(items, 75)


def test_classes_and_pairs_between_them(spark):
    items = [(f"c{k}", t, 5) for k in range(30) for t in ("u", "v", "w", "x")] + [(f"d{k}", t, 5) for k in range(3) for t in ("u", "v", "w")] + [("solo", "q", 1)]
    s = similar_classes(spark.createDataFrame(items, "r string, t string, w bigint"), "r", "t", "w")
    rep = {r["id"]: (r["rep"], r["n"], r["copies"], r["weight"]) for r in s.classes.collect()}
    assert set(rep.values()) == {("c0", 4, 30, 20), ("d0", 3, 3, 15), ("solo", 1, 1, 1)}
    assert [({rep[r["x"]][0], rep[r["y"]][0]}, r["shared_weight"]) for r in s.pairs.collect()] == [({"c0", "d0"}, 15)]
    assert s.members.count() == 34


def test_folders(spark):
    rows = [("1:a", 1, ["/x/f", "/x/g", "/y/f", None, "nofolder"]), ("1:b", 1, None), (None, 1, ["/z/f"]), ("1:c", None, ["/top"])]
    df = spark.createDataFrame(rows, "digest string, size bigint, paths array<string>")
    found = {tuple(r) for r in folder_contents(df).where("token IS NOT NULL").collect()}
    assert found == {("/x", "1:a", 1), ("/y", "1:a", 1), ("", "1:c", None)}
