"""Groups of linked records against a plain search."""

import random

import pytest

from stratafold.llm import components
from stratafold.llm.components import linked_groups, list_links


def brute(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, seen = set(), set()
    for v in near:
        if v not in seen:
            todo, group = [v], {v}
            while todo:
                for y in near[todo.pop()] - group:
                    group.add(y)
                    todo.append(y)
            seen |= group
            least = min(group, key=lambda s: s.encode())
            out |= {(x, least) for x in group}
    return out


def run(spark, links):
    found = [tuple(r) for r in linked_groups(spark.createDataFrame([(*x, 1) for x in links], "a string, b string, id int")).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_random_links(spark):
    r = random.Random(2)
    links = [(f"/d{r.randrange(120)}", f"/d{r.randrange(120)}") for _ in range(80)]
    links += [("/é", "/z"), ("/z", "/漢"), (None, "/d1"), ("/d1", None), (None, None), ("/q", "/q")] + links[:10] + [(b, a) for a, b in links[:10]]
    assert run(spark, links) == brute(links)


def test_long_chains_hub_and_cliques(spark):
    r = random.Random(3)
    order = list(range(300))
    r.shuffle(order)
    links = [(f"c{a:03}", f"c{b:03}") for a, b in zip(order, order[1:])]  # diameter 299
    links += [(f"m{k:03}", f"m{k + 1:03}") for k in range(150)]  # in order
    links += [("hub", f"leaf{k}") for k in range(800)] + [("leaf7", "tail0")] + [(f"tail{k}", f"tail{k + 1}") for k in range(60)]
    assert run(spark, links) == brute(links)


@pytest.mark.parametrize("part", [0.0, 0.1, 1.0, 1e9])
def test_short_and_long_peels_give_the_same(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PEEL_PART", part or 1e-9)
    links = [("hub", f"l{k}") for k in range(30)] + [("l3", "a0")] + [(f"a{k}", f"a{k + 1}") for k in range(8)] + [("x", "y"), ("l4", "l5"), ("a2", "l9")]
    assert run(spark, links) == brute(links)


def test_no_links(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "a"), (None, "b")]) == set()


def test_lists(spark):
    rows = [(["/b", "/a", None, "/b", "/c"],), ([],), (["/x"],), (None,), ([None],), ([None, "/y", "/y"],)]
    found = {tuple(r) for r in list_links(spark.createDataFrame(rows, "dirs array<string>"), "dirs").collect()}
    assert found == {("/a", "/b"), ("/a", "/c")}
