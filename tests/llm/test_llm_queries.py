"""The queries with SQL against DuckDB, the others against their definitions, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from stratafold.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("sim_pairs", "dir_clusters", "file_groups", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = c.execute(queries.SQL[name])
    names = sorted(x[0] for x in found.description)
    at = [[x[0] for x in found.description].index(n) for n in names]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in found.fetchall())


def test_columns(spark):
    kinds = {n: [(f.name, f.dataType.simpleString()) for f in queries.QUERIES[n](spark, SF).schema] for n in ("p1_found", "p2_found", "p5_found", "p6_ids", "p8_found")}
    assert kinds["p1_found"] == [("tbl", "string"), ("id_a", "bigint"), ("id_b", "bigint")]
    assert kinds["p2_found"] == [("group_dir", "string"), ("dir", "string")]
    assert kinds["p5_found"] == [("dir_a", "string"), ("dir_b", "string")]
    assert kinds["p6_ids"] == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert kinds["p8_found"] == [("doc_id", "bigint")]


def test_mixtures(spark):
    table = queries.QUERIES["p7_shares"](spark, SF).collect()
    assert len(table) == 21
    for r in table:
        most = r["available_tokens"] * r["max_repeats"]
        assert r["reached_tokens"] <= most and r["most_uses"] <= max(r["max_repeats"], 0)


def test_documents_of_the_filled_mixtures(spark):
    drawn = Counter()
    for r in queries.QUERIES["p7_mix_filled"](spark, SF).collect():
        drawn[r["mix_name"], r["source"]] += r["tokens"] * r["uses"]
    table = {(r["mix_name"], r["source"]): r["reached_tokens"] for r in queries.QUERIES["p7_shares_filled"](spark, SF).collect()}
    assert drawn == {k: n for k, n in table.items() if n}
    kept = {(r["mix_name"], r["source"]): r["reached_tokens"] for r in queries.QUERIES["p7_shares"](spark, SF).collect()}
    assert table != kept


def test_pairs_follow_from_classes(spark):
    """Every pair has two entries of one class, and every entry of a class is in a pair."""
    classes = {(r["tbl"], r["id"]): r["form"] for r in queries.QUERIES["p1_classes"](spark, SF).collect()}
    pairs = [tuple(r) for r in queries.QUERIES["p1_found"](spark, SF).collect()]
    assert all(classes[t, a] == classes[t, b] for t, a, b in pairs)
    assert {(t, i) for t, a, b in pairs for i in (a, b)} == set(classes)


def test_tree_of_mixtures(spark):
    rows = queries.QUERIES["p7_tree_shares"](spark, SF).collect()
    assert rows and all(r["reached_tokens"] <= r["available_tokens"] * max(1, r["most_uses"]) for r in rows)
    assert any(r["budget_tokens"] > r["share_tokens"] + 1 for r in rows)
