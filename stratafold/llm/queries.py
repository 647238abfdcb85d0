"""Queries of the text and set problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import mixing
from stratafold.llm.bpe import TOKENIZERS, encode_corpus, encoder_functions
from stratafold.llm.components import linked_groups, list_links
from stratafold.llm.lookalike import canonical, same_look_classes, same_look_pairs
from stratafold.llm.mojibake import held_out, restore_encoding
from stratafold.llm.setjoin import folder_contents, similar_classes, similar_sets
from stratafold.session import spread
from stratafold.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = same_look_pairs(table(spark, d, "files"), "file_id", "path")
    compared = same_look_pairs(table(spark, d, "folder_compare"), "row_id", "relative_path", "compare_id")
    return files.select(F.lit("files").alias("tbl"), "id_a", "id_b").unionByName(
        compared.select(F.lit("folder_compare").alias("tbl"), "id_a", "id_b").distinct()
    )


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The entries that look like others, each with the form it shares with them: one row an entry."""
    files = same_look_classes(table(spark, d, "files"), "file_id", "path")
    compared = same_look_classes(table(spark, d, "folder_compare"), "row_id", "relative_path", "compare_id")
    columns = lambda df, name: df.select(F.lit(name).alias("tbl"), "id", "form")
    return columns(files, "files").unionByName(columns(compared, "folder_compare")).distinct()


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every path of files with its consistent form."""
    return table(spark, d, "files").select("file_id", "path").distinct().select("file_id", "path", canonical(F.col("path")).alias("form"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "sim_pairs").select(F.col("dir_a").alias("a"), F.col("dir_b").alias("b"))
    lists = list_links(table(spark, d, "dir_clusters"), "dirs")
    groups = linked_groups(pairs.unionByName(lists))
    return groups.select(F.col("group").alias("group_dir"), F.col("member").alias("dir"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = similar_sets(folder_contents(table(spark, d, "file_groups")), "record", "token", "weight")
    return found.select(F.col("a").alias("dir_a"), F.col("b").alias("dir_b"), F.round("percent", 1).alias("percent"), F.col("shared_weight").alias("shared_bytes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("dir_a", "dir_b")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """The similar pairs of different sets, each set by its smallest folder."""
    s = similar_classes(folder_contents(table(spark, d, "file_groups")), "record", "token", "weight")
    rep = s.classes.select("id", "rep")
    named = s.pairs.join(rep.withColumnsRenamed({"id": "x", "rep": "p"}), "x").join(rep.withColumnsRenamed({"id": "y", "rep": "q"}), "y")
    return named.select(F.least("p", "q").alias("dir_a"), F.greatest("p", "q").alias("dir_b"), F.round("percent", 1).alias("percent"), F.col("shared_weight").alias("shared_bytes"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """Each folder with the smallest folder of the same set."""
    s = similar_classes(folder_contents(table(spark, d, "file_groups")), "record", "token", "weight")
    return s.members.join(s.classes.select("id", "rep"), "id").select(F.col("name").alias("dir"), F.col("rep").alias("class_dir"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those among them whose ids don't decode to their text."""
    encode, _, decode = encoder_functions(spark, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    texts = table(spark, d, "documents").select("text")
    back = spread(texts).select(F.coalesce("text", F.lit("")).alias("text"), decode(encode("text")).alias("back"))
    return back.agg(F.count("*").alias("documents"), F.count_if(~F.col("back").eqNullSafe(F.col("text"))).alias("mismatches"))


def _mixture(spark: SparkSession, d: str, keep_source_shares: bool) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.corpus_sizes(table(spark, d, "documents"))
    plan = mixing.mixture_budgets(sizes, table(spark, d, "mix_plans"), keep_source_shares)
    return plan, mixing.draw(sizes, plan)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mixture with their number of uses."""
    return _mixture(spark, d, True)[1]


def p7_mix_filled(spark: SparkSession, d: str) -> DataFrame:
    """As p7_mix, where sources with documents left make up for those without."""
    return _mixture(spark, d, False)[1]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share reached beside the share wanted."""
    return mixing.shares(*_mixture(spark, d, True))


def p7_shares_filled(spark: SparkSession, d: str) -> DataFrame:
    """As p7_shares, where sources with documents left make up for those without."""
    return mixing.shares(*_mixture(spark, d, False))


LEVELS = ("domain", "lang", "source")


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    domains = docs.select("doc_id", mixing.domain(F.col("root_dir")).alias("domain"))
    sizes = mixing.corpus_sizes(docs).join(domains, "doc_id")
    plans = table(spark, d, "mix_plans")
    plan = mixing.tree_budgets(sizes, plans, plans.select("mix_name", F.lit("source").alias("level"), F.col("source").alias("value"), "weight"), LEVELS)
    return plan, mixing.draw(sizes, plan, levels=LEVELS)


def p7_tree(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mixture by a tree of domains (first part of the folder), languages and sources: domains and languages of
    equal weight, sources by the plan; small domains and languages run short, and siblings make up for them before ancestors."""
    return _tree(spark, d)[1]


def p7_tree_shares(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by weight, budget after redistribution and tokens reached of each leaf of the tree."""
    return mixing.tree_shares(*_tree(spark, d), LEVELS)


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with their text restored where it can be."""
    return restore_encoding(table(spark, d, "documents"), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id").distinct()


def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Recall and false alarms on held-out records, by chain."""
    return held_out(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_classes": p1_classes, "p1_forms": p1_forms, "p2_found": p2_found, "p5_found": p5_found, "p5_pairs": p5_pairs,
    "p5_classes": p5_classes, "p5_members": p5_members,
    "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_mix": p7_mix, "p7_mix_filled": p7_mix_filled, "p7_shares": p7_shares, "p7_shares_filled": p7_shares_filled,
    "p7_tree": p7_tree, "p7_tree_shares": p7_tree_shares,
    "p8_found": p8_found, "p8_restored": p8_restored, "p8_held_out": p8_held_out,
}

_SETS = """
WITH g AS (SELECT digest, size, unnest(paths) AS path FROM file_groups WHERE digest IS NOT NULL),
s AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, digest, max(coalesce(size, 0)) AS w FROM g WHERE contains(path, '/') GROUP BY 1, 2),
z AS (SELECT dir, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.dir AS dir_a, b.dir AS dir_b, count(*) AS k, CAST(sum(a.w) AS BIGINT) AS shared_bytes FROM s a JOIN s b ON a.digest = b.digest AND a.dir < b.dir GROUP BY 1, 2),
q AS (SELECT dir_a, dir_b, 200.0::DOUBLE * k / (x.n + y.n) AS percent, shared_bytes FROM p JOIN z x ON x.dir = dir_a JOIN z y ON y.dir = dir_b)
"""

_CLASSES = _SETS + """, t AS (SELECT dir, string_agg(digest, '|' ORDER BY digest) AS t FROM s GROUP BY 1), c AS (SELECT dir, min(dir) OVER (PARTITION BY t) AS class_dir FROM t)
"""

SQL = {
    "p2_found": """
WITH RECURSIVE l AS (
  SELECT dir_a AS a, dir_b AS b FROM sim_pairs WHERE dir_a <> dir_b
  UNION SELECT list_min(dirs), b FROM (SELECT dirs, unnest(dirs) AS b FROM dir_clusters)
    WHERE b IS NOT NULL AND b <> list_min(dirs)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS dir, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.dir WHERE r.root < e.b)
SELECT min(root) AS group_dir, dir FROM (SELECT * FROM r UNION ALL SELECT a, a FROM e) GROUP BY dir""",
    "p5_found": _SETS + "SELECT dir_a, dir_b FROM q WHERE percent >= 75",
    "p5_classes": _CLASSES + """SELECT dir_a, dir_b, round(percent, 1) AS percent, shared_bytes FROM q JOIN c x ON x.dir = dir_a JOIN c y ON y.dir = dir_b
WHERE percent >= 75 AND x.class_dir = dir_a AND y.class_dir = dir_b AND x.class_dir <> y.class_dir""",
    "p5_members": _CLASSES + "SELECT dir, class_dir FROM c",
    "p6_roundtrip": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS mismatches FROM documents",
    "p5_pairs": _SETS + "SELECT dir_a, dir_b, round(percent, 1) AS percent, shared_bytes FROM q WHERE percent >= 75",
}
