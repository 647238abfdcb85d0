"""Joins of groups of any size, split so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block: a task pairs two blocks, so at most BLOCK ** 2 rows come from one key.
BLOCK = 256


def expand_pairs(pairs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b, *rest, m, n)``: each row of ``pairs(a, b, ...)`` with every member m of group a and n of group b, and all pairs m < n
    of distinct members where a = b.

    ``members(g, m)`` may hold groups of any size. They are cut into blocks by a hash of the member, in proportion to their counted
    size; pairs of blocks are joined, so that a group with a third of all rows is spread over all tasks. Repeated members count
    once; pairs with a group that has no members give no rows.
    """
    each = members.select("g", "m").distinct()
    sizes = each.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    placed = each.join(sizes, "g").withColumn("p", F.pmod(F.xxhash64("m"), F.col("k")).cast("int")).drop("k")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    wide = pairs.join(sizes.withColumnsRenamed({"g": "a", "k": "ka"}), "a").join(sizes.withColumnsRenamed({"g": "b", "k": "kb"}), "b")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    blocks = wide.select("a", "b", *rest, "kb", upto("ka").alias("pa")).select("a", "b", *rest, "pa", upto("kb").alias("pb"))
    blocks = blocks.where("a <> b OR pa <= pb")
    left = blocks.join(placed.withColumnsRenamed({"g": "a", "m": "m", "p": "pa"}), ["a", "pa"])
    both = left.join(placed.withColumnsRenamed({"g": "b", "m": "n", "p": "pb"}), ["b", "pb"])
    # two blocks of one group are paired once, so either order of their members is wanted; one block with itself gives each pair twice
    return both.where("a <> b OR pa < pb OR m < n").select("a", "b", *rest, "m", "n")
