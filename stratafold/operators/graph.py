"""Connected components by minimum propagation with pointer jumping, over integer vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.session import cut, is_empty, release

#: Pointer jumps between two written tables; each doubles the distance that a label travels.
JUMPS = 3


def number_vertices(names: DataFrame, column: str) -> DataFrame:
    """(id, name) for the distinct non-null values of ``column``: ids ascend with the byte order of the names, so the
    smallest id of a group is the id of its smallest name. Range partitioning keeps this without a global sort."""
    ordered = (
        names.select(F.col(column).alias("name"))
        .where(F.col("name").isNotNull())
        .distinct()
        .repartitionByRange("name")
        .sortWithinPartitions("name")
    )
    return cut(ordered.select(F.monotonically_increasing_id().alias("id"), "name"))


def propagate_minimum(edges: DataFrame) -> DataFrame:
    """Label every vertex with the smallest vertex of its component.

    ``edges(src BIGINT, dst BIGINT)`` holds each edge in both directions, without loops. Returns ``(id, label)`` for each
    vertex that has an edge. Each round hooks every vertex to its smallest neighbour, follows these pointers to
    their ends and contracts the edges, so a chain of n vertices takes O(log n) rounds, not n. The aggregations
    combine on the map side, so a vertex with a third of all edges is no hot spot.
    """
    schema_edges = edges.select("src", "dst")
    rounds: list[DataFrame] = []
    current = schema_edges
    while True:
        parent = cut(
            current.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("label"))
        )
        if is_empty(parent):
            release(parent)
            break
        parent = _follow(parent)
        rounds.append(parent)
        p = parent.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        q = parent.select(F.col("id").alias("src"), F.col("label").alias("a"))
        contracted = cut(
            current.join(q, "src").join(p, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        )
        if current is not schema_edges:
            release(current)
        current = contracted
    if not rounds:
        return schema_edges.select(F.col("src").alias("id"), F.col("dst").alias("label"))
    labels = rounds[0].select("id", "label")
    for later in rounds[1:]:
        step = later.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = labels.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return labels


def _follow(parent: DataFrame) -> DataFrame:
    """Replace each pointer by the end of its path. The last jump of a round marks what still moved, so that the end is seen in
    the written table without another join."""
    while True:
        hops = parent.select("id", "label")
        for jump in range(JUMPS):
            step = hops.select(F.col("id").alias("label"), F.col("label").alias("next"))
            joined = hops.select("id", "label").join(step, "label")
            moved = [(F.col("next") != F.col("label")).alias("moved")] if jump == JUMPS - 1 else []
            hops = joined.select("id", F.col("next").alias("label"), *moved)
        hops = cut(hops)
        release(parent)
        parent = hops
        if is_empty(hops.where("moved")):
            return hops
