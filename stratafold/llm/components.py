"""Problem 2: one group identifier for all records that are linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.graph import number_vertices, propagate_minimum
from stratafold.session import cut, cut_by, release

#: Peeling ends with a layer that adds less than this part of what was reached: long tails are labelled with the rest.
PEEL_PART = 0.1


def list_links(lists: DataFrame, column: str) -> DataFrame:
    """Links (a, b) that connect all distinct non-null entries of each list: a star around its smallest entry, one link
    an entry, never all pairs. Null and empty lists give none."""
    clean = lists.select(F.array_distinct(F.array_compact(F.col(column))).alias("x"))
    return clean.select(F.array_min("x").alias("a"), F.explode("x").alias("b")).where("a <> b")


def linked_groups(links: DataFrame) -> DataFrame:
    """``(member STRING, group STRING)`` from ``links(a STRING, b STRING)``: ``group`` is the smallest member, in byte
    order, of everything linked directly or indirectly.

    The giant component is peeled by breadth-first frontier joins from the vertex of the highest degree and anti-joined
    away; minimum propagation labels the rest. The edges are written once, hashed by their source, and every frontier join reads
    them in this layout without a shuffle. Where the frontier dries up slowly (long tails), peeling ends early: what was reached
    counts as one vertex and is labelled with the rest, which gives the same groups. All tables but the result are deleted.

    Links with a null end and links of a record with itself connect nothing and are left out; repeated and reversed
    links count once; other columns of ``links`` are ignored; no links give no rows.
    """
    pairs = (
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .where("a < b")
        .distinct()
    )
    pairs = cut(pairs)
    names = number_vertices(pairs.select(F.col("a").alias("v")).union(pairs.select("b")), "v")
    ends = pairs.join(names.select(F.col("name").alias("a"), F.col("id").alias("x")), "a").join(
        names.select(F.col("name").alias("b"), F.col("id").alias("y")), "b"
    )
    one_way = cut(ends.select("x", "y"))
    both = one_way.select(F.col("x").alias("src"), F.col("y").alias("dst")).union(one_way.select("y", "x"))
    edges = cut_by(both, "src", 2 * one_way.count())
    release(pairs, one_way)

    hub = edges.groupBy("src").count().orderBy(F.desc("count"), "src").head(1)
    if not hub:
        return names.select(F.col("name").alias("member"), F.col("name").alias("group"))
    layers = _peel(edges, hub[0]["src"])
    reached = layers[0]
    for layer in layers[1:]:
        reached = reached.union(layer)
    lowest = reached.agg(F.min("id")).head()[0]
    # only the last layer has neighbours that weren't reached; edges to it lead to the vertex that stands for the giant component
    edge = layers[-1].select(F.col("id").alias("dst"), F.lit(lowest).alias("giant"))
    outside = edges.join(reached.withColumnRenamed("id", "src"), "src", "left_anti").join(edge, "dst", "left")
    outside = cut(outside.select("src", F.coalesce("giant", "dst").alias("dst"), F.col("giant").isNotNull().alias("back")))
    rest = outside.select("src", "dst").union(outside.where("back").select("dst", "src")).distinct()
    labels = propagate_minimum(rest)
    giant = labels.where(F.col("id") == lowest).select("label").head(1)
    top = giant[0]["label"] if giant else lowest
    labels = labels.where(F.col("id") != lowest).unionByName(reached.select("id", F.lit(top).alias("label")))
    named = labels.join(names.withColumnRenamed("name", "member"), "id").join(names.select(F.col("id").alias("label"), F.col("name").alias("group")), "label")
    out = cut(named.select("member", "group"))
    release(edges, outside, names, *layers)
    return out


def _peel(edges: DataFrame, hub: int) -> list[DataFrame]:
    """The layers of vertices that breadth-first rounds from ``hub`` reach."""
    before = frontier = edges.sparkSession.range(hub, hub + 1)
    layers, reached = [frontier], 1
    while True:
        step = edges.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        # neighbours of a layer lie in it, in the one before and in the next
        after = cut(step.join(before.union(frontier), "id", "left_anti"))
        found = after.count()
        layers.append(after)
        if found < PEEL_PART * reached:
            return layers
        reached += found
        before, frontier = frontier, after
