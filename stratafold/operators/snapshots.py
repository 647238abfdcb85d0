"""Saved scans: differences, recomputation after removals, constraints, relocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions import paths as P

CLASS_PATTERN = r"^(\d+:[0-9a-f]{64}|u:.+)$"
IDENTITY = ["size", "mtime_ns", "ctime_ns", "dev", "ino"]


def refresh_stats(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row: files added, removed, changed and unchanged between two inventories by path; any part of the identity may
    change, null equals null."""
    a = previous.select("path", F.struct(*IDENTITY).alias("a"))
    b = current.select("path", F.struct(*IDENTITY).alias("b"))
    j = a.join(b, "path", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(
        F.count_if(F.col("a").isNull()).alias("added"),
        F.count_if(F.col("b").isNull()).alias("removed"),
        F.count_if(both & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
        F.count_if(both & F.col("a").eqNullSafe(F.col("b"))).alias("unchanged"),
    )


def remaining(files: DataFrame, removed: DataFrame) -> DataFrame:
    """``files`` without the ``removed(path)`` and all that lies under those that are folders. Classes stay as they are: one of a
    single file left keeps its proven digest."""
    direct = files.join(removed.select("path").distinct(), "path", "left_anti")
    up = direct.select("dir").distinct().select("dir", F.explode(P.ancestors(F.col("dir"), include_self=True)).alias("path"))
    gone = up.join(removed.select("path").distinct(), "path", "left_semi").select("dir").distinct()
    return direct.join(gone, "dir", "left_anti")


def violations(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(rule, path)``: every breach of a saved scan's constraints; a valid one has none."""
    path, c = F.col("path"), F.col("class_id")
    rules = [
        ("path is absolute and normal", path.isNull() | ~path.startswith("/") | path.rlike(r"//|/\.{1,2}(/|$)|.+/$")),
        ("name and folder are the path's", ~(F.concat(F.when(F.col("dir") == "/", "").otherwise(F.col("dir")), F.lit("/"), F.col("name"))).eqNullSafe(path)),
        ("class has the right form", c.isNotNull() & ~c.rlike(CLASS_PATTERN)),
        ("class has the file's size", c.rlike(r"^\d{1,18}:") & ~F.try_to_number(F.split(c, ":")[0], F.lit("9" * 18)).cast("bigint").eqNullSafe(F.col("size"))),
        ("size is known and not negative", F.col("size").isNull() | (F.col("size") < 0)),
        ("identity is known", F.col("dev").isNull() | F.col("ino").isNull()),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules]))
    out = files.select(F.explode(broken).alias("rule"), "path")
    twice = files.groupBy("path").count().where("count > 1").select(F.lit("path comes once").alias("rule"), "path")
    parts = [out, twice]
    if roots is not None:
        up = files.select("path", F.explode(P.ancestors(path)).alias("root"))
        inside = up.join(roots.select("root"), "root", "left_semi").select("path").distinct()
        parts.append(files.join(inside, "path", "left_anti").select(F.lit("path is under a root").alias("rule"), "path"))
    return reduce(DataFrame.unionByName, parts)


def seed_rows(previous: DataFrame, moved_roots: DataFrame) -> DataFrame:
    """Digests of a saved scan worth reusing, at their new places: proven classes of the file's own size with change time,
    device and inode; ``moved_roots(old, new)``. Of several rows for one new path the first old one counts."""
    good = previous.where(
        F.col("class_id").rlike(r"^\d{1,18}:[0-9a-f]{64}$")
        & (F.split("class_id", ":")[0] == F.col("size").cast("string"))
        & (F.col("ctime_ns") > 0)
        & (F.col("dev") > 0)
        & (F.col("ino") > 0)
    )
    up = good.select("*", F.explode(P.ancestors(F.col("path"), include_self=True)).alias("old"))
    moved = up.join(moved_roots, "old").groupBy("path").agg(
        F.max_by("new", F.length("old")).alias("new"), F.max_by("old", F.length("old")).alias("old"), F.first("class_id").alias("class_id"), *[F.first(c).alias(c) for c in IDENTITY]
    )
    at = moved.select(P.rebase(F.col("path"), F.col("old"), F.col("new")).alias("path"), F.col("path").alias("from"), F.split("class_id", ":")[1].alias("digest"), *IDENTITY)
    first = at.groupBy("path").agg(F.min(F.struct("from", "digest", *IDENTITY)).alias("r"))
    return first.select("path", "r.digest", *[f"r.{c}" for c in IDENTITY])
