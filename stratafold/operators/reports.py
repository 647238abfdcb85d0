"""Report rows of the three result relations with one set of columns, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import report_category
from stratafold.operators.ranking import Order, numbered, reclaimable

COLUMNS = ["record_type", "group", "category", "path", "counterpart", "size_bytes", "copies", "selected", "reclaimable_bytes", "digest", "similarity_percent", "shared_bytes"]


def report_rows(files: DataFrame, folders: DataFrame, pairs: DataFrame, selected: Column) -> DataFrame:
    """Exact files, exact folders and similar folders as one relation. ``files(class_id, path, size)`` holds the copies of
    groups, ``folders(digest, dir, size)`` those of folder groups, ``pairs(dir_a, dir_b, percent, shared_bytes)``. Groups are numbered
    F1, D1, S1 and on by waste or shared bytes, descending, ties by key."""
    null = lambda kind: F.lit(None).cast(kind)

    def exact(copies: DataFrame, kind: str, prefix: str) -> DataFrame:
        g = copies.groupBy("class_id").agg(F.max("size").alias("gsize"), F.count("*").alias("copies")).where("copies >= 2")
        g = g.withColumn("wasted", F.col("gsize") * (F.col("copies") - 1))
        g = numbered(g, prefix, [Order(F.col("wasted"), True), Order(F.col("class_id"))])
        r = reclaimable(copies, selected).join(g, "class_id")
        folder = kind == "exact_directory"
        return r.select(
            F.lit(kind).alias("record_type"),
            F.col("label").alias("group"),
            (F.lit("folder") if folder else report_category(F.col("path"))).alias("category"),
            "path",
            F.lit("").alias("counterpart"),
            F.col("gsize").alias("size_bytes"),
            "copies",
            "selected",
            F.col("reclaimable").cast("bigint").alias("reclaimable_bytes"),
            (F.lit("") if folder else F.split("class_id", ":")[1]).alias("digest"),
            null("double").alias("similarity_percent"),
            null("bigint").alias("shared_bytes"),
        )

    similar = numbered(pairs, "S", [Order(F.col("shared_bytes"), True), Order(F.col("percent"), True), Order(F.col("dir_a"), True), Order(F.col("dir_b"), True)])
    similar = similar.select(
        F.lit("similar_directories").alias("record_type"),
        F.col("label").alias("group"),
        F.lit("folder").alias("category"),
        F.col("dir_a").alias("path"),
        F.col("dir_b").alias("counterpart"),
        null("bigint").alias("size_bytes"),
        F.lit(2).cast("bigint").alias("copies"),
        F.coalesce(selected_pair(selected), F.lit(False)).alias("selected"),
        F.lit(0).cast("bigint").alias("reclaimable_bytes"),
        F.lit("").alias("digest"),
        F.col("percent").alias("similarity_percent"),
        "shared_bytes",
    )
    dirs = folders.select(F.col("digest").alias("class_id"), F.col("dir").alias("path"), "size")
    return exact(files, "exact_file", "F").unionByName(exact(dirs, "exact_directory", "D")).unionByName(similar)


def selected_pair(_: Column) -> Column:
    """Folders of a similar pair are never selected by a rule on file paths."""
    return F.lit(False)


def report_summary(rows: DataFrame) -> DataFrame:
    """``(record_type, groups, items, bytes, potential, selected_items, selected_bytes)``. The potential counts each group's size
    once less than its copies, whatever storage they share."""
    first = rows.groupBy("record_type", "group").agg(
        F.count("*").alias("items"), F.max("size_bytes").alias("size"), F.count_if("selected").alias("chosen"), F.sum("reclaimable_bytes").alias("reclaim")
    )
    size = F.coalesce("size", F.lit(0))
    return first.groupBy("record_type").agg(
        F.count("*").alias("groups"),
        F.sum("items").alias("items"),
        F.sum(size * F.col("items")).alias("bytes"),
        F.sum(size * (F.col("items") - 1)).alias("potential"),
        F.sum("chosen").alias("selected_items"),
        F.sum("reclaim").alias("reclaimable_bytes"),
    )


def category_counters(rows: DataFrame) -> DataFrame:
    """``(category, items, bytes, selected_items, selected_bytes)`` over all exact rows."""
    size = F.coalesce("size_bytes", F.lit(0))
    return rows.where("record_type <> 'similar_directories'").groupBy("category").agg(
        F.count("*").alias("items"), F.sum(size).alias("bytes"), F.count_if("selected").alias("selected_items"), F.sum(F.when(F.col("selected"), size).otherwise(0)).alias("selected_bytes")
    )
