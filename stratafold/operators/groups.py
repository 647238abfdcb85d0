"""Groups of equal files and their sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import category, problem_title


def duplicate_groups(files: DataFrame) -> DataFrame:
    """``(class_id, size, copies, wasted)`` of classes with two files or more: all copies but one are waste."""
    g = files.groupBy("class_id").agg(F.max("size").alias("size"), F.count("*").alias("copies"))
    return g.where("copies >= 2").withColumn("wasted", F.col("size") * (F.col("copies") - 1))


def storage_families(files: DataFrame) -> DataFrame:
    """``(class_id, size, copies, families, freeable, wasted)``: copies that share their storage are one family, and
    free their blocks once. A file of unknown storage is its own family; unknown allocation counts as the size, and
    no file frees more than its size."""
    known = F.col("storage_dev").isNotNull() & F.col("storage_off").isNotNull()
    family = F.when(known, F.concat_ws(":", F.lit("s"), F.col("storage_dev"), F.col("storage_off"))).otherwise(F.concat(F.lit("p:"), F.col("path")))
    held = F.least(F.coalesce("alloc", "size"), "size")
    each = files.groupBy("class_id", family.alias("family")).agg(F.max(held).alias("a"), F.count("*").alias("n"), F.max("size").alias("size"))
    g = each.groupBy("class_id").agg(F.max("size").alias("size"), F.sum("n").alias("copies"), F.count("*").alias("families"), F.sum("a").alias("s"), F.min("a").alias("m"))
    freeable = F.when(F.col("families") > 1, F.col("s") - F.col("m")).otherwise(0)
    out = g.where("copies >= 2").select("class_id", "size", "copies", "families", freeable.cast("bigint").alias("freeable"))
    return out.withColumn("wasted", group_waste(F.col("size"), F.col("copies"), F.col("families"), F.col("freeable")))


def group_waste(size: Column, copies: Column, families: Column, freeable: Column) -> Column:
    """Waste of a group: what it frees if that was computed, else the size of all families but one; unknown families (null
    or 0) count each copy."""
    n = F.when(families.isNull() | (families == 0), copies).otherwise(families)
    return F.when(freeable >= 0, freeable).otherwise(size * (F.greatest(F.lit(1), n) - 1))


def category_summary(files: DataFrame) -> DataFrame:
    """(category, files, bytes)."""
    return files.groupBy(category(F.col("path")).alias("category")).agg(F.count("*").alias("files"), F.sum(F.greatest(F.lit(0), F.coalesce("size", F.lit(0)))).alias("bytes"))


def batch_summary(entries: DataFrame) -> DataFrame:
    """One row over well-formed entries (size >= 0, group known): counts, bytes and groups, in all and of those that are ready."""
    good = entries.where("size >= 0 AND group_id IS NOT NULL")
    ready = F.col("status") == "ready"
    return good.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.countDistinct("group_id").alias("groups"),
        F.count_if(ready).alias("ready_items"),
        F.coalesce(F.sum(F.when(ready, F.col("size"))), F.lit(0)).alias("ready_bytes"),
        F.countDistinct(F.when(ready, F.col("group_id"))).alias("ready_groups"),
    )


def skipped_by_status(entries: DataFrame, known: list[str]) -> DataFrame:
    """(status, items) of the entries that aren't ready; malformed entries and other statuses count as unknown."""
    good = F.col("size").isNotNull() & (F.col("size") >= 0) & F.col("group_id").isNotNull()
    status = F.when(good & F.col("status").isin(known), F.col("status")).otherwise("unknown")
    return entries.select(F.coalesce(status, F.lit("unknown")).alias("status")).where("status <> 'ready'").groupBy("status").agg(F.count("*").alias("items"))


def problem_summary(messages: DataFrame, column: str) -> DataFrame:
    """(title, problems): messages by kind; most frequent first, then by title."""
    titled = messages.where(F.col(column).isNotNull()).groupBy(problem_title(F.col(column)).alias("title")).agg(F.count("*").alias("problems"))
    return titled.orderBy(F.desc("problems"), "title")


def problem_caption(shown: Column, total: Column) -> Column:
    """What a list says that shows fewer problems than there are; null if it shows all. Thousands are parted by commas."""
    return F.when(total > shown, F.concat(F.lit("Показано "), F.format_number(shown, 0), F.lit(" із "), F.format_number(total, 0)))


def independent_copies(files: DataFrame) -> DataFrame:
    """(class_id, copies, inodes) of classes with two different inodes or more."""
    g = files.groupBy("class_id").agg(F.count("*").alias("copies"), F.countDistinct("dev", "ino").alias("inodes"))
    return g.where("inodes >= 2")
