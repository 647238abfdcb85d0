"""The journal of removals as a table of operations with nested items: constraints, bounds, updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.ranking import Order, running

ITEM = (
    "struct<original_path:string,size:bigint,kind:string,status:string,trashed_path:string,restored_path:string,restored_ns:bigint,"
    "digest:string,identity:array<bigint>,error:string>"
)
SCHEMA = f"id string, created_ns bigint, updated_ns bigint, status string, errors array<string>, items array<{ITEM}>"
# What statuses and kinds may be, and the journal's bounds.
OPERATION_STATUSES = ["completed", "partial", "failed", "restored"]
ITEM_STATUSES = ["pending", "trashed", "failed", "restored", "missing", "skipped"]
KINDS = ["file", "directory", "symlink"]
MOST_OPERATIONS = 500
MOST_ITEMS = 50_000
MOST_ITEMS_EACH = 10_000
MOST_ERRORS = 100


def journal_violations(operations: DataFrame) -> DataFrame:
    """``(rule, id)``: every breach of the journal's constraints, once an operation; a valid journal has none."""
    items = F.col("items")
    bad_path = lambda p: p.isNull() | ~p.startswith("/") | p.contains("\0")
    any_item = lambda test: F.exists(items, test)
    unlike = lambda value, allowed: value.isNull() | ~value.isin(allowed)
    restored: Column = lambda x: x["status"] == "restored"
    rules = [
        ("id has the right form", F.col("id").isNull() | ~F.col("id").rlike("^[0-9a-f]{32}$")),
        ("times are positive and in order", F.col("created_ns").isNull() | F.col("updated_ns").isNull() | (F.col("created_ns") <= 0) | (F.col("updated_ns") < F.col("created_ns"))),
        ("operation has a known status", unlike(F.col("status"), OPERATION_STATUSES)),
        ("errors are few", F.col("errors").isNull() | (F.size("errors") > MOST_ERRORS)),
        ("items are there and not too many", items.isNull() | (F.size(items) == 0) | (F.size(items) > MOST_ITEMS_EACH)),
        ("original paths come once", F.size(F.array_distinct(F.transform(items, lambda x: x["original_path"]))) < F.size(items)),
        ("paths are absolute", any_item(lambda x: bad_path(x["original_path"]) | (x["trashed_path"].isNotNull() & bad_path(x["trashed_path"])))),
        ("item has a known status and kind", any_item(lambda x: unlike(x["status"], ITEM_STATUSES) | unlike(x["kind"], KINDS))),
        ("size is known and not negative", any_item(lambda x: x["size"].isNull() | (x["size"] < 0))),
        ("digest has the right form", any_item(lambda x: x["digest"].isNotNull() & ~x["digest"].rlike("^[0-9a-f]{64}$"))),
        ("identity has six parts", any_item(lambda x: x["identity"].isNotNull() & ((F.size(x["identity"]) != 6) | F.exists(x["identity"], lambda v: v.isNull() | (v < 0))))),
        (
            "restored items and only they say where and when",
            any_item(lambda x: F.when(restored(x), x["restored_path"].isNull() | x["restored_ns"].isNull()).otherwise(x["restored_path"].isNotNull() | x["restored_ns"].isNotNull())),
        ),
        ("restored operation has no open items", (F.col("status") == "restored") & any_item(lambda x: ~x["status"].isin("restored", "skipped"))),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules]))
    twice = operations.groupBy("id").count().where("count > 1").select(F.lit("id comes once").alias("rule"), "id")
    return operations.select(F.explode(broken).alias("rule"), "id").unionByName(twice)


def bounded_journal(operations: DataFrame, most: int = MOST_OPERATIONS, items: int = MOST_ITEMS) -> DataFrame:
    """The newest operations within both bounds; the newest one always stays. Bounds are the store's definition."""
    order = [Order(F.col("created_ns"), True), Order(F.col("id"), True)]
    counted = running(operations, order).withColumnRenamed("k", "__place")
    summed = running(counted, order, F.size("items").cast("bigint"), "__items")
    return summed.where((F.col("__place") == 1) | ((F.col("__place") <= most) & (F.col("__items") <= items))).select(*operations.columns)


def update_operations(journal: DataFrame, changes: DataFrame) -> DataFrame:
    """``journal`` with operations replaced by those of ``changes`` of the same id, or added; the latest ``updated_ns`` wins."""
    both = journal.unionByName(changes)
    columns = [c for c in journal.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*columns), "updated_ns").alias("r")).select("id", *[F.col("r")[c].alias(c) for c in columns]).select(*journal.columns)


def auto_restorable(item: Column) -> Column:
    """Whether an item may be restored without asking: its place in the trash is known, and its identity or, for a file, digest."""
    return F.coalesce(item["trashed_path"].isNotNull() & (item["identity"].isNotNull() | ((item["kind"] == "file") & item["digest"].isNotNull())), F.lit(False))


def with_digests(items: DataFrame, classified: DataFrame) -> DataFrame:
    """Journal items (original_path, ...) with the proven digest of their class, where there is one."""
    known = classified.where("class_id IS NOT NULL AND NOT startswith(class_id, 'u:')").select(F.col("path").alias("original_path"), F.split("class_id", ":")[1].alias("digest"))
    rest = [c for c in items.columns if c != "digest"]
    return items.select(*rest).join(known, "original_path", "left").select(*rest, "digest")


def outcome_counts(verdicts: DataFrame, known: list[str]) -> DataFrame:
    """(outcome, items): verdicts by kind; those not known count as error."""
    outcome = reduce(lambda c, v: c.when(F.col("verdict") == v, v), known[1:], F.when(F.col("verdict") == known[0], known[0])).otherwise("error")
    return verdicts.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("items"))
