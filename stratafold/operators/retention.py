"""What bounded stores keep: by number, by bytes, by age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.ranking import Order, running

# Bounds of the digest store, in rows and nanoseconds.
CACHE_ROWS = 1_000_000
STALE_NS = 180 * 86_400 * 10**9
TOUCH_NS = 7 * 86_400 * 10**9


def keep_newest(rows: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows; of equal times the greater key is newer. A bounded store's definition, not a cap on work."""
    return running(rows, [Order(F.col(time), True), Order(F.col(key), True)]).where(F.col("k") <= n).drop("k")


def keep_within(rows: DataFrame, time: str, key: str, size: str, budget: int, protected: str) -> DataFrame:
    """``rows`` with ``kept``: the oldest unprotected rows go until the rest fits the budget; protected rows never go, so a
    store may stay above it."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"))
    free = running(rows.where(~F.col(protected)), [F.col(time), F.col(key)], F.col(size), "upto")
    # a row goes while what is left without all older ones is above the budget
    marked = free.crossJoin(F.broadcast(total)).withColumn("kept", F.col("total") - (F.col("upto") - F.col(size)) <= budget)
    return marked.select(*rows.columns, "kept").unionByName(rows.where(F.col(protected)).select("*", F.lit(True).alias("kept")))


def stale(rows: DataFrame, now_ns: int) -> DataFrame:
    """Rows without use time, change time, device or inode, or unused for longer than ``STALE_NS``."""
    missing = F.lit(False)
    for c in ("accessed_ns", "ctime_ns", "dev", "ino"):
        missing = missing | F.coalesce(F.col(c) == 0, F.lit(True))
    return rows.where(missing | (F.col("accessed_ns") < now_ns - STALE_NS))


def touched(rows: DataFrame, used: DataFrame, now_ns: int) -> DataFrame:
    """``rows`` with the use time of the keys in ``used(path, kind)`` set to now, where it is older than ``TOUCH_NS``."""
    u = used.select("path", "kind").distinct().withColumn("u", F.lit(True))
    at = F.when(F.col("u") & (F.col("accessed_ns") < now_ns - TOUCH_NS), F.lit(now_ns)).otherwise(F.col("accessed_ns"))
    return rows.join(u, ["path", "kind"], "left").withColumn("accessed_ns", at).select(*rows.columns)


def bounded_log(lines: DataFrame, order: str, text: str, budget: int, entry: int) -> DataFrame:
    """Lines in order while they fit the budget of bytes; one longer than ``entry`` bytes becomes a marker."""
    size = F.octet_length(text)
    short = lines.withColumn(text, F.when(size > entry, F.lit("<oversized-text-omitted>")).otherwise(F.col(text)))
    return running(short, [F.col(order)], F.coalesce(F.octet_length(text) + 1, F.lit(0)).cast("bigint"), "upto").where(F.col("upto") <= budget).drop("upto")


def legacy_cut(scans: DataFrame, now_ns: int, days: int, preserved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the scans to delete, one row (removed, freed_bytes, store_bytes)) of ``scans(path, created_ns, size, legacy)``: those of the legacy form that
    are older than ``days``. The newest scan and ``preserved(path)`` stay; nothing is deleted here, ``store_bytes`` is what would be left."""
    newest = scans.agg(F.max(F.struct("created_ns", "path")).alias("n")).select(F.col("n.path").alias("path"))
    old = scans.where(F.col("legacy") & (F.col("created_ns") < now_ns - days * 86_400 * 10**9)).join(newest, "path", "left_anti")
    if preserved is not None:
        old = old.join(preserved.select("path"), "path", "left_anti")
    marked = scans.join(old.select("path", F.lit(True).alias("gone")), "path", "left")
    size = lambda gone: F.coalesce(F.sum(F.when(F.col("gone").isNotNull() if gone else F.col("gone").isNull(), F.col("size"))), F.lit(0))
    return old, marked.agg(F.count("gone").alias("removed"), size(True).alias("freed_bytes"), size(False).alias("store_bytes"))
