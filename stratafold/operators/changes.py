"""Problem 3: typed changes between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each combination of ``keys``: that with the greatest ``order`` columns (nulls lowest; of full ties
    the greatest ``values``). A maximum of structs combines on the map side, so a key delivered very often is no hot
    spot; identical rows count once."""
    best = F.max(F.struct(*order, *[v for v in values if v not in order]))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col("__best")[v].alias(v) for v in values])


#: Rows looked at for keys delivered very often, and the part of them that makes a key one of these: at most 1 / OFTEN keys.
LOOK, OFTEN = 100_000, 0.01


def _combined(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with the readings of very frequent keys combined on the map side, others as they are. Such keys are told by a bounded
    sample; whether a key is taken for one changes the plan, never the result."""
    total = rows.count()
    seen = rows.select(keys[0]).sample(min(1.0, LOOK / max(1, total)), 7).groupBy(keys[0]).count()
    hot = [r[0] for r in seen.where(F.col("count") >= max(2.0, OFTEN * min(total, LOOK))).limit(int(2 / OFTEN)).collect()]
    if not hot:
        return rows
    often = F.coalesce(F.col(keys[0]).isin(hot), F.lit(False))
    return rows.where(~often).unionByName(latest_rows(rows.where(often), keys, order, values).select(rows.columns))


def snapshot_changes(
    rows: DataFrame,
    key: str,
    snapshot: str,
    compare: Sequence[str],
    order: Sequence[str],
    first: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """``(snapshot, key, change_kind)``: what each of the snapshots ``first + 1`` to ``last`` (by default all after the least one of the
    table) adds, removes or changes against the one before it.

    One exchange by ranges of the key and one sort by key, snapshot and ``order`` make every range a stream in which all readings of
    a key stand side by side. Two passes of the window operator over that stream, in constant memory and without another exchange
    or sort, merge it: the first keeps the last reading of each snapshot, the second compares a row with those before and after it. A key
    that is delivered very often is combined on the map side before, so no range gets all its rows.

    Of several readings of a key in one snapshot the one with the greatest ``order`` counts (then the greatest compared
    values). Null equals null in ``compare``. Rows without key or snapshot number are no records. A key absent from
    a snapshot and back later is removed and then added. Other columns are ignored; an empty table gives no rows; a
    whole missing snapshot counts as an empty one.
    """
    if first is None or last is None:
        least, most = rows.agg(F.min(snapshot), F.max(snapshot)).head()
        first, last = least if first is None else first, most if last is None else last
    known = rows.where(F.col(key).isNotNull() & F.col(snapshot).between(first, last)).select(*dict.fromkeys([key, snapshot, *order, *compare]))
    placed = _combined(known, [key, snapshot], list(order), list(dict.fromkeys([*order, *compare]))).repartitionByRange(key)
    readings = W.partitionBy(key).orderBy(snapshot, *order, *[c for c in compare if c not in order])
    newest = placed.withColumn("__next", F.lead(snapshot).over(readings)).where(~F.col("__next").eqNullSafe(F.col(snapshot)))
    w = W.partitionBy(key).orderBy(snapshot)
    state = F.struct(*compare)
    merged = newest.select(
        key,
        F.col(snapshot).alias("__n"),
        state.alias("__now"),
        F.lag(snapshot).over(w).alias("__before_n"),
        F.lag(state).over(w).alias("__before"),
        F.lead(snapshot).over(w).alias("__after_n"),
    )
    n = F.col("__n")
    followed = F.col("__before_n").eqNullSafe(n - 1)
    arrival: Column = F.when(n == first, None).when(~followed, "added").when(~_same(compare), "changed")
    departure: Column = F.when((n < last) & ~F.col("__after_n").eqNullSafe(n + 1), "removed")
    events = F.array(
        F.struct(n.alias("n"), arrival.alias("kind")),
        F.struct((n + 1).cast(rows.schema[snapshot].dataType).alias("n"), departure.alias("kind")),
    )
    return (
        merged.select(key, F.explode(events).alias("e"))
        .where("e.kind IS NOT NULL")
        .select(F.col("e.n").alias(snapshot), key, F.col("e.kind").alias("change_kind"))
    )


def keep_snapshot(rows: DataFrame, key: str, compare: Sequence[str], order: Sequence[str], name: str, path: str, parts: int = 200) -> DataFrame:
    """Write one snapshot as the table ``name`` at ``path`` in the layout that :func:`kept_changes` reads: one row a key, the newest, in
    ``parts`` buckets of the key, each one file sorted by key. Spark plans no joins on ranges, so buckets stand in for them; all snapshots
    that are compared need the same ``parts``."""
    one = latest_rows(rows.where(F.col(key).isNotNull()), [key], order, compare)
    sorted_rows = one.repartition(parts, key).sortWithinPartitions(key)
    sorted_rows.write.format("parquet").bucketBy(parts, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def kept_changes(before: DataFrame, after: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """``(key, change_kind)`` between two tables of :func:`keep_snapshot`: a full outer merge join that reads the kept layout, so
    neither side is shuffled."""
    a = before.select(F.col(key).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in compare])
    b = after.select(F.col(key).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in compare])
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(differs, "changed")
    joined = a.hint("merge").join(b, F.col("__a") == F.col("__b"), "full_outer")
    return joined.select(F.coalesce("__a", "__b").alias(key), kind.alias("change_kind")).where("change_kind IS NOT NULL")


def _same(compare: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in compare:
        same = same & F.col("__now")[c].eqNullSafe(F.col("__before")[c])
    return same
