"""Problem 4: the middle entry of every key, although a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.session import cut, is_empty

#: Most rows of a key whose state is the set of its entries (16 bytes each); keys with more have counts as their state.
DIRECT = 4096
#: Bits of the ordering value that one narrowing step decides.
STEP_BITS = 12
#: Most keys (of 8 to 32 bytes) in a broadcast table; larger ones are joined by a shuffle.
LIGHT = 500_000


def middle_entries(rows: DataFrame, key: str, order: str, ident: str, direct: int | None = None) -> DataFrame:
    """``(key, ident)``: for each ``key`` with n >= 2 distinct entries, entry number (n + 1) div 2 by (``order``, ``ident``).

    Every key has a mergeable state that each task builds in a hash table which spills, and only these states are shuffled:

    * rows per key, to tell the frequent keys (more than ``direct`` rows);
    * for the other keys the set of their entries, bounded by ``direct``, in which repeated rows vanish already on the map side; its
      middle is read off the sorted set;
    * for frequent keys counts by (key, leading bits of the order): the running count over a key's buckets finds the bucket with
      the middle entry, just its entries are looked at again with the next bits, and after ``order`` the bits of ``ident``,
      until ``direct`` entries are left. A key with a third of all rows, or with a single order value, takes some steps more,
      not one long task. Counts don't tell repeated rows, so the rows of these keys are made distinct once before: the only
      raw rows that are shuffled.

    ``order`` and ``ident`` are BIGINT. Rows in which ``key``, ``order`` or ``ident`` is null are no entries. Repeated
    rows count once. Keys with a single entry have no row; an empty table gives none; other columns are ignored. The result
    doesn't depend on ``direct`` (by default ``DIRECT``).
    """
    bound = DIRECT if direct is None else direct
    given = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(ident).alias("i")).where("k IS NOT NULL AND o IS NOT NULL AND i IS NOT NULL")
    heavy = cut(given.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > bound).select("k"))
    hint = _light(heavy)
    others = given.join(hint(heavy), "k", "left_anti").groupBy("k").agg(F.array_sort(F.collect_set(F.struct("o", "i"))).alias("s")).where(F.size("s") >= 2)
    done = [others.select("k", F.element_at("s", F.expr("(size(s) + 1) div 2").cast("int"))["i"].alias("i"))]
    if not is_empty(heavy):
        done += _narrow(cut(given.join(hint(heavy), "k", "left_semi").distinct()), bound)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("k").alias(key), F.col("i").alias(ident))


def _narrow(held: DataFrame, bound: int) -> list[DataFrame]:
    """The middle entries of the keys of ``held(k, o, i)``, whose rows are distinct."""
    targets = held.groupBy("k").agg(F.count("*").alias("left")).where("left >= 2")
    targets = cut(targets.select("k", F.expr("(left + 1) div 2").alias("rank"), "left"))
    done: list[DataFrame] = []
    for column, shift in [*(("o", s) for s in _shifts()), *(("i", s) for s in _shifts())]:
        done.append(_rank(held, targets.where(F.col("left") <= bound)))
        large = targets.where(F.col("left") > bound)
        hint = _light(large)
        if is_empty(large):
            return done
        bucket = F.shiftright(column, shift).alias("b")
        counted = held.join(hint(large.select("k")), "k", "left_semi").groupBy("k", bucket).agg(F.count("*").alias("n"))
        hit = (
            counted.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("b")))
            .join(hint(large.select("k", "rank")), "k")
            .where("rank > upto - n AND rank <= upto")
            .select("k", "b", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("n").alias("left"))
        )
        found = cut(hit)
        held = cut(held.withColumn("b", bucket).join(hint(found.select("k", "b")), ["k", "b"], "left_semi").select("k", "o", "i"))
        targets = found.select("k", "rank", "left")
    return [*done, _rank(held, targets)]


def _light(keys: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The broadcast hint if ``keys`` has at most ``LIGHT`` rows, counted here; else none, and the join is shuffled."""
    few = keys.limit(LIGHT + 1).count() <= LIGHT
    return F.broadcast if few else lambda df: df


def _shifts() -> list[int]:
    return [*range(63 - STEP_BITS, 0, -STEP_BITS), 0]


def _rank(held: DataFrame, small: DataFrame) -> DataFrame:
    """The entry of the wanted rank of each key in ``small``, of which a bounded number of entries is held."""
    w = W.partitionBy("k").orderBy("o", "i")
    mine = held.join(_light(small)(small.select("k", "rank")), "k")
    return mine.withColumn("r", F.row_number().over(w)).where("r = rank").select("k", "i")
