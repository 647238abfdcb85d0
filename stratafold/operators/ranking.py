"""Which copy to keep, safe selections, numbering and running totals over all rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions.paths import casefold, is_under, nfc
from stratafold.session import cut


@dataclass(frozen=True)
class KeepRules:
    """``policy``: newest, oldest or lexical. Copies under ``always_keep`` win over those under ``prefer_keep``, these over
    others; then those not under ``prefer_remove``, then with ``internal_first`` those on no external volume."""

    policy: str = "newest"
    always_keep: Sequence[str] = field(default_factory=tuple)
    prefer_keep: Sequence[str] = field(default_factory=tuple)
    prefer_remove: Sequence[str] = field(default_factory=tuple)
    internal_first: bool = False

    def __post_init__(self) -> None:
        if self.policy not in ("newest", "oldest", "lexical"):
            raise ValueError(f"unknown policy: {self.policy}")


def under_any(path: Column, roots: Iterable[str]) -> Column:
    """Whether a path is one of ``roots`` or below one; the list is a setting of a few entries."""
    out = F.lit(False)
    for r in roots:
        out = out | is_under(path, F.lit(r))
    return out


def keep_order(rules: KeepRules, path: Column, mtime: Column) -> list[Column]:
    """The order by which the first copy of a group is kept. Times are compared as doubles; unknown ones come last."""
    tier = F.when(under_any(path, rules.always_keep), 0).when(under_any(path, rules.prefer_keep), 1).otherwise(2)
    keys = [tier.alias("k0"), under_any(path, rules.prefer_remove).alias("k1")]
    if rules.internal_first:
        keys.append(path.startswith("/Volumes/").alias("k2"))
    if rules.policy != "lexical":
        t = F.when(mtime >= 0, mtime).cast("double")
        keys += [t.isNull().alias("k3"), (-t if rules.policy == "newest" else t).alias("k4")]
    return [*keys, casefold(path).alias("k5"), nfc(path).alias("k6"), path.alias("k7")]


# The columns that may hold a copy's time, the first one counts.
TIMES = ("mtime_ns", "modified_ns", "mtime", "btime_ns")


def time_of(rows: DataFrame) -> Column:
    """A copy's time as a double: the first known one of ``TIMES`` among the columns of ``rows``; null if that is negative or no number."""
    known = [F.col(c).cast("double") for c in TIMES if c in rows.columns]
    value = F.coalesce(*known) if known else F.lit(None).cast("double")
    return F.when((value >= 0) & ~F.isnan(value) & (value < float("inf")), value)


def choose_keepers(copies: DataFrame, rules: KeepRules) -> DataFrame:
    """``(class_id, keeper)``: a minimum of structs per group, combined on the map side; no group is collected or sorted."""
    order = F.struct(*keep_order(rules, F.col("path"), F.col("mtime_ns")))
    return copies.groupBy("class_id").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n >= 2").select("class_id", F.col("o.k7").alias("keeper"))


def removals(copies: DataFrame, rules: KeepRules, reference_roots: Sequence[str] = ()) -> DataFrame:
    """``(class_id, path, keeper)``: copies that may go: not the keeper, not always kept, not under a reference root."""
    k = choose_keepers(copies, rules)
    path = F.col("path")
    return copies.join(k, "class_id").where((path != F.col("keeper")) & ~under_any(path, [*rules.always_keep, *reference_roots])).select("class_id", "path", "keeper")


def safe_selection(copies: DataFrame, wanted: Column, prior: Column | None = None) -> DataFrame:
    """``(class_id, path, selected)`` of groups of two or more: the wanted copies and those of an earlier selection (``prior``), which a view that
    hides them doesn't touch; but where that is a whole group its survivor, the oldest of the wanted ones (unknown times
    count as 0, ties go to the first path), is let go."""
    chosen = wanted if prior is None else wanted | F.coalesce(prior, F.lit(False))
    age = F.struct(F.coalesce("mtime_ns", F.lit(0)).alias("t"), "path")
    g = copies.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(chosen).alias("s"), F.min(F.when(wanted, age)).alias("a")).where("n >= 2")
    j = copies.join(g, "class_id")
    return j.select("class_id", "path", F.coalesce(chosen & ~F.coalesce((F.col("s") == F.col("n")) & (F.col("path") == F.col("a.path")), F.lit(False)), F.lit(False)).alias("selected"))


def reclaimable(copies: DataFrame, selected: Column) -> DataFrame:
    """``(class_id, path, selected, reclaimable)``: selected copies free their size in path order, but one copy of a group
    never counts, so of a wholly selected group the last doesn't."""
    g = copies.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(selected).alias("s"), F.max("path").alias("last"))
    j = copies.join(g, "class_id")
    counts = selected & ~((F.col("s") == F.col("n")) & (F.col("path") == F.col("last")))
    return j.select("class_id", "path", F.coalesce(selected, F.lit(False)).alias("selected"), F.when(counts, F.col("size")).otherwise(0).alias("reclaimable"))


def selection_stats(copies: DataFrame, selected: Column) -> DataFrame:
    """One row: selected files, their bytes and the groups touched."""
    s = copies.where(selected)
    return s.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.countDistinct("class_id").alias("groups"))


def running(rows: DataFrame, order: Sequence[Column], value: Column | None = None, name: str = "k") -> DataFrame:
    """``rows`` with the running sum of ``value`` (by default the row number) over all rows in ``order``, without bringing
    them to one task: rows are range-partitioned and sorted, sums of whole ranges, one row each, give the offsets."""
    v = F.lit(1).cast("bigint") if value is None else value
    keyed = rows.select("*", v.alias("__v"), *[o.alias(f"__o{i}") for i, o in enumerate(_plain(order))])
    direction = [F.desc_nulls_last(f"__o{i}") if _descending(o) else F.asc_nulls_first(f"__o{i}") for i, o in enumerate(order)]
    ranged = keyed.repartitionByRange(*direction).sortWithinPartitions(*direction)
    placed = cut(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", 33)
    sums = placed.groupBy(part.alias("__p")).agg(F.sum("__v").alias("s"))
    before = sums.select("__p", (F.sum("s").over(W.orderBy("__p")) - F.col("s")).alias("__before"))
    inner = F.sum("__v").over(W.partitionBy("__p").orderBy("__id"))
    out = placed.withColumn("__p", part).withColumn("__in", inner).join(F.broadcast(before), "__p")
    return out.withColumn(name, (F.col("__before") + F.col("__in")).cast("bigint")).select(*rows.columns, name)


@dataclass(frozen=True)
class Order:
    """A column and its direction."""

    column: Column
    descending: bool = False


def _plain(order: Sequence[Column | Order]) -> list[Column]:
    return [o.column if isinstance(o, Order) else o for o in order]


def _descending(o: Column | Order) -> bool:
    return isinstance(o, Order) and o.descending


def numbered(groups: DataFrame, prefix: str, order: Sequence[Column | Order]) -> DataFrame:
    """``groups`` with ``label``: F1, F2 and so on in order."""
    return running(groups, order).withColumn("label", F.concat(F.lit(prefix), F.col("k").cast("string"))).drop("k")


def bottom_sample(rows: DataFrame, group: str, key: str, k: int = 8) -> DataFrame:
    """The ``k`` rows of each group whose key has the smallest SHA-256: a repeatable sample. Each task keeps at most k
    of a group before the shuffle."""
    w = W.partitionBy(group).orderBy(F.sha2(key, 256), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def relocation_vote(samples: DataFrame, current: DataFrame) -> DataFrame:
    """``(root, candidate, hits, accepted)`` for ``samples(root, rel)``, paths below a moved root, and ``current(candidate, rel)``, what lies
    below each possible new place: how many samples each candidate that has any holds. Accepted is the best if it wins clearly:
    of one sample it has it and no other has; if no other has any, it has two; else three quarters and a lead of two. Samples and
    places meet by an equality join on the path below, not as all combinations."""
    sample = samples.select("root", "rel").distinct()
    sizes = sample.groupBy("root").agg(F.count("*").alias("n"))
    votes = sample.join(current.select("candidate", "rel").distinct(), "rel").groupBy("root", "candidate").agg(F.count("*").alias("hits"))
    w = W.partitionBy("root").orderBy(F.desc("hits"), "candidate")
    ranked = votes.join(sizes, "root").withColumn("r", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("hits").over(w), F.lit(0)))
    n, best, second = F.col("n"), F.col("hits"), F.col("next")
    clear = F.when(n == 1, (best == 1) & (second == 0)).when(second == 0, best >= 2).otherwise((best * 4 >= n * 3) & (best - second >= 2))
    return ranked.select("root", "candidate", "hits", ((F.col("r") == 1) & clear).alias("accepted"))


def busy_time(intervals: DataFrame, group: str) -> DataFrame:
    """``(group, busy, bytes)``: length of the union of ``intervals(group, start, end, bytes)``; ends before their starts and
    nulls count as empty.

    The intervals are range-partitioned by group and start. How far earlier ranges reach, one row a range and group, is known to each
    range; within it a running maximum tells what an interval adds. So a group with most intervals is spread over many tasks."""
    valid = intervals.where("end >= start").select(F.col(group).alias("__g"), "start", "end")
    placed = valid.repartitionByRange("__g", "start", "end").sortWithinPartitions("__g", "start", "end")
    placed = cut(placed.withColumn("id", F.monotonically_increasing_id())).withColumn("part", F.shiftrightunsigned("id", 33))
    reach = placed.groupBy("__g", "part").agg(F.max("end").alias("reach"))
    earlier = F.max("reach").over(W.partitionBy("__g").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = reach.select(F.col("__g").alias("rg"), F.col("part").alias("rp"), earlier.alias("reached"))
    inner = F.max("end").over(W.partitionBy("__g", "part").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    j = placed.withColumn("inner", inner).join(before, F.col("__g").eqNullSafe(F.col("rg")) & (F.col("part") == F.col("rp")))
    covered = F.greatest("start", "inner", "reached")
    busy = j.groupBy("__g").agg(F.sum(F.greatest(F.lit(0), F.col("end") - covered)).alias("busy"))
    sums = intervals.groupBy(group).agg(F.sum("bytes").alias("bytes"))
    return sums.join(busy, F.col(group).eqNullSafe(F.col("__g"))).select(group, "busy", "bytes")
