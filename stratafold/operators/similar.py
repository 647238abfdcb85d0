"""Folders that share content: scored pairs, comparisons, differences and merge plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions.paths import ancestors, is_under, relative
from stratafold.operators.ranking import running
from stratafold.operators.tree import dirs_under, files_under
from stratafold.session import cut, is_empty, release

# Folders of one class that are paired at most, pairs kept, evidence rows of a pair.
FANOUT = 64
PAIRS = 400
EVIDENCE = 60
#: Pairs up to which scoring all is cheaper than bounding them first; results don't depend on it.
FEW = 500_000
#: Folders of most duplicate bytes among which the best pairs are looked for first, rows that are broadcast at most, steps that one
#: mask holds; results don't depend on them.
FIRST, SENT, STEPS = 1024, 50_000, 63
#: Folders of a block, the pairs of two of which one task scores; folders whose names are broadcast at most.
BLOCK, NAMED = 8_000, 500_000


def sampled_folders(dup: DataFrame, fanout: int | None = FANOUT) -> DataFrame:
    """(class_id, dir): the distinct folders of every class in two folders or more; of more than ``fanout``, as many
    at even steps of their order, which is the bound of the result's definition; None for all of them. Places come from one running number
    over all classes, so a class in very many folders is ranked by many tasks."""
    each = dup.select("class_id", "dir").distinct()
    counts = each.groupBy("class_id").agg(F.count("*").alias("n")).where("n >= 2")
    placed = each.join(counts, "class_id")
    if fanout is None:
        return placed.select("class_id", "dir")
    small = placed.where(F.col("n") <= fanout).select("class_id", "dir")
    ranked = cut(running(placed.where(F.col("n") > fanout), [F.col("class_id"), F.col("dir")]))
    first = ranked.groupBy("class_id").agg(F.min("k").alias("first"))
    large = ranked.join(first, "class_id").withColumn("k", F.col("k") - F.col("first"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (fanout - 1)))
    return small.unionByName(large.where(F.array_contains(steps, F.col("k"))).select("class_id", "dir"))


def candidate_pairs(dup: DataFrame, digests: DataFrame, ignored: DataFrame | None = None, sampled: bool = True) -> DataFrame:
    """(dir_a, dir_b): folders that share a class, and their ancestors at equal steps above them until these meet, without
    pairs one of which holds the other, ignored pairs and folders with equal trees. With ``sampled`` only
    :func:`sampled_folders` count, so pairs that share nothing but classes in more than ``FANOUT`` folders can be missed;
    without, all pairs come out, whose number grows with the square of the folders of a class."""
    s = sampled_folders(dup, FANOUT if sampled else None)
    a, b = s.withColumnRenamed("dir", "a"), s.withColumnRenamed("dir", "b")
    base = a.join(b, "class_id").where("a < b").select("a", "b").distinct()
    up = lambda c: F.reverse(ancestors(F.col(c), include_self=True))
    steps = base.select(F.explode(F.arrays_zip(up("a").alias("a"), up("b").alias("b"))).alias("z")).select("z.a", "z.b")
    steps = steps.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = steps.select(F.least("a", "b").alias("dir_a"), F.greatest("a", "b").alias("dir_b")).distinct()
    pairs = pairs.where(~is_under(F.col("dir_a"), F.col("dir_b")) & ~is_under(F.col("dir_b"), F.col("dir_a")))
    if ignored is not None:
        pairs = without_ignored(pairs, ignored)
    known = digests.where("digest IS NOT NULL")
    marked = pairs.join(known.select(F.col("dir").alias("dir_a"), F.col("digest").alias("da")), "dir_a", "left").join(
        known.select(F.col("dir").alias("dir_b"), F.col("digest").alias("db")), "dir_b", "left"
    )
    return marked.where("da IS NULL OR db IS NULL OR da <> db").select("dir_a", "dir_b")


def without_ignored(pairs: DataFrame, ignored: DataFrame) -> DataFrame:
    """``pairs(dir_a, dir_b)`` without those of ``ignored(dir_a, dir_b)``, whichever way round either stands."""
    key = lambda df: df.select(F.least("dir_a", "dir_b").alias("lo"), F.greatest("dir_a", "dir_b").alias("hi"))
    marked = pairs.withColumn("lo", F.least("dir_a", "dir_b")).withColumn("hi", F.greatest("dir_a", "dir_b"))
    return marked.join(key(ignored).distinct(), ["lo", "hi"], "left_anti").select(*pairs.columns)


def class_counts(dup: DataFrame) -> DataFrame:
    """(dir, class_id, size, n): files of each class below each folder."""
    per = dup.groupBy("dir", "class_id").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    up = per.select(F.explode(ancestors(F.col("dir"), include_self=True)).alias("dir"), "class_id", "n", "size")
    return up.groupBy("dir", "class_id").agg(F.sum("n").alias("n"), F.max("size").alias("size"))


def score_pairs(pairs: DataFrame, counts: DataFrame, sums: DataFrame) -> DataFrame:
    """(dir_a, dir_b, percent, shared_bytes, shared_total): bytes of the common multiset of classes, twice, against the
    bytes of both folders. Pairs that share no bytes are left out. ``shared_total`` is the number of common classes."""
    l = counts.select(F.col("dir").alias("dir_a"), "class_id", "size", F.col("n").alias("na"))
    r = counts.select(F.col("dir").alias("dir_b"), "class_id", F.col("n").alias("nb"))
    common = pairs.join(l, "dir_a").join(r, ["dir_b", "class_id"])
    shared = common.groupBy("dir_a", "dir_b").agg(F.sum(F.col("size") * F.least("na", "nb")).alias("shared_bytes"), F.count("*").alias("shared_total"))
    sized = shared.join(sums.select(F.col("dir").alias("dir_a"), F.col("bytes").alias("ta")), "dir_a").join(
        sums.select(F.col("dir").alias("dir_b"), F.col("bytes").alias("tb")), "dir_b"
    )
    percent = F.round(200 * F.col("shared_bytes") / (F.col("ta") + F.col("tb")), 1)
    return sized.where("shared_bytes > 0 AND ta + tb > 0").select("dir_a", "dir_b", percent.alias("percent"), "shared_bytes", "shared_total")


def top_pairs(scored: DataFrame, k: int = PAIRS) -> DataFrame:
    """The first ``k`` pairs by shared bytes, percent and names, all descending: a top-k report."""
    return scored.orderBy(F.desc("shared_bytes"), F.desc("percent"), F.desc("dir_a"), F.desc("dir_b")).limit(k)


def best_pairs(pairs: DataFrame, counts: DataFrame, sums: DataFrame, k: int = PAIRS, few: int = FEW) -> DataFrame:
    """:func:`top_pairs` of :func:`score_pairs`, without scoring all pairs where there are more than ``few``. A pair shares no more than the smaller of both folders'
    duplicate bytes. The ``k`` pairs of the greatest bounds are scored first; their least shared bytes are reached by k pairs, so
    only pairs whose bound reaches them too can be among the first ``k``."""
    pairs = cut(pairs)
    if pairs.count() <= few:
        return top_pairs(score_pairs(pairs, counts, sums), k)
    held = counts.groupBy("dir").agg(F.sum(F.col("size") * F.col("n")).alias("held"))
    bounded = pairs.join(held.select(F.col("dir").alias("dir_a"), F.col("held").alias("ha")), "dir_a").join(held.select(F.col("dir").alias("dir_b"), F.col("held").alias("hb")), "dir_b")
    bounded = cut(bounded.select("dir_a", "dir_b", F.least("ha", "hb").alias("bound")))
    first = score_pairs(bounded.orderBy(F.desc("bound"), "dir_a", "dir_b").limit(k).select("dir_a", "dir_b"), counts, sums)
    n, least = first.agg(F.count("*"), F.min("shared_bytes")).head()
    rest = bounded.where(F.col("bound") >= (least if n >= k else 1))
    return top_pairs(score_pairs(rest.select("dir_a", "dir_b"), counts, sums), k)


def class_entries(dup: DataFrame, fanout: int | None = FANOUT) -> DataFrame:
    """(class_id, dir, n, size, direct): files of each class in each folder that holds some itself, for classes in two folders or
    more. ``direct`` tells the folders of :func:`sampled_folders`, all of them with ``fanout`` None."""
    per = cut(dup.groupBy("class_id", "dir").agg(F.count("*").alias("n"), F.max("size").alias("size")))
    counts = per.groupBy("class_id").agg(F.count("*").alias("m")).where("m >= 2")
    rows = cut(per.join(counts, "class_id"))
    release(per)
    plain = ["class_id", "dir", "n", "size"]
    if fanout is None:
        return rows.select(*plain, F.lit(True).alias("direct"))
    large = rows.where(F.col("m") > fanout)
    if is_empty(large):
        return rows.select(*plain, F.lit(True).alias("direct"))
    picked = sampled_folders(large, fanout).withColumn("direct", F.lit(True))
    marked = large.join(picked, ["class_id", "dir"], "left").select(*plain, F.coalesce("direct", F.lit(False)).alias("direct"))
    return cut(rows.where(F.col("m") <= fanout).select(*plain, F.lit(True).alias("direct")).unionByName(marked))


def held_bytes(entries: DataFrame) -> DataFrame:
    """(dir, held): bytes of the files of :func:`class_entries` below each folder, which no pair of the folder shares more of."""
    per = entries.groupBy("dir").agg(F.sum(F.col("size") * F.col("n")).alias("s"))
    return per.select(F.explode(ancestors(F.col("dir"), include_self=True)).alias("dir"), "s").groupBy("dir").agg(F.sum("s").alias("held"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` broadcast if its counted ``rows`` are few."""
    return F.broadcast(df) if rows <= SENT else df


def class_steps(entries: DataFrame, ids: DataFrame, rows: int) -> tuple[DataFrame, list[str]]:
    """(class_id, id, n, size, *masks): files of each class below each of the ``rows`` folders of ``ids(id, dir)``, and a bit for every
    number of steps that a folder with ``direct`` lies below it; the names of the masks."""
    deepest = entries.agg(F.max(F.size(ancestors(F.col("dir"), include_self=True)))).head()[0] or 0
    names = [f"m{w}" for w in range(deepest // STEPS + 1)]
    up = entries.select("class_id", "n", "size", "direct", F.posexplode(F.reverse(ancestors(F.col("dir"), include_self=True))).alias("step", "dir"))
    bit = lambda w: F.when(F.col("direct") & (F.expr(f"step div {STEPS}") == w), F.expr(f"shiftleft(1L, cast(step % {STEPS} AS int))")).otherwise(F.lit(0).cast("bigint"))
    masks = [F.bit_or(bit(w)).alias(name) for w, name in enumerate(names)]
    up = up.join(_sent(ids.select("id", "dir"), rows), "dir")
    return up.groupBy("class_id", "id").agg(F.sum("n").alias("n"), F.max("size").alias("size"), *masks), names


def _both(masks: list[str], l: str, r: str) -> Column:
    """Whether folders with the class lie as many steps below either folder."""
    out = F.lit(False)
    for m in masks:
        out = out | (F.col(f"{l}.{m}").bitwiseAND(F.col(f"{r}.{m}")) != 0)
    return out


def _overlaps(found: DataFrame, masks: list[str]) -> DataFrame:
    """(a, b, shared_bytes, shared_total): all pairs of the folders of :func:`class_steps`, numbered in their order, that share bytes and are
    :func:`candidate_pairs` or hold one another. Two folders come from a pair of folders with a common class exactly if some
    class is ``direct`` equally many steps below both. Members of a class are joined by class and each task sums by
    pair, so that only pairs of different folders, not of files, are shuffled."""
    pair = found.alias("l").join(found.alias("r"), F.expr("l.class_id = r.class_id AND l.id < r.id"))
    one = pair.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), (F.col("l.size") * F.least("l.n", "r.n")).alias("s"), _both(masks, "l", "r").alias("near"))
    return one.groupBy("a", "b").agg(F.sum("s").alias("shared_bytes"), F.count("*").alias("shared_total"), F.bool_or("near").alias("near")).where("near AND shared_bytes > 0").drop("near")


def _named(pairs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """``pairs(a, b, shared_bytes, shared_total)`` of the ``rows`` folders ``ids(id, dir, files, bytes, classes)`` with names and percent,
    without pairs one of which holds the other. ``alike`` tells those whose trees may be equal: as many files, and all classes common."""
    side = lambda x: _sent(ids.select(F.col("id").alias(x), F.col("dir").alias(f"dir_{x}"), F.col("files").alias(f"f{x}"), F.col("bytes").alias(f"t{x}"), F.col("classes").alias(f"c{x}")), rows)
    j = pairs.join(side("a"), "a").join(side("b"), "b").where(~is_under(F.col("dir_b"), F.col("dir_a")))
    percent = F.round(200 * F.col("shared_bytes") / (F.col("ta") + F.col("tb")), 1)
    return j.select("dir_a", "dir_b", percent.alias("percent"), "shared_bytes", "shared_total", F.expr("fa = fb AND ca = shared_total AND cb = shared_total").alias("alike"))


def _without_equal_trees(scored: DataFrame, digests: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``scored(dir_a, dir_b, ..., alike)`` without folders with equal trees: only the folders of pairs ``alike`` need a digest."""
    scored = cut(scored)
    same = scored.where("alike").select("dir_a", "dir_b")
    if is_empty(same):
        return scored.drop("alike")
    known = cut(digests(cut(same.select(F.col("dir_a").alias("dir")).union(same.select("dir_b")).distinct())).where("digest IS NOT NULL"))
    side = lambda x: known.select(F.col("dir").alias(f"dir_{x}"), F.col("digest").alias(f"d{x}"))
    equal = same.join(side("a"), "dir_a").join(side("b"), "dir_b").where("da = db").select("dir_a", "dir_b")
    return scored.join(equal, ["dir_a", "dir_b"], "left_anti").drop("alike")


def best_overlaps(dup: DataFrame, sums: DataFrame, digests: Callable[[DataFrame], DataFrame], k: int = PAIRS, fanout: int | None = FANOUT, first: int = FIRST) -> DataFrame:
    """The rows of :func:`best_pairs` of all :func:`candidate_pairs`, without listing these. ``sums(dir, files, bytes)``; ``digests``
    gives ``(dir, digest)`` of a table of folders ``dir``.

    A pair shares no more than either folder's duplicate bytes. The pairs among the ``first`` folders of most such bytes are scored;
    the k-th of them is reached by k pairs, so only folders that hold as much can be in a better one. Where these are more
    than were looked at, the pairs among all of them are scored."""
    entries = class_entries(dup, fanout)
    held = cut(held_bytes(entries))

    def scored(dirs: DataFrame) -> DataFrame:
        named = cut(running(dirs.select("dir"), [F.col("dir")], name="id"))
        n = named.count()
        found, masks = class_steps(entries, named, n)
        found = cut(found)
        ids = cut(_sent(named, n).join(sums, "dir").join(found.groupBy("id").agg(F.count("*").alias("classes")), "id"))
        return cut(_without_equal_trees(_named(_overlaps(found, masks), ids, n), digests))

    top = cut(held.orderBy(F.desc("held"), "dir").limit(first))
    out = top_pairs(scored(top), k)
    total, (n, least_held) = held.count(), top.agg(F.count("*"), F.min("held")).head()
    if total > n:
        reached = [r[0] for r in out.select("shared_bytes").collect()]
        least = min(reached) if len(reached) >= k else 1
        if least <= least_held:
            out = top_pairs(scored(held.where(F.col("held") >= least)), k)
    return out


def all_overlaps(dup: DataFrame, sums: DataFrame, digests: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of :func:`score_pairs` of all :func:`candidate_pairs` without bound. Folders are dealt into blocks of about ``block``, and a
    task gets all that two blocks hold: it sums the pairs between them and names them, so no pair is shuffled or written before
    the result. What is shuffled is the folders' classes, once for every block."""
    entries = class_entries(dup, None)
    named = cut(running(held_bytes(entries).select("dir"), [F.col("dir")], name="id"))
    n = named.count()
    found, masks = class_steps(entries, named, n)
    found = cut(found)
    numbers = cut(found.select("class_id").distinct().withColumn("c", F.monotonically_increasing_id()))
    twice = cut(digests.where("digest IS NOT NULL")).withColumn("copies", F.count("*").over(W.partitionBy("digest"))).where("copies > 1").select("dir", "digest")
    ids = cut(named.join(sums, "dir").join(twice, "dir", "left").select("id", "dir", "bytes", "digest"))
    blocks = max(1, -(-n // block))
    rows = found.join(numbers, "class_id").select("c", F.struct(F.col("id").cast("long").alias("id"), "n", "size", *masks).alias("x"), F.col("id").cast("long").alias("id"))
    rows = rows.repartition("c").sortWithinPartitions("c")
    rows = rows.select("c", "x", (F.col("id") % blocks).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"))
    i, j = F.least("p", "q"), F.greatest("p", "q")
    dealt = rows.select((i * blocks + j).alias("task"), "c", "x", (F.col("p") == i).alias("left"), (F.col("p") == j).alias("right"))
    dealt = dealt.repartitionByRange(blocks * (blocks + 1) // 2, "task")
    members = dealt.groupBy("task", "c").agg(F.collect_list(F.when(F.col("left"), F.col("x"))).alias("l"), F.collect_list(F.when(F.col("right"), F.col("x"))).alias("r"))
    pair = members.select("task", F.explode("l").alias("l"), "r").select("task", "l", F.explode("r").alias("r"))
    pair = pair.where(F.when(F.col("task") % (blocks + 1) == 0, F.expr("l.id < r.id")).otherwise(True))
    first = F.expr("l.id < r.id")
    one = pair.select(
        "task", F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), (F.when(first, F.col("l.size")).otherwise(F.col("r.size")) * F.least("l.n", "r.n")).alias("s"), _both(masks, "l", "r").alias("near")
    )
    summed = one.groupBy("task", "a", "b").agg(F.sum("s").alias("shared_bytes"), F.count("*").alias("shared_total"), F.bool_or("near").alias("near")).where("near AND shared_bytes > 0")
    side = lambda x: ids.select(F.col("id").alias(x), F.col("dir").alias(f"dir_{x}"), F.col("bytes").alias(f"t{x}"), F.col("digest").alias(f"d{x}"))
    sent = lambda df: F.broadcast(df) if n <= NAMED else df
    j = summed.join(sent(side("a")), "a").join(sent(side("b")), "b").where(~is_under(F.col("dir_b"), F.col("dir_a")) & F.expr("da IS NULL OR db IS NULL OR da <> db"))
    percent = F.round(200 * F.col("shared_bytes") / (F.col("ta") + F.col("tb")), 1)
    return j.select("dir_a", "dir_b", percent.alias("percent"), "shared_bytes", "shared_total")


def _rank(size: str) -> Column:
    """A whole number that grows with ``size``: its binary length and the four digits after the first."""
    s = F.greatest(F.col(size), F.lit(0))
    n = F.length(F.bin(s))
    return n * 16 + F.expr(f"cast(shiftright(greatest({size}, 0), greatest(length(bin(greatest({size}, 0))) - 5, 0)) % 16 AS int)")


def evidence(pairs: DataFrame, dup: DataFrame, limit: int = EVIDENCE) -> DataFrame:
    """(dir_a, dir_b, class_id, size, path_a, path_b): the common classes of each pair by size, at most ``limit`` a pair, with
    the first path on either side. Common classes are counted by rank of their size first, so only those of the ranks that reach
    ``limit`` are sorted, and paths are looked up for what is left."""
    pairs = cut(pairs.select("dir_a", "dir_b").distinct())
    roots = cut(pairs.select(F.col("dir_a").alias("root")).union(pairs.select("dir_b")).distinct())
    n, m = pairs.count(), roots.count()
    per = dup.groupBy("dir", "class_id").agg(F.max("size").alias("size"))
    up = per.select("class_id", "size", F.explode(ancestors(F.col("dir"), include_self=True)).alias("root")).join(_sent(roots, m), "root")
    sized = cut(up.groupBy("class_id", "root").agg(F.max("size").alias("size")))
    l, r = sized.withColumnRenamed("root", "dir_a"), sized.select("class_id", F.col("root").alias("dir_b"))
    common = l.join(r, "class_id").join(_sent(pairs, n), ["dir_a", "dir_b"]).withColumn("rank", _rank("size"))
    ranks = common.groupBy("dir_a", "dir_b", "rank").agg(F.count("*").alias("c"))
    w = W.partitionBy("dir_a", "dir_b").orderBy(F.desc("rank"))
    before = ranks.withColumn("before", F.sum("c").over(w) - F.col("c")).where(F.col("before") < limit)
    lowest = cut(before.groupBy("dir_a", "dir_b").agg(F.min("rank").alias("lowest")))
    rows = common.join(_sent(lowest, n), ["dir_a", "dir_b"]).where("rank >= lowest")
    w = W.partitionBy("dir_a", "dir_b").orderBy(F.desc("size"), "class_id")
    kept = cut(rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).select("dir_a", "dir_b", "class_id", "size"))
    wanted = cut(kept.select(F.col("dir_a").alias("root"), "class_id").union(kept.select("dir_b", "class_id")).distinct())
    classes = cut(wanted.select("class_id").distinct())
    some = dup.join(_sent(classes, classes.count()), "class_id", "left_semi").select("class_id", "path", F.explode(ancestors(F.col("dir"), include_self=True)).alias("root"))
    first = cut(some.join(_sent(wanted, wanted.count()), ["root", "class_id"]).groupBy("root", "class_id").agg(F.min("path").alias("path")))
    side = lambda x: first.select(F.col("root").alias(f"dir_{x}"), "class_id", F.col("path").alias(f"path_{x}"))
    return kept.join(side("a"), ["dir_a", "class_id"]).join(side("b"), ["dir_b", "class_id"]).select("dir_a", "dir_b", "class_id", "size", "path_a", "path_b")


def _sides(pairs: DataFrame, files: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The files below either folder of each pair, with their path below it."""
    out = []
    for side in ("a", "b"):
        p = pairs.select(*keys, F.col(f"dir_{side}").alias("root")).distinct()
        below = dirs_under(files, p).join(p, "root")
        out.append(files.join(below, "dir").select(*keys, "path", "size", "class_id", relative(F.col("path"), F.col("root")).alias("rel")))
    return out[0], out[1]


def compare_folders(pairs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, relative_path, status, path_a, path_b, size_a, size_b)`` for pairs (keys, dir_a, dir_b).

    A full outer join on the relative path: on both sides ``identical`` if the classes are equal (two unknown classes
    are equal), else ``different_content``; on one side ``shared_elsewhere`` if its class is anywhere on the other, else
    ``only_a`` or ``only_b``. An absent side has a null path and size 0.
    """
    a, b = _sides(pairs, files, keys)
    elsewhere = lambda x: x.select(*keys, "class_id").distinct().withColumn("there", F.lit(True))
    safe = lambda l, r: [l[k].eqNullSafe(r[k]) for k in keys] + [l["class_id"].eqNullSafe(r["class_id"])]

    def known(x: DataFrame, other: DataFrame) -> DataFrame:
        o = elsewhere(other)
        return x.join(o, safe(x, o), "left").select(*[x[c] for c in x.columns], F.coalesce("there", F.lit(False)).alias("there"))

    left = known(a, b).select(*keys, "rel", F.col("path").alias("path_a"), F.col("size").alias("sa"), F.col("class_id").alias("ca"), F.col("there").alias("ta"))
    right = known(b, a).select(*keys, "rel", F.col("path").alias("path_b"), F.col("size").alias("sb"), F.col("class_id").alias("cb"), F.col("there").alias("tb"))
    j = left.join(right, [*keys, "rel"], "full_outer")
    status = (
        F.when(F.col("path_a").isNotNull() & F.col("path_b").isNotNull(), F.when(F.col("ca").eqNullSafe(F.col("cb")), "identical").otherwise("different_content"))
        .when(F.coalesce("ta", "tb"), "shared_elsewhere")
        .when(F.col("path_b").isNull(), "only_a")
        .otherwise("only_b")
    )
    size = lambda s: F.when(F.col(f"path_{s}").isNull(), 0).otherwise(F.coalesce(f"s{s}", F.lit(0))).alias(f"size_{s}")
    return j.select(*keys, F.col("rel").alias("relative_path"), status.alias("status"), "path_a", "path_b", size("a"), size("b"))


def pair_difference(pairs: DataFrame, files: DataFrame, keys: list[str], cap: int = EVIDENCE) -> DataFrame:
    """``(*keys, side, total, place, path, size)``: files of either side whose class isn't on the other, largest first, at most
    ``cap`` a side with the exact total. Unknown classes are equal to each other."""
    a, b = _sides(pairs, files, keys)
    only = _without(a, b, keys).withColumn("side", F.lit("a")).unionByName(_without(b, a, keys).withColumn("side", F.lit("b")))
    w = W.partitionBy(*keys, "side").orderBy(F.desc("size"), F.desc("path"))
    totals = only.groupBy(*keys, "side").agg(F.count("*").alias("total"))
    ranked = only.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    return ranked.join(totals, [*keys, "side"]).select(*keys, "side", "total", "place", "path", "size")


def _without(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    o = y.select(*keys, "class_id").distinct()
    match = [x[k].eqNullSafe(o[k]) for k in keys] + [x["class_id"].eqNullSafe(o["class_id"])]
    return x.join(o, match, "left_anti")


def shared_side(pairs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, path, size)``: the files of side a whose proven class is on side b too, whatever their names."""
    a, b = _sides(pairs, files, keys)
    return a.where("class_id IS NOT NULL").join(b.select(*keys, "class_id").distinct(), [*keys, "class_id"], "left_semi").select(*keys, "path", "size")


def merge_plan(pairs: DataFrame, files: DataFrame, links: DataFrame | None, keys: list[str]) -> DataFrame:
    """``(*keys, bucket, size, source, target)``: what folder b lacks of folder a: files whose class b hasn't
    (``unique``), files without proof (``uncovered``) and links (``symlink``); a path comes once, in the first of these
    buckets. ``target`` is the place below b."""
    a, b = _sides(pairs, files, keys)
    proven = a.where("class_id IS NOT NULL")
    unique = proven.join(b.where("class_id IS NOT NULL").select(*keys, "class_id").distinct(), [*keys, "class_id"], "left_anti")
    rows = unique.select(*keys, F.lit(1).alias("o"), F.lit("unique").alias("bucket"), "size", "path", "rel").unionByName(
        a.where("class_id IS NULL").select(*keys, F.lit(2).alias("o"), F.lit("uncovered").alias("bucket"), "size", "path", "rel")
    )
    if links is not None:
        up = links.select(F.explode(ancestors(F.col("dir"), include_self=True)).alias("root"), "path")
        l = up.join(pairs.select(*keys, F.col("dir_a").alias("root")).distinct(), "root")
        l = l.select(*keys, F.lit(3).alias("o"), F.lit("symlink").alias("bucket"), F.lit(0).cast("bigint").alias("size"), "path", relative(F.col("path"), F.col("root")).alias("rel"))
        rows = rows.unionByName(l)
    first = rows.groupBy(*keys, "path").agg(F.min_by(F.struct("bucket", "size", "rel"), "o").alias("r"))
    out = first.join(pairs.select(*keys, "dir_b").distinct(), keys)
    return out.select(*keys, F.col("r.bucket").alias("bucket"), F.col("r.size").alias("size"), F.col("path").alias("source"), F.concat_ws("/", "dir_b", "r.rel").alias("target"))
