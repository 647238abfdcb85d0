"""Problem 5: all pairs of similar sets by recursive chosen-path splitting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.operators.skew import expand_pairs
from stratafold.session import cut, is_empty, release

#: 64-bit words of the occupancy map that bounds an overlap from above.
WORDS = 4
_MAPS = [f"m{i}" for i in range(WORDS)]


@dataclass(frozen=True)
class ChosenPath:
    """Parameters of the search.

    ``percent``: least 200 * common / (size a + size b). ``trees``: independent repetitions. ``shared``: how many common
    tokens a pair at the threshold is expected to follow together on each level; a tree misses it there with a probability
    under exp(-shared), so four trees with 3 miss it with one under 1e-5 on the first level, whatever the threshold.
    ``leaf``: most records of a node that is compared directly; larger ones are split again for as long as they are larger.
    ``exact``: search by :func:`prefix_pairs` instead, which misses nothing, for data without very frequent tokens.
    """

    percent: float = 75.0
    trees: int = 4
    shared: float = 3.0
    leaf: int = 96
    exact: bool = False

    @property
    def share(self) -> float:
        """Least common / (size a + size b)."""
        return self.percent / 200.0

    @property
    def kept(self) -> float:
        """Least part of the larger set's tokens that a pair at the threshold has in common."""
        return self.percent / (200.0 - self.percent)

    @property
    def tokens(self) -> float:
        """Tokens that a record is expected to follow on each level."""
        return self.shared / self.kept


def _h(*parts: Column | str) -> Column:
    return F.xxhash64(*parts)


def _child(node: Column) -> Column:
    """The node that the token ``t`` leads to: that of the path's set of tokens, in whatever order they came."""
    return node.bitwiseXOR(_h(F.lit("child"), "t"))


def _unit(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def _signature() -> list[Column]:
    """Two sums that don't depend on the order of tokens; equal sets have equal ones."""
    return [F.expr("sum(cast(xxhash64(token) AS decimal(20,0)))").alias("s1"), F.bit_xor(_h(F.lit("x"), "token")).alias("s2")]


@dataclass(frozen=True)
class SimilarSets:
    """``members(id, name)``: the class of each record, classes being equal sets; ``classes(id, rep, n, copies, weight)``: their
    smallest record, tokens, records and summed weight; ``pairs(x, y, percent, shared_weight)``: similar classes, each once.
    Records of one class are similar at 100 percent without a row in ``pairs``."""

    members: DataFrame
    classes: DataFrame
    pairs: DataFrame


def similar_classes(items: DataFrame, record: str, token: str, weight: str, params: ChosenPath = ChosenPath()) -> SimilarSets:
    """The similar sets of ``items(record STRING, token STRING, weight BIGINT)``, the long form of the sets, as classes.

    Repeated rows count once, rows with a null record or token are left out, a null weight counts as 0 (of several weights
    of a token in a record the greatest counts). Records without tokens are in no class. Other columns are ignored; an empty table
    gives no rows.

    Records with the same set become one class first: those with equal signatures, if the class holds no more different tokens than
    each of its records (else its records stay apart). A tree branches every class on the tokens that a hash shared by all
    chooses; small nodes are compared by brute force, large ones split again by further tokens. A node's records share the
    tokens of its path, so pairs that these alone make similar are emitted at once; all others share another token. Every
    pair found is verified on the tokens themselves. A record of any size is kept in long form, its size, signature and
    occupancy map are algebraic aggregates.
    """
    rows = items.select(
        F.col(record).alias("name"), F.col(token).alias("token"), F.coalesce(F.col(weight), F.lit(0)).cast("bigint").alias("w")
    ).where("name IS NOT NULL AND token IS NOT NULL")
    rows = cut(rows.groupBy("name", "token").agg(F.max("w").alias("w")))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(token), 64) AS int))")
    word = F.pmod(F.shiftright(_h("token"), 6), F.lit(WORDS))
    maps = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(m) for i, m in enumerate(_MAPS)]
    records = cut(rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), *_signature(), *maps))
    key = ["n", "s1", "s2", "apart"]
    copied = records.groupBy("n", "s1", "s2").agg(F.count("*").alias("copies")).where("copies > 1")
    # a class is one set if it holds as many different tokens as each of its records
    mixed = rows.join(records.join(copied, ["n", "s1", "s2"]).select("name", "n", "s1", "s2"), "name").groupBy("n", "s1", "s2", "token").count()
    mixed = mixed.groupBy("n", "s1", "s2").agg(F.count("*").alias("distinct")).where("distinct > n").select("n", "s1", "s2", F.lit(True).alias("mixed"))
    marked = records.join(mixed, ["n", "s1", "s2"], "left").withColumn("apart", F.when(F.col("mixed"), F.col("name")).otherwise(""))
    marked = cut(marked.drop("mixed"))
    classes = marked.groupBy(*key).agg(
        F.min("name").alias("rep"), F.count("*").alias("copies"), F.max("weight").alias("weight"), *[F.max(m).alias(m) for m in _MAPS]
    )
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    members = marked.select("name", *key).join(classes.select("id", *key), key).select("id", "name")
    tokens = cut(rows.withColumnRenamed("name", "rep").join(classes.select("rep", "id", "n"), "rep").select("id", "n", "token", "w", _h("token").alias("t")))
    near = prefix_pairs(tokens, classes, params) if params.exact else _search(tokens, classes, params)
    found = cut(_verify(near, tokens, params.percent))
    release(rows, records)
    return SimilarSets(members, classes.select("id", "rep", "n", "copies", "weight"), found)


def similar_sets(items: DataFrame, record: str, token: str, weight: str, params: ChosenPath = ChosenPath()) -> DataFrame:
    """``(a, b, percent, shared_weight)`` for all pairs a < b of records whose token sets overlap by ``params.percent``: the classes of
    :func:`similar_classes`, expanded in blocks of members, so that no task pairs a whole class."""
    s = similar_classes(items, record, token, weight, params)
    same = s.classes.where("copies > 1").select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(100.0).alias("percent"), F.col("weight").alias("shared_weight"))
    pairs = s.pairs.unionByName(same).withColumnsRenamed({"x": "a", "y": "b"})
    wide = expand_pairs(pairs, s.members.select(F.col("id").alias("g"), F.col("name").alias("m")))
    return wide.select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"), "percent", "shared_weight")


def _search(tokens: DataFrame, classes: DataFrame, p: ChosenPath) -> DataFrame:
    """Pairs (x, y, nx, ny) of classes from all trees whose overlap may reach the threshold; each pair once.

    A level is written once and everything else is read from it. The loop ends when no node is larger than ``leaf``: each level
    takes a token of the record away, and the number of nodes of d tokens falls like tokens ** d / d!.
    """
    maps = classes.select("id", *_MAPS)
    chance = lambda n: F.lit(p.tokens) / F.greatest(n, F.lit(1))
    # sets of at most ``tokens`` tokens follow all of them, so one tree finds their pairs for certain, and a set of at most ``shared`` tokens
    # has no larger partners: it needs no other tree
    trees = F.when(F.col("n") <= p.shared, 1).otherwise(p.trees)
    forest = tokens.select(F.explode(F.sequence(F.lit(1), trees)).alias("tree"), "id", "n", "t")
    level = forest.where(_unit(_h("tree", "t")) < chance(F.col("n"))).select(
        _child(_h(F.lit("root"), "tree")).alias("node"), "id", "n", F.array("t").alias("path")
    )
    pairs: list[DataFrame] = []
    depth = 1
    while True:
        here = cut(level)
        sizes = here.groupBy("node").agg(F.count("*").alias("k"))
        pairs.append(_compare(here.join(sizes.where(F.col("k").between(2, p.leaf)).select("node"), "node", "left_semi"), maps, p.share))
        large = cut(sizes.where(F.col("k") > p.leaf).select("node", "k"))
        if is_empty(large):
            break
        wide = here.join(large, "node")
        pairs.append(_by_path(wide, depth, p))
        further = wide.join(tokens.select("id", "t"), "id").where(~F.array_contains("path", F.col("t")))
        level = (
            further.where(_unit(_h("node", "t")) < chance(F.col("n") - depth))
            .select(_child(F.col("node")).alias("node"), "id", "n", F.array_append("path", F.col("t")).alias("path"))
            .dropDuplicates(["node", "id"])
        )
        depth += 1
    out = pairs[0]
    for q in pairs[1:]:
        out = out.unionByName(q)
    return out.distinct()


def _by_path(wide: DataFrame, depth: int, p: ChosenPath) -> DataFrame:
    """Pairs of a large node which the tokens of the path alone make similar: results, all of them. The node is cut into blocks by
    the counted size, so one task pairs two blocks only."""
    most = depth / p.share + 1e-9
    done = wide.where(F.col("n") <= most - depth).withColumn("b", F.ceil(F.col("k") / p.leaf))
    a = done.select("node", F.col("id").alias("x"), F.col("n").alias("nx"), F.pmod(_h("id"), F.col("b")).alias("pa"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b") - 1)).alias("pb"))
    b = done.select("node", F.col("id").alias("y"), F.col("n").alias("ny"), F.pmod(_h("id"), F.col("b")).alias("pb"))
    return a.join(b, ["node", "pb"]).where((F.col("x") < F.col("y")) & (F.col("nx") + F.col("ny") <= most)).select("x", "y", "nx", "ny")


def _bounded(pairs: DataFrame, share: float) -> DataFrame:
    """Pairs whose sizes and occupancy maps allow the threshold. A token whose bit the other map lacks isn't shared, so the number
    of such bits bounds the overlap from above; no similar pair is lost."""
    lacks = lambda s, o: sum((F.bit_count(F.col(f"{c}{s}").bitwiseAND(F.bitwise_not(f"{c}{o}"))) for c in _MAPS), F.lit(0))
    need = F.lit(share) * (F.col("nx") + F.col("ny")) - 1e-9
    return (
        pairs.where(F.col("x") < F.col("y"))
        .where((F.least("nx", "ny") >= need) & (F.col("nx") - lacks("x", "y") >= need) & (F.col("ny") - lacks("y", "x") >= need))
        .select("x", "y", "nx", "ny")
        .distinct()
    )


def _compare(members: DataFrame, maps: DataFrame, share: float) -> DataFrame:
    """All pairs within each node that :func:`_bounded` allows."""
    full = members.select("node", "id", "n").join(maps, "id")
    side = lambda s: full.select("node", F.col("id").alias(s), F.col("n").alias(f"n{s}"), *[F.col(c).alias(f"{c}{s}") for c in _MAPS])
    return _bounded(side("x").join(side("y"), "node"), share)


def prefix_pairs(tokens: DataFrame, classes: DataFrame, p: ChosenPath) -> DataFrame:
    """Pairs (x, y, nx, ny) by prefix filtering, which misses no similar pair: a set's tokens from the rarest on; two similar sets
    share a token among the first n - ceil(kept * n) + 1 of each. As dear as its most frequent prefix token."""
    counts = tokens.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    ranked = tokens.select("id", "n", "t").join(counts, "t", "left")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.coalesce("f", F.lit(1)), "t"))
    kept = ranked.withColumn("k", place).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * p.kept - 1e-9) + 1).where("f > 1")
    full = kept.select("t", "id", "n").join(classes.select("id", *_MAPS), "id")
    side = lambda s: full.select("t", F.col("id").alias(s), F.col("n").alias(f"n{s}"), *[F.col(c).alias(f"{c}{s}") for c in _MAPS])
    return _bounded(side("x").join(side("y"), "t"), p.share)


def _verify(pairs: DataFrame, tokens: DataFrame, percent: float) -> DataFrame:
    """The pairs (x, y) that reach the threshold on their tokens, with percent and shared weight."""
    left = pairs.join(tokens.select(F.col("id").alias("x"), "token", "w"), "x")
    common = left.join(tokens.select(F.col("id").alias("y"), "token"), ["y", "token"])
    counted = common.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("common"), F.sum("w").alias("shared_weight"))
    exact = F.lit(200.0) * F.col("common") / (F.col("nx") + F.col("ny"))
    return counted.withColumn("percent", exact).where(F.col("percent") >= percent).select("x", "y", "percent", "shared_weight")


def folder_contents(file_groups: DataFrame) -> DataFrame:
    """``(record, token, weight)``: the contents directly in each folder, from groups of paths. A path without ``/`` is
    in no folder; null paths and null digests are left out."""
    each = file_groups.select("digest", "size", F.explode("paths").alias("path"))
    folder = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    return each.where(F.col("path").contains("/")).select(folder.alias("record"), F.col("digest").alias("token"), F.col("size").alias("weight"))
