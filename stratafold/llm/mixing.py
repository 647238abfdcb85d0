"""Problem 7: mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.llm.bpe import TOKENIZERS, encoder_functions
from stratafold.session import cut, spread

#: Leading bits of a document's seeded position: a leaf's cut is looked for among 2**BITS partial sums.
BITS = 14
#: Most rows (some 100 bytes each) of the budget table that are broadcast; counted before.
LIGHT = 100_000


def fill(weights: Sequence[float], caps: Sequence[float], budget: float) -> list[float]:
    """Split ``budget`` by weight; what a child can't take goes to its siblings by their weights. The rest that no sibling
    of positive weight can take is not given out."""
    w, cap = np.maximum(np.nan_to_num(np.asarray(weights, float)), 0), np.asarray(caps, float)
    given, active = np.zeros(len(w)), (w > 0) & (cap > 0)
    left = float(budget)
    while left > 1e-9 and active.any():
        share = np.where(active, w, 0) / w[active].sum() * left
        full = active & (given + share >= cap)
        if not full.any():
            given += share
            break
        left -= float((cap - given)[full].sum())
        given[full] = cap[full]
        active &= ~full
    return given.tolist()


def budgets(leaves: pd.DataFrame, levels: Sequence[str], total: float, fixed: Sequence[str] = ()) -> pd.Series:
    """The budget of every leaf of a tree, from the root down.

    ``leaves`` has a row for each leaf: its path in the columns ``levels``, ``w_<level>`` for the weight of the
    node on each level among its siblings, and ``cap`` for the most it can give. A node's capacity is that of its leaves,
    so a shortage is made up by siblings first and by the ancestors' siblings only for the rest. On the levels in ``fixed``
    no sibling makes up for another: every node gets its own share, as far as it goes.
    """
    out = pd.Series(0.0, index=leaves.index)

    def descend(rows: pd.DataFrame, depth: int, budget: float) -> None:
        if depth == len(levels):
            out.loc[rows.index] = min(budget, float(rows["cap"].sum())) / len(rows)
            return
        level = levels[depth]
        parts = [part for _, part in rows.groupby(level, dropna=False, sort=True)]
        w = [max(0.0, float(part[f"w_{level}"].iloc[0])) for part in parts]
        caps = [float(part["cap"].sum()) for part in parts]
        if level in fixed:
            own = [min(c, budget * x / sum(w)) if sum(w) > 0 else 0.0 for x, c in zip(w, caps)]
        else:
            own = fill(w, caps, budget)
        for part, b in zip(parts, own):
            descend(part, depth + 1, b)

    if len(leaves):
        descend(leaves, 0, total)
    return out


def corpus_sizes(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, lang, tokens), written once: every later step reads these numbers, not the texts."""
    _, count, _ = encoder_functions(documents.sparkSession, path)
    return cut(spread(documents.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", count("text").alias("tokens")))


def mixture_budgets(sizes: DataFrame, plans: DataFrame, keep_source_shares: bool = True) -> DataFrame:
    """A row for each mixture, source and language with tokens: its budget, in whole epochs and the rest.

    The tree is mixture - source - language. A source's weight comes from the plan; a language's weight within its source
    is what the source holds of it. With ``keep_source_shares`` a source that runs short stays short, since a source's
    share of the wanted size is what is asked for; without, other sources make up for it by their weights.
    Repeated plan rows of a source add up (the greatest ``max_repeats`` and ``total_fraction`` count); negative and
    null weights count as 0, null ``max_repeats`` as 0. A planned source without documents has one row of language null.
    """
    total = sizes.agg(F.sum("tokens").alias("all_tokens"))
    held = sizes.where("tokens > 0").groupBy("source", "lang").agg(F.sum("tokens").alias("available"))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    asked = plans.where("mix_name IS NOT NULL").groupBy("mix_name", "source").agg(
        F.sum(weight).alias("w_source"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"), F.max("total_fraction").alias("part")
    )
    asked = asked.withColumn("part", F.max("part").over(W.partitionBy("mix_name")))
    rows = asked.join(held, "source", "left").crossJoin(F.broadcast(total))
    rows = rows.select(
        "mix_name",
        "source",
        "lang",
        "w_source",
        F.coalesce(F.col("available"), F.lit(0)).cast("double").alias("available"),
        F.greatest(F.col("max_repeats"), F.lit(0)).cast("double").alias("max_repeats"),
        (F.coalesce("part", F.lit(0.0)) * F.coalesce("all_tokens", F.lit(0))).alias("wanted"),
    )

    def plan(leaves: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.reset_index(drop=True)
        leaves["w_lang"] = leaves["available"]
        leaves["cap"] = leaves["available"] * leaves["max_repeats"]
        wanted = float(leaves["wanted"].iloc[0])
        leaves["budget"] = budgets(leaves, ["source", "lang"], wanted, fixed=["source"] if keep_source_shares else [])
        epochs = np.floor(leaves["budget"] / leaves["available"].where(leaves["available"] > 0) + 1e-9).fillna(0)
        leaves["epochs"] = epochs.astype("int64")
        leaves["rest"] = (leaves["budget"] - epochs * leaves["available"]).clip(lower=0)
        return leaves[["mix_name", "source", "lang", "w_source", "available", "max_repeats", "wanted", "budget", "epochs", "rest"]]

    schema = "mix_name string, source string, lang string, w_source double, available double, max_repeats double, wanted double, budget double, epochs bigint, rest double"
    return cut(rows.groupBy("mix_name").applyInPandas(plan, schema))


def domain(root_dir: Column) -> Column:
    """The first part of a folder, the domain of the documents about it; null for null."""
    return F.regexp_extract(root_dir, r"^(/?[^/]*)", 1)


def tree_budgets(sizes: DataFrame, mixes: DataFrame, weights: DataFrame, levels: Sequence[str]) -> DataFrame:
    """A row for each mixture and leaf of a tree with tokens: its budget, in whole epochs and the rest.

    ``sizes(doc_id, *levels, tokens)`` are the documents with their path in the tree, from the top down; ``mixes(mix_name,
    total_fraction, max_repeats)`` the mixtures; ``weights(mix_name, level, value, weight)`` the weight of a node among its siblings,
    1 where none is given, negative and null weights as 0, repeated ones added up. Budgets go from the root down; a shortage is made up by siblings
    first, by the ancestors' siblings only for what is left (:func:`budgets`). A mixture's tree is planned in one task: it has a row
    for each combination of values that documents have.
    """
    levels = list(levels)
    held = sizes.where("tokens > 0").groupBy(*levels).agg(F.sum("tokens").cast("double").alias("available"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    asked = mixes.where("mix_name IS NOT NULL").groupBy("mix_name").agg(F.max("total_fraction").alias("part"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    rows = held.crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(total))
    given = weights.groupBy("mix_name", "level", "value").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("w"))
    for level in levels:
        mine = given.where(F.col("level") == level).select(F.col("mix_name").alias("m"), F.col("value").alias("v"), F.col("w").alias(f"w_{level}"))
        rows = rows.join(mine, (F.col("mix_name") == F.col("m")) & F.col(level).eqNullSafe(F.col("v")), "left").drop("m", "v")
        rows = rows.withColumn(f"w_{level}", F.coalesce(f"w_{level}", F.lit(1.0)))
    rows = rows.withColumn("wanted", F.coalesce("part", F.lit(0.0)) * F.col("all_tokens")).withColumn("cap", F.col("available") * F.greatest("max_repeats", F.lit(0)))

    def plan(leaves: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.reset_index(drop=True)
        wanted = float(leaves["wanted"].iloc[0])
        free = leaves.assign(cap=float("inf"))
        leaves["share_tokens"] = budgets(free, levels, wanted)
        leaves["budget"] = budgets(leaves, levels, wanted)
        epochs = np.floor(leaves["budget"] / leaves["available"] + 1e-9)
        leaves["epochs"] = epochs.astype("int64")
        leaves["rest"] = (leaves["budget"] - epochs * leaves["available"]).clip(lower=0)
        return leaves[["mix_name", *levels, "available", "max_repeats", "wanted", "share_tokens", "budget", "epochs", "rest"]]

    path = ", ".join(f"{x} string" for x in levels)
    return cut(rows.groupBy("mix_name").applyInPandas(plan, f"mix_name string, {path}, available double, max_repeats int, wanted double, share_tokens double, budget double, epochs bigint, rest double"))


def tree_shares(plan: DataFrame, drawn: DataFrame, levels: Sequence[str]) -> DataFrame:
    """For each leaf of each mixture: tokens by the weights alone, the budget after shortages were made up for, tokens reached."""
    keys = ["mix_name", *levels]
    got = drawn.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum(F.col("tokens") * F.col("uses")).alias("got"), F.max("uses").alias("most_uses"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = plan.join(got, match, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(*keys, "share_tokens", F.col("budget").alias("budget_tokens"), zero("got").alias("reached_tokens"), F.col("available").cast("bigint").alias("available_tokens"), zero("most_uses").alias("most_uses"))


def draw(sizes: DataFrame, plan: DataFrame, seed: int = 17, levels: Sequence[str] = ("source", "lang")) -> DataFrame:
    """(mix_name, *levels, doc_id, tokens, uses): the documents of each mixture.

    Each leaf (combination of ``levels``) is read in epochs, every epoch in its own seeded order. All whole epochs use each document
    once; of the last epoch the prefix is used whose tokens come closest to the rest of the budget. Its end is found in partial sums
    over leading bits of the seeded position, then among the documents of one such bucket, so no task ranks a leaf.
    Documents without tokens are never used. The same input and seed give the same rows.
    """
    levels = list(levels)
    few = plan.limit(LIGHT + 1).count() <= LIGHT
    hint = F.broadcast if few else (lambda df: df)

    def same(prefix: str, mix: bool) -> Column:
        match = F.col("mix_name") == F.col(f"{prefix}mix") if mix else F.lit(True)
        for c in levels:
            match = match & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        return match

    leaf = plan.where("epochs > 0 OR rest > 0").select("mix_name", *[F.col(c).alias(f"p_{c}") for c in levels], "epochs", "rest")
    docs = sizes.where("tokens > 0").join(hint(leaf), same("p_", False))
    place = F.xxhash64(F.lit(seed), "mix_name", "epochs", "doc_id")
    docs = docs.select("mix_name", *levels, "doc_id", "tokens", "epochs", "rest", place.alias("u"))
    docs = docs.withColumn("b", F.shiftrightunsigned("u", 64 - BITS))
    w = W.partitionBy("mix_name", *levels).orderBy("b")
    sums = docs.where("rest > 0").groupBy("mix_name", *levels, "b", "rest").agg(F.sum("tokens").alias("t"))
    last = sums.withColumn("upto", F.sum("t").over(w)).where("upto - t < rest AND rest <= upto")
    last = last.select(F.col("mix_name").alias("q_mix"), *[F.col(c).alias(f"q_{c}") for c in levels], F.col("b").alias("cut"), (F.col("upto") - F.col("t")).alias("below"))
    placed = docs.join(hint(last), same("q_", True), "left")
    used = placed.where("cut IS NULL OR b <> cut").withColumn("uses", F.col("epochs") + F.when(F.col("b") < F.col("cut"), 1).otherwise(0))
    inner = W.partitionBy("mix_name", *levels).orderBy("u", "doc_id")
    edge = placed.where("b = cut").withColumn("upto", F.col("below") + F.sum("tokens").over(inner))
    edge = edge.withColumn("uses", F.col("epochs") + F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    columns = ["mix_name", *levels, "doc_id", "tokens", "uses"]
    return used.select(columns).unionByName(edge.select(columns)).where("uses > 0")


def shares(plan: DataFrame, drawn: DataFrame) -> DataFrame:
    """For each mixture and source the share wanted and the share reached, of the wanted size and of the size reached."""
    reached = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached_tokens"), F.max("uses").alias("most_uses"))
    source = plan.groupBy("mix_name", "source").agg(
        F.max("w_source").alias("w"), F.max("wanted").alias("wanted"), F.sum("available").alias("available"), F.max("max_repeats").alias("max_repeats"), F.sum("budget").alias("budget")
    )
    w = W.partitionBy("mix_name")
    joined = source.join(reached.withColumnRenamed("source", "s").withColumnRenamed("mix_name", "m"), (F.col("mix_name") == F.col("m")) & F.col("source").eqNullSafe(F.col("s")), "left")
    got = F.coalesce("reached_tokens", F.lit(0))
    share = F.coalesce(F.try_divide("w", F.sum("w").over(w)), F.lit(0.0))
    return joined.select(
        "mix_name",
        "source",
        share.alias("wanted_share"),
        (share * F.col("wanted")).alias("wanted_tokens"),
        F.col("budget").alias("budget_tokens"),
        got.alias("reached_tokens"),
        F.coalesce(F.try_divide(got, "wanted"), F.lit(0.0)).alias("reached_share"),
        F.coalesce(F.try_divide(got, F.sum(got).over(w)), F.lit(0.0)).alias("share_of_mixture"),
        F.col("available").cast("bigint").alias("available_tokens"),
        F.col("max_repeats").cast("int").alias("max_repeats"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
