"""Folders tied together by chains of shared content, and look-alike groups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.hashing import hamming
from stratafold.operators.graph import number_vertices, propagate_minimum
from stratafold.session import cut


def folder_clusters(files: DataFrame, min_files: int = 0) -> DataFrame:
    """``(cluster, dir, dup_files, total_files, percent, class_count, size, dup_file_count)``.

    Two folders are linked if a class has copies in both; each class is a star of its folders, never all pairs. ``dup_files``
    counts the files of a folder whose class has two members or more anywhere; sums over the cluster follow. The
    cluster is named by its smallest folder. ``files(dir, class_id, size)`` may hold files of unknown class, which
    count in the totals only.
    """
    proven = files.where("class_id IS NOT NULL AND NOT startswith(class_id, 'u:')")
    classes = proven.groupBy("class_id").agg(F.count("*").alias("n"), F.min("dir").alias("lo"), F.max("dir").alias("hi")).where("n >= 2")
    classes = cut(classes)
    repeated = proven.join(classes.select("class_id"), "class_id", "left_semi")
    spanning = classes.where("lo <> hi").select("class_id", "lo")
    star = proven.select("class_id", "dir").join(spanning, "class_id").where("dir <> lo").select("lo", "dir").distinct()
    star = cut(star)
    names = number_vertices(star.select(F.col("lo").alias("v")).union(star.select("dir")), "v")
    ids = star.join(names.select(F.col("name").alias("lo"), F.col("id").alias("x")), "lo").join(names.select(F.col("name").alias("dir"), F.col("id").alias("y")), "dir")
    edges = cut(ids.select(F.col("x").alias("src"), F.col("y").alias("dst")).union(ids.select("y", "x")))
    labels = propagate_minimum(edges)
    of = labels.join(names.withColumnRenamed("name", "dir"), "id").join(names.select(F.col("id").alias("label"), F.col("name").alias("cluster")), "label").select("cluster", "dir")
    of = cut(of)
    dup = repeated.groupBy("dir").agg(F.count("*").alias("dup_files"), F.sum("size").alias("dup_bytes"))
    total = files.groupBy("dir").agg(F.count("*").alias("total_files"))
    linking = proven.join(spanning.select("class_id"), "class_id", "left_semi").select("dir", "class_id").distinct().join(of, "dir")
    per = of.join(dup, "dir", "left").join(total, "dir", "left")
    sums = per.groupBy("cluster").agg(F.sum("dup_bytes").alias("size"), F.sum("dup_files").alias("dup_file_count"))
    n_classes = linking.groupBy("cluster").agg(F.countDistinct("class_id").alias("class_count"))
    percent = F.coalesce(F.col("dup_files") * 100.0 / F.nullif("total_files", F.lit(0)), F.lit(0.0))
    out = per.join(sums, "cluster").join(n_classes, "cluster").where(F.col("dup_file_count") >= min_files)
    return out.select("cluster", "dir", "dup_files", "total_files", percent.alias("percent"), "class_count", "size", "dup_file_count")


def cluster_totals(clusters: DataFrame) -> DataFrame:
    """One row over the rows of :func:`folder_clusters`: clusters, folders, bytes and duplicate files."""
    one = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.max("size").alias("s"), F.max("dup_file_count").alias("d"))
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return one.agg(F.count("*").alias("clusters"), zero("n", "folders"), zero("s", "bytes"), zero("d", "dup_files"))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """``(hash, rep)``: the smallest id of each hash; null hashes have none."""
    return hashes.where("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("rep"))


def band_radii(radius: int, bands: int) -> list[int]:
    """Differing bits to allow in each band so that no pair within ``radius`` is lost: with one more than allowed in every band a
    pair would differ in more than ``radius`` bits. -1 leaves a band out."""
    whole, more = divmod(radius + 1, bands)
    return [whole - (k >= more) for k in range(bands)]


def near_hashes(hashes: DataFrame, radius: int, bits: int = 64, bands: int | None = None) -> DataFrame:
    """``(a, b, distance)``, a < b: pairs of representatives of ``hashes(id, hash)`` that differ in 1 to ``radius`` bits.

    Equal hashes are one class, whose smallest id represents it (``hash_classes``), so copies are never paired with
    each other; null hashes are in no pair. The bits are cut in a few wide bands, each with a radius of its own (:func:`band_radii`). A
    pair near in a band has a value between both: one side lists the values up to half of that radius away, the other the
    rest, and an equality join on (band, value) brings them together. The exact distance decides; nothing is lost. Bands are as
    wide as the number of classes asks for (some log2 n bits), unless ``bands`` is given; the result doesn't depend on it.
    """
    classes = hash_classes(hashes).select(F.col("rep").alias("id"), "hash")
    if bands is None:
        bands = max(1, min(radius + 1, round(bits / max(16, classes.count().bit_length()))))
    ends = [round(k * bits / bands) for k in range(bands + 1)]
    flips: list[list[tuple[int, int]]] = [[], []]
    for k, r in enumerate(band_radii(radius, bands)):
        for side, reach in enumerate(((r + 1) // 2, r // 2) if r >= 0 else ()):
            places = range(ends[k], ends[k + 1])
            flips[side] += [(k, _signed(sum(1 << i for i in c))) for n in range(reach + 1) for c in combinations(places, n)]
    spark = hashes.sparkSession
    whole = F.create_map(*[x for k in range(bands) for x in (F.lit(k), F.lit(_signed((1 << ends[k + 1]) - (1 << ends[k]))))])

    def probes(side: int, ident: str, value: str) -> DataFrame:
        masks = spark.createDataFrame(flips[side] or [(-1, 0)], "band int, flip bigint")
        at = F.col("hash").bitwiseXOR(F.col("flip")).bitwiseAND(F.element_at(whole, F.col("band")))
        return classes.crossJoin(F.broadcast(masks)).select("band", at.alias("at"), F.col("id").alias(ident), F.col("hash").alias(value))

    close = probes(0, "a", "ha").join(probes(1, "b", "hb"), ["band", "at"]).where("a < b")
    return close.select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("distance")).where(F.col("distance") <= radius).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def lookalike_groups(hashes: DataFrame, radius: int) -> DataFrame:
    """``(group_id, id)``: single-linkage groups of two or more over equal and near hashes, named by their smallest id."""
    known = hashes.where("hash IS NOT NULL").select("id", "hash")
    classes = cut(hash_classes(known))
    near = near_hashes(known, radius).select("a", "b")
    edges = cut(near.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(near.select("b", "a")))
    labels = propagate_minimum(edges).select(F.col("id").alias("rep"), "label")
    members = known.join(classes, "hash").join(labels, "rep", "left").select(F.coalesce("label", "rep").alias("group_id"), "id")
    several = members.groupBy("group_id").count().where("count >= 2").select("group_id")
    return members.join(several, "group_id", "left_semi").select("group_id", "id")
