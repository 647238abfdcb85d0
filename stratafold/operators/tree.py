"""Folder trees: digests from the bottom up, sums over subtrees, identical folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.paths import ancestors, nfc
from stratafold.session import cut


#: Pieces of an entry's hashes that are summed: (hash, first bit); sums of PIECE bits don't overflow below 2 ** 35 entries.
PIECE = 28
_PIECES = [("h", 0), ("h", PIECE), ("g", 0), ("g", PIECE)]


def folder_digests(folders: DataFrame, files: DataFrame, links: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """``(dir, digest)``: equal for folders with equal trees, null where that can't be proven.

    A folder's tree is the multiset of all that lies below it: files, links and hard-link aliases by their NFC path below the folder
    with class or target, and sub-folders, empty ones too, by their path. The digest is null if the folder or one below is
    incomplete or a file's class is unknown. Each entry is hashed once for every folder above it, and the hashes are added
    up: sums don't depend on order and combine on the map side, so one aggregation does for all levels and no task holds a
    folder's entries, however many. ``folders(dir, ok)``, ``files(dir, name, class_id)``, ``links(dir, name, target)``,
    ``aliases(dir, name, class_id)``; other columns are ignored.
    """
    below = F.when(F.col("dir") == "/", "").otherwise(F.col("dir"))

    def entries(rows: DataFrame, tag: str, key: str) -> DataFrame:
        return rows.select(F.concat(below, F.lit("/"), F.col("name")).alias("p"), F.lit(tag).alias("tag"), F.col(key).alias("key"), F.col(key).isNull().alias("bad"), F.lit(1).alias("own"))

    rows = entries(files, "F", "class_id")
    if links is not None:
        rows = rows.unionByName(entries(links, "L", "target"))
    if aliases is not None:
        rows = rows.unionByName(entries(aliases, "A", "class_id"))
    rows = rows.unionByName(folders.select(F.col("dir").alias("p"), F.lit("D").alias("tag"), F.lit("").alias("key"), ~F.coalesce("ok", F.lit(False)), F.lit(0).alias("own")).toDF("p", "tag", "key", "bad", "own"))
    flat = F.regexp_replace(F.concat(F.lit("/"), F.col("p")), "/+", "/")
    rows = rows.withColumn("p", F.rtrim(flat, F.lit("/"))).withColumn("n", F.size(F.split("p", "/")) - 1)
    rows = rows.where("n > own").select("*", nfc(F.col("p")).alias("q"), F.explode(F.sequence(F.lit(1), F.col("n") - F.col("own"))).alias("k"))
    rest = F.when(F.col("k") < F.col("n"), F.expr("substring_index(q, '/', k - n)")).otherwise("")
    up = rows.select(F.expr("substring_index(p, '/', k + 1)").alias("dir"), "tag", "key", "bad", rest.alias("rel"), (F.col("own") == 0).alias("folder"))
    hashed = up.select("dir", "bad", "folder", F.xxhash64("tag", "rel", "key").alias("h"), F.xxhash64("key", "rel", "tag", F.lit("g")).alias("g"))
    part = lambda c, at: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << PIECE) - 1).cast("bigint"))
    sums = [F.sum(part(c, at)).alias(f"{c}{at}") for c, at in _PIECES]
    g = hashed.groupBy("dir").agg(F.bool_or("bad").alias("bad"), F.bool_or("folder").alias("known"), F.count("*").alias("n"), F.bit_xor("h").alias("x"), *sums)
    text = F.concat_ws(":", "n", "x", *[f"{c}{at}" for c, at in _PIECES])
    return g.where("known").select("dir", F.when(~F.col("bad"), F.sha2(text, 256)).alias("digest"))


def dirs_under(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``(dir, root)``: the folders of ``files`` at or below each of ``roots(root)``. Only distinct folders are joined with the roots, so a
    root that holds most files is no hot key."""
    up = files.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"), include_self=True)).alias("root"))
    return up.join(roots.select("root").distinct(), "root", "left_semi")


def subtree_sums(files: DataFrame, aliases: DataFrame | None = None, digests: DataFrame | None = None) -> DataFrame:
    """``(dir, files, bytes)`` over everything below each folder. The ancestors of a file's folder are exploded after
    the files of that folder were summed, so the root's sums combine on the map side. Hard-link ``aliases(dir)`` count as files without
    bytes, with ``digests(dir, digest)`` only in folders that can be proven."""
    per = files.groupBy("dir").agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("s"))
    up = lambda df: df.withColumn("dir", F.explode(ancestors(F.col("dir"), include_self=True)))
    rows = up(per)
    if aliases is not None:
        more = up(aliases.groupBy("dir").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("s")))
        if digests is not None:
            more = more.join(digests.where("digest IS NOT NULL").select("dir"), "dir", "left_semi")
        rows = rows.unionByName(more)
    return rows.groupBy("dir").agg(F.sum("n").alias("files"), F.sum("s").alias("bytes"))


def identical_folders(digests: DataFrame, sums: DataFrame) -> DataFrame:
    """``(digest, dir, size, n_files, copies)``: groups of folders with equal trees, without those that lie in a folder
    which is itself in a group; groups with fewer than two left are dropped."""
    many = digests.where("digest IS NOT NULL").groupBy("digest").count().where("count >= 2").select("digest")
    grouped = cut(digests.join(many, "digest", "left_semi").select("dir", "digest"))
    above = grouped.select("dir", "digest", F.explode_outer(ancestors(F.col("dir"))).alias("above"))
    covered = above.join(grouped.select(F.col("dir").alias("above")), "above", "left_semi").select("dir").distinct()
    kept = grouped.join(covered, "dir", "left_anti")
    left = kept.groupBy("digest").agg(F.count("*").alias("copies")).where("copies >= 2")
    return (
        kept.join(left, "digest")
        .join(sums, "dir", "left")
        .select("digest", "dir", F.coalesce("bytes", F.lit(0)).alias("size"), F.coalesce("files", F.lit(0)).alias("n_files"), "copies")
    )


def tree_state(folders: DataFrame) -> DataFrame:
    """``(dir, complete, mergeable)``: complete if every folder below was read wholly; mergeable if none below failed to be
    read, while deliberate omissions are allowed."""
    up = folders.select(F.explode(ancestors(F.col("dir"), include_self=True)).alias("dir"), "ok", "read_failed")
    return up.groupBy("dir").agg(F.bool_and("ok").alias("complete"), F.bool_and(F.col("ok") | ~F.col("read_failed")).alias("mergeable"))


def storage_signatures(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """``(dir, signature)``: a digest of the sorted storage places of all files below each of ``dirs``; null if one is unknown."""
    below = dirs_under(files, dirs.select(F.col("dir").alias("root")))
    up = files.join(below, "dir").select(F.col("root").alias("dir"), "storage_dev", "storage_off")
    known = F.col("storage_dev").isNotNull() & F.col("storage_off").isNotNull()
    # order-free and of fixed size: sums of two hashes over the places
    g = up.groupBy("dir").agg(
        F.bool_and(known).alias("all_known"),
        F.count("*").alias("n"),
        F.expr("sum(cast(xxhash64(storage_dev, storage_off) AS decimal(20,0)))").alias("a"),
        F.expr("sum(cast(xxhash64('s', storage_dev, storage_off) AS decimal(20,0)))").alias("b"),
    )
    return g.select("dir", F.when(F.col("all_known"), F.concat_ws(":", "n", "a", "b")).alias("signature"))


def folder_families(groups: DataFrame, signatures: DataFrame) -> DataFrame:
    """``(digest, copies, families, size, wasted)``: folders that share all their storage are one family; one of
    unknown storage is its own."""
    g = groups.join(signatures, "dir", "left").groupBy("digest").agg(
        F.count("*").alias("copies"), F.max("size").alias("size"), (F.countDistinct("signature") + F.count_if(F.col("signature").isNull())).alias("f")
    )
    families = F.least(F.greatest(F.col("f"), F.lit(1)), F.col("copies"))
    return g.select("digest", "copies", families.alias("families"), "size", (F.col("size") * (F.greatest(F.lit(1), families) - 1)).alias("wasted"))


def files_under(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The files below each root, with column ``root``: an equality join on folders, not a prefix scan."""
    return files.join(dirs_under(files, roots), "dir").select(*files.columns, "root")


def longest_root(paths: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """``paths`` with the longest of ``roots(root)`` that contains each, null if none does."""
    up = paths.select(column).distinct().select(column, F.explode(ancestors(F.col(column), include_self=True)).alias("root"))
    best = up.join(roots.select("root").distinct(), "root", "left_semi").groupBy(column).agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, column, "left")


def state_digests(folders: DataFrame, entries: DataFrame) -> DataFrame:
    """``(dir, digest)`` over the identity of every entry below a folder instead of its content: two calls tell whether anything was
    touched in between. ``entries(dir, name, size, mtime_ns, ctime_ns, dev, ino)`` may hold ``nlink``, ``mode``, ``uid`` and ``gid``, which count too,
    and more columns, which don't."""
    more = [c for c in ("nlink", "mode", "uid", "gid") if c in entries.columns]
    identity = F.to_json(F.struct("dev", "ino", "size", "mtime_ns", "ctime_ns", *more))
    return folder_digests(folders, entries.select("dir", "name", identity.alias("class_id")))


def content_digests(folders: DataFrame, entries: DataFrame) -> DataFrame:
    """``(dir, digest, files, bytes)`` by the digests of all contents, unique ones too. Hard links to one inode are hashed alike
    and count once in the bytes. ``entries(dir, name, size, dev, ino, digest)``; an entry without digest makes its folders null."""
    d = folder_digests(folders, entries.select("dir", "name", F.col("digest").alias("class_id")))
    one = entries.groupBy("dev", "ino").agg(F.min("dir").alias("dir"), F.max("size").alias("size"))
    per = entries.groupBy("dir").agg(F.count("*").alias("n"))
    up = lambda x: x.withColumn("dir", F.explode(ancestors(F.col("dir"), include_self=True)))
    files = up(per).groupBy("dir").agg(F.sum("n").alias("files"))
    # an inode counts once in every folder that holds one of its names
    held = up(entries.select("dir", "dev", "ino").distinct()).distinct().join(one.select("dev", "ino", "size"), ["dev", "ino"])
    size = held.groupBy("dir").agg(F.sum("size").alias("bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.join(files, "dir", "left").join(size, "dir", "left").select("dir", "digest", zero("files"), zero("bytes"))
