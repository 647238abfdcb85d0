"""A scan from entries to results: what is taken in, which contents are equal, what could not be read, and the relations of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.paths import ancestors, depth, dirname
from stratafold.operators import funnel, groups, similar, tree
from stratafold.operators.views import Profile, should_include
from stratafold.session import cut
from stratafold.sources import inventory as I

# The flag of a file whose content is in the cloud only, and most messages that a result keeps.
CLOUD_ONLY = 0x40000000
ERRORS = 10_000


def cloud_only(flags: Column) -> Column:
    """Whether a file's content isn't on the disk; false for unknown flags."""
    return F.coalesce(flags.bitwiseAND(F.lit(CLOUD_ONLY)) != 0, F.lit(False))


@dataclass(frozen=True)
class Scan:
    """The relations of a scan, all written: ``files(path, dir, name, size, class_id, dev, ino, ...)`` with one path for each inode,
    ``aliases(dir, name, alias, canonical, class_id)``, ``links(dir, name, path, target)``, ``folders(dir, parent, depth, ok, read_failed)``,
    ``errors(path, message)``. ``complete`` is false for a scan that was stopped."""

    files: DataFrame
    aliases: DataFrame
    links: DataFrame
    folders: DataFrame
    errors: DataFrame
    complete: bool = True

    def duplicates(self) -> DataFrame:
        return I.duplicates(self.files)

    def file_groups(self) -> DataFrame:
        """``(class_id, size, copies, families, freeable, wasted)``; of a scan that was stopped the plain groups without families, whose
        copies count one by one."""
        if self.complete:
            return groups.storage_families(self.duplicates())
        g = groups.duplicate_groups(self.duplicates())
        return g.select("class_id", "size", "copies", F.lit(None).cast("bigint").alias("families"), F.lit(None).cast("bigint").alias("freeable"), "wasted")

    def digests(self) -> DataFrame:
        """``(dir, digest)`` with links and aliases."""
        return tree.folder_digests(self.folders, self.files, self.links, self.aliases)

    def folder_groups(self) -> DataFrame:
        """Identical folders, hard links among their files; none of a scan that was stopped."""
        digests = cut(self.digests())
        found = tree.identical_folders(digests, tree.subtree_sums(self.files, self.aliases, digests))
        return found if self.complete else found.limit(0)

    def pairs(self, ignored: DataFrame | None = None, k: int | None = similar.PAIRS, sampled: bool = True) -> DataFrame:
        """Similar folders without the pairs ``ignored(dir_a, dir_b)``, the first ``k``; none of a scan that was stopped."""
        dup = self.duplicates()
        pairs = similar.candidate_pairs(dup, self.digests(), ignored, sampled)
        parts = pairs if self.complete else pairs.limit(0), cut(similar.class_counts(dup)), tree.subtree_sums(self.files)
        return similar.score_pairs(*parts) if k is None else similar.best_pairs(*parts, k)

    def summary(self) -> DataFrame:
        """One row: files, bytes, folders, groups, their copies, waste and problems."""
        f = self.files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        g = self.file_groups().agg(F.count("*").alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"), F.coalesce(F.sum(F.greatest(F.lit(0), "wasted")), F.lit(0)).alias("wasted"))
        d = self.folders.agg(F.count("*").alias("folders"))
        e = self.errors.agg(F.count("*").alias("problems"))
        out = f
        for one in (d, g, e):
            out = out.crossJoin(F.broadcast(one))
        return out


def scan(
    entries: DataFrame,
    content: DataFrame | None = None,
    classes: DataFrame | None = None,
    profile: Profile = Profile(),
    skip_cloud: bool = True,
    complete: bool = True,
) -> Scan:
    """Scan ``entries(kind, path, dir, name, size, mtime_ns, ..., dev, ino, target, error)`` as :mod:`stratafold.sources.walk` lists them.

    Contents are told by ``content(path, content BINARY)`` through the funnel of sizes and digests, or by ``classes(path, class_id)`` that
    are known. Left out are excluded names and places, companions, what the profile doesn't take in and, with ``skip_cloud``, files
    that are in the cloud only (column ``flags``, if there is one). A folder is incomplete (``ok`` false) if it couldn't be listed, if an
    entry vanished or couldn't be read, or if something in it was left out by profile or cloud; ``read_failed`` tells failures from
    deliberate omissions. A file whose content is missing although its size occurs twice gets an error row, its own class and
    an incomplete folder. The paths of one inode are one file, the least, and its aliases. An empty table gives an empty scan.
    """
    rows = entries if "flags" in entries.columns else entries.withColumn("flags", F.lit(0))
    for c in ("storage_dev", "storage_off"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("bigint"))
    rows = rows.withColumn("is_bundle", I.is_bundle(F.col("name"))).withColumn("is_symlink", F.col("kind") == "link")
    rows = rows.where(~I.excluded(F.col("path"), F.col("name")) & ~I.companion(F.col("name")))
    rows = cut(rows)
    dirs = rows.where("kind = 'dir'")
    shut = dirs.where(~should_include(profile, directory=True)).select("path")
    below = rows.select("dir").union(dirs.select("path")).distinct().select("dir", F.explode(ancestors(F.col("dir"), include_self=True)).alias("path"))
    closed = below.join(shut, "path", "left_semi").select("dir").distinct()
    rows = rows.join(closed, "dir", "left_anti").where(~((F.col("kind") == "dir") & ~should_include(profile, directory=True)))
    cloud = cloud_only(F.col("flags")) if skip_cloud else F.lit(False)
    taken = F.when(F.col("kind").isin("file", "link"), should_include(profile) & ~cloud).otherwise(True)
    rows = rows.withColumn("taken", taken)
    kept, same = I.admit(rows.where("kind = 'file' AND taken").drop("taken"))
    kept = cut(kept)
    if classes is None:
        if content is None:
            raise ValueError("a scan needs contents or classes")
        found = funnel.classify(kept, content)
        doubled = kept.join(kept.where("size > 0").groupBy("size").count().where("count > 1"), "size", "left_semi")
        unread = doubled.join(content.select("path"), "path", "left_anti").select("path", "dir")
        files = kept.join(found.select("path", "class_id"), "path")
    else:
        files = kept.drop("class_id").join(classes.select("path", "class_id"), "path", "left")
        unread = files.where("class_id IS NULL").select("path", "dir")
        files = files.withColumn("class_id", F.coalesce("class_id", F.concat(F.lit("u:"), "path")))
    files, unread = cut(files.drop("flags", "is_bundle", "is_symlink", "kind", "target", "error")), cut(unread)
    told = rows.where("error IS NOT NULL").select("path", F.col("error").alias("message"))
    errors = cut(told.unionByName(unread.select("path", F.concat("path", F.lit(": content could not be read")).alias("message"))))
    aliases = cut(same.join(files.select(F.col("path").alias("canonical"), "class_id"), "canonical").select("dir", F.element_at(F.split("alias", "/"), -1).alias("name"), "alias", "canonical", "class_id"))
    # what isn't known of a file isn't known of its other paths either
    unknown = unread.unionByName(aliases.join(unread.select(F.col("path").alias("canonical")), "canonical", "left_semi").select(F.col("alias").alias("path"), "dir"))
    links = cut(rows.where("kind = 'link' AND taken").select("dir", "name", "path", "target"))
    return Scan(files, aliases, links, cut(_folders(rows, shut, unknown)), errors, complete)


def scan_roots(spark: SparkSession, *roots: str, profile: Profile = Profile()) -> Scan:
    """:func:`scan` of the folders ``roots``: walked level by level, contents read piece by piece and only where sizes and first bytes
    agree. Excluded entries and hard links are read too where their sizes occur twice."""
    from stratafold.sources.walk import read_classes, walk

    entries = walk(spark, *roots)
    return scan(entries, classes=read_classes(entries.where("kind = 'file'")), profile=profile)


def _folders(rows: DataFrame, shut: DataFrame, unread: DataFrame) -> DataFrame:
    """Every folder of the scan with what keeps it from being complete."""
    mark = lambda df, path, ok, failed: df.select(path.alias("dir"), ok.alias("ok"), failed.alias("read_failed"))
    yes, no = F.lit(True), F.lit(False)
    # of a subtree that isn't entered only the top makes its parent incomplete
    above_shut = shut.select("path", dirname(F.col("path")).alias("up"))
    shut = above_shut.join(shut.select(F.col("path").alias("up")), "up", "left_anti").select("path")
    fine = F.col("error").isNull()
    parts = [
        mark(rows.where("kind = 'dir'"), F.col("path"), fine, ~fine),
        mark(rows.where("kind <> 'dir'"), F.col("dir"), fine & F.col("taken"), ~fine),
        mark(shut, dirname(F.col("path")), no, no),
        mark(unread, F.col("dir"), no, yes),
    ]
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    own = own.groupBy("dir").agg(F.bool_and("ok").alias("ok"), F.bool_or("read_failed").alias("read_failed"))
    above = own.select(F.explode(ancestors(F.col("dir"))).alias("dir")).distinct()
    both = own.unionByName(mark(above, F.col("dir"), yes, no)).groupBy("dir").agg(F.bool_and("ok").alias("ok"), F.bool_or("read_failed").alias("read_failed"))
    return both.select("dir", dirname(F.col("dir")).alias("parent"), depth(F.col("dir")).alias("depth"), "ok", "read_failed")


def kept_errors(errors: DataFrame, most: int | None = ERRORS) -> tuple[DataFrame, DataFrame]:
    """(the first messages by path, one row with ``problems``, the number of all). ``most`` None keeps all."""
    total = errors.agg(F.count("*").alias("problems"))
    return (errors if most is None else errors.orderBy("path", "message").limit(most)), total


def settled_digests(files: DataFrame, hits: DataFrame) -> DataFrame:
    """``(path, kind, size, mtime_ns, ctime_ns, dev, ino, digest)`` to write back to the store of digests: the fresh digests of proven
    classes, of kind ``f``, also of files so small that their first digest settled them. What came from the store
    (``hits(path)``) and what couldn't be read isn't written."""
    fresh = files.where(I.shared_class(F.col("class_id"))).join(hits.select("path"), "path", "left_anti")
    return fresh.select("path", F.lit("f").alias("kind"), "size", "mtime_ns", "ctime_ns", "dev", "ino", F.element_at(F.split("class_id", ":"), 2).alias("digest"))


def read_parallelism(candidates: DataFrame, workers: int = 8, cap: int = 16) -> DataFrame:
    """One row ``(workers)``: how many full reads at once suit the devices that ``candidates(path, dev)`` lie on: two for each external
    volume, at most ``cap``, if all are external; else ``workers``. Spark schedules its own tasks; this is for readers outside."""
    g = candidates.agg(F.countDistinct("dev").alias("devices"), F.bool_and(F.col("path").startswith("/Volumes/")).alias("external"))
    return g.select(F.when(F.col("external"), F.least(F.lit(cap), F.col("devices") * 2)).otherwise(F.lit(workers)).cast("bigint").alias("workers"))
