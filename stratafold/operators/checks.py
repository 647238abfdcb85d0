"""Constraints of saved scans and settings, and decisions that need only what is known already."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions import paths as P
from stratafold.operators.snapshots import violations

# Places that are the same folder under two names, and the folders in which they lie.
LEXICAL = {"/var": "/private/var", "/tmp": "/private/tmp", "/etc": "/private/etc"}
# Choices of a view.
DENSITIES, SCOPES = ("compact", "comfortable"), ("group", "filtered", "all_safe")


def scan_violations(relations: Mapping[str, DataFrame], roots: DataFrame | None = None) -> DataFrame:
    """``(relation, rule, path)``: every breach of the constraints within and between the relations of a saved scan: those of
    :func:`stratafold.operators.snapshots.violations` on ``files``, and that aliases name a file that exists, links and aliases lie in
    the folder they name, a folder's parent is its path's and is there, groups name files of their class, and pairs name folders.
    Relations that weren't saved are not checked. ``roots(root)`` must hold all files."""
    parts: list[DataFrame] = []

    def add(relation: str, rule: str, rows: DataFrame, path: str = "path") -> None:
        parts.append(rows.select(F.lit(relation).alias("relation"), F.lit(rule).alias("rule"), F.col(path).alias("path")))

    files, folders = relations.get("files"), relations.get("folders")
    if files is not None:
        bad = violations(files, roots)
        parts.append(bad.select(F.lit("files").alias("relation"), "rule", "path"))
    if folders is not None:
        add("folders", "folder comes once", folders.groupBy("dir").count().where("count > 1"), "dir")
        add("folders", "parent is the path's", folders.where(~F.col("parent").eqNullSafe(P.dirname(F.col("dir")))), "dir")
        held = folders.select(F.col("dir").alias("parent"))
        add("folders", "parent is there", folders.where("depth > 1").join(held, "parent", "left_anti"), "dir")
        if files is not None:
            add("files", "folder is there", files.join(folders.select("dir"), "dir", "left_anti"))
    for name, path in (("links", "path"), ("aliases", "alias")):
        if name in relations:
            rows = relations[name]
            add(name, "lies in its folder", rows.where(~F.col("dir").eqNullSafe(P.dirname(F.col(path)))), path)
    if files is not None and "aliases" in relations:
        add("aliases", "canonical file is there", relations["aliases"].join(files.select(F.col("path").alias("canonical")), "canonical", "left_anti"), "alias")
    if files is not None and "groups" in relations:
        g = relations["groups"].select("class_id", "copies")
        n = files.groupBy("class_id").agg(F.count("*").alias("n"))
        add("groups", "copies are the class's files", g.join(n, "class_id", "left").where(~F.col("n").eqNullSafe(F.col("copies"))), "class_id")
    if folders is not None and "pairs" in relations:
        named = relations["pairs"].select(F.explode(F.array("dir_a", "dir_b")).alias("dir")).distinct()
        add("pairs", "folder is there", named.join(folders.select("dir"), "dir", "left_anti"), "dir")
    if not parts:
        raise ValueError("no relation to check")
    return reduce(DataFrame.unionByName, parts)


def derived_sections(files: DataFrame, folders: DataFrame) -> dict[str, DataFrame]:
    """The relations that are rebuilt, not saved: ``class_sizes(class_id, size)`` from the class ids, ``class_members(class_id, copies)`` of
    shared classes, ``folder_files(dir, files, bytes)`` with the folders that hold none."""
    size = F.try_to_number(F.element_at(F.split("class_id", ":"), 1), F.lit("9" * 18)).cast("bigint")
    shared = files.where(F.col("class_id").rlike(r"^\d{1,18}:"))
    per = files.groupBy("dir").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return {
        "class_sizes": shared.select("class_id", size.alias("size")).distinct(),
        "class_members": shared.groupBy("class_id").agg(F.count("*").alias("copies")).where("copies >= 2"),
        "folder_files": folders.select("dir").join(per, "dir", "left").select("dir", zero("files"), zero("bytes")),
    }


def lexical_aliases(path: Column) -> Column:
    """The names of a place: its own, and the one under which the system knows it too."""
    other = F.lit(None).cast("string")
    for short, long in LEXICAL.items():
        for a, b in ((short, long), (long, short)):
            other = F.coalesce(P.rebase(path, F.lit(a), F.lit(b)), other)
    return F.array_compact(F.array(path, other))


def in_allowed_roots(rows: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """``rows`` with ``allowed``: whether the path, under either of its names, is at or below one of ``roots(root)``."""
    allowed = roots.select(F.explode(lexical_aliases(F.col("root"))).alias("root")).distinct()
    up = rows.select(column).distinct().select(column, F.explode(lexical_aliases(F.col(column))).alias("p"))
    up = up.select(column, F.explode(P.ancestors(F.col("p"), include_self=True)).alias("root"))
    inside = up.join(allowed, "root", "left_semi").select(column).distinct().withColumn("allowed", F.lit(True))
    return rows.join(inside, column, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def probe_specs(paths: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """``(path, kind, size)``: what a saved scan expects at each path: ``file`` with its size, ``dir``, or ``unknown``."""
    f = files.select("path", F.col("size").alias("s"), F.lit(True).alias("is_file")).dropDuplicates(["path"])
    d = folders.select(F.col("dir").alias("path"), F.lit(True).alias("is_dir")).distinct()
    kind = F.when(F.col("is_file"), "file").when(F.col("is_dir"), "dir").otherwise("unknown")
    return paths.select("path").distinct().join(f, "path", "left").join(d, "path", "left").select("path", kind.alias("kind"), F.when(F.col("is_file"), F.col("s")).alias("size"))


def probe_matches(specs: DataFrame, found: DataFrame) -> DataFrame:
    """``(path, matches)``: whether ``found(path, kind, size)`` is what ``specs`` expect: the same kind, of files also the same size; where
    nothing is known anything that exists will do."""
    now = found.select("path", F.col("kind").alias("k"), F.col("size").alias("s"))
    same = F.when(F.col("kind") == "unknown", F.col("k").isNotNull()).when(F.col("kind") == "dir", F.col("k") == "dir").otherwise((F.col("k") == "file") & F.col("s").eqNullSafe(F.col("size")))
    return specs.join(now, "path", "left").select("path", F.coalesce(same, F.lit(False)).alias("matches"))


def merge_root_verdicts(pairs: DataFrame, links: DataFrame | None = None, identities: DataFrame | None = None) -> DataFrame:
    """``(src, dst, verdict)`` for folders to merge: ``relative`` paths, ``link`` if either is a symbolic link (``links(path)``), ``same`` if
    they are one folder by name or by inode (``identities(path, dev, ino)``), ``nested`` if one holds the other, else ``ready``."""
    j = pairs.select("src", "dst")
    mark = lambda df, side, name: df.select(F.col("path").alias(side), F.lit(True).alias(name)).distinct()
    for side in ("src", "dst"):
        j = j.join(mark(links, side, f"{side}_link"), side, "left") if links is not None else j.withColumn(f"{side}_link", F.lit(False))
        if identities is not None:
            j = j.join(identities.select(F.col("path").alias(side), F.struct("dev", "ino").alias(f"{side}_id")), side, "left")
        else:
            j = j.withColumn(f"{side}_id", F.lit(None).cast("struct<dev:bigint,ino:bigint>"))
    absolute = F.col("src").startswith("/") & F.col("dst").startswith("/")
    nested = P.is_under(F.col("src"), F.col("dst")) | P.is_under(F.col("dst"), F.col("src"))
    verdict = (
        F.when(~F.coalesce(absolute, F.lit(False)), "relative").when(F.coalesce("src_link", F.lit(False)) | F.coalesce("dst_link", F.lit(False)), "link")
        .when((F.col("src") == F.col("dst")) | F.coalesce(F.col("src_id") == F.col("dst_id"), F.lit(False)), "same").when(nested, "nested").otherwise("ready")
    )
    return j.select("src", "dst", verdict.alias("verdict"))


def nearest_existing(paths: DataFrame, existing: DataFrame, mounted: DataFrame) -> DataFrame:
    """``(path, nearest, problem)``: the deepest of ``existing(path)`` that holds each path, and ``not mounted`` where the path lies on an
    external volume that isn't among ``mounted(volume)``."""
    up = paths.select("path").distinct().select("path", F.explode(P.ancestors(F.col("path"), include_self=True)).alias("at"))
    best = up.join(existing.select(F.col("path").alias("at")).distinct(), "at", "left_semi").groupBy("path").agg(F.max_by("at", F.length("at")).alias("nearest"))
    v = P.volume(F.col("path"))
    rows = paths.select("path").distinct().withColumn("volume", v).join(mounted.select("volume", F.lit(True).alias("here")).distinct(), "volume", "left")
    problem = F.when((F.col("volume") != "/") & F.col("here").isNull(), "not mounted")
    return rows.join(best, "path", "left").select("path", F.coalesce("nearest", F.lit("/")).alias("nearest"), problem.alias("problem"))


def bounded_paths(paths: DataFrame, most: int = 2_000, value_bytes: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` paths, one row with the counts ``total`` and ``rejected``): paths with a NUL are rejected, longer ones stand as a
    marker. The bound is the report's."""
    sound = paths.where("path IS NOT NULL AND NOT contains(path, '\\u0000')")
    shown = sound.orderBy("path").limit(most).select(F.when(F.octet_length("path") > value_bytes, "<oversized-text-omitted>").otherwise(F.col("path")).alias("path"))
    return shown, paths.agg(F.count("*").alias("total"), F.count_if(F.col("path").isNull() | F.col("path").contains("\u0000")).alias("rejected"))


def bounded_json(text: Column, most: int) -> Column:
    """A JSON text, or an object that says so if it is longer than ``most`` bytes."""
    return F.when(F.octet_length(text) <= most, text).when(text.isNotNull(), F.lit('{"truncated":true}'))


# The fields of an update manifest, those that must be there, its format and the longest summary.
MANIFEST = "schema_version bigint, version string, release_url string, summary string, published_at string"
REQUIRED, OPTIONAL = ("schema_version", "version", "release_url"), ("summary", "published_at")
MANIFEST_FORMAT, SUMMARY = 1, 8_000


def parse_manifest(text: Column) -> Column:
    """An update manifest as a struct, null unless it is valid: an object with the fields above and no others, each once, of format 1,
    with a semantic version and an https address whose host has a dot; summary and time of publication may be missing."""
    from stratafold.functions.text import https_url, semver_key

    m, keys = F.from_json(text, MANIFEST), F.json_object_keys(text)
    fields = (F.size(F.array_distinct(keys)) == F.size(keys)) & (F.size(F.array_except(keys, F.array(*map(F.lit, (*REQUIRED, *OPTIONAL))))) == 0)
    host = F.try_parse_url(m["release_url"], F.lit("HOST"))
    there = lambda name: F.array_contains(keys, name)
    summary = ~there("summary") | F.get_json_object(text, "$.summary").isNull() | (F.length(m["summary"]) <= SUMMARY) & ~m["summary"].contains("\u0000")
    at = m["published_at"].isNull() | F.try_to_timestamp(m["published_at"], F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()
    sound = fields & (m["schema_version"] == MANIFEST_FORMAT) & semver_key(m["version"]).isNotNull() & https_url(m["release_url"]) & host.contains(".") & ~host.endswith(".") & summary & at
    return F.when(F.coalesce(sound, F.lit(False)), m)


def update_available(manifest: Column, version: Column) -> Column:
    """Whether a manifest names a later version; null for an invalid manifest or version."""
    from stratafold.functions.text import semver_key

    new, old = semver_key(manifest["version"]), semver_key(version)
    return F.when(new.isNotNull() & old.isNotNull(), new > old)


def view_state(density: str, scope: str, preset: str) -> tuple[str, str, str]:
    """The choices of a view, if they are known ones; else ValueError."""
    from stratafold.operators.views import PRESETS

    for value, known in ((density, DENSITIES), (scope, SCOPES), (preset, PRESETS)):
        if value not in known:
            raise ValueError(f"unknown choice: {value!r}")
    return density, scope, preset


def same_device(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """``(*on, same)``: whether the rows of ``a`` and ``b(*on, dev)`` lie on one device; unknown ones don't."""
    j = a.select(*on, F.col("dev").alias("da")).join(b.select(*on, F.col("dev").alias("db")), list(on), "left")
    return j.select(*on, F.coalesce((F.col("da") == F.col("db")) & (F.col("da") > 0), F.lit(False)).alias("same"))
