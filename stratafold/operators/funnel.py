"""Content classes by a cascade of ever dearer keys: size, digest of the first bytes, digest of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the first digest.
PROBE = 131_072
# Fixed value: SHA-256 of nothing, the class of all empty files.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur more than once. The counts combine on the map side."""
    many = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    return rows.join(many, list(keys), "left_semi")


def classify(inventory: DataFrame, content: DataFrame, ident: str = "path") -> DataFrame:
    """``(ident, size, digest, class_id)`` for every row of ``inventory(ident, size)``.

    ``content(ident, content BINARY)`` is read only for sizes that occur twice, and digested wholly only where the first
    ``PROBE`` bytes agree too; up to that length the first digest is the whole one. A class of one file is unique:
    its digest is null and its id ``u:<ident>``. All empty files share one class, even a single one. Files whose content is
    missing (unreadable) are unique.
    """
    rows = inventory.select(ident, "size")
    candidates = shared(rows.where("size > 0"), "size")
    read = candidates.join(content.select(ident, "content"), ident)
    probed = read.select(ident, "size", "content", F.sha2(F.substring("content", 1, PROBE), 256).alias("probe"))
    same_head = shared(probed, "size", "probe")
    full = F.when(F.col("size") <= PROBE, F.col("probe")).otherwise(F.sha2("content", 256))
    proven = shared(same_head.select(ident, "size", full.alias("digest")), "size", "digest")
    digests = proven.select(ident, "digest").unionByName(rows.where("size = 0").select(ident, F.lit(EMPTY).alias("digest")))
    out = rows.join(digests, ident, "left")
    unique = F.concat(F.lit("u:"), F.col(ident).cast("string"))
    return out.withColumn("class_id", F.when(F.col("digest").isNull(), unique).otherwise(F.concat_ws(":", F.col("size").cast("string"), "digest")))


def cached_digests(current: DataFrame, cache: DataFrame, kind: str = "f") -> tuple[DataFrame, DataFrame]:
    """(hits with their digest, misses): a cached digest holds while path, size, mtime, ctime, dev and ino are the same;
    of old rows without device only size and mtime are compared."""
    old = cache.where(F.col("kind") == kind).select("path", "digest", *[F.col(c).alias(f"c_{c}") for c in ("size", "mtime_ns", "ctime_ns", "dev", "ino")])
    basic = F.col("size").eqNullSafe(F.col("c_size")) & F.col("mtime_ns").eqNullSafe(F.col("c_mtime_ns"))
    exact = F.col("ctime_ns").eqNullSafe(F.col("c_ctime_ns")) & F.col("dev").eqNullSafe(F.col("c_dev")) & F.col("ino").eqNullSafe(F.col("c_ino"))
    joined = current.join(old, "path", "left")
    valid = F.col("digest").isNotNull() & basic & ((F.col("c_dev") == 0) | exact)
    marked = joined.withColumn("hit", F.coalesce(valid, F.lit(False)))
    return marked.where("hit").select(*current.columns, "digest"), marked.where("NOT hit").select(*current.columns)
