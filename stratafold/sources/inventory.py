"""The relations of one scan, derived from the inventory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import paths as P
from stratafold.operators.changes import latest_rows
from stratafold.sources.tables import table

# Names and folders that no scan enters, and suffixes of folders that count as one item.
EXCLUDED_NAMES = [
    ".git", "node_modules", ".Trash", "__pycache__", ".Trashes", ".Spotlight-V100", ".fseventsd", ".TemporaryItems", ".DocumentRevisions-V100",
]
EXCLUDED_PREFIXES = ["/System", "/usr", "/bin", "/sbin", "/Library", "/private/var/db"]
BUNDLE_SUFFIXES = [".app", ".framework", ".bundle", ".photoslibrary", ".kext", ".plugin", ".xcodeproj", ".pkg"]
FILE_COLUMNS = [
    "path", "dir", "name", "size", "mtime_ns", "btime_ns", "ctime_ns", "dev", "ino", "class_id", "storage_dev", "storage_off", "alloc",
]


def files(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """One row per file entry: of rows delivered again the latest batch counts. Entries without path are left out. With ``columns`` only
    these are read and shuffled."""
    rows = table(spark, d, "files").where("path IS NOT NULL AND file_id IS NOT NULL")
    return latest_rows(rows, ["file_id"], ["batch_no", "scanned_at"], FILE_COLUMNS if columns is None else columns)


def shared_class(class_id: Column) -> Column:
    """Whether a class id stands for proven content (``size:digest``)."""
    return class_id.isNotNull() & ~class_id.startswith("u:")


def duplicates(rows: DataFrame) -> DataFrame:
    """The files of proven classes with a size."""
    return rows.where(shared_class(F.col("class_id")) & F.col("size").isNotNull())


def excluded(path: Column, name: Column) -> Column:
    """Whether a scan leaves an entry out by its name or place."""
    out = name.isin(EXCLUDED_NAMES)
    for prefix in EXCLUDED_PREFIXES:
        out = out | P.is_under(path, F.lit(prefix))
    return out


def companion(name: Column) -> Column:
    """Whether a file only carries another file's metadata."""
    return name.startswith("._")


def is_bundle(name: Column) -> Column:
    return F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in BUNDLE_SUFFIXES) + ")$")


def admit(rows: DataFrame, order: str = "path") -> tuple[DataFrame, DataFrame]:
    """(kept, aliases): of the entries of one inode the first by ``order`` is kept, the others name it as canonical.
    Entries without inode are each their own. A minimum per inode combines on the map side."""
    known = rows.where("dev IS NOT NULL AND ino IS NOT NULL AND ino <> 0")
    first = known.groupBy("dev", "ino").agg(F.min_by("path", order).alias("canonical"))
    marked = rows.join(first, ["dev", "ino"], "left")
    kept = marked.where("canonical IS NULL OR canonical = path").drop("canonical")
    aliases = marked.where("canonical <> path").select("dir", F.col("path").alias("alias"), "canonical")
    return kept, aliases


def folders(rows: DataFrame) -> DataFrame:
    """(dir, parent, depth, ok, read_failed) for every folder of the inventory and all its ancestors. A folder with a
    file of unknown class is incomplete, one with a file of unknown size could not be read."""
    own = rows.groupBy("dir").agg(F.bool_and(F.col("class_id").isNotNull() & F.col("size").isNotNull()).alias("ok"), F.bool_or(F.col("size").isNull()).alias("read_failed"))
    above = rows.select("dir").distinct().select(F.explode(P.ancestors(F.col("dir"))).alias("dir")).distinct()
    both = above.select("dir", F.lit(True).alias("ok"), F.lit(False).alias("read_failed")).unionByName(own)
    one = both.groupBy("dir").agg(F.bool_and("ok").alias("ok"), F.bool_or("read_failed").alias("read_failed"))
    return one.select("dir", P.dirname(F.col("dir")).alias("parent"), P.depth(F.col("dir")).alias("depth"), "ok", "read_failed")

