"""A folder tree as a table: a Python data source with inodes and links, which the binary file source lacks."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratafold.operators.funnel import EMPTY, PROBE, shared
from stratafold.session import cut, is_empty
from stratafold.sources.inventory import EXCLUDED_NAMES, EXCLUDED_PREFIXES

SCHEMA = (
    "kind string, path string, dir string, name string, size bigint, mtime_ns bigint, btime_ns bigint, ctime_ns bigint, dev bigint, ino bigint, alloc bigint, target string, error string"
)


class _Slice(InputPartition):
    def __init__(self, folder: str, deep: bool) -> None:
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    """Folders down to ``depth`` are listed on the driver and become one partition each; the tasks walk what lies below."""

    def __init__(self, options) -> None:
        self.roots = [os.path.realpath(r) for r in options.get("roots", options.get("path", "")).split(os.pathsep) if r]
        self.depth = int(options.get("depth", "1"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        level = list(self.roots)
        for _ in range(self.depth):
            below: list[str] = []
            for folder in level:
                out.append(_Slice(folder, False))
                try:
                    with os.scandir(folder) as entries:
                        below += [e.path for e in entries if e.is_dir(follow_symlinks=False) and not _left_out(e.path, e.name)]
                except OSError:
                    pass  # its partition reports it
            level = below
        return out + [_Slice(folder, True) for folder in level]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        pending = [partition.folder]
        while pending:
            for *row, down in self.listed(pending.pop()):
                if not down:
                    yield tuple(row)
                elif partition.deep:
                    pending.append(row[1])

    def listed(self, folder: str) -> Iterator[tuple]:
        """A row for the folder and each of its entries; the last value says whether it is a folder to go down into."""
        failure = None
        try:
            with os.scandir(folder) as listing:
                entries = sorted(listing, key=lambda e: e.name)
        except OSError as error:
            entries, failure = [], f"{folder}: {error.strerror}"
        yield *_row("dir", folder, None, error=failure), False
        for e in entries:
            row = self._entry(e)
            if row == "down":
                yield *_row("dir", e.path, None), True
            elif row is not None:
                yield *row, False

    @staticmethod
    def _entry(e: os.DirEntry):
        if _left_out(e.path, e.name):
            return None
        try:
            if e.is_symlink():
                return _row("link", e.path, e.stat(follow_symlinks=False), target=os.readlink(e.path))
            s = e.stat(follow_symlinks=False)
        except FileNotFoundError:
            return _row("phantom", e.path, None, error=f"{e.path}: listed but missing")
        except OSError as error:
            return _row("error", e.path, None, error=f"{e.path}: {error.strerror}")
        if stat.S_ISDIR(s.st_mode):
            return "down"
        if stat.S_ISREG(s.st_mode) and not e.name.startswith("._"):
            return _row("file", e.path, s)
        return None


def _left_out(path: str, name: str) -> bool:
    return name in EXCLUDED_NAMES or any(path == p or path.startswith(p + "/") for p in EXCLUDED_PREFIXES)


def _row(kind: str, path: str, s: os.stat_result | None, target: str | None = None, error: str | None = None) -> tuple:
    birth = int(getattr(s, "st_birthtime", 0) * 1e9) if s else None
    numbers = (s.st_size, s.st_mtime_ns, birth, s.st_ctime_ns, s.st_dev, s.st_ino, getattr(s, "st_blocks", 0) * 512) if s else (None,) * 7
    return (kind, path, os.path.dirname(path), os.path.basename(path), *numbers, target, error)


class TreeSource(DataSource):
    """``spark.read.format("tree").option("roots", "/a:/b").load()``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, *roots: str, depth: int = 1) -> DataFrame:
    """All entries below ``roots``; nested roots are read once."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("roots", os.pathsep.join(top_roots(roots))).option("depth", str(depth)).load()


def top_roots(roots) -> list[str]:
    """Existing folders among ``roots``, each once, without those below another one; shallow ones first."""
    kept: list[str] = []
    seen: set[tuple[int, int]] = set()
    real = sorted({os.path.realpath(r) for r in roots if os.path.isdir(r)}, key=lambda p: (p.count("/"), p.casefold()))
    for r in real:
        s = os.stat(r)
        if (s.st_dev, s.st_ino) not in seen and not any(r == k or r.startswith(k.rstrip("/") + "/") for k in kept):
            seen.add((s.st_dev, s.st_ino))
            kept.append(r)
    return kept


def read_content(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, content): file bytes; the source reads no content for columns or rows that a plan leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"file://{r}" for r in roots])
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")


def walk(spark: SparkSession, *roots: str) -> DataFrame:
    """As :func:`read_tree`, level by level: the folders of a level are listed by tasks, however many there are, and written with what
    they hold; those found become the next level. No folder is listed by the driver, and a deep or wide branch is split up
    again on every level. The folders must be on storage that all executors see."""
    level = spark.createDataFrame([(r,) for r in top_roots(roots)], "path string")
    schema = f"{SCHEMA}, down boolean"
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    reader = TreeReader({"roots": ""})

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(n, pa.bool_() if n == "down" else pa.int64() if n in _NUMBERS else pa.string()) for n in names])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(reader.listed(folder))
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*part))], schema=kinds)

    levels: list[DataFrame] = []
    while True:
        # folders next to each other often have one owner, so they are mixed over the tasks
        here = cut(level.repartition("path").mapInArrow(listing, schema))
        levels.append(here.where("NOT down").drop("down"))
        level = here.where("down").select("path")
        if is_empty(level):
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


_NUMBERS = ("size", "mtime_ns", "btime_ns", "ctime_ns", "dev", "ino", "alloc")
#: Bytes that are read at once.
CHUNK = 1 << 20
DIGESTS = "path string, digest string, size bigint, mtime_ns bigint, ctime_ns bigint, dev bigint, ino bigint, error string"


def read_digests(paths: DataFrame, most: int | None = None) -> DataFrame:
    """``(path, digest, size, mtime_ns, ctime_ns, dev, ino, error)`` of ``paths(path)``: the SHA-256 of each file as it is now, read piece by piece,
    so that files of any size do; with ``most`` of its first bytes only. Of a symbolic link its target's text is digested. A file that
    changes while it is read, can't be read or isn't there has an error and no digest. Repeated paths are read once."""

    def one(path: str) -> tuple:
        try:
            before = os.lstat(path)
            h = hashlib.sha256()
            if stat.S_ISLNK(before.st_mode):
                h.update(os.fsencode(os.readlink(path)))
            elif stat.S_ISREG(before.st_mode):
                left = before.st_size if most is None else most
                with open(path, "rb") as f:
                    while left > 0 and (piece := f.read(min(CHUNK, left))):
                        h.update(piece)
                        left -= len(piece)
            else:
                return (path, *(None,) * 6, "no regular file")
            after = os.lstat(path)
        except OSError as error:
            return (path, *(None,) * 6, error.strerror or str(error))
        identity = lambda s: (s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_dev, s.st_ino)
        same = identity(before) == identity(after)
        return (path, h.hexdigest() if same else None, *identity(after), None if same else "changed while it was read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.string()]
        for batch in batches:
            columns = list(zip(*map(one, batch.column(0).to_pylist()))) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    asked = paths.where("path IS NOT NULL").select("path").distinct()
    return asked.repartition("path").mapInArrow(run, DIGESTS)


def read_classes(files: DataFrame) -> DataFrame:
    """``(path, class_id)`` of ``files(path, size)`` by the funnel of :mod:`stratafold.operators.funnel`, whose digests are read piece by piece: first
    bytes of files that share their size, all bytes of those that share these too. Null for files that couldn't be read."""
    rows = files.select("path", "size").distinct()
    heads = cut(read_digests(shared(rows.where("size > 0"), "size"), PROBE).select("path", F.col("digest").alias("probe")))
    probed = rows.join(heads, "path")
    alike = cut(shared(probed.where("probe IS NOT NULL"), "size", "probe"))
    whole = read_digests(alike.where(F.col("size") > PROBE)).select("path", "digest")
    small = alike.where(F.col("size") <= PROBE).select("path", F.col("probe").alias("digest"))
    full = cut(alike.select("path", "size").join(small.unionByName(whole), "path"))
    proven = shared(full.where("digest IS NOT NULL"), "size", "digest").select("path", "digest")
    failed = heads.where("probe IS NULL").select("path").union(full.where("digest IS NULL").select("path")).withColumn("failed", F.lit(True))
    digests = proven.unionByName(rows.where("size = 0").select("path", F.lit(EMPTY).alias("digest")))
    known = F.when(F.col("digest").isNotNull(), F.concat_ws(":", F.col("size").cast("string"), "digest")).when(F.col("failed").isNull(), F.concat(F.lit("u:"), "path"))
    return rows.join(digests, "path", "left").join(failed, "path", "left").select("path", known.alias("class_id"))
