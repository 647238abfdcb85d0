"""Lineage cuts in shared storage, and small helpers on the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()
#: Rows that a bucket of a kept table holds at least, where their number is known.
BUCKET = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a fresh temporary one in local mode; a
    cluster must name one."""
    setting = "spark.checkpoint.dir"
    path = spark.conf.get(setting, None) or spark.sparkContext.getConf().get(setting) or spark.conf.get("stratafold.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {setting} to a folder that all executors share")
        path = "file://" + _temporary()
        spark.conf.set("stratafold.scratch", path)
    return path.rstrip("/")


def _temporary() -> str:
    """A folder of this process, deleted at its end."""
    path = tempfile.mkdtemp(prefix="stratafold-")
    atexit.register(shutil.rmtree, path, True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: its lineage ends there, and it survives the loss
    of executors. The columns keep their names and types."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratafold_path = path
    return out


def cut_by(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """:func:`cut` in a layout that later joins and aggregations on ``column`` use as it is: hashed into as many buckets as there
    are shuffle partitions, each one sorted file; into fewer, but one a core at least, if the number of ``rows`` is known and small. Reading
    it again for a join on ``column`` shuffles and sorts nothing."""
    spark = df.sparkSession
    name = f"stratafold_{uuid.uuid4().hex}"
    path = f"{_own_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        n = min(n, max(spark.sparkContext.defaultParallelism, rows // BUCKET + 1))
    df.repartition(n, column).sortWithinPartitions(column).write.format("parquet").bucketBy(n, column).sortBy(column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._stratafold_path, out._stratafold_table = path, name
    return out


def _own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/stratafold/{spark.sparkContext.applicationId}"
    if path not in _own:
        _own.add(path)
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; its tables stay in the shared folder then
        pass


def clear(spark: SparkSession) -> None:
    """Delete all tables that :func:`cut` wrote in this application; results not yet written can't be computed after that."""
    _delete(spark, _own_dir(spark))


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later plan reads."""
    for df in tables:
        path, name = getattr(df, "_stratafold_path", None), getattr(df, "_stratafold_table", None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            _delete(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it has fewer input splits than there are cores (a few small files); else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_empty(df: DataFrame) -> bool:
    return len(df.head(1)) == 0


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, where their path may lack it."""
    sc = spark.sparkContext
    if getattr(sc, "_stratafold_shipped", False):
        return
    base = Path(__file__).resolve().parent.parent
    if base.is_dir():
        target = Path(_temporary()) / "stratafold.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted((base / "stratafold").rglob("*.py")):
                z.write(p, p.relative_to(base))
        sc.addPyFile(str(target))
    sc._stratafold_shipped = True


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """All jobs started in this block can be ended by :func:`cancel` from another thread; what was written before stays."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End the jobs of :func:`cancellable` blocks with this tag."""
    spark.sparkContext.cancelJobsWithTag(tag)
