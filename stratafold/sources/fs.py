"""Small files and folders through Spark's own file systems, so that stores work on a cluster's storage as on a local disk."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's direct entries, in order; none of a folder that isn't there."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str, most: int = 1 << 26) -> str:
    """The text of a small file; ValueError for one of more than ``most`` bytes, of which nothing is read."""
    fs, p = _at(spark, path)
    if fs.getFileStatus(p).getLen() > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all: beside its place first, then renamed."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        fs.delete(beside, False)
        raise OSError(f"can't write {path}")


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.delete(p, True))
