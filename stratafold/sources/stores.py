"""Stores of digests, saved scans and removals as Parquet, and files of settings."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators.checks import scan_violations
from stratafold.sources import fs

CACHE_KEY = ["path", "kind"]
FORMAT = 1
#: Written parts of the digest store that are merged into one when a further one comes.
PARTS = 16


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """Finished parts of the digest store from the last whole one on, in the order they were written."""
    done = [n for n in fs.names(spark, folder) if n[0] in "vw" and fs.exists(spark, f"{folder}/{n}/_SUCCESS")]
    done.sort(key=lambda n: n[1:])
    whole = [k for k, n in enumerate(done) if n[0] == "w"]
    return done[whole[-1] :] if whole else done


def _latest(rows: DataFrame) -> DataFrame:
    values = [c for c in rows.columns if c not in (*CACHE_KEY, "part_no")]
    best = rows.groupBy(*CACHE_KEY).agg(F.max(F.struct("part_no", "accessed_ns", *[v for v in values if v != "accessed_ns"])).alias("r"))
    return best.select(*CACHE_KEY, *[F.col("r")[v].alias(v) for v in values])


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The digest store: of each path and kind the row written last."""
    parts = _parts(spark, folder)
    if not parts:
        raise FileNotFoundError(folder)
    return _latest(spark.read.parquet(*[f"{folder}/{n}" for n in parts]))


def upsert_cache(new: DataFrame, folder: str) -> str:
    """Add ``new`` to the store: its rows replace those of the same path and kind (of several in ``new`` the one accessed last counts).
    Only these rows are written; after ``PARTS`` such parts the store is written anew, and the former parts stay until
    readers are done with them."""
    spark = new.sparkSession
    number = time.time_ns()
    target = f"{folder}/v{number:020d}"
    new.withColumn("part_no", F.lit(number)).write.mode("errorifexists").parquet(target)
    if len(_parts(spark, folder)) > PARTS:
        number = time.time_ns()
        target = f"{folder}/w{number:020d}"
        read_cache(spark, folder).withColumn("part_no", F.lit(number)).write.mode("errorifexists").parquet(target)
    return target


def save_scan(relations: Mapping[str, DataFrame], folder: str, meta: Mapping[str, object] | None = None) -> str:
    """Save the relations of a scan; the header comes last, so a scan without one was never finished."""
    at = f"{folder}/scan-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    spark = next(iter(relations.values())).sparkSession
    for name, df in relations.items():
        df.write.mode("errorifexists").parquet(f"{at}/{name}")
    header = dict(meta or {}) | {"format": FORMAT, "created_ns": time.time_ns(), "relations": sorted(relations)}
    fs.write_text(spark, f"{at}/header.json", json.dumps(header, ensure_ascii=False, sort_keys=True))
    return at


def list_scans(spark: SparkSession, folder: str) -> list[dict]:
    """Headers of finished scans, newest first; broken ones are left out."""
    out = []
    for name in fs.names(spark, folder):
        at = f"{folder}/{name}"
        if not name.startswith("scan-") or not fs.exists(spark, f"{at}/header.json"):
            continue
        try:
            header = json.loads(fs.read_text(spark, f"{at}/header.json"))
        except ValueError:
            continue
        if header.get("format") == FORMAT:
            out.append(header | {"path": at})
    return sorted(out, key=lambda h: -h["created_ns"])


def load_scan(spark: SparkSession, at: str, check: bool = True) -> dict[str, DataFrame]:
    """The relations of a saved scan. With ``check`` a scan that breaches its constraints, within or between relations, is refused."""
    header = json.loads(fs.read_text(spark, f"{at}/header.json"))
    if header.get("format") != FORMAT:
        raise ValueError(f"unknown format of a saved scan: {header.get('format')}")
    relations = {name: spark.read.parquet(f"{at}/{name}") for name in header["relations"]}
    if check and "files" in relations:
        bad = scan_violations(relations).head(1)
        if bad:
            raise ValueError(f"saved scan is invalid: {bad[0]['rule']}: {bad[0]['path']}")
    return relations


def import_scan(spark: SparkSession, source: str, folder: str) -> str:
    """Take a scan saved elsewhere into the store ``folder``, if it is valid; its place there."""
    header = json.loads(fs.read_text(spark, f"{source}/header.json"))
    meta = {k: v for k, v in header.items() if k not in ("format", "created_ns", "relations")}
    return save_scan(load_scan(spark, source), folder, meta | {"imported_from": source})


def export_scan(spark: SparkSession, at: str, folder: str) -> str:
    """Write a valid saved scan to another folder; its place there."""
    header = json.loads(fs.read_text(spark, f"{at}/header.json"))
    meta = {k: v for k, v in header.items() if k not in ("format", "created_ns", "relations")}
    return save_scan(load_scan(spark, at), folder, meta)


def delete_scan(spark: SparkSession, folder: str, at: str) -> bool:
    """Delete a saved scan of the store ``folder``: the header first, so that a deletion which fails leaves no scan that looks finished.
    ValueError for a place that isn't a scan of this store."""
    name = at.rstrip("/").rsplit("/", 1)[-1]
    if at.rstrip("/") != f"{folder.rstrip('/')}/{name}" or not name.startswith("scan-"):
        raise ValueError(f"not a scan of this store: {at}")
    return fs.delete(spark, f"{at}/header.json") and fs.delete(spark, at)


@contextmanager
def atomic_file(path: str) -> Iterator[IO[str]]:
    """A text file on the driver's disk that appears whole or not at all, written piece by piece."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_atomically(path: str, text: str) -> None:
    """Write a small file of the driver whole or not at all."""
    with atomic_file(path) as f:
        f.write(text)


class SettingsStore:
    """Named settings in one JSON file of the driver: the default first, then by folded name; names differ in more than case."""

    def __init__(self, path: str, default: Mapping[str, object], most: int = 100) -> None:
        self.path, self.default, self.most = path, dict(default), most

    def _read(self) -> dict[str, dict]:
        try:
            return json.loads(Path(self.path).read_text())
        except FileNotFoundError:
            return {}

    def names(self) -> list[str]:
        return ["default", *sorted(self._read(), key=str.casefold)]

    def load(self, name: str) -> dict:
        if name.casefold() == "default":
            return dict(self.default)
        for known, value in self._read().items():
            if known.casefold() == name.casefold():
                return value
        raise KeyError(name)

    def save(self, name: str, value: Mapping[str, object]) -> None:
        if not name.strip() or name.casefold() == "default":
            raise ValueError("the default can't be replaced")
        kept = {k: v for k, v in self._read().items() if k.casefold() != name.casefold()}
        if len(kept) >= self.most:
            raise ValueError(f"more than {self.most} settings")
        write_atomically(self.path, json.dumps(kept | {name: dict(value)}, ensure_ascii=False, sort_keys=True))

    def delete(self, name: str) -> None:
        if name.casefold() == "default":
            raise ValueError("the default can't be deleted")
        write_atomically(self.path, json.dumps({k: v for k, v in self._read().items() if k.casefold() != name.casefold()}, ensure_ascii=False, sort_keys=True))
