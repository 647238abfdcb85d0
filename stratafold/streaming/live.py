"""Structured Streaming forms: incremental inventories and stateful streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratafold.operators.funnel import cached_digests
from stratafold.sources.stores import read_cache, upsert_cache
from stratafold.streaming.folds import remaining_of_batch


def stream_inventory(spark: SparkSession, folder: str, schema: Any, files_per_trigger: int = 8) -> DataFrame:
    """New inventory files in a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def incremental_rescan(stream: DataFrame, cache_folder: str, digest: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, kind: str = "f") -> StreamingQuery:
    """Classify each batch with the digest store: only files whose identity changed are digested, by ``digest(misses)``, which adds
    a column ``digest``; the store is brought up to date, results are appended to ``out`` under their batch number, which
    makes a repeated batch overwrite itself."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        cache = read_cache(rows.sparkSession, cache_folder)
        hits, misses = cached_digests(rows, cache, kind)
        fresh = digest(misses).persist()
        hits.withColumn("hit", F.lit(True)).unionByName(fresh.withColumn("hit", F.lit(False))).write.mode("overwrite").parquet(f"{out}/batch={number}")
        added = fresh.select("path", F.lit(kind).alias("kind"), "size", "mtime_ns", "ctime_ns", "dev", "ino", F.lit(0).cast("bigint").alias("accessed_ns"), "digest")
        upsert_cache(added, cache_folder)
        fresh.unpersist()
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful_fold(stream: DataFrame, key: str, order: list[str], start: Callable[[], Any], fields: list[str], step: Callable[[Any, Any], Any], out: str) -> DataFrame:
    """Each stream's operator state kept between batches: ``start()`` makes it, ``fields`` are its plain attributes to keep,
    ``step(state, row)`` gives the value of ``out`` ("name type") for each row. Rows of a batch are taken in ``order``, for which a
    key's rows of one batch are held in memory; the source's limit for a trigger bounds them. With an empty ``order`` they are taken as they
    come, piece by piece."""
    import pickle

    name = out.split()[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + f", {out}"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = start()
        if state.exists:
            for f, v in zip(fields, pickle.loads(state.get[0])):
                setattr(fold, f, v)
        parts = [pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")] if order else batches
        for rows in parts:
            values = [step(fold, r) for r in rows.itertuples(index=False)]
            yield rows.assign(**{name: pd.Series(values, index=rows.index, dtype=object)})
        state.update((pickle.dumps([getattr(fold, f) for f in fields]),))

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def remaining_stream(stream: DataFrame, key: str, t: str, done: str, total: str) -> DataFrame:
    """``(key, t, done, total, remaining)``: :func:`stratafold.streaming.folds.remaining_time` over a stream. The state of a key is a
    dozen readings at most. Rows with a null time or count are no readings and give none."""
    import pickle

    kind = lambda c: stream.schema[c].dataType.simpleString()
    schema = f"`{key}` {kind(key)}, t double, done bigint, total bigint, remaining double"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "done"], kind="stable", ignore_index=True)
        kept = pickle.loads(state.get[0]) if state.exists else rows.iloc[:0]
        left, keep = remaining_of_batch(kept[["t", "done", "total"]], rows[["t", "done", "total"]])
        state.update((pickle.dumps(keep),))
        yield pd.DataFrame({key: [k[0]] * len(rows), "t": rows["t"], "done": rows["done"], "total": rows["total"], "remaining": left})

    rows = stream.select(key, F.col(t).cast("double").alias("t"), F.col(done).cast("bigint").alias("done"), F.col(total).cast("bigint").alias("total"))
    return rows.dropna(subset=["t", "done", "total"]).groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def windowed_activity(stream: DataFrame, time: str, key: str, value: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Readings and their sum per key and window; a window is final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("readings"), F.sum(value).alias("total"))
