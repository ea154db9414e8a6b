"""Ingestion as Structured Streaming: debounced arrivals, flush by count or time, idempotent upserts, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import shared_folder


def route_events(events: DataFrame) -> DataFrame:
    """File events (path, kind, ts, size, target) to actions: moves count for their target, a deleted extraction is an immediate delete, a created one is ignored."""
    yaml = F.lower("path").rlike(r"\.ya?ml$")
    path = F.when(F.col("kind") == "moved", F.col("target")).otherwise(F.col("path"))
    action = F.when(yaml & (F.col("kind") == "deleted"), "delete").when(yaml & (F.col("kind") == "created"), None).when(F.col("kind") == "deleted", None).otherwise("ingest")
    return events.select(path.alias("path"), action.alias("action"), "ts", "size").where("action is not null")


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """A file once it has been quiet: a session for each path, emitted when the watermark passes its end; empty files are dropped."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), "path").agg(F.max("ts").alias("last"), F.max_by("size", "ts").alias("size"), F.count("*").alias("touches")).where("size > 0").select("path", "last", "size", "touches")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and window (an extension; sliding with slide)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """User sessions by inactivity (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark (an extension)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def enriched(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream joined to a static table (an extension)."""
    return events.join(static, key, "left")


class FlushProcessor(StatefulProcessor):
    """Collects ids by key and emits them as one batch at `most` items, or `seconds` after the first."""

    def __init__(self, most: int = 20, seconds: int = 30):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "id string")

    def _out(self, key, ids: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "n": [len(ids)], "ids": [",".join(ids)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids = [r[0] for r in self.items.get()] if self.items.exists() else []
        if not ids:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds)
        for f in rows:
            ids.extend(f["id"].astype(str))
        while len(ids) >= self.most:
            yield self._out(key, ids[: self.most])
            ids = ids[self.most :]
        self.items.clear()
        if ids:
            self.items.put([(i,) for i in ids])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids = [r[0] for r in self.items.get()] if self.items.exists() else []
        self.items.clear()
        if ids:
            yield self._out(key, ids)

    def close(self) -> None:
        pass


def flushed(stream: DataFrame, most: int = 20, seconds: int = 30) -> DataFrame:
    """stream: key, id. Batches by count or time (needs the RocksDB state store)."""
    return stream.groupBy("key").transformWithStateInPandas(FlushProcessor(most, seconds), "key string, n bigint, ids string", "append", "ProcessingTime")


def upsert_batches(path: str, key: list[str], order: list[str] | None = None):
    """A foreachBatch writer: each batch is a version of its own below the path with one row of each key, the greatest by `order` (by all other columns where none is given); replaying a batch overwrites the same version, so late or repeated delivery changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        by = F.struct(*(order or []), *[c for c in rest if c not in (order or [])])
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_row")) if rest else batch.select(*key).distinct()
        last.select(*[F.col(c) if c in key or not rest else F.col(f"_row.{c}") for c in batch.columns]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def current(spark, path: str, key: list[str]) -> DataFrame:
    """The latest version of each key over all epochs."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*key).agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, [*key, "epoch"], "left_semi").drop("epoch")


def newest(spark, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The greatest version of each key by `order` over all epochs (of equal ones the latest), so that old rows that are delivered again don't win."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in key]
    by = F.struct(*order, *[c for c in ("epoch", *rest) if c not in order])
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}") for c in rest if c != "epoch"])


def replay(parts: list[DataFrame], build, name: str = "replay") -> str:
    """Delivers the parts to a folder, one after another, each read by a stream that takes what is there and ends; the next one goes on from its checkpoint, as after a restart. build: (stream, folder for results) -> DataStreamWriter. The folder for results."""
    spark = parts[0].sparkSession
    root = shared_folder(spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        build(stream, f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{root}/out"


def finalise(steps, failures: list | None = None):
    """A foreachBatch writer that runs named steps (batch -> None) in order, each on its own; a failing step doesn't stop the others. What failed goes to `failures` as (epoch, step, error); without that list the batch fails after its last step, so that the stream doesn't go on unnoticed."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        failed = []
        try:
            for name, step in steps:
                try:
                    step(batch)
                except Exception as e:  # best effort by contract
                    failed.append((name, e))
        finally:
            batch.unpersist()
        if failures is not None:
            failures.extend((epoch, name, e) for name, e in failed)
        elif failed:
            raise RuntimeError(f"epoch {epoch}: " + "; ".join(f"step {name} failed: {e}" for name, e in failed))

    return run


class Cadence:
    """Which periodic jobs are due: state is a plain dict of last runs that the caller keeps."""

    def __init__(self, hours: dict[str, float]):
        self.hours = hours

    def due(self, state: dict[str, float], now: float) -> list[str]:
        return [k for k, h in self.hours.items() if now - state.get(k, float("-inf")) >= h * 3600]

    def ran(self, state: dict[str, float], names: list[str], now: float) -> dict[str, float]:
        return {**state, **dict.fromkeys(names, now)}
