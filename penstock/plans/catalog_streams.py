"""Catalog, fifth part: streams over the events, delivered in parts, some late, some twice; each result equals that of a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .catalog import query

_PARTS = 5


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,6)").alias("value"))


def _parts(e):
    """Six days each."""
    k = F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(_PARTS - 1))
    return [e.where(k == i) for i in range(_PARTS)]


_EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,6)) AS value FROM events)"


@query(f"WITH {_EVENTS} SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM e WHERE NOT (event_id % 50 = 0 AND day(ts) <= 12) GROUP BY ALL")
def stream_event_windows(s, d):
    """Hourly windows kept up to date by upserts; what comes weeks late is dropped by the watermark."""
    e = _events(s, d)
    late = (F.col("event_id") % 50 == 0) & (F.dayofmonth("ts") <= 12)
    key = ["start", "event_type"]

    def build(stream, out):
        return streams.tumbling(stream).writeStream.outputMode("update").foreachBatch(streams.upsert_batches(out, key))

    out = streams.replay([*_parts(e.where(~late)), e.where(late)], build, "windows")
    return streams.current(s, out, key).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query(f"WITH {_EVENTS} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM e GROUP BY 1")
def stream_newest_events(s, d):
    """The newest event of each user, from parts that come out of order, one of them twice."""
    p = _parts(_events(s, d))

    def build(stream, out):
        return stream.select("user_id", "event_id", "ts").writeStream.foreachBatch(streams.upsert_batches(out, ["user_id"], ["ts", "event_id"]))

    out = streams.replay([p[2], p[0], p[4], p[1], p[3], p[2]], build, "newest")
    return streams.newest(s, out, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"WITH {_EVENTS} SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM e GROUP BY 1")
def stream_distinct_events(s, d):
    """Every event counts once, though each part is delivered again with the next."""
    p = _parts(_events(s, d))
    again = [p[0], *[a.unionByName(b) for a, b in zip(p, p[1:], strict=False)], p[4]]

    def build(stream, out):
        return streams.distinct_events(stream).writeStream.outputMode("append").format("parquet").option("path", out)

    out = s.read.parquet(streams.replay(again, build, "distinct"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query(
    f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 hour THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT 'file ' || user_id AS path, max(ts) AS last, arg_max(event_id, ts) + 1 AS size, count(*) AS touches FROM r GROUP BY user_id, run"""
)
def stream_quiet_files(s, d):
    """Files (a user's events) once they have been quiet for two hours; bursts reach over the parts."""
    e = _events(s, d).select(F.concat(F.lit("file "), "user_id").alias("path"), "ts", (F.col("event_id") + 1).alias("size"))
    end = e.agg(F.max("ts").alias("ts"))
    bell = [end.select(F.lit("bell").alias("path"), (F.col("ts") + F.expr(f"interval {k} days")).alias("ts"), F.lit(1).cast("bigint").alias("size")) for k in (2, 4)]

    def build(stream, out):
        return streams.debounced(stream, "2 hours").writeStream.outputMode("append").format("parquet").option("path", out)

    out = s.read.parquet(streams.replay([*_parts(e), *bell], build, "quiet"))
    return out.where("path <> 'bell'").select("path", F.col("last").cast("timestamp_ntz").alias("last"), "size", "touches")
