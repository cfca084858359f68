"""Case lifecycle over event streams, with late data and bounded state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import lifecycle as L
from tallyline.sources.derived import BASE
from tallyline.sources.sinks import UpsertLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """Raw events as a file stream whose micro-batches are limited in size.

    Event time is cast to TIMESTAMP, which watermarks need.
    """
    reader = spark.readStream.schema(BASE["events"]).option("pathGlobFilter", "events*.parquet")
    reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def metrics(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Windowed counts; rows later than ``delay`` behind the newest event are dropped."""
    return L.lifecycle_metrics(events.withWatermark("ts", delay), window)


def earliest(rows: DataFrame, keys: tuple[str, ...], time: str, values: tuple[str, ...], delay: str, keep_minutes: int) -> DataFrame:
    """The earliest row per key and tumbling window of ``keep_minutes``; ties fall to the smallest event_id.

    State holds one row per key and window until the watermark passes the window, so it stays bounded however many
    keys come. ``first_of`` takes the first window of a key from the table this leaves.
    """
    first = F.struct(time, "event_id")
    per = rows.withWatermark(time, delay).groupBy(*keys, F.window(time, f"{int(keep_minutes)} minutes").alias("w"))
    found = per.agg(*[F.min_by(v, first).alias(v) for v in values], F.min(time).alias(time))
    return found.select(*keys, F.col("w.start").alias("window_start"), *values, time)


def first_of(windows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key out of a table of ``earliest``: windows do not overlap, so the first one holds the earliest row."""
    rest = [c for c in windows.columns if c not in (*keys, "window_start")]
    return windows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "window_start").alias("first")).select(*keys, "first.*")


def dedupe_submissions(submissions: DataFrame, delay: str = "24 hours", keep_minutes: int = 24 * 60) -> DataFrame:
    """The earliest submission per idempotency key and window, with its case (see ``earliest``)."""
    return earliest(submissions, ("idempotency_key",), "created_at", ("case_id",), delay, keep_minutes)


def idempotent_stages(results: DataFrame, delay: str = "24 hours", keep_minutes: int = 24 * 60) -> DataFrame:
    """The first written result per case, stage and window (see ``earliest``)."""
    return earliest(results, ("case_id", "stage"), "completed_at", ("output",), delay, keep_minutes)


SETTLE = pd.Timedelta("1 minute")
TICK = "INTERVAL 1 MICROSECOND"


def sessions(events: DataFrame, gap_minutes: int = 10, delay: str = "1 hour") -> DataFrame:
    """Bursts of events per case with ``gap_minutes`` of silence after them, put out once the watermark has passed them.

    For append mode. ``open_bursts`` reads those that still wait. An event exactly ``gap_minutes`` after the last one
    starts a new burst; session windows that touch are merged, so the gap is a microsecond shorter.
    """
    ended = F.coalesce(F.col("to_status").isin(*L.TERMINAL), F.lit(False)).cast("int")
    burst = F.session_window("ts", f"{int(gap_minutes) * 60_000_000 - 1} microseconds").alias("w")
    per = events.withWatermark("ts", delay).groupBy("case_id", burst).agg(F.count("*").alias("events"), F.sum(ended).alias("terminal_events"))
    closed = F.col("w.end") + F.expr(TICK)
    return per.select("case_id", "events", "terminal_events", F.col("w.start").alias("started_at"), closed.alias("closed_at"))


def open_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """The bursts that a stream of ``sessions`` still holds as state, as they stand after its last micro-batch."""
    held = spark.read.format("statestore").load(f"{folder}/checkpoint").select("value.*")
    closed = F.col("session_window.end") + F.expr(TICK)
    return held.select(
        "case_id", F.col("count").alias("events"), F.col("sum").alias("terminal_events"),
        F.col("session_window.start").alias("started_at"), closed.alias("closed_at"),
    )


def all_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Closed bursts from the table of a stream of ``sessions``, open ones from its state. A burst is in one of the two.

    To be read while the stream stands still: a running one may close a burst between the two readings.
    """
    return table(spark, folder, ("case_id", "started_at")).unionByName(open_bursts(spark, folder))


@dataclass(frozen=True)
class Parts:
    """A stream that puts out parts of its answer, the newest row of a key each, and how a reader makes the whole of them.

    Stateful streams cannot be chained in update mode; so one keeps what lies together in time, and ``table`` puts a case together.
    """

    rows: DataFrame
    whole: Callable[[DataFrame], DataFrame]


def _per_bucket(events: DataFrame, item: Column, minutes: int, delay: str) -> DataFrame:
    """(case_id, bucket, held, last): the items of a case in each time bucket of ``minutes``, and the latest time among them.

    Runs in the JVM. The watermark is that of buckets: no row at most ``delay`` behind the newest is lost, and a
    bucket leaves the state at the latest when the newest row lies ``delay`` and two buckets after its start. Rows without a
    time are never late; they stay.
    """
    width = int(minutes) * 60_000_000
    us = F.unix_micros("ts")
    behind = pd.Timedelta(delay) // pd.Timedelta("1us") + width
    rows = events.select("case_id", F.timestamp_micros(us - F.pmod(us, F.lit(width))).alias("bucket"), item.alias("item"), "ts")
    per = rows.withWatermark("bucket", f"{behind} microseconds").groupBy("case_id", "bucket")
    return per.agg(F.collect_list("item").alias("held"), F.max("ts").alias("last"))


def guarded_transitions(events: DataFrame, delay: str = "1 hour", bucket_minutes: int = 60) -> Parts:
    """State per case, whatever the order of arrival within ``delay``.

    The state holds the events of a case and time bucket until the watermark has passed it; put out is what they make of
    each state a case may come in with (``L.map_number``). A micro-batch folds only the buckets it has rows for.
    """
    item = F.struct("ts", F.col("event_id").cast("bigint").alias("event_id"), L.event_steps().alias("step"))
    per = _per_bucket(events, item, bucket_minutes, delay)
    return Parts(per.select("case_id", "bucket", L.map_number("held").alias("number"), F.size("held").cast("bigint").alias("events")), L.case_states)


def reap_stuck(events: DataFrame, minutes: int = 15, delay: str = "1 minute") -> Parts:
    """Cases that reach no terminal state within ``minutes`` of event time of their first event.

    A time-out stands once the newest event is a minute past the limit (``delay`` past it, if that is less), and
    events later than that, but within ``delay``, may take it back. The state holds the events of a case and ``minutes``
    until the watermark has passed them. The table remembers a case, so what it says later does not start it anew.
    """
    item = F.struct("ts", F.col("event_id").cast("bigint").alias("event_id"), "to_status")
    per = _per_bucket(events, item, minutes, delay).select("case_id", "bucket", F.col("held").alias("events"), "last")
    wait = f"{min(pd.Timedelta(delay), SETTLE) // pd.Timedelta('1us')} MICROSECONDS"
    return Parts(per, lambda parts: L.time_outs(parts, minutes, wait))


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's with what stateful streams need.

    State goes to RocksDB. A stream keeps its number of state partitions for life, and
    adaptive execution does not reduce them, so it uses no more than the cluster has cores.
    """
    beside = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        beside.conf.set(key, spark.conf.get(key))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    beside.conf.set("spark.sql.shuffle.partitions", min(wanted, max(spark.sparkContext.defaultParallelism, 1)))
    beside.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Lists of few items for many keys: hashing them falls back to sorting after 128 keys, in each of the four aggregates.
    beside.conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
    return beside


def run(stream: DataFrame | Parts, folder: str, keys: tuple[str, ...], mode: str = "update") -> None:
    """Run a stream over everything available into an upsert table under the folder."""
    log = UpsertLog(f"{folder}/table", keys)
    df = stream.rows if isinstance(stream, Parts) else stream
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(log.write)
        .start()
    )
    query.awaitTermination()


def table(spark: SparkSession, folder: str, keys: tuple[str, ...], stream: DataFrame | Parts | None = None) -> DataFrame:
    """What the stream's upserts left, put together if they are parts."""
    log = UpsertLog(f"{folder}/table", keys)
    return stream.whole(log.versions(spark)) if isinstance(stream, Parts) else log.read(spark)


def run_to_table(stream: DataFrame | Parts, folder: str, keys: tuple[str, ...], mode: str = "update") -> DataFrame:
    run(stream, folder, keys, mode)
    df = stream.rows if isinstance(stream, Parts) else stream
    return table(df.sparkSession, folder, keys, stream)
