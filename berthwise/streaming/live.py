"""Structured Streaming: AIS ingest (X1), latest call state (X2), replan
triggers (X3) and congestion alerts (X4).  The berth timeline (X5) is in :mod:`berthwise.streaming.timeline`.

Each stream applies the same DataFrame functions as its batch twin, so a
``trigger(availableNow=True)`` run over files equals the batch result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berthwise import schema as S
from berthwise.operators.vessels import ais_to_calls

AIS_RAW_SCHEMA = "msg_id long, received_at timestamp_ntz, value string"


def read_ais_stream(spark, path: str, fmt: str = "json", schema: str = AIS_RAW_SCHEMA,
                    max_files: int | None = None) -> DataFrame:
    """SRC3: AIS feed as a stream of ``(msg_id, received_at, value)`` rows
    from files (JSON lines); a Kafka source yields the same columns after
    ``selectExpr('CAST(value AS STRING)', ...)``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def ais_calls_stream(raw: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Typed calls and rejected payloads from a raw AIS stream (the batch
    function, applied to a streaming frame)."""
    return ais_to_calls(raw, now)


def _there(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def start_ais_ingest(raw: DataFrame, now, ok_path: str, reject_path: str, checkpoint: str,
                     trigger: dict | None = None, commits: str | None = None):
    """X1 sink: each micro-batch writes accepted calls and rejects to two tables (``foreachBatch``) and then, last, one line
    in ``commits`` (default: beside the checkpoint) that names what it wrote.  :func:`read_committed` shows only what is
    named there, so both halves of a batch appear together.  A batch that is tried again writes anew under another name,
    unless its line is there already."""
    log = commits or commits_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        line = f"{log}/batch_id={batch_id}"
        if _there(spark, f"{line}/_SUCCESS"):
            return
        attempt = uuid.uuid4().hex
        batch = batch.persist()
        try:
            for part, path in zip(ais_to_calls(batch, now), (ok_path, reject_path)):
                part.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}/attempt={attempt}")
            spark.createDataFrame([(attempt,)], "attempt string").coalesce(1).write.mode("overwrite").json(line)
        finally:
            batch.unpersist()

    w = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def commits_of(checkpoint: str) -> str:
    return checkpoint.rstrip("/") + "-commits"


def read_committed(spark, path: str, commits: str) -> DataFrame:
    """The rows of an ingest table whose batches are committed."""
    if not _there(spark, commits):
        return spark.read.parquet(path).limit(0)
    done = spark.read.schema("attempt string, batch_id long").json(commits)
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.join(done, ["batch_id", "attempt"], "left_semi").drop("batch_id", "attempt")


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session clock is
    UTC, so the cast keeps the same instant."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _dedup(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop repeated deliveries: within the watermark on a stream (bounded
    state), plainly on a static frame (the batch twin)."""
    return df.dropDuplicatesWithinWatermark(cols) if df.isStreaming else df.dropDuplicates(cols)


def latest_calls(calls: DataFrame, watermark: str = "1 hour", key: str = "name",
                 ts: str = "received_at", msg_id: str = "msg_id") -> DataFrame:
    """Last reported state per call (a later message overwrites an
    earlier one).  Duplicated deliveries are dropped within the watermark;
    run in ``update`` output mode."""
    d = _dedup(_event_time(calls, ts).withWatermark(ts, watermark), [msg_id])
    cols = [c for c in calls.columns if c != key]
    # latest by event time, ties broken by message id (deterministic)
    return d.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(msg_id))).alias("_s")) \
            .select(key, *[F.col(f"_s.{c}").alias(c) for c in cols])


def latest_call_sessions(calls: DataFrame, idle: str = "6 hours", watermark: str = "1 hour", key: str = "name",
                         ts: str = "received_at", msg_id: str = "msg_id") -> DataFrame:
    """X2 with bounded state: the last reported state of each call, once it has been silent for ``idle``.  A call's state
    leaves with that row; a call that reports again starts anew.  ``append`` mode; repeated deliveries change nothing."""
    w = _event_time(calls, ts).withWatermark(ts, watermark)
    cols = [c for c in calls.columns if c != key]
    g = w.groupBy(key, F.session_window(ts, idle).alias("_w")).agg(
        F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(msg_id))).alias("_s"), F.min(ts).alias("first_seen"))
    return g.select(key, *[F.col(f"_s.{c}").alias(c) for c in cols], "first_seen")


def replan_triggers(updates: DataFrame, plan: DataFrame, threshold_hours: float = S.LATE_ARRIVAL_HOURS,
                    key: str = "name", new_eta: str = "eta", planned_eta: str = "planned_eta") -> DataFrame:
    """Updates whose ETA is more than ``threshold`` hours after the
    planned ETA (stream-static join on the call key)."""
    j = updates.join(plan.select(key, planned_eta), key, "inner")
    d = F.timestamp_diff("MICROSECOND", F.col(planned_eta), F.col(new_eta))
    return j.withColumn("delay_hours", d / F.lit(3.6e9)).filter(d > F.lit(int(threshold_hours * 3.6e9)))


def congestion_alerts(reports: DataFrame, watermark: str = "2 hours", threshold: int = S.CONGESTION_ALERT_VESSELS,
                      port: str = "port_id", call: str = "name", ts: str = "received_at",
                      window: str = "1 hour", waiting=None) -> DataFrame:
    """Per port and tumbling hour, the number of distinct calls reporting
    as waiting (``waiting``: the predicate on a report; default: every report given); hours above ``threshold`` are alerts.  A call is counted once
    per hour (dedup within the watermark); ``append`` mode emits an hour once
    the watermark has passed its end, and rows later than the watermark are
    dropped."""
    reports = reports if waiting is None else reports.filter(waiting)
    w = _event_time(reports, ts).withWatermark(ts, watermark)
    # plain key for the per-hour dedup (the window struct would be a second event-time column)
    w = w.withColumn("_hour_key", F.window(ts, window).start.cast("long"))
    d = _dedup(w, [port, call, "_hour_key"])
    g = d.groupBy(port, F.window(ts, window).alias("hour")).agg(F.count(F.lit(1)).alias("waiting_calls"))
    return g.filter(F.col("waiting_calls") > threshold).select(
        port, F.col("hour.start").alias("hour_start"), F.col("hour.end").alias("hour_end"), "waiting_calls")
