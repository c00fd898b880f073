"""Streams over job events and files: throughput timeline, per-job state with timers, idempotent intake."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmill.operators import transitions
from docmill.operators.lifecycle import STALE

STATE = "status string, attempts int, last_seen double"
OUT = "job_id string, status string, attempts int, reason string"
#: State that each event leads to (fixed values).
LEADS_TO = {"received": "QUEUED", "dispatched": "QUEUED", "started": "PROCESSING", "heartbeat": None, "succeeded": "SUCCEEDED", "failed": "FAILED", "cancelled": "CANCELLED", "retry_scheduled": "RETRYING", "worker_lost": "QUEUED", "cache_hit": "SUCCEEDED"}
FINAL = ("SUCCEEDED", "FAILED", "CANCELLED")


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 64) -> DataFrame:
    """A growing Parquet folder (or a single file's folder) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def table_stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of a data folder as a stream, whether it is one file or a folder of files."""
    path = f"{base}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)


def event_timeline(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(start, event, n) of tumbling windows; works on streams (with a watermark of ``late``) and tables alike.

    Events are counted, not deduplicated; the watermark bounds a live stream's state to the open windows. A replay that
    ends with the data takes None: its state is one count a window and event.
    """
    timed = events.withWatermark("created_at", late) if events.isStreaming and late else events
    return timed.groupBy(F.window("created_at", width), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def track_jobs(events: DataFrame, most_attempts: int = 3, stale_s: int = STALE) -> DataFrame:
    """(job_id, status, attempts, reason): the state of each job after its events, kept across batches.

    A job that is being processed and stays silent for ``stale_s`` is requeued, or failed at its last attempt. Events of
    a job in one batch are applied in order of id, so replays give the same state; final states take no more events.
    Timers fire in batches without data; a run that is to end with the data (``availableNow``) turns those off by
    ``spark.sql.streaming.noDataMicroBatches.enabled``.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, seen = state.get if state.exists else ("QUEUED", 0, 0.0)
        reason = ""
        if state.hasTimedOut:
            status, reason = ("FAILED", "WORKER_LOST") if attempts >= most_attempts else ("QUEUED", "worker_lost")
        else:
            for row in pd.concat(list(frames)).sort_values("id").itertuples():
                after = LEADS_TO.get(row.event)
                seen = max(seen, row.created_at.timestamp())
                if status in FINAL or after is None:
                    continue
                attempts += row.event == "started"
                status, reason = after, row.event
        state.update((status, int(attempts), float(seen)))
        if status == "PROCESSING":
            state.setTimeoutDuration(stale_s * 1000)
        yield pd.DataFrame([[key[0], status, int(attempts), reason]], columns=[c.split(" ")[0] for c in OUT.split(", ")])

    narrow = events.filter("job_id is not null").select("job_id", "id", "event", "created_at")
    return narrow.groupBy("job_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_into_table(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Process everything that is there and return the result table, the last row of each key.

    Changed rows of each batch are written as a part named by the batch, so a batch that is repeated after a failure
    replaces its part; a restart from the checkpoint beside the parts adds nothing. Nothing passes through the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("written_by", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    written = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("written_by", T.IntegerType())])).parquet(f"{folder}/parts")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "written_by").alias("r")).select(*keys, "r.*")


def intake(files: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``store`` on each micro-batch of new files, one row per content. ``store`` gets the batch id and must write by
    it (or by content hash), as batches are repeated after a failure."""

    def one(batch: DataFrame, batch_id: int) -> None:
        store(batch.dropDuplicates(["sha256"]), batch_id)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake_jobs(files: DataFrame, options: Column, finished: Callable[[], DataFrame], now: Callable[[], Column], folder: str, checkpoint: str):
    """New files (id, sha256, original_filename, kind, queue) of a stream as jobs and events, one part a batch.

    Ids follow from the files, and a part is named by its batch, so a batch that is repeated replaces what it wrote.
    ``finished`` gives the succeeded jobs whose results answer known bytes at once, as they are when the batch runs.
    """

    def one(batch: DataFrame, number: int) -> None:
        jobs, _, events = transitions.intake(batch.dropDuplicates(["id"]), options, finished(), now())
        for name, rows in (("jobs", jobs), ("job_events", events)):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
