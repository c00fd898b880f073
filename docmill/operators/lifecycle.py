"""Job lifecycle as column expressions: staleness, expiry, backoff, re-dispatch. Times are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Timings in seconds (fixed values).
STALE, REDISPATCH, EXPIRY, BACKOFF = 45, 60, 24 * 3600, 10


def age(column: str, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(column)) / 1e6


def next_state(now: Column) -> Column:
    """What a sweep at ``now`` does with a job: CANCELLED, FAILED, REQUEUED, EXPIRED, or null."""
    silent = (F.col("status") == "PROCESSING") & (F.col("heartbeat_at").isNull() | (age("heartbeat_at", now) > STALE))
    lost = F.when(F.col("cancel_requested"), "CANCELLED").when(F.col("attempts") >= F.col("max_attempts"), "FAILED").otherwise("REQUEUED")
    old = F.col("status").isin("QUEUED", "RETRYING") & (age("created_at", now) > EXPIRY)
    return F.when(silent, lost).when(old, "EXPIRED")


def retry_delay(attempts: Column) -> Column:
    """Seconds before a retry after ``attempts`` transient failures."""
    return (F.lit(BACKOFF) * F.pow(F.lit(2), attempts - 1)).cast("long")


def after_transient_failure(jobs: DataFrame) -> DataFrame:
    """(id, outcome, delay_s): RETRYING with its delay, or FAILED at the last attempt."""
    last = F.col("attempts") >= F.col("max_attempts")
    return jobs.select("id", F.when(last, "FAILED").otherwise("RETRYING").alias("outcome"), F.when(~last, retry_delay(F.col("attempts"))).alias("delay_s"))


def to_redispatch(jobs: DataFrame, broker: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Waiting jobs whose message is due and no longer in the broker (job_id): an anti join on distinct ids."""
    due = jobs.filter("status in ('QUEUED', 'RETRYING')").filter(F.col("last_dispatched_at").isNull() | (age("last_dispatched_at", now) > REDISPATCH)).filter(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    lost = due.join(broker.select(F.col("job_id").alias("id")).distinct(), "id", "left_anti")
    return lost.orderBy("created_at", "id").limit(limit) if limit else lost


def claimable(job_status: Column) -> Column:
    return job_status.isin("QUEUED", "RETRYING")


def job_id_of_message(raw: Column) -> Column:
    """Job id of a broker envelope: the part of its id before the dot."""
    return F.split_part(F.get_json_object(raw, "$.headers.id"), F.lit("."), F.lit(1))
