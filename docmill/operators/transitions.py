"""Changes of job state. A change is new snapshots of the jobs it concerns and the events it leaves in the audit log.

Nothing is updated in place: a snapshot carries the time of its change as ``loaded_at`` and is appended, and the current
row of a job is its latest snapshot. Whether a change applies depends on the current row alone (status, worker, attempts),
and event ids are derived from what happened, so a change that is made again, after a lost task or a repeated message,
finds nothing left to do or appends the same rows. All times are arguments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators import analytics, lifecycle

#: Longest run of a job in seconds, and the share of progress that reading a document spans (fixed values).
TIME_LIMIT, FIRST_PROGRESS, READING_PROGRESS = 900, 5, 85
#: Error codes of a job, and whether another attempt may help (fixed values).
ERRORS = {
    "CORRUPTED_FILE": False, "ENCRYPTED_DOCUMENT": False, "UNSUPPORTED_FORMAT": False, "LIMIT_EXCEEDED": False, "EMPTY_FILE": False, "NO_ADAPTER": False, "DOCUMENT_MISSING": False,
    "TIMEOUT": False, "INVALID_OPTIONS": False, "WORKER_LOST": False, "EXPIRED": False, "INFRASTRUCTURE_ERROR": True, "INTERNAL_ERROR": True,
}
WAITING = ("QUEUED", "RETRYING")


@dataclass
class Change:
    """Snapshots to append to the jobs, and events to append to the log."""

    jobs: DataFrame
    events: DataFrame

    def then(self, other: Change) -> Change:
        return Change(self.jobs.unionByName(other.jobs), self.events.unionByName(other.events))


def change(jobs: DataFrame, columns: list[str], when: Column, now: Column, event: Column | str, level: Column | str = "info", data: Column | None = None, **new: Column | str | float | None) -> Change:
    """The jobs that satisfy ``when``, with ``new`` values; ``jobs`` may hold further columns that those refer to."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    hit = jobs.filter(when)
    types = {f.name: f.dataType for f in jobs.schema.fields}
    values = {k: as_column(v).cast(types[k]) for k, v in {**new, "loaded_at": now}.items() if k in types}
    rows = hit.select(*[values.get(c, F.col(c)).alias(c) for c in columns])
    what = as_column(event).cast("string")
    log = hit.filter(what.isNotNull()).select(F.xxhash64("id", what, F.unix_micros(now)).alias("id"), F.col("id").alias("job_id"), now.alias("created_at"), as_column(level).cast("string").alias("level"), what.alias("event"), (F.to_json(data) if data is not None else F.lit("{}")).alias("data"))
    return Change(rows, log)


def met(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs with one request (job_id, ...) each: of several for a job the least, as only one can win."""
    rest = [c for c in requests.columns if c != "job_id"]
    one = requests.groupBy("job_id").agg(F.min(F.struct(*rest, F.lit(0).alias("_"))).alias("asked"))
    return jobs.join(one, jobs["id"] == one["job_id"]).drop("job_id")


def owned() -> Column:
    """Is the job still being processed by the worker that asks?"""
    return (F.col("status") == "PROCESSING") & (F.col("worker_id") == F.col("asked.worker_id"))


def claim(jobs: DataFrame, requests: DataFrame, now: Column) -> Change:
    """Waiting jobs that workers (job_id, worker_id) take up; a job goes to one worker."""
    free = F.col("status").isin(*WAITING) & ~F.coalesce("cancel_requested", F.lit(False)) & (F.col("attempts") < F.col("max_attempts"))
    data = F.struct(F.col("asked.worker_id").alias("worker"), (F.col("attempts") + 1).alias("attempt"))
    return change(met(jobs, requests), jobs.columns, free, now, "started", data=data, status="PROCESSING", stage="starting", progress=0.0, attempts=F.col("attempts") + 1, worker_id=F.col("asked.worker_id"), started_at=now, heartbeat_at=now, next_retry_at=None, error_code=None, error_message=None)


def heartbeat(jobs: DataFrame, beats: DataFrame, now: Column) -> Change:
    """Signs of life (job_id, worker_id) of the workers that own a job. No event."""
    return change(met(jobs, beats), jobs.columns, owned(), now, F.lit(None), heartbeat_at=now)


def replies(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """(job_id, worker_id, lost, cancel_requested): what a worker that gives a sign of life (job_id, worker_id) is told."""
    both = beats.join(jobs.select(F.col("id").alias("job_id"), "status", F.col("worker_id").alias("owner"), "cancel_requested"), "job_id", "left")
    held = F.coalesce((F.col("status") == "PROCESSING") & (F.col("owner") == F.col("worker_id")), F.lit(False))
    return both.select("job_id", "worker_id", (~held).alias("lost"), (held & F.coalesce("cancel_requested", F.lit(False))).alias("cancel_requested"))


def progress(jobs: DataFrame, reports: DataFrame, now: Column) -> Change:
    """Progress (job_id, worker_id, fraction, stage) of the owners; the furthest report of a batch counts. No event."""
    furthest = reports.groupBy("job_id", "worker_id").agg(F.max(F.struct("fraction", "stage")).alias("r")).select("job_id", "worker_id", "r.fraction", "r.stage")
    done = F.round(F.least(FIRST_PROGRESS + F.col("asked.fraction") * READING_PROGRESS, F.lit(99.0)), 1)
    return change(met(jobs, furthest), jobs.columns, owned(), now, F.lit(None), progress=done, stage=F.col("asked.stage"), heartbeat_at=now)


def succeed(jobs: DataFrame, results: DataFrame, now: Column) -> Change:
    """Results (job_id, worker_id, page_count, char_count, word_count, token_count, chunk_count, warnings) of the owners;
    those of a worker that lost its job are dropped."""
    fresh = analytics.new_warnings(F.col("warnings"), F.col("asked.warnings"))
    counts = {c: F.col(f"asked.{c}") for c in ("page_count", "char_count", "word_count", "token_count", "chunk_count")}
    level = F.when(F.size("asked.warnings") > 0, "warning").otherwise("info")
    return change(met(jobs, results), jobs.columns, owned(), now, "succeeded", level, F.struct(*[v.alias(k) for k, v in counts.items()]), status="SUCCEEDED", stage="done", progress=100.0, finished_at=now, warnings=fresh, **counts)


def fail(jobs: DataFrame, failures: DataFrame, now: Column) -> Change:
    """Failures (job_id, worker_id, error_code, message) of the owners: jobs whose error may pass wait for another attempt
    while one is left, with a doubled delay; the others end. A run beyond the time limit ends as TIMEOUT."""
    asked = met(jobs, failures)
    late = lifecycle.age("started_at", now) >= TIME_LIMIT
    asked = asked.withColumn("code_", F.when(late, "TIMEOUT").otherwise(F.col("asked.error_code")))
    passing = F.col("code_").isin(*[c for c, again in ERRORS.items() if again])
    again = passing & (F.col("attempts") < F.col("max_attempts"))
    delay = lifecycle.retry_delay(F.col("attempts"))
    data = F.struct(F.col("code_").alias("error_code"))
    waits = change(asked, jobs.columns, owned() & again, now, "retry_scheduled", "warning", data, status="RETRYING", stage="retrying", worker_id=None, next_retry_at=F.timestamp_micros(F.unix_micros(now) + delay * 1_000_000))
    ends = change(asked, jobs.columns, owned() & ~F.coalesce(again, F.lit(False)), now, "failed", "error", data, status="FAILED", stage="failed", error_code=F.col("code_"), error_message=F.col("asked.message"), finished_at=now)
    return waits.then(ends)


def cancel(jobs: DataFrame, requests: DataFrame, now: Column) -> Change:
    """Jobs (job_id) whose cancellation is asked for: waiting ones end at once, running ones are told."""
    asked = met(jobs, requests)
    ends = change(asked, jobs.columns, F.col("status").isin(*WAITING), now, "cancelled", "warning", status="CANCELLED", stage="cancelled", cancel_requested=True, finished_at=now)
    told = change(asked, jobs.columns, F.col("status") == "PROCESSING", now, "cancel_requested", "warning", cancel_requested=True)
    return ends.then(told)


def retry(jobs: DataFrame, requests: DataFrame, now: Column) -> Change:
    """Failed and cancelled jobs (job_id) that start anew: attempts from zero, and waiting counts from now."""
    data = F.struct(F.coalesce("error_code", F.lit("CANCELLED")).alias("before"))
    return change(met(jobs, requests), jobs.columns, F.col("status").isin("FAILED", "CANCELLED"), now, "manual_retry", data=data, status="QUEUED", stage="queued", progress=0.0, attempts=0, cancel_requested=False, finished_at=None, error_code=None, error_message=None, created_at=now)


def refusal(action: str, status: Column) -> Column:
    """Why a request for a job in this state is refused; null where it isn't."""
    allowed = {"cancel": (analytics.ACTIVE, "JOB_NOT_ACTIVE"), "retry": (("FAILED", "CANCELLED"), "JOB_NOT_RETRYABLE")}
    states, code = allowed[action]
    return F.when(~status.isin(*states), code)


def recover(jobs: DataFrame, broker: DataFrame, now: Column, limit: int | None = 500) -> Change:
    """One sweep: silent jobs are cancelled, failed or queued again, old waiting ones expire, and due ones without a
    message in the broker (job_id) are dispatched anew, at most ``limit`` (oldest first) of these a sweep."""
    columns, state = jobs.columns, jobs.withColumn("next_", lifecycle.next_state(now))
    lost = F.col("next_")
    stopped = change(state, columns, lost == "CANCELLED", now, "cancelled", "warning", status="CANCELLED", stage="cancelled", finished_at=now)
    given_up = change(state, columns, lost == "FAILED", now, "failed", "error", status="FAILED", stage="failed", error_code="WORKER_LOST", finished_at=now)
    again = change(state, columns, lost == "REQUEUED", now, "worker_lost", "warning", status="QUEUED", stage="requeued", worker_id=None, last_dispatched_at=now, dispatch_count=F.col("dispatch_count") + 1)
    expired = change(state, columns, lost == "EXPIRED", now, "failed", "error", status="FAILED", stage="failed", error_code="EXPIRED", finished_at=now)
    due = lifecycle.to_redispatch(state.filter("next_ is null"), broker, now, limit)
    sent = change(due, columns, F.lit(True), now, "message_missing", "warning", status="QUEUED", last_dispatched_at=now, dispatch_count=F.col("dispatch_count") + 1)
    return stopped.then(given_up).then(again).then(expired).then(sent)


def dispatch(jobs: DataFrame, now: Column) -> Change:
    """Waiting jobs are handed to their queue."""
    return change(jobs, jobs.columns, F.col("status").isin(*WAITING), now, "dispatched", data=F.struct("queue"), last_dispatched_at=now, dispatch_count=F.coalesce("dispatch_count", F.lit(0)) + 1)


def intake(files: DataFrame, options: Column, finished: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New files (id, sha256, original_filename, kind, queue) as (jobs, hits, events).

    A job's id follows from its file's id and options, so files taken in twice give the same rows. ``hits`` are the jobs
    (id, hit_id) whose bytes were read before with equal options: ``finished`` holds succeeded jobs (id, document_id,
    options, status, cached_from_job_id, finished_at, sha256). They are answered at once.
    """
    new = files.select(F.sha2(F.concat_ws("|", "id", F.to_json(options)), 256).alias("id"), F.col("id").alias("document_id"), "sha256", "queue", options.alias("options"))
    source = analytics.newest(finished.filter(analytics.FIRST_RUN), ["sha256", "options"], "finished_at", "id").select("sha256", "options", F.col("id").alias("hit_id"))
    found = new.join(source, (new["sha256"] == source["sha256"]) & new["options"].eqNullSafe(source["options"]), "left").select(new["id"], "document_id", new["sha256"], "queue", new["options"], "hit_id")
    hit = F.col("hit_id").isNotNull()
    jobs = found.select(
        "id", "document_id", F.when(hit, "SUCCEEDED").otherwise("QUEUED").alias("status"), F.when(hit, "done").otherwise("queued").alias("stage"), F.when(hit, 100.0).otherwise(0.0).alias("progress"), "queue", "options", F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(False).alias("cancel_requested"),
        F.col("hit_id").alias("cached_from_job_id"), now.alias("created_at"), F.when(hit, now).alias("started_at"), F.when(hit, now).alias("finished_at"), now.alias("loaded_at"),
    )
    kinds = F.explode(F.array(F.lit("received"), F.when(hit, "cache_hit").otherwise("dispatched")))
    events = found.select("id", kinds.alias("event")).select(F.xxhash64("id", "event").alias("id"), F.col("id").alias("job_id"), now.alias("created_at"), F.lit("info").alias("level"), "event", F.lit("{}").alias("data"))
    return jobs, found.filter(hit).select("id", "hit_id"), events
