"""Queries of results and of changes of job state, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import graph, lifecycle, results, transitions
from docmill.operators.analytics import shaped_result
from docmill.operators.current import current_jobs
from docmill.plans.registry import AT, CUR, NOW, query, stamp
from docmill.session import table

BEFORE_NOW = "epoch_us({}) - epoch_us({{}})".format(AT.format(NOW))


def current(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "jobs")
    return current_jobs(jobs, *[c for c in jobs.columns if c not in ("id", "loaded_at")])


def asked(jobs: DataFrame, *more) -> DataFrame:
    """A request for every job."""
    return jobs.select(F.col("id").alias("job_id"), *more)


def said(made: transitions.Change) -> DataFrame:
    """(job_id, event) of a change, beside which its jobs are joined."""
    return made.events.select("job_id", "event")


@query(f"""WITH {CUR} SELECT id, 'PROCESSING' AS status, (attempts + 1)::INT AS attempts, 'w-' || (attempts % 3) AS worker_id, 'started' AS event FROM cur WHERE status IN ('QUEUED', 'RETRYING') AND NOT coalesce(cancel_requested, false) AND attempts < max_attempts""")
def jobs_claimed(spark: SparkSession, sf: str) -> DataFrame:
    """Every waiting job is taken up by the least of two workers that ask for it."""
    jobs = current(spark, sf)
    one = asked(jobs, F.concat(F.lit("w-"), (F.col("attempts") % 3).cast("string")).alias("worker_id"))
    made = transitions.claim(jobs, one.unionByName(asked(jobs, F.lit("x").alias("worker_id"))), stamp(NOW))
    return made.jobs.join(said(made), F.col("id") == F.col("job_id")).select("id", "status", "attempts", "worker_id", "event")


@query(f"""WITH {CUR}, s AS (SELECT job_id, arg_max(json_extract_string(data, '$.worker'), id) AS worker_id FROM job_events WHERE event = 'started' AND job_id IS NOT NULL AND json_extract_string(data, '$.worker') IS NOT NULL GROUP BY job_id)
SELECT s.job_id, NOT coalesce(status = 'PROCESSING' AND cur.worker_id = s.worker_id, false) AS lost, coalesce(status = 'PROCESSING' AND cur.worker_id = s.worker_id, false) AND coalesce(cancel_requested, false) AS cancel_requested FROM s LEFT JOIN cur ON cur.id = s.job_id""")
def heartbeat_replies(spark: SparkSession, sf: str) -> DataFrame:
    """What the workers that last started a job are told when they give a sign of life."""
    started = table(spark, sf, "job_events").filter("event = 'started' and job_id is not null").select("id", "job_id", F.get_json_object("data", "$.worker").alias("worker_id")).filter("worker_id is not null")
    beats = started.groupBy("job_id").agg(F.max_by("worker_id", "id").alias("worker_id"))
    return transitions.replies(current(spark, sf), beats).select("job_id", "lost", "cancel_requested")


@query(f"""WITH {CUR} SELECT id, round(least(5 + 85 * (0.1 + 0.3 * (attempts % 4)), 99), 1) AS progress, 'reading' AS stage FROM cur WHERE status = 'PROCESSING' AND worker_id IS NOT NULL""")
def progress_reported(spark: SparkSession, sf: str) -> DataFrame:
    """The furthest of two reports of each owner; what others report is dropped."""
    jobs = current(spark, sf)
    far = 0.1 + 0.3 * (F.col("attempts") % 4)
    reports = asked(jobs, "worker_id", far.alias("fraction"), F.lit("reading").alias("stage")).unionByName(asked(jobs, "worker_id", F.lit(0.05).alias("fraction"), F.lit("opening").alias("stage")))
    others = asked(jobs, F.lit("~").alias("worker_id"), F.lit(1.0).alias("fraction"), F.lit("x").alias("stage"))
    made = transitions.progress(jobs, reports.unionByName(others.filter("job_id is null")), stamp(NOW))
    return made.jobs.select("id", "progress", "stage")


@query(f"""WITH {CUR} SELECT id, 'SUCCEEDED' AS status, (attempts + 2)::INT AS page_count, len(coalesce(warnings, [])) + CASE WHEN list_contains(coalesce(warnings, []), 'w') THEN 0 ELSE 1 END AS n_warnings FROM cur WHERE status = 'PROCESSING' AND attempts % 2 = 1 AND worker_id IS NOT NULL""")
def results_committed(spark: SparkSession, sf: str) -> DataFrame:
    """Results of all jobs' workers; those that lost their job, here all with an even attempt, change nothing."""
    jobs = current(spark, sf)
    owner = F.when(F.col("attempts") % 2 == 1, F.col("worker_id")).otherwise("gone")
    counts = [(F.col("attempts") + 2).alias(c) for c in ("page_count", "char_count", "word_count", "token_count", "chunk_count")]
    made = transitions.succeed(jobs, asked(jobs, owner.alias("worker_id"), *counts, F.array(F.lit("w")).alias("warnings")), stamp(NOW))
    return made.jobs.select("id", "status", "page_count", F.size("warnings").cast("long").alias("n_warnings"))


@query(f"""WITH {CUR}, f AS (SELECT *, CASE WHEN {BEFORE_NOW.format('started_at')} >= 900000000 THEN 'TIMEOUT' WHEN attempts % 2 = 0 THEN 'CORRUPTED_FILE' ELSE 'INTERNAL_ERROR' END AS code FROM cur WHERE status = 'PROCESSING' AND worker_id IS NOT NULL)
SELECT id, CASE WHEN code = 'INTERNAL_ERROR' AND attempts < max_attempts THEN 'RETRYING' ELSE 'FAILED' END AS status, CASE WHEN code = 'INTERNAL_ERROR' AND attempts < max_attempts THEN NULL ELSE code END AS new_code FROM f""")
def failures_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of all running jobs: passing ones wait while an attempt is left, long runs are timeouts."""
    jobs = current(spark, sf)
    code = F.when(F.col("attempts") % 2 == 0, "CORRUPTED_FILE").otherwise("INTERNAL_ERROR")
    made = transitions.fail(jobs, asked(jobs, "worker_id", code.alias("error_code"), F.lit("m").alias("message")), stamp(NOW))
    return made.jobs.select("id", "status", F.when(F.col("status") == "FAILED", F.col("error_code")).alias("new_code"))


@query(f"""WITH {CUR} SELECT id, CASE WHEN status = 'PROCESSING' THEN 'PROCESSING' ELSE 'CANCELLED' END AS status, CASE WHEN status = 'PROCESSING' THEN 'cancel_requested' ELSE 'cancelled' END AS event FROM cur WHERE status IN ('QUEUED', 'RETRYING', 'PROCESSING')""")
def jobs_cancelled(spark: SparkSession, sf: str) -> DataFrame:
    jobs = current(spark, sf)
    made = transitions.cancel(jobs, asked(jobs), stamp(NOW))
    return made.jobs.filter("cancel_requested").join(said(made), F.col("id") == F.col("job_id")).select("id", "status", "event")


@query(f"""WITH {CUR} SELECT id, 'QUEUED' AS status, 0 AS attempts, error_code IS NULL AS was_cancelled FROM cur WHERE status IN ('FAILED', 'CANCELLED')""")
def jobs_retried(spark: SparkSession, sf: str) -> DataFrame:
    jobs = current(spark, sf)
    made = transitions.retry(jobs, asked(jobs), stamp(NOW))
    told = made.events.select("job_id", (F.get_json_object("data", "$.before") == "CANCELLED").alias("was_cancelled"))
    return made.jobs.filter("error_code is null and created_at = loaded_at").join(told, F.col("id") == F.col("job_id")).select("id", "status", "attempts", "was_cancelled")


@query(f"""WITH {CUR} SELECT id, CASE WHEN status NOT IN ('QUEUED', 'PROCESSING', 'RETRYING') THEN 'JOB_NOT_ACTIVE' END AS cancel, CASE WHEN status NOT IN ('FAILED', 'CANCELLED') THEN 'JOB_NOT_RETRYABLE' END AS retry FROM cur""")
def requests_refused(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf).select("id", transitions.refusal("cancel", F.col("status")).alias("cancel"), transitions.refusal("retry", F.col("status")).alias("retry"))


LOST = f"status = 'PROCESSING' AND (heartbeat_at IS NULL OR {BEFORE_NOW.format('heartbeat_at')} > 45000000)"
OLD = f"status IN ('QUEUED', 'RETRYING') AND {BEFORE_NOW.format('created_at')} > 86400000000"
DUE = f"status IN ('QUEUED', 'RETRYING') AND (last_dispatched_at IS NULL OR {BEFORE_NOW.format('last_dispatched_at')} > 60000000) AND (next_retry_at IS NULL OR next_retry_at <= {AT.format(NOW)})"


@query(f"""WITH {CUR}, s AS (SELECT id, created_at, CASE WHEN {LOST} THEN CASE WHEN cancel_requested THEN 'CANCELLED' WHEN attempts >= max_attempts THEN 'WORKER_LOST' ELSE 'worker_lost' END WHEN {OLD} THEN 'EXPIRED' WHEN {DUE} AND id NOT IN (SELECT id FROM cur WHERE dispatch_count % 2 = 0) THEN 'message_missing' END AS what FROM cur),
d AS (SELECT id, what, row_number() OVER (PARTITION BY what ORDER BY created_at, id) AS i FROM s WHERE what IS NOT NULL)
SELECT id, CASE what WHEN 'CANCELLED' THEN 'CANCELLED' WHEN 'WORKER_LOST' THEN 'FAILED' WHEN 'EXPIRED' THEN 'FAILED' ELSE 'QUEUED' END AS status, CASE WHEN what IN ('WORKER_LOST', 'EXPIRED') THEN 'failed' WHEN what = 'CANCELLED' THEN 'cancelled' ELSE what END AS event FROM d WHERE what <> 'message_missing' OR i <= 500""")
def recovery_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """One sweep over all jobs where the broker holds the messages of those dispatched an even number of times."""
    jobs = current(spark, sf)
    broker = jobs.filter("dispatch_count % 2 = 0").select(F.col("id").alias("job_id"))
    made = transitions.recover(jobs, broker, stamp(NOW))
    return made.jobs.join(said(made), F.col("id") == F.col("job_id")).select("id", "status", "event")


@query(f"""WITH {CUR} SELECT id, (coalesce(dispatch_count, 0) + 1)::INT AS dispatch_count, queue AS told FROM cur WHERE status IN ('QUEUED', 'RETRYING')""")
def jobs_dispatched(spark: SparkSession, sf: str) -> DataFrame:
    made = transitions.dispatch(current(spark, sf), stamp(NOW))
    told = made.events.select("job_id", F.get_json_object("data", "$.queue").alias("told"))
    return made.jobs.join(told, F.col("id") == F.col("job_id")).select("id", "dispatch_count", "told")


@query(f"""WITH {CUR}, u AS (SELECT id, max(sha256) AS sha256, max(kind) AS kind FROM uploads GROUP BY id), k AS (SELECT sha256, options, cur.id, finished_at FROM cur JOIN u ON u.id = cur.document_id WHERE status = 'SUCCEEDED' AND cached_from_job_id IS NULL AND sha256 IS NOT NULL),
o AS (SELECT arg_min(options, cur.id) AS options FROM cur WHERE options IS NOT NULL), h AS (SELECT sha256, arg_min(k.id, struct_pack(a := -coalesce(epoch_us(finished_at), -9223372036854775807), b := k.id)) AS hit_id FROM k, o WHERE k.options = o.options GROUP BY sha256)
SELECT u.id AS document_id, h.hit_id IS NOT NULL AS hit, h.hit_id, CASE WHEN h.hit_id IS NULL THEN 'QUEUED' ELSE 'SUCCEEDED' END AS status FROM u LEFT JOIN h ON h.sha256 = u.sha256 WHERE u.id IS NOT NULL""")
def uploads_taken_in(spark: SparkSession, sf: str) -> DataFrame:
    """Every upload arrives once more with one job's options: known bytes are answered from the job that read them."""
    jobs = current(spark, sf)
    uploads = table(spark, sf, "uploads").filter("id is not null").groupBy("id").agg(F.max("sha256").alias("sha256"), F.max("kind").alias("kind"))
    finished = jobs.join(uploads.select(F.col("id").alias("document_id"), "sha256"), "document_id").filter("sha256 is not null")
    chosen = jobs.filter("options is not null").agg(F.min_by("options", "id").alias("o"))  # one row
    options = F.lit(None).cast(jobs.schema["options"].dataType)
    files = uploads.select("id", "sha256", F.lit("").alias("original_filename"), "kind", F.lit("light").alias("queue"))
    made, hits, _ = transitions.intake(files.withColumn("o", chosen.scalar()), F.coalesce("o", options), finished, stamp(NOW))
    found = made.join(hits, "id", "left")
    return found.select("document_id", F.col("hit_id").isNotNull().alias("hit"), "hit_id", "status")


@query(f"""WITH {CUR}, d AS (SELECT job_id, count(*) AS pages, md5(string_agg(coalesce(text, ''), chr(10) || chr(12) || chr(10) ORDER BY number)) AS digest FROM (SELECT job_id, number, max(text) AS text FROM page_results WHERE job_id IS NOT NULL GROUP BY ALL) GROUP BY job_id), c AS (SELECT job_id, count(DISTINCT chunk_index) AS chunks FROM chunks GROUP BY job_id)
SELECT cur.id AS job_id, CASE cur.status WHEN 'SUCCEEDED' THEN NULL WHEN 'FAILED' THEN 'JOB_FAILED' WHEN 'CANCELLED' THEN 'JOB_CANCELLED' ELSE 'JOB_NOT_FINISHED' END AS error, CASE WHEN cur.status = 'SUCCEEDED' THEN d.digest END AS digest, CASE WHEN cur.status = 'SUCCEEDED' THEN c.chunks END AS chunks
FROM cur LEFT JOIN d ON d.job_id = coalesce(cur.cached_from_job_id, cur.id) LEFT JOIN c ON c.job_id = coalesce(cur.cached_from_job_id, cur.id) AND d.job_id IS NOT NULL""")
def job_results(spark: SparkSession, sf: str) -> DataFrame:
    """The result of every job, or why it has none; pages without their text, as they come without it."""
    whole = results.job_results(current(spark, sf), table(spark, sf, "page_results").filter("job_id is not null"), table(spark, sf, "chunks"))
    shaped = shaped_result(whole.withColumn("digest", F.md5("text")), text=False)
    assert "text" not in shaped.columns and "text" not in shaped.schema["pages"].dataType.elementType.names
    return shaped.select("job_id", "error", "digest", F.when(F.col("chunks").isNotNull(), F.size(F.array_distinct(F.transform("chunks", lambda c: c["chunk_index"])))).cast("long").alias("chunks"))


@query(f"""WITH {CUR}, u AS (SELECT id, max(struct_pack(sha256, extension, original_filename, mime_type)) AS f FROM uploads GROUP BY id) SELECT cur.id AS job_id, 'sha256/' || left(f.sha256, 2) || '/' || f.sha256 || coalesce(f.extension, '') AS key, f.mime_type FROM cur JOIN u ON u.id = cur.document_id""")
def originals_of_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return results.originals(current(spark, sf), table(spark, sf, "uploads")).select("job_id", "key", "mime_type")


@query(f"""WITH {CUR} SELECT status, count(*) AS n, count(*) FILTER (WHERE status IN ('QUEUED', 'RETRYING')) AS claimable FROM cur GROUP BY status""")
def jobs_claimable(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.count_if(lifecycle.claimable(F.col("status"))).alias("claimable"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT in_reply_to AS a, message_id AS b FROM documents WHERE in_reply_to IS NOT NULL AND message_id IS NOT NULL AND in_reply_to <> message_id), r AS (SELECT DISTINCT message_id AS m FROM documents WHERE message_id IS NOT NULL AND in_reply_to IS NULL UNION SELECT e.b FROM r JOIN e ON e.a = r.m)
SELECT m AS message_id FROM r""")
def threads_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that replies lead to from those that answer none, over any number of steps."""
    d = table(spark, sf, "documents").filter("message_id is not null")
    edges = d.filter("in_reply_to is not null and in_reply_to <> message_id").select(F.col("in_reply_to").alias("source"), F.col("message_id").alias("target"))
    return graph.reachable(edges, d.filter("in_reply_to is null").select(F.col("message_id").alias("node"))).select(F.col("node").alias("message_id"))
