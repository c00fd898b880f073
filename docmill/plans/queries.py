"""Registered queries of the core and the SQL that checks them. All run over whole tables; ``now`` is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import entities as E
from docmill.functions import text as T
from docmill.functions.markdown import as_udf, from_lines
from docmill.functions.text import LETTER, SPACE
from docmill.operators import analytics as A
from docmill.operators import chunking, documents, lifecycle, scoring
from docmill.plans.registry import AT, CUR, NOW, NOW_S, ORACLES, PG, QUERIES, RE_SPACE, SINCE, SINCE_S, TOOK, UP, WAIT, jobs_now, query, stamp
from docmill.session import shared_folder, table
from docmill.sources import formats
from docmill.streaming import jobs as streams

__all__ = ["ORACLES", "QUERIES", "entry"]


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every message with its statistics and its chunks at 512 tokens with 64 of overlap. No shuffle."""
    docs = table(spark, sf, "documents").filter("text is not null")
    chunks = chunking.chunk_markdown(as_udf(from_lines)("text"), F.lit(512), F.lit(64))
    each = docs.select("doc_id", *documents.text_statistics(F.col("text")), F.explode(chunks).alias("c"))
    columns = ("chunk_index", "page_start", "page_end", "char_start", "char_end", "overlap_tokens")
    return each.select(*[c for c in each.columns if c != "c"], F.col("c.token_count").alias("chunk_tokens"), *[f"c.{c}" for c in columns])


# ------------------------------------------------------------------ text


@query(f"""SELECT doc_id, length(text) AS char_count, len(regexp_extract_all(text, '[^{RE_SPACE}]+')) AS word_count,
  CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count,
  CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS token_count,
  round(len(regexp_extract_all(text, '[^{RE_SPACE}]+')) / 230, 4) AS reading_min FROM documents WHERE text IS NOT NULL""")
def doc_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text is not null")
    return docs.select("doc_id", *documents.text_statistics(F.col("text"))).withColumn("reading_min", F.round("reading_min", 4))


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), ''),
  '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{RE_SPACE}]+', ''), '[{RE_SPACE}]+$', '')) AS digest FROM documents WHERE text IS NOT NULL""")
def doc_normalized(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@query(f"""SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?¡¿…])[{RE_SPACE}]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)""")
def doc_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").filter("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(CASE WHEN length(text) <= 256 THEN text WHEN regexp_matches(right(text, 256), '[{RE_SPACE}]')
  THEN regexp_replace(right(text, 256), '^[^{RE_SPACE}]*[{RE_SPACE}]', '') ELSE '' END, '^[{RE_SPACE}]+', ''), '[{RE_SPACE}]+$', '')) AS tail FROM documents WHERE text IS NOT NULL""")
def doc_overlap_tail(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(T.tail(F.col("text"), 64)).alias("tail"))


#: The entity forms once more for an engine without lookaround: white space is folded to spaces and letters beyond ASCII to
#: one letter, so that ASCII boundaries are those of words; before a phone number a mark stands for "no word character".
FOLDED = f"regexp_replace(regexp_replace(text, '[{RE_SPACE}]', ' ', 'g'), '[^\\x00-\\x7f\\P{{L}}]|[^\\x00-\\x7f\\P{{N}}]', 'q', 'g')"
MARKING = "regexp_replace({}, '(^|[^0-9A-Za-z_\\x01])([(+0-9])', '\\1' || chr(1) || '\\2', 'g')"
MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|ene|abr|ago|dic"
ENTITY_SQL = {
    "emails": ("text", f"[{LETTER}][{LETTER}.+-]*@[{LETTER}-]+(?:\\.[{LETTER}-]+)*\\.[{LETTER}-]*[{LETTER}]"),
    "urls": (f"regexp_replace(text, '([{LETTER}])((?i:https?)://)', '\\1', 'g')", f"(?i)https?://[^{RE_SPACE}<>()\"'']+"),
    "dates": (FOLDED, f"(?i)\\b(?:\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}[/.-]\\d{{1,2}}[/.-]\\d{{2,4}}|\\d{{1,2}} +(?:de +)?(?:{MONTH})[a-z]*\\.?(?: +(?:de +)?\\d{{4}})?)\\b"),
    "amounts": (FOLDED, "(?i)(?:(?:US\\$|MX\\$|\\$|€|£) ?\\d[\\d,.]*\\d|\\b\\d[\\d,.]*\\d ?(?:USD|MXN|EUR|€|pesos|dollars)\\b)"),
    "phone_numbers": (MARKING.format(MARKING.format(FOLDED)), "\\x01(?:(?:\\+\\x01*\\d{1,3}[ .-]?)?(?:\\x01*\\(\\x01*\\d{2,3}\\)[ .-]?)?\\x01*\\d{2,4}[ .-]\\x01*\\d{3,4}[ .-]\\x01*\\d{3,4}|\\+\\x01*\\d{11,13})\\b"),
}


def entity_query(kind: str, source: str, key: str) -> None:
    text, pattern = ENTITY_SQL[kind]
    sql = f"""WITH p AS (SELECT {key}, max(text) AS text FROM {source} GROUP BY {key}), f AS (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS raws FROM p), m AS (SELECT {key}, unnest(raws) AS raw, generate_subscripts(raws, 1) AS i FROM f),
      v AS (SELECT {key}, regexp_replace(trim(replace(regexp_replace(raw, '[{RE_SPACE}]', ' ', 'g'), chr(1), '')), '[.,;:]+$', '') AS v, min(i) AS i FROM m GROUP BY ALL)
      SELECT {key}, string_agg(v, ' ¦ ' ORDER BY i) AS found FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i) <= {E.MOST}) GROUP BY {key}"""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Found in the scan; of repeated rows the few values are compared, not the texts."""
        found = table(spark, sf, source).select(key, E.entities(F.col("text"), kind).alias("v")).filter(F.size("v") > 0)
        return found.select(key, F.regexp_replace(F.array_join("v", " ¦ "), f"[{SPACE}]", " ").alias("found")).distinct()

    run.__name__ = f"entity_{kind}"
    query(sql)(run)


for _kind, _source, _key in (("emails", "page_results", "page_key"), ("urls", "documents", "doc_id"), ("dates", "documents", "doc_id"), ("amounts", "page_results", "page_key"), ("phone_numbers", "page_results", "page_key")):
    entity_query(_kind, _source, _key)


@query("""SELECT block_key, md5(replace(replace(replace(replace(max(text), '‘', ''''), '’', ''''), '“', '"'), '”', '"')) AS digest FROM blocks GROUP BY block_key""")
def block_folded_quotes(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "blocks").groupBy("block_key").agg(F.max("text").alias("text"))
    return once.select("block_key", F.md5(F.translate("text", "‘’“”", "''\"\"")).alias("digest"))


@query("""SELECT id, lower(regexp_extract(max(original_filename), '[^.](\\.[^./\\\\]*)$', 1)) AS ext,
  'sha256/' || max(sha256)[1:2] || '/' || max(sha256) || lower(regexp_extract(max(original_filename), '[^.](\\.[^./\\\\]*)$', 1)) AS key FROM uploads GROUP BY id""")
def document_keys(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "uploads").groupBy("id").agg(F.max("original_filename").alias("name"), F.max("sha256").alias("sha"))
    ext = T.extension(F.col("name"))
    return once.select("id", ext.alias("ext"), T.document_key(F.col("sha"), ext).alias("key"))


# ------------------------------------------------------------------ documents, blocks, chunks


@query(f"""WITH {PG} SELECT job_id, count(*) AS n_pages, md5(string_agg(coalesce(text, ''), chr(10) || chr(12) || chr(10) ORDER BY number)) AS digest FROM pg WHERE job_id IS NOT NULL GROUP BY job_id""")
def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents.document_texts(table(spark, sf, "page_results").filter("job_id is not null"))
    return docs.select("job_id", "n_pages", F.md5("text").alias("digest"))


@query(r"""SELECT block_key, len(regexp_extract_all(max(text), '(?m)^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$')) AS tables FROM blocks GROUP BY block_key""")
def block_tables(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "blocks").groupBy("block_key").agg(F.max("text").alias("text"))
    return once.select("block_key", documents.table_count(F.col("text")).alias("tables"))


@query("""WITH b AS (SELECT DISTINCT job_id, block_index, text FROM blocks)
SELECT job_id, block_index, coalesce(sum(length(text) + 1) OVER (PARTITION BY job_id ORDER BY block_index, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, length(text) AS n FROM b""")
def block_offsets(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "blocks").select("job_id", "block_index", "text").distinct().withColumn("o", F.struct("block_index", "text"))
    return documents.line_offsets(b, "job_id", "o", "text").select("job_id", "block_index", "char_start", F.length("text").cast("long").alias("n"))


@query(f"""WITH {PG}, m AS (SELECT job_id, number, min(method) AS method, max(ocr_confidence) AS c FROM page_results GROUP BY job_id, number)
SELECT coalesce(method, 'unknown') AS method, count(*) AS pages, round(avg(c), 4) AS mean_confidence FROM m GROUP BY 1""")
def pages_by_method(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "page_results").groupBy("job_id", "number").agg(F.min("method").alias("method"), F.max("ocr_confidence").alias("c"))
    return once.groupBy(F.coalesce("method", F.lit("unknown")).alias("method")).agg(F.count("*").alias("pages"), F.round(F.avg("c"), 4).alias("mean_confidence"))


@query("""WITH n AS (SELECT DISTINCT job_id, number FROM page_results WHERE number IS NOT NULL), i AS (SELECT job_id, number, number - row_number() OVER (PARTITION BY job_id ORDER BY number) AS g FROM n)
SELECT job_id, CASE WHEN min(number) = max(number) THEN min(number)::VARCHAR ELSE min(number) || '-' || max(number) END AS pages FROM i GROUP BY job_id, g""")
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    ranges = documents.number_ranges(table(spark, sf, "page_results"), "job_id", "number")
    return ranges.select("job_id", documents.range_label(F.col("first"), F.col("last")).alias("pages"))


@query(f"""WITH {CUR}, s AS (SELECT worker_id, epoch_us(started_at) AS a, epoch_us(finished_at) AS b FROM cur WHERE worker_id IS NOT NULL AND finished_at IS NOT NULL AND started_at IS NOT NULL),
r AS (SELECT worker_id, a, max(b) OVER (PARTITION BY worker_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT worker_id, max(a - reach) AS gap FROM r WHERE a - reach > 0 GROUP BY worker_id""")
def worker_idle_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The longest idle stretch of each worker."""
    runs = jobs_now(spark, sf, "worker_id", "started_at", "finished_at").filter("worker_id is not null and started_at is not null and finished_at is not null")
    micros = runs.select("worker_id", F.unix_micros("started_at").alias("a"), F.unix_micros("finished_at").alias("b"))
    return documents.largest_gap(micros, "worker_id", "a", "b", 3_600_000_000).select("worker_id", "gap")


# ------------------------------------------------------------------ jobs


@query(f"""WITH {CUR} SELECT s.status, count(cur.id) AS n FROM (SELECT unnest(['QUEUED', 'PROCESSING', 'RETRYING', 'SUCCEEDED', 'FAILED', 'CANCELLED']) AS status) s LEFT JOIN cur ON cur.status = s.status GROUP BY s.status""")
def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.status_histogram(jobs_now(spark, sf, "status"))


@query(f"""WITH {CUR}, w AS (SELECT *, {WAIT} AS wait, {TOOK} AS took FROM cur WHERE created_at >= {AT.format(SINCE)})
SELECT count(*) AS created, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(cached_from_job_id) AS cache_hits,
 round(avg(wait) FILTER (WHERE cached_from_job_id IS NULL), 4) AS avg_wait,
 round(percentile_cont(0.5) WITHIN GROUP (ORDER BY took) FILTER (WHERE status = 'SUCCEEDED' AND cached_from_job_id IS NULL), 4) AS p50_duration,
 round(percentile_cont(0.95) WITHIN GROUP (ORDER BY took) FILTER (WHERE status = 'SUCCEEDED' AND cached_from_job_id IS NULL), 4) AS p95_duration,
 coalesce(sum(page_count) FILTER (WHERE status = 'SUCCEEDED'), 0)::BIGINT AS pages, coalesce(sum(char_count) FILTER (WHERE status = 'SUCCEEDED'), 0)::BIGINT AS chars,
 coalesce(sum(token_count) FILTER (WHERE status = 'SUCCEEDED'), 0)::BIGINT AS tokens, coalesce(sum(chunk_count) FILTER (WHERE status = 'SUCCEEDED'), 0)::BIGINT AS chunks,
 count(*) FILTER (WHERE len(warnings) > 0) AS with_warnings FROM w""")
def window_summary(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("status", "created_at", "started_at", "finished_at", "cached_from_job_id", "page_count", "char_count", "token_count", "chunk_count", "warnings")
    out = A.window_summary(jobs_now(spark, sf, *columns), stamp(SINCE))
    return out.select(*[F.round(c, 4).alias(c) if c.startswith(("avg", "p50", "p95")) else F.col(c) for c in out.columns])


@query(f"""WITH {CUR}, {UP} SELECT up.kind, count(*) AS jobs, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed,
 round(sum(epoch_us(finished_at) - epoch_us(started_at)) FILTER (WHERE status = 'SUCCEEDED' AND cached_from_job_id IS NULL)
  / count(epoch_us(finished_at) - epoch_us(started_at)) FILTER (WHERE status = 'SUCCEEDED' AND cached_from_job_id IS NULL) / 1e6, 4) AS avg_duration_s, coalesce(sum(page_count), 0)::BIGINT AS pages
FROM cur JOIN up ON up.uid = cur.document_id WHERE created_at >= {AT.format(SINCE)} GROUP BY up.kind""")
def by_kind(spark: SparkSession, sf: str) -> DataFrame:
    jobs = jobs_now(spark, sf, "document_id", "status", "created_at", "started_at", "finished_at", "cached_from_job_id", "page_count")
    return A.by_kind(jobs, table(spark, sf, "uploads"), stamp(SINCE)).withColumn("avg_duration_s", F.round("avg_duration_s", 4))


@query(f"""WITH {CUR}, c AS (SELECT (epoch_us(finished_at) // 3600000000) * 3600 AS t, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed
 FROM cur WHERE epoch_us(finished_at) >= {SINCE_S}000000 GROUP BY 1)
SELECT r.t, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed FROM (SELECT unnest(generate_series({SINCE_S // 3600 * 3600}, {NOW_S}, 3600)) AS t) r LEFT JOIN c ON c.t = r.t""")
def timeline_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return A.timeline(jobs_now(spark, sf, "status", "finished_at"), SINCE_S, NOW_S, A.bucket_seconds(72 * 60))


@query(f"""WITH {CUR} SELECT error_code AS code, count(*) AS n FROM cur WHERE status = 'FAILED' AND finished_at >= {AT.format(SINCE)} GROUP BY error_code""")
def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    jobs = jobs_now(spark, sf, "status", "error_code", "finished_at").filter((F.col("status") == "FAILED") & (F.col("finished_at") >= stamp(SINCE)))
    return A.histogram(jobs, "error_code", "code")


@query(f"""SELECT event, count(*) AS n FROM (SELECT DISTINCT * FROM job_events) WHERE created_at >= {AT.format(SINCE)} AND event IN ('worker_lost', 'message_missing', 'retry_scheduled', 'dispatch_failed', 'manual_retry', 'cancelled') GROUP BY event""")
def reliability_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "job_events").filter(F.col("event").isin(*A.RELIABILITY) & (F.col("created_at") >= stamp(SINCE))).distinct()
    return A.histogram(events, "event", "event")


@query(f"""WITH {CUR} SELECT id, queue, rank() OVER (PARTITION BY queue ORDER BY created_at) - 1 AS position FROM cur WHERE status = 'QUEUED'""")
def queue_position(spark: SparkSession, sf: str) -> DataFrame:
    return A.queue_position(jobs_now(spark, sf, "status", "queue", "created_at"))


@query(f"""WITH {CUR} SELECT client_reference, id, status FROM cur QUALIFY row_number() OVER (PARTITION BY client_reference ORDER BY created_at DESC, id) = 1""")
def newest_per_client(spark: SparkSession, sf: str) -> DataFrame:
    jobs = jobs_now(spark, sf, "client_reference", "status", "created_at")
    return A.newest(jobs, ["client_reference"], "created_at", "id").select("client_reference", "id", "status")


@query(f"""WITH {CUR}, f AS (SELECT DISTINCT id AS uid, original_filename, kind FROM uploads) SELECT cur.id, original_filename, kind FROM cur JOIN f ON f.uid = cur.document_id
 WHERE status = 'SUCCEEDED' AND kind = 'pdf' AND original_filename ILIKE '%a%' ORDER BY created_at DESC, cur.id LIMIT 50""")
def jobs_list(spark: SparkSession, sf: str) -> DataFrame:
    """The listing's newest page (a top-k report)."""
    jobs = jobs_now(spark, sf, "document_id", "status", "client_reference", "created_at")
    return A.newest_page(A.list_jobs(jobs, table(spark, sf, "uploads"), status="SUCCEEDED", kind="pdf", name="a")).select("id", "original_filename", "kind")


@query(f"""WITH {CUR}, f AS (SELECT DISTINCT id AS uid, original_filename, kind FROM uploads) SELECT kind, status, count(*) AS total FROM cur JOIN f ON f.uid = cur.document_id GROUP BY kind, status""")
def jobs_total(spark: SparkSession, sf: str) -> DataFrame:
    return A.list_jobs(jobs_now(spark, sf, "document_id", "status"), table(spark, sf, "uploads")).groupBy("kind", "status").agg(F.count("*").alias("total"))


@query(f"""WITH {CUR} SELECT id, status FROM cur WHERE status IN ('QUEUED', 'PROCESSING', 'RETRYING') ORDER BY CASE WHEN status = 'PROCESSING' THEN 0 ELSE 1 END, created_at, id LIMIT 25""")
def active_first(spark: SparkSession, sf: str) -> DataFrame:
    return A.active_jobs(jobs_now(spark, sf, "status", "created_at")).select("id", "status")


@query(f"""WITH {CUR} SELECT id, error_code FROM cur WHERE status = 'FAILED' ORDER BY finished_at DESC NULLS FIRST, id LIMIT 8""")
def recent_failures(spark: SparkSession, sf: str) -> DataFrame:
    return A.recent_failures(jobs_now(spark, sf, "status", "error_code", "finished_at")).select("id", "error_code")


@query(f"""WITH {CUR}, {UP}, k AS (SELECT cur.id, sha256, options, status, cached_from_job_id, finished_at FROM cur JOIN up ON up.uid = cur.document_id WHERE sha256 IS NOT NULL),
s AS (SELECT sha256, options, id AS hit_id FROM k WHERE status = 'SUCCEEDED' AND cached_from_job_id IS NULL QUALIFY row_number() OVER (PARTITION BY sha256, options ORDER BY finished_at DESC NULLS LAST, id) = 1)
SELECT k.id, s.hit_id FROM k JOIN s ON s.sha256 = k.sha256 AND s.options IS NOT DISTINCT FROM k.options WHERE k.id <> s.hit_id""")
def result_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    jobs = jobs_now(spark, sf, "document_id", "options", "status", "cached_from_job_id", "created_at", "finished_at")
    return A.cache_hits(jobs, table(spark, sf, "uploads"))


@query("""SELECT sha256, min(id) AS first_id, count(DISTINCT id) AS ids, count(*) AS copies FROM uploads WHERE sha256 IS NOT NULL GROUP BY sha256""")
def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return A.stored_once(table(spark, sf, "uploads"))


@query(f"""WITH {CUR} SELECT id, status, status IN ('SUCCEEDED', 'FAILED', 'CANCELLED') AS is_terminal, round({TOOK}, 2) AS took_s, round({WAIT}, 2) AS wait_s, language.code AS language_code, language.confidence AS language_confidence,
 '/v1/jobs/' || id AS self_link, '/v1/jobs/' || id || '/result' AS result_link, '/v1/jobs/' || id || '/chunks' AS chunks_link, '/v1/jobs/' || id || '/document' AS document_link,
 CASE status WHEN 'SUCCEEDED' THEN NULL WHEN 'FAILED' THEN 'JOB_FAILED' WHEN 'CANCELLED' THEN 'JOB_CANCELLED' ELSE 'JOB_NOT_FINISHED' END AS result_error, coalesce(len(warnings), 0) > 0 AS has_warnings FROM cur""")
def job_listing(spark: SparkSession, sf: str) -> DataFrame:
    return A.job_listing(jobs_now(spark, sf, "status", "created_at", "started_at", "finished_at", "language", "warnings"))


@query("""SELECT job_id, count(*) AS events, arg_min(event, id) AS first_event, arg_max(event, id) AS last_event FROM (SELECT DISTINCT * FROM job_events) WHERE job_id IS NOT NULL GROUP BY job_id""")
def events_of_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Partial aggregation by event id: the stuck job with a tenth of the rows is no hot key."""
    events = table(spark, sf, "job_events").filter("job_id is not null").select("id", "job_id", "event").distinct()
    return events.groupBy("job_id").agg(F.count("*").alias("events"), F.min_by("event", "id").alias("first_event"), F.max_by("event", "id").alias("last_event"))


@query(f"""WITH {CUR}, s AS (SELECT id, status, cancel_requested, attempts, max_attempts, heartbeat_at, created_at FROM cur)
SELECT id, CASE WHEN status = 'PROCESSING' AND (heartbeat_at IS NULL OR epoch_us({AT.format(NOW)}) - epoch_us(heartbeat_at) > 45000000) THEN CASE WHEN cancel_requested THEN 'CANCELLED' WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'REQUEUED' END
 WHEN status IN ('QUEUED', 'RETRYING') AND epoch_us({AT.format(NOW)}) - epoch_us(created_at) > 86400000000 THEN 'EXPIRED' END AS next_state FROM s""")
def stale_classify(spark: SparkSession, sf: str) -> DataFrame:
    jobs = jobs_now(spark, sf, "status", "cancel_requested", "attempts", "max_attempts", "heartbeat_at", "created_at")
    return jobs.select("id", lifecycle.next_state(stamp(NOW)).alias("next_state"))


@query(f"""WITH {CUR} SELECT id, CASE WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'RETRYING' END AS outcome, CASE WHEN attempts >= max_attempts THEN NULL ELSE (10 * pow(2, attempts - 1))::BIGINT END AS delay_s FROM cur WHERE status = 'PROCESSING'""")
def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.after_transient_failure(jobs_now(spark, sf, "status", "attempts", "max_attempts").filter("status = 'PROCESSING'"))


@query(f"""WITH {CUR} SELECT id FROM cur WHERE status IN ('QUEUED', 'RETRYING') AND (last_dispatched_at IS NULL OR epoch_us({AT.format(NOW)}) - epoch_us(last_dispatched_at) > 60000000)
 AND (next_retry_at IS NULL OR next_retry_at <= {AT.format(NOW)}) AND id NOT IN (SELECT job_id FROM (SELECT job_id, arg_max(event, id) AS last FROM job_events WHERE job_id IS NOT NULL GROUP BY job_id) WHERE last = 'dispatched')""")
def redispatch_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting jobs that are due and have no entry on the other side of the anti join."""
    jobs = jobs_now(spark, sf, "status", "created_at", "last_dispatched_at", "next_retry_at")
    events = table(spark, sf, "job_events").filter("job_id is not null").groupBy("job_id").agg(F.max_by("event", "id").alias("last"))
    broker = events.filter("last = 'dispatched'")  # jobs whose message was sent and not yet taken
    return lifecycle.to_redispatch(jobs, broker, stamp(NOW)).select("id")


@query(f"""WITH {CUR} SELECT id, array_to_string(list_concat(coalesce(warnings, []), list_filter(['Low OCR confidence on page 1', 'Checked again'], lambda w: NOT list_contains(coalesce(warnings, []), w))), ' ¦ ') AS merged FROM cur""")
def warning_merge(spark: SparkSession, sf: str) -> DataFrame:
    new = F.array(F.lit("Low OCR confidence on page 1"), F.lit("Checked again"))
    return jobs_now(spark, sf, "warnings").select("id", F.array_join(A.new_warnings(F.col("warnings"), new), " ¦ ").alias("merged"))


@query(f"""WITH {CUR}, t AS (SELECT queue, {WAIT} AS wait, {TOOK} AS took, epoch_us(created_at) AS a, epoch_us(started_at) AS b FROM cur WHERE status = 'SUCCEEDED' AND cached_from_job_id IS NULL),
e AS (SELECT queue, a AS t, 1 AS d FROM t WHERE a IS NOT NULL AND (b IS NULL OR b >= a) UNION ALL SELECT queue, b, -1 FROM t WHERE a IS NOT NULL AND b >= a), k AS (SELECT queue, t, sum(d) AS d FROM e GROUP BY ALL),
r AS (SELECT queue, sum(d) OVER (PARTITION BY queue ORDER BY t) AS depth FROM k), m AS (SELECT queue, max(depth)::BIGINT AS peak_depth FROM r GROUP BY queue)
SELECT t.queue, count(*) AS n, round(quantile_cont(wait, 0.5), 4) AS wait_p50, round(quantile_cont(wait, 0.95), 4) AS wait_p95, round(max(wait), 4) AS wait_max, round(avg(took), 4) AS took_mean, any_value(m.peak_depth) AS peak_depth FROM t LEFT JOIN m ON m.queue = t.queue GROUP BY t.queue""")
def queue_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = A.queue_summary(jobs_now(spark, sf, "status", "cached_from_job_id", "queue", "created_at", "started_at", "finished_at"))
    return out.select("queue", "n", *[F.round(c, 4).alias(c) for c in ("wait_p50", "wait_p95", "wait_max", "took_mean")], "peak_depth")


@query(f"""WITH {CUR}, c AS (SELECT count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status IN ('QUEUED', 'PROCESSING', 'RETRYING')) AS in_flight FROM cur)
SELECT succeeded, failed, in_flight, round(succeeded / (succeeded + failed), 6) AS success_rate FROM c""")
def outcome_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return A.outcome(jobs_now(spark, sf, "status")).withColumn("success_rate", F.round("success_rate", 6))


@query(f"""WITH {CUR} SELECT queue, count(*) AS depth FROM cur WHERE status = 'QUEUED' GROUP BY queue""")
def queue_depths(spark: SparkSession, sf: str) -> DataFrame:
    return A.queue_depths(jobs_now(spark, sf, "status", "queue"))


@query("""WITH p AS (SELECT page_key, max(coalesce(method, 'unknown')) AS method, max(job_id) AS job_id, max(duration_ms) AS ms FROM page_results GROUP BY page_key),
c AS (SELECT method, job_id, avg(ms) AS m FROM p GROUP BY ALL) SELECT method, round(avg(m), 4) AS macro, count(*) AS categories FROM c GROUP BY method""")
def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the jobs' mean page times per method."""
    once = table(spark, sf, "page_results").groupBy("page_key").agg(F.max(F.coalesce("method", F.lit("unknown"))).alias("method"), F.max("job_id").alias("job_id"), F.max("duration_ms").alias("ms"))
    return A.macro_average(once, ["method"], "job_id", "ms").withColumn("macro", F.round("macro", 4))


@query(f"""WITH {CUR} SELECT queue, round(sum(duration_s * page_count) / sum(page_count), 4) AS s_weighted FROM cur WHERE status = 'SUCCEEDED' AND duration_s > 0 AND isfinite(duration_s) AND page_count > 0 GROUP BY queue""")
def weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    jobs = jobs_now(spark, sf, "status", "queue", "duration_s", "page_count").filter("status = 'SUCCEEDED' and duration_s > 0 and not isnan(duration_s) and duration_s < double('inf') and page_count > 0")
    return jobs.groupBy("queue").agg(F.round(A.weighted_mean("duration_s", "page_count"), 4).alias("s_weighted"))


@query("""WITH p AS (SELECT page_key, max(coalesce(method, 'unknown')) AS method, max(duration_ms) AS ms FROM page_results GROUP BY page_key HAVING ms IS NOT NULL),
r AS (SELECT method, ms, row_number() OVER (PARTITION BY method ORDER BY ms) AS i, count(*) OVER (PARTITION BY method) AS n FROM p)
SELECT method, round(quantile_cont(ms, 0.95), 4) AS p95_interpolated, max(ms) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)::BIGINT + 1)::BIGINT AS p95_nearest FROM r GROUP BY method""")
def page_time_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Both percentile definitions, from counts of values: no method's pages are sorted or collected in one task."""
    once = table(spark, sf, "page_results").groupBy("page_key").agg(F.max(F.coalesce("method", F.lit("unknown"))).alias("method"), F.max("duration_ms").alias("ms"))
    out = A.exact_quantiles(once, ["method"], "ms", {"p95_interpolated": 0.95, "p95_nearest": 0.95}, nearest=("p95_nearest",))
    return out.select("method", F.round("p95_interpolated", 4).alias("p95_interpolated"), F.col("p95_nearest").cast("long").alias("p95_nearest"))


#: Jobs as records of a benchmark: kind of file as category, pages' times pooled.
RECORDS = f"""{CUR}, {UP}, p AS (SELECT page_key, max(job_id) AS job_id, max(duration_ms) AS ms FROM page_results GROUP BY page_key), r AS (SELECT cur.id, up.kind AS category, cur.queue, count(*) AS pages, list(p.ms) AS times, avg(p.ms) AS mean_ms
 FROM cur JOIN up ON up.uid = cur.document_id JOIN p ON p.job_id = cur.id WHERE p.ms IS NOT NULL GROUP BY ALL)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "page_results").groupBy("page_key").agg(F.max("job_id").alias("job_id"), F.max("duration_ms").alias("ms")).filter("ms is not null")
    per_job = pages.groupBy("job_id").agg(F.count("*").alias("pages"), F.collect_list("ms").alias("times"), F.avg("ms").alias("mean_ms"))
    kinds = table(spark, sf, "uploads").groupBy(F.col("id").alias("document_id")).agg(F.max("kind").alias("category"))
    return jobs_now(spark, sf, "document_id", "queue").join(kinds, "document_id").join(per_job, F.col("id") == F.col("job_id")).select("id", "category", "queue", "pages", "times", "mean_ms")


@query(f"""WITH {RECORDS}, f AS (SELECT category, unnest(times) AS ms FROM r), m AS (SELECT category, avg(ms) AS time_mean, quantile_cont(ms, 0.95) AS time_p95 FROM f GROUP BY category)
SELECT r.category, count(*) AS samples, sum(pages)::BIGINT AS pages, round(any_value(time_mean), 4) AS time_mean, round(any_value(time_p95), 4) AS time_p95, round(avg(mean_ms), 4) AS mean_ms FROM r JOIN m ON m.category = r.category GROUP BY r.category""")
def category_page_times(spark: SparkSession, sf: str) -> DataFrame:
    """Page times pooled by category beside the mean of the jobs' means."""
    out = A.category_means(records(spark, sf), ["category"], "times", "pages", "mean_ms")
    return out.select("category", "samples", "pages", *[F.round(c, 4).alias(c) for c in ("time_mean", "time_p95", "mean_ms")])


@query(f"""WITH {RECORDS}, s AS (SELECT queue, sum(mean_ms * pages) FILTER (WHERE category <> 'pdf') / sum(pages) FILTER (WHERE category <> 'pdf') AS s_weighted, avg(mean_ms) FILTER (WHERE category = 'pdf') AS real_mean, min(mean_ms) FILTER (WHERE category = 'pdf') AS real_min,
 sum(mean_ms * pages) FILTER (WHERE category = 'pdf') / sum(pages) FILTER (WHERE category = 'pdf') AS real_s_weighted FROM r GROUP BY queue), c AS (SELECT queue, category, avg(mean_ms) AS m FROM r WHERE category <> 'pdf' GROUP BY ALL), a AS (SELECT queue, avg(m) AS macro, count(*) AS categories FROM c GROUP BY queue)
SELECT s.queue, round(s_weighted, 4) AS s_weighted, round(real_mean, 4) AS real_mean, round(real_min, 4) AS real_min, round(real_s_weighted, 4) AS real_s_weighted, round(macro, 4) AS macro, categories FROM s LEFT JOIN a ON a.queue IS NOT DISTINCT FROM s.queue""")
def queue_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Queues as candidates: macro average without one category, that category's mean, minimum and weighted mean."""
    out = A.candidate_summary(records(spark, sf), ["queue"], "category", "mean_ms", "mean_ms", "pages", "pdf")
    return out.select("queue", *[F.round(c, 4).alias(c) for c in ("s_weighted", "real_mean", "real_min", "real_s_weighted", "macro")], "categories")


@query(f"""WITH {RECORDS}, c AS (SELECT queue, category, avg(mean_ms) AS m FROM r WHERE category NOT LIKE 'h%' GROUP BY ALL) SELECT queue, round(avg(m), 4) AS macro, count(*) AS categories FROM c GROUP BY queue""")
def macro_without_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of category means, categories of one prefix left out."""
    return A.macro_average(records(spark, sf), ["queue"], "category", "mean_ms", without="h").withColumn("macro", F.round("macro", 4))


# ------------------------------------------------------------------ scoring


@query(f"""WITH {PG}, c AS (SELECT job_id, chunk_index, max(text) AS text FROM chunks GROUP BY ALL),
a AS (SELECT job_id, w, count(*) AS n FROM (SELECT job_id, unnest(regexp_extract_all(lower(text), '[{LETTER}]+')) AS w FROM pg WHERE job_id IN (SELECT job_id FROM c)) GROUP BY ALL),
b AS (SELECT job_id, w, count(*) AS n FROM (SELECT job_id, unnest(regexp_extract_all(lower(text), '[{LETTER}]+')) AS w FROM c) GROUP BY ALL)
SELECT job_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::BIGINT AS common, coalesce(sum(a.n), 0)::BIGINT AS left_words, coalesce(sum(b.n), 0)::BIGINT AS right_words FROM a FULL JOIN b USING (job_id, w) GROUP BY job_id""")
def chunk_word_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Word multisets of a job's pages and of its chunks."""
    chunks = table(spark, sf, "chunks").groupBy("job_id", "chunk_index").agg(F.max("text").alias("text"))
    pages = table(spark, sf, "page_results").groupBy("job_id", "number").agg(F.max("text").alias("text"))
    both = pages.join(chunks.select("job_id").distinct(), "job_id", "left_semi")
    return scoring.bag_overlap(both, chunks, "job_id", "text")


@query("""WITH n AS (SELECT sha256, regexp_replace(original_filename, '[^ -~]', '?', 'g') AS name FROM uploads WHERE sha256 IS NOT NULL AND original_filename IS NOT NULL), u AS (SELECT sha256, min(name) AS a, max(name) AS b FROM n GROUP BY sha256)
SELECT sha256, levenshtein(a, b) AS distance, round(levenshtein(a, b) / greatest(length(a), 1), 4) AS cer FROM u""")
def filename_cer(spark: SparkSession, sf: str) -> DataFrame:
    """Edit distance of the names one content came under (characters beyond ASCII as one sign, as DuckDB counts bytes)."""
    name = F.regexp_replace("original_filename", "[^ -~]", "?")
    names = table(spark, sf, "uploads").filter("sha256 is not null and original_filename is not null").groupBy("sha256").agg(F.min(name).alias("a"), F.max(name).alias("b"))
    return names.select("sha256", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(scoring.cer(F.col("a"), F.col("b")), 4).alias("cer"))


# ------------------------------------------------------------------ formats


@query("""WITH u AS (SELECT id, max(kind) AS kind, max(extension) AS extension FROM uploads GROUP BY id)
SELECT kind, extension, count(*) AS n FROM u GROUP BY ALL""")
def kinds_and_extensions(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "uploads").groupBy("id").agg(F.max("kind").alias("kind"), F.max("extension").alias("extension"))
    return once.groupBy("kind", "extension").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT id, max(kind) AS kind, max(original_filename) AS name FROM uploads GROUP BY id), e AS (SELECT id, kind, lower(regexp_extract(name, '[^.](\\.[^./\\\\]*)$', 1)) AS ext FROM u)
SELECT id, ext, NOT CASE kind WHEN 'pdf' THEN ext = '.pdf' WHEN 'image' THEN ext IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.webp', '.bmp', '.gif') WHEN 'text' THEN ext IN ('.txt', '.md', '.markdown', '.csv', '.tsv', '.log', '.json', '.xml')
 WHEN 'html' THEN ext IN ('.html', '.htm', '.xhtml') WHEN 'docx' THEN ext = '.docx' WHEN 'pptx' THEN ext = '.pptx' WHEN 'xlsx' THEN ext = '.xlsx' WHEN 'eml' THEN ext = '.eml' WHEN 'rtf' THEN ext = '.rtf' ELSE FALSE END AS mismatch FROM e""")
def extension_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "uploads").groupBy("id").agg(F.max("kind").alias("kind"), F.max("original_filename").alias("name"))
    known = formats.formats_table(spark).select(F.col("kind").alias("k"), "extensions")
    both = once.withColumn("ext", T.extension(F.col("name"))).join(F.broadcast(known), F.col("kind") == F.col("k"), "left")
    return both.select("id", "ext", (~F.coalesce(F.array_contains("extensions", F.col("ext")), F.lit(False))).alias("mismatch"))


@query(f"""WITH {CUR}, up AS (SELECT id AS uid, max(kind) AS kind, max(size_bytes) AS bytes FROM uploads GROUP BY id) SELECT cur.id, CASE WHEN up.kind IN ('pdf', 'image') AND options.pipeline = 'layout' THEN 'layout' WHEN up.kind IN ('docx', 'pptx') AND coalesce(options.ocr_mode, 'auto') <> 'off' AND bytes // 20 >= 51200 THEN 'heavy' WHEN up.kind IN ('pdf', 'image', 'eml') THEN 'heavy' WHEN up.kind IN ('text', 'html', 'docx', 'pptx', 'xlsx', 'rtf') THEN 'light' END AS pool
FROM cur JOIN up ON up.uid = cur.document_id""")
def route_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The twentieth part of a file stands for the pictures in it, as the tables don't tell their size."""
    jobs = jobs_now(spark, sf, "document_id", F.col("options.pipeline").alias("pipeline"), F.col("options.ocr_mode").alias("mode"))
    kinds = table(spark, sf, "uploads").groupBy(F.col("id").alias("document_id")).agg(F.max("kind").alias("kind"), F.max("size_bytes").alias("bytes"))
    return jobs.join(kinds, "document_id").select("id", formats.queue_for(F.col("kind"), F.floor(F.col("bytes") / 20), F.col("pipeline"), F.col("mode")).alias("pool"))


# ------------------------------------------------------------------ streams


@query("""SELECT epoch_us(date_trunc('hour', created_at)) AS start_us, event, count(*) AS n FROM job_events GROUP BY ALL""")
def timeline_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly event counts by a stream that reads all there is, batch by batch, into a table."""
    events = streams.table_stream(spark, sf, "job_events")
    counted = streams.event_timeline(events, late=None)  # a replay of all history: no event is late
    folder = shared_folder(spark, "timeline")
    result = streams.run_into_table(counted, folder, ["start", "event"])
    return result.select(F.unix_micros("start").alias("start_us"), "event", "n")


from docmill.plans import files, states, structure  # noqa: E402, F401  (they register their queries)
