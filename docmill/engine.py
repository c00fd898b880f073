"""The engine's façade over a folder of tables: listings, results, ingestion and statistics."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import entities, language, text
from docmill.operators import analytics, chunking, documents, results, transitions
from docmill.operators.current import current_jobs
from docmill.schemas import TABLES, conformed
from docmill.session import cut_lineage, table
from docmill.sources import extract, files, formats

MOST_SAMPLES = 5_000  # bound of the passages that languages are told by
MODES, PIPELINES, ENGINES = ("auto", "force", "off"), ("standard", "layout"), ("rapidocr", "tesseract")


class InvalidOptions(ValueError):
    """Options that no job accepts."""


class Refused(RuntimeError):
    """A request that a job's state doesn't allow; its text is the code."""


def check_options(language: str | None = None, ocr_mode: str = "auto", chunk_size_tokens: int = 512, chunk_overlap_tokens: int = 64, pipeline: str = "standard", ocr_engine: str | None = None, extract_entities: bool = True) -> dict:
    """Validated options of a job; languages may be joined by commas."""
    if ocr_mode not in MODES or pipeline not in PIPELINES:
        raise InvalidOptions(f"ocr_mode is one of {MODES}, pipeline one of {PIPELINES}")
    if ocr_engine is not None and ocr_engine not in ENGINES:
        raise InvalidOptions(f"ocr_engine is one of {ENGINES}")
    if not 64 <= chunk_size_tokens <= 4096 or not 0 <= chunk_overlap_tokens <= 1024 or chunk_overlap_tokens >= chunk_size_tokens:
        raise InvalidOptions("chunk size is 64 to 4096, overlap 0 to 1024 and below the size")
    return {"language": language.replace(",", "+") if language else None, "ocr_mode": ocr_mode, "ocr_engine": ocr_engine, "extract_entities": extract_entities, "chunk_size_tokens": chunk_size_tokens, "chunk_overlap_tokens": chunk_overlap_tokens, "pipeline": pipeline}


class UnknownJob(KeyError):
    """No job has this id."""


class Engine:
    """Reads the tables of ``base``. Methods return lazy DataFrames; those that change jobs return what is to be appended,
    and :meth:`commit` appends it."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def table(self, name: str) -> DataFrame:
        df = table(self.spark, self.base, name)
        return conformed(df, name) if name in TABLES else df

    def current(self) -> DataFrame:
        jobs = self.table("jobs")
        return current_jobs(jobs, *[c for c in jobs.columns if c not in ("id", "loaded_at")])

    def jobs(self, status: str | None = None, kind: str | None = None, client_reference: str | None = None, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return analytics.newest_page(analytics.list_jobs(self.current(), self.table("uploads"), status, kind, client_reference, q), limit, offset)

    def job(self, id_: str) -> DataFrame:
        """One job as the listing shows it, with its position in its queue while it waits there."""
        now = self.current()
        return analytics.job_listing(now.filter(F.col("id") == id_)).join(analytics.queue_position(now).filter(F.col("id") == id_).select("id", "position"), "id", "left")

    def events(self, job_id: str) -> DataFrame:
        return self.table("job_events").filter(F.col("job_id") == job_id).distinct().orderBy("id")

    def text(self, job_id: str) -> DataFrame:
        return documents.document_texts(self.table("page_results").filter(F.col("job_id") == job_id))

    def markdown(self, job_id: str) -> DataFrame:
        return documents.document_markdown(self.table("page_results").filter(F.col("job_id") == job_id))

    def chunks(self, job_id: str, form: str = "rows") -> DataFrame:
        """The chunks in order, as rows or as one JSON line each (``jsonl``)."""
        found = self.table("chunks").filter(F.col("job_id") == job_id).distinct().orderBy("chunk_index")
        return found.select(files.result_json("job_id", *[c for c in found.columns if c != "job_id"]).alias("line")) if form == "jsonl" else found

    def result(self, job_id: str, text: bool = True, pages: bool = True, chunks: bool = False) -> DataFrame:
        """One row with what was asked for; ``error`` says why a job has no result yet, or none at all."""
        whole = results.job_results(self.current().filter(F.col("id") == job_id), *(self.table(t).filter(F.col("job_id") == job_id) for t in ("page_results", "chunks")))
        return analytics.shaped_result(whole, text, pages, chunks)

    def original(self, job_id: str) -> DataFrame:
        """(key, original_filename, mime_type, download_name) of the stored file of a job."""
        return results.originals(self.current().filter(F.col("id") == job_id), self.table("uploads"))

    def _asked(self, job_id: str) -> DataFrame:
        return self.spark.createDataFrame([(job_id,)], "job_id string")

    def cancel(self, job_id: str, now: datetime) -> transitions.Change:
        return self._checked("cancel", transitions.cancel, job_id, now)

    def retry(self, job_id: str, now: datetime) -> transitions.Change:
        return self._checked("retry", transitions.retry, job_id, now)

    def _checked(self, action: str, make: Callable, job_id: str, now: datetime) -> transitions.Change:
        job = self.current().filter(F.col("id") == job_id)
        row = job.select(transitions.refusal(action, F.col("status")).alias("why")).first()
        if row is None:
            raise UnknownJob(job_id)
        if row["why"] is not None:
            raise Refused(row["why"])
        return make(job, self._asked(job_id), F.lit(now).cast("timestamp"))

    def recover(self, broker: DataFrame, now: datetime) -> transitions.Change:
        return transitions.recover(self.current(), broker, F.lit(now).cast("timestamp"))

    def commit(self, made: transitions.Change) -> None:
        """Append snapshots and events; both are read completely before either table grows."""
        jobs, events = cut_lineage(conformed(made.jobs, "jobs")), cut_lineage(conformed(made.events, "job_events"))
        files.append_events(events, f"{self.base}/job_events.parquet")
        files.append_events(jobs, f"{self.base}/jobs.parquet")

    def formats(self) -> DataFrame:
        return formats.formats_table(self.spark)

    def stats(self, window_minutes: int, now: datetime) -> dict[str, DataFrame]:
        """The dashboard's tables for the window that ends at ``now``."""
        if not 5 <= window_minutes <= 10_080:
            raise InvalidOptions("window is 5 to 10080 minutes")
        since = int(now.timestamp()) - 60 * window_minutes
        start, jobs, uploads = F.timestamp_seconds(F.lit(since)), self.current(), self.table("uploads")
        events = self.table("job_events").distinct().filter((F.col("created_at") >= start) & F.col("event").isin(*analytics.RELIABILITY))
        return {
            "status_counts": analytics.status_histogram(jobs), "window": analytics.window_summary(jobs, start), "by_kind": analytics.by_kind(jobs, uploads, start),
            "timeline": analytics.timeline(jobs, since, int(now.timestamp()), analytics.bucket_seconds(window_minutes)), "errors": analytics.histogram(jobs.filter((F.col("status") == "FAILED") & (F.col("finished_at") >= start)), "error_code", "code"),
            "reliability": analytics.histogram(events, "event", "event"), "active": analytics.active_jobs(jobs), "recent_failures": analytics.recent_failures(jobs), "queues": analytics.queue_depths(jobs),
        }

    def ingest(self, path: str, samples: DataFrame | None = None, **options: object) -> dict[str, DataFrame]:
        """Files of a folder to ``pages``, ``errors``, ``chunks`` and ``documents``; equal contents are read once. With
        ``samples`` (lang, text), a small table of passages of certain language, documents get a language."""
        chosen = check_options(**options)
        stored = files.distinct_contents(files.scan_files(self.spark, path))
        pages = extract.extract_pages(stored, chosen)
        good = pages.filter("error_code is null").withColumn("job_id", F.col("path"))
        marked = documents.document_markdown(good, "markdown")
        size, overlap = (F.lit(chosen[k]) for k in ("chunk_size_tokens", "chunk_overlap_tokens"))
        chunks = chunking.chunk_documents(marked, "job_id", "markdown", size, overlap)
        body = documents.document_texts(good)
        words = language.small_words([tuple(r) for r in samples.select("lang", "text").filter("lang is not null and text is not null").limit(MOST_SAMPLES).collect()]) if samples is not None else {}
        found = entities.all_entities(F.col("text")) if chosen["extract_entities"] else F.lit(None).cast("map<string,array<string>>")
        enriched = body.select("job_id", "n_pages", *documents.text_statistics(F.col("text")), found.alias("entities"), language.language_of(F.col("text"), words).alias("language"))
        derived = marked.select("job_id", documents.outline(F.col("markdown")).alias("outline"), text.estimate_tokens(F.col("markdown")).alias("markdown_tokens"), F.lit(chunking.TOKENIZER).alias("tokenizer"), F.length("markdown").alias("markdown_chars"), documents.table_count(F.col("markdown")).alias("tables"))
        counted = chunks.groupBy("job_id").agg(F.count("*").alias("chunk_count"))
        whole = enriched.join(derived, "job_id").join(counted, "job_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        return {"pages": good, "errors": pages.filter("error_code is not null").select("path", "kind", "error_code", "warnings"), "chunks": chunks, "documents": whole}
