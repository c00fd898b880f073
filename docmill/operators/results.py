"""A job's result from its pages and chunks, and where its file is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import analytics, documents


def job_results(jobs: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(job_id, error, text, markdown, pages, chunks, warnings) of every job; only a succeeded one has a result, and one
    that was answered from an earlier job has that one's."""
    page = F.struct("number", "text", "method", "char_count", "ocr_confidence", "duration_ms", "warnings")
    once = pages.groupBy("job_id").agg(F.sort_array(F.collect_set(page)).alias("pages"))
    piece = F.struct("chunk_index", "id", "text", "token_count", "page_start", "page_end", "heading_path", "char_start", "char_end", "kinds", "overlap_tokens")
    parts = chunks.groupBy("job_id").agg(F.sort_array(F.collect_set(piece)).alias("chunks"))
    whole = documents.document_texts(pages).select("job_id", "text").join(documents.document_markdown(pages).select("job_id", "markdown"), "job_id")
    made = whole.join(once, "job_id").join(parts, "job_id", "left").withColumnRenamed("job_id", "from_id")
    asked = jobs.select(F.col("id").alias("job_id"), analytics.result_error(F.col("status")).alias("error"), "warnings", F.coalesce("cached_from_job_id", "id").alias("source_id"))
    both = asked.join(made, asked["error"].isNull() & (asked["source_id"] == made["from_id"]), "left")
    return both.select("job_id", "error", "text", "markdown", "pages", "chunks", "warnings")


def originals(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """(job_id, key, original_filename, mime_type, download_name) of the stored files of jobs."""
    file = uploads.groupBy(F.col("id").alias("document_id")).agg(F.max(F.struct("sha256", "extension", "original_filename", "mime_type")).alias("f"))
    both = jobs.select(F.col("id").alias("job_id"), "document_id").join(file, "document_id")
    return both.select("job_id", T.document_key(F.col("f.sha256"), F.col("f.extension")).alias("key"), "f.original_filename", "f.mime_type", T.download_name(F.col("f.original_filename")).alias("download_name"))
