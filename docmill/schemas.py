"""The tables' columns, and how a table of an older or wider form is brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = "struct<language string, ocr_mode string, ocr_engine string, extract_entities boolean, chunk_size_tokens int, chunk_overlap_tokens int, pipeline string>"
#: Columns of the data contract (fixed values).
TABLES = {
    "uploads": "id string, sha256 string, original_filename string, kind string, mime_type string, extension string, size_bytes long, created_at timestamp",
    "jobs": f"id string, document_id string, status string, stage string, progress double, queue string, options {OPTIONS}, client_reference string, attempts int, max_attempts int, dispatch_count int, cancel_requested boolean, worker_id string, error_code string, error_message string, warnings array<string>, page_count int, char_count int, word_count int, token_count int, chunk_count int, language struct<code string, confidence double>, cached_from_job_id string, created_at timestamp, last_dispatched_at timestamp, started_at timestamp, heartbeat_at timestamp, next_retry_at timestamp, finished_at timestamp, duration_s double, queue_wait_s double, loaded_at timestamp",
    "job_events": "id long, job_id string, created_at timestamp, level string, event string, message string, data string",
    "page_results": "page_key long, job_id string, number int, text string, method string, char_count int, ocr_confidence double, duration_ms int, warnings array<string>",
    "blocks": "block_key long, job_id string, block_index int, kind string, text string, page int, char_start int, char_end int, heading_path array<string>, level int, tokens int",
    "chunks": "chunk_key long, job_id string, id string, chunk_index int, text string, token_count int, page_start int, page_end int, heading_path array<string>, char_start int, char_end int, kinds array<string>, overlap_tokens int",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of a table: missing ones are null, others are cast, further ones are left out."""
    held = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[(F.col(f.name) if held.get(f.name) == f.dataType else F.col(f.name).cast(f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema_of(name)])


def differences(df: DataFrame, name: str) -> list[str]:
    """What sets ``df`` apart from a table's columns, one line a column; empty where nothing does."""
    held, wanted = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (df.schema, schema_of(name)))
    return [f"{c}: {held.get(c, 'missing')} instead of {wanted.get(c, 'nothing')}" for c in sorted(set(held) | set(wanted)) if held.get(c) != wanted.get(c)]
