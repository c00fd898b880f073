"""The registry of queries and of the SQL that checks them, and what both sides share. ``now`` is fixed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import SPACE
from docmill.operators.current import current_jobs
from docmill.session import table

NOW, SINCE = "2026-08-22 00:00:00", "2026-08-19 00:00:00"
NOW_S, SINCE_S = 1787356800, 1787097600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the SQL side.
CUR = "cur AS (SELECT * FROM jobs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
UP = "up AS (SELECT id AS uid, max(kind) AS kind, max(sha256) AS sha256 FROM uploads GROUP BY id)"
PG = "pg AS (SELECT job_id, number, max(text) AS text FROM page_results GROUP BY job_id, number)"
AT = "TIMESTAMPTZ '{}+00'"
EPOCH = "(epoch_us({}) - epoch_us({})) / 1e6"
WAIT, TOOK = EPOCH.format("started_at", "created_at"), EPOCH.format("finished_at", "started_at")
RE_SPACE = SPACE.replace("'", "''")


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{RE_SPACE}]+', ''), '[{RE_SPACE}]+$', '')"


def tokens_sql(length: str) -> str:
    return f"CASE WHEN {length} = 0 THEN 0 ELSE greatest(1, {length} // 4) END"


def query(sql: str | None = None) -> Callable:
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def jobs_now(spark: SparkSession, sf: str, *columns: str | Column) -> DataFrame:
    return current_jobs(table(spark, sf, "jobs"), *columns)


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")
