"""The current row of each job of a table that holds several snapshots of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_jobs(jobs: DataFrame, *columns: str | Column) -> DataFrame:
    """One row a job: the one with the latest ``loaded_at`` (of equal ones the greatest row). Null ids are left out.

    A partial aggregation of structs: rows are combined before the shuffle, so repeated snapshots of one job cost no
    skew. Only the columns named are read.
    """
    named = jobs.filter("id is not null").select("id", "loaded_at", *columns)
    rest = [F.col(c) for c in named.columns if c != "id"]
    return named.groupBy("id").agg(F.max(F.struct(*rest)).alias("row")).select("id", "row.*")
