"""Bounded lists for the driver: the most frequent keys of a large table, and small tables of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

STEPS = 16  # bins a doubling of the count
PARTS = 4096  # of rows with the same count


def most_frequent(counts: DataFrame, n: str, most: int, key: str | None = None) -> DataFrame:
    """The rows of ``counts`` with the largest ``n`` (positive), at most ``most`` of them.

    Rows are counted by logarithmic bins of ``n`` (some hundred, whatever the table), the driver finds the lowest bin
    that still fits, and the table is filtered by it. Nothing is sorted, and no partition sends a list of its own. Rows
    of one bin stay or go together, so slightly fewer than ``most`` may come out; with ``key``, the bin that doesn't fit
    is divided by ``n`` and equal ``n`` by the hash of ``key``, so that large bins aren't lost.
    """
    bin_ = F.floor(F.log2(F.col(n).cast("double")) * STEPS).cast("int")
    held, lowest, over = 0, None, None
    for row in sorted(counts.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -(r["bin"] or 0)):
        if held + row["count"] > most:
            over = row["bin"]
            break
        held += row["count"]
        lowest = row["bin"]
    fits = F.lit(False) if lowest is None else bin_ >= lowest
    if key is None or over is None:
        return counts.filter(fits)
    tied = bin_ == over
    for part in (-F.col(n), F.pmod(F.xxhash64(key), F.lit(PARTS))):
        for row in sorted(counts.filter(tied).groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
            if held + row["count"] > most:
                fits, tied = fits | (tied & (part < row["part"])), tied & (part == row["part"])
                break
            held += row["count"]
    return counts.filter(fits)


def collected(df: DataFrame, most: int, what: str) -> list[Row]:
    """All rows of a table that has to be small. Beyond ``most`` an error says so; rows are never dropped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most:,} rows")
    return rows


def drawn(df: DataFrame, group: str, text: str, most: int) -> DataFrame:
    """A draw of labelled rows: at most ``most`` of each ``group``, by hash of ``text``, so that none is preferred."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.xxhash64(text), text)
    return df.withColumn("draw_", F.row_number().over(order)).filter(F.col("draw_") <= most).drop("draw_")
