"""Problem 7: mergeable percentiles of very large numeric columns with a known rank error.

Deterministic buffer collapsing: a summary holds full sorted buffers of ``K`` values, each with a power-of-two weight
(its level). Two buffers of one level collapse into one of the next by taking every second position of their merged
order, alternately the odd and the even ones. Buffers are scheduled as a binary tree, so ``n`` values need at most
``log2(n / K) + 1`` buffers, and ranks are off by at most ``n * log2(n / K) / (2 K)``; up to ``K`` values are exact.
Summaries of partitions, days or queues merge by the same rule.

Defined results: null, NaN and infinite values are left out; a group without values has no summary; ties keep their
multiplicity; the percentile of an even number of values is the mean of both middle ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.tokens import current_rows
from docmill.session import cut_lineage, table

K = 2048


FAN = 32  # summaries that one task merges into one
BUFFER = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("odd", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
STATE = [T.StructField("n", T.LongType()), T.StructField("buffers", T.ArrayType(BUFFER))]


class Buffers:
    """One summary: ``tail`` unsorted values of weight 1 and at most one full buffer a level. ``odd`` is the side that the
    next collapse of a level takes; it is stored with the summary, so merging goes on where it stopped."""

    def __init__(self) -> None:
        self.n = 0
        self.tail: list[np.ndarray] = []
        self.held = 0
        self.levels: dict[int, np.ndarray] = {}
        self.odd: dict[int, int] = {}

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.tail.append(values)
        self.held += len(values)
        if self.held >= K:
            pool = np.concatenate(self.tail)
            full = len(pool) // K
            for i in range(full):
                self.push(np.sort(pool[i * K : (i + 1) * K]), 0)
            self.tail, self.held = [pool[full * K :]], len(pool) - full * K

    def push(self, buffer: np.ndarray, level: int) -> None:
        while level in self.levels:
            both = np.sort(np.concatenate([self.levels.pop(level), buffer]), kind="stable")
            side = self.odd.get(level, 0)
            self.odd[level] = 1 - side
            buffer, level = both[side::2], level + 1
        self.levels[level] = buffer

    def merge(self, other: Buffers) -> None:
        n = self.n + other.n
        for level, side in other.odd.items():
            self.odd[level] = self.odd.get(level, 0) ^ side
        for level in sorted(other.levels):
            self.push(other.levels[level], level)
        for part in other.tail:
            self.add(part)
        self.n = n

    def rows(self) -> list[tuple[int, int, np.ndarray]]:
        """(level, side, values) of each level; level -1 holds the values of weight 1."""
        out = [(level, self.odd.get(level, 0), self.levels.get(level, np.zeros(0))) for level in sorted({*self.levels, *self.odd})]
        return out + ([(-1, 0, np.sort(np.concatenate(self.tail)))] if self.held else [])

    @staticmethod
    def of(rows: list) -> Buffers:
        out = Buffers()
        for level, side, values in rows:
            values = np.asarray(values, float)
            if level < 0:
                out.add(values)
                continue
            if side:
                out.odd[level] = side
            if len(values):
                out.levels[level] = values
                out.n += len(values) << level
        return out

    def quantile(self, q: float) -> float:
        parts = [(np.sort(np.concatenate(self.tail)) if self.held else np.array([]), 1)] + [(b, 1 << level) for level, b in self.levels.items()]
        values = np.concatenate([v for v, _ in parts])
        weights = np.concatenate([np.full(len(v), w) for v, w in parts])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        at = q * (ranks[-1] - 1)
        low, high = (values[np.searchsorted(ranks, r, side="right")] for r in (np.floor(at), np.ceil(at)))
        return float(low + (high - low) * (at - np.floor(at)))


def packed(keys: list[pa.Array], names: list[str], held: list[Buffers]) -> pa.RecordBatch:
    """Summaries as a record batch of their keys, n and buffers."""
    rows = [b.rows() for b in held]
    flat = [x for own in rows for x in own]
    values = np.concatenate([v for *_, v in flat]) if flat else np.zeros(0)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for *_, v in flat])]).astype(np.int32)), pa.array(values, pa.float64()))
    items = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), inner], names=["level", "odd", "values"])
    buffers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in rows])]).astype(np.int32)), items)
    return pa.RecordBatch.from_arrays([*keys, pa.array([b.n for b in held], pa.int64()), buffers], names=[*names, "n", "buffers"])


def unpacked(column: pa.Array) -> Iterator[Buffers]:
    """The summaries of a ``buffers`` column, their values without a copy into Python lists."""
    for i in range(len(column)):
        own = column[i].values
        yield Buffers.of([(own.field("level")[j].as_py(), own.field("odd")[j].as_py(), own.field("values")[j].values.to_numpy(zero_copy_only=False)) for j in range(len(own))])


def merged_tree(parts: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One summary a key from ``parts`` (keys, n, buffers and a number ``at``, at most ``FAN`` rows a key and number).

    Level by level the summaries of a key and number become one and the number is divided by ``FAN``, so no task holds
    more than some ``FAN`` summaries of a key at a time, however many there are.
    """
    spark = parts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [parts.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField(at, T.LongType()), *STATE])
    order = [*keys, at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, done_keys, done = None, None, [], []

        def out(kinds: list[pa.DataType]) -> pa.RecordBatch:
            batch = packed([pa.array([k[i] for k in done_keys], t) for i, t in enumerate(kinds)], order, done)
            done_keys.clear(), done.clear()
            return batch

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [f.type for f in batch.schema][: len(order)]
            own = list(zip(*(batch.column(i).to_pylist() for i in range(len(order)))))
            for key, summary in zip(own, unpacked(batch.column(len(order) + 1))):
                if key != now:
                    if total is not None:
                        done_keys.append(now), done.append(total)
                    now, total = key, summary
                else:
                    total.merge(summary)
            if len(done) >= 256:
                yield out(kinds)
        if total is not None:
            done_keys.append(now), done.append(total)
        if done:
            yield out(kinds)

    last = parts.agg(F.max(at).alias("top")).first()["top"]
    while True:
        parts = parts.repartition(tasks, *order).sortWithinPartitions(*order).select(*order, "n", "buffers").mapInArrow(run, schema)
        if not last:
            return parts.drop(at)
        parts, last = parts.withColumn(at, F.floor(F.col(at) / FAN)), last // FAN


def summaries(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, buffers) of every group. ``buffers`` is array<struct<level, odd, values>> of bounded size.

    Every task first summarises what it scanned, so at most some summaries a task and group are shuffled, and these are
    merged as a tree by the number of their task: neither a hot group nor very many tasks meet in one task.
    """
    x = F.col(value).cast("double")
    clean = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(*keys, x.alias("value_"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Buffers] = {}
        kinds: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            made = list(held)
            batch = packed([pa.array([k[i] for k in made], t) for i, t in enumerate(kinds)], keys, list(held.values()))
            held.clear()
            return batch

        for batch in batches:
            kinds = [f.type for f in batch.schema][:-1]
            coded = [batch.column(i).dictionary_encode(null_encoding="encode") for i in range(len(keys))]
            code = np.zeros(batch.num_rows, np.int64)
            for c in coded:
                code = code * max(len(c.dictionary), 1) + c.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            values = batch.column(len(keys)).to_numpy(zero_copy_only=False)[order]
            starts = np.flatnonzero(np.diff(code[order], prepend=-1)) if batch.num_rows else np.zeros(0, int)
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(c[int(order[a])].as_py() for c in coded)
                held.setdefault(key, Buffers()).add(values[a:b])
            if len(held) > 20_000:  # many groups: hand on what there is, they merge later
                yield out()
        if held:
            yield out()

    schema = T.StructType([*(df.schema[k] for k in keys), *STATE])
    partial = cut_lineage(clean.mapInArrow(scan, schema).withColumn("at_", F.floor(F.spark_partition_id() / FAN)))
    return merged_tree(partial, keys, "at_")


def merge_summaries(df: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of coarser groups from finer ones, merged as a tree over numbers drawn by hash, some ``FAN`` a number."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // FAN))
    return merged_tree(df.select(*keys, "n", "buffers", F.pmod(F.xxhash64("buffers"), F.lit(parts)).alias("at_")), keys, "at_")


def quantiles(df: DataFrame, qs: dict[str, float]) -> DataFrame:
    """Adds one column a quantile, and ``rank_error`` (the bound in ranks), to a table of summaries."""
    names = list(qs)

    @F.pandas_udf(f"struct<{', '.join(f'{n}: double' for n in names)}, rank_error: double>")
    def read(buffers: pd.Series) -> pd.DataFrame:
        out = []
        for b in buffers:
            s = Buffers.of([(x["level"], x["odd"], x["values"]) for x in b])
            top = max(s.levels, default=0)
            out.append([*(s.quantile(q) for q in qs.values()), s.n * top / (2 * K)])
        return pd.DataFrame(out, columns=[*names, "rank_error"])

    return df.withColumn("q_", read("buffers")).select(*[c for c in df.columns if c != "buffers"], "q_.*")


def job_metrics(jobs: DataFrame) -> DataFrame:
    """(metric, queue, day, value) of current, succeeded, uncached jobs; values finite and above 0."""
    now = current_rows(jobs, "status", "cached_from_job_id", "queue", "created_at", "duration_s", "queue_wait_s")
    now = now.filter("status = 'SUCCEEDED' and cached_from_job_id is null")
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("duration_s", "queue_wait_s")])).alias("x")
    long = now.select("queue", F.date_format("created_at", "yyyy-MM-dd").alias("day"), stack).select("x.metric", "queue", "day", "x.value")
    return long.filter("value > 0 and not isnan(value) and value < double('inf')")


def p7_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    daily = summaries(job_metrics(table(spark, sf, "jobs")), ["metric", "queue", "day"], "value")
    return quantiles(daily, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    daily = cut_lineage(summaries(job_metrics(table(spark, sf, "jobs")), ["metric", "queue", "day"], "value"))
    whole = quantiles(merge_summaries(daily, ["metric", "queue"]), {"all": 0.5}).select("metric", F.col("queue").alias("q"), "all")
    days = quantiles(daily, {"p50": 0.5}).filter("n >= 10 and queue is not null and day is not null")
    found = days.join(whole, (days["metric"] == whole["metric"]) & (days["queue"] == whole["q"]))
    return found.filter(F.col("p50") >= 3 * F.col("all")).select(days["metric"], "queue", "day")
