"""Problem 3: cut oversized items at natural boundaries.

Size is the project's estimate: characters // 4, at least 1, and 0 for an empty text. A text is first cut into atomic
segments (lines of tables, lists and code; sentences of prose; words of a sentence, and fixed spans of a word, that is
too large itself). All adjacent pairs lie in a heap, weakest boundary first; the top pair is merged if its combined size
plus overlap fits, so what remains uncut in the end are the strongest boundaries.

Defined results: null and empty texts are size 0 and never cut; a missing job, null options or null sizes in them give
512 and 64; sizes under 32 count as 32; an overlap above half the size is cut to half; a null kind is prose. Every
piece starts with what stands before its cut, at most ``4 * overlap`` characters from the start of a word on, and
joining the pieces without it gives the text again. Repeated rows are one item.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.tokens import current_rows
from docmill.session import cut_lineage, table

SIZE, OVERLAP, LEAST_SIZE = 512, 64, 32
MOST_KEYS = 200_000  # oversized items whose keys are broadcast, some 20 MB
BUCKETS = 1 << 19  # of hashed job ids, 2 MB in a scan task
#: Boundary strengths: blank line, heading or fence, line end, sentence end, clause end, space, inside a word.
BLANK, LINE, SENTENCE, CLAUSE, SPACE, INSIDE = 6, 5, 4, 3, 2, 1
PROSE = re.compile(r"\n\s*\n|(?<=[.!?…])[\"”»’)]*\s+|(?<=[.!?…])(?=\n)")
LINES = re.compile(r"\n+")
FINE = re.compile(r"(?<=[,;:|\t])\s*|\s+")


def estimate(text: Column) -> Column:
    """The project's token estimate as a column."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def atoms(text: str, room: int, kind: str | None) -> tuple[list[int], list[int]]:
    """End offsets of the atomic segments, each at most ``room`` characters, and the strength of the boundary there."""
    ends, strength = [], []

    def add(end: int, strong: int) -> None:
        begin = ends[-1] if ends else 0
        if end <= begin:
            return
        if end - begin > room:
            for m in FINE.finditer(text, begin, end):
                at = m.end()
                if begin < at < end and at > ends[-1] if ends else 0 < at < end:
                    while at - (ends[-1] if ends else 0) > room:
                        ends.append((ends[-1] if ends else 0) + room)
                        strength.append(INSIDE)
                    if at > (ends[-1] if ends else 0):
                        ends.append(at)
                        strength.append(CLAUSE if text[m.start() - 1 : m.start()] in ",;:|\t" else SPACE)
            while end - (ends[-1] if ends else 0) > room:
                ends.append((ends[-1] if ends else 0) + room)
                strength.append(INSIDE)
        ends.append(end)
        strength.append(strong)

    for m in (LINES if kind in ("table", "list", "code") else PROSE).finditer(text):
        gap = m.group()
        add(m.end(), BLANK if gap.count("\n") > 1 else LINE if "\n" in gap and kind in ("table", "list", "code") else SENTENCE)
    add(len(text), BLANK)
    return ends, strength


def cut(text: str, size: int, overlap: int, kind: str | None = None) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start with overlap, start of new text, end), every piece within ``size`` tokens."""
    if len(text) // 4 <= size:
        return [(0, 0, len(text))] if text else []
    most = 4 * size + 3
    tail = 4 * min(overlap, size // 2)
    room = most - tail
    ends, strength = atoms(text, room, kind)
    n = len(ends)
    begins = [0, *ends[:-1]]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[i], ends[i + 1] - begins[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, length, a, b = heapq.heappop(heap)
        if not alive[a] or b >= n or not alive[b] or after[a] != b or ends[b] - begins[a] != length or length > room:
            continue  # outdated, or it no longer fits
        ends[a], strength[a], alive[b] = ends[b], strength[b], False
        after[a] = after[b]
        if after[b] < n:
            before[after[b]] = a
            heapq.heappush(heap, (strength[a], ends[after[a]] - begins[a], a, after[a]))
        if before[a] >= 0:
            p = before[a]
            heapq.heappush(heap, (strength[p], ends[a] - begins[p], p, a))
    return [(word_start(text, max(0, begins[i] - tail), begins[i]), begins[i], ends[i]) for i in range(n) if alive[i]]


def word_start(text: str, at: int, end: int) -> int:
    """The first start of a word from ``at`` on; ``at`` itself where the stretch up to ``end`` is one word."""
    if at == 0 or at == end or text[at - 1].isspace():
        return at
    gap = re.compile(r"\s+").search(text, at, end)
    return at if gap is None else gap.end()


def split_items(items: DataFrame) -> DataFrame:
    """Pieces of the oversized ones of ``items`` (src, rec_key, kind, text, size, overlap), one scan without a shuffle.

    Columns: src, rec_key, piece_no, char_start, char_end, overlap_chars, n_tokens, text.
    """
    large = items.filter(estimate(F.col("text")) > F.col("size")).select("src", "rec_key", "kind", "text", "size", "overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                out = [
                    (r["src"], r["rec_key"], i, new, end, new - start, max(1, (end - start) // 4), r["text"][start:end])
                    for r in rows
                    for i, (start, new, end) in enumerate(cut(r["text"], r["size"], r["overlap"], r["kind"]))
                ]
                columns = list(zip(*out)) if out else [[] for _ in range(8)]
                types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                names = ["src", "rec_key", "piece_no", "char_start", "char_end", "overlap_chars", "n_tokens", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "src string, rec_key long, piece_no int, char_start long, char_end long, overlap_chars int, n_tokens int, text string"
    return large.mapInArrow(run, schema)


def limit_floor(limits: DataFrame, buckets: int) -> Column:
    """array<int>: for each bucket of hashed job ids the least limit of its jobs, at most the default.

    One row of fixed size that every scan task gets, so items that no job of their bucket could find too large are left
    out before anything is shuffled. It is a lower bound: with very many jobs a bucket it prunes less and loses nothing.
    """
    least = limits.groupBy(job_bucket(F.col("job_id"), buckets).alias("at")).agg(F.min("size").alias("least"))
    every = limits.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("at")).join(F.broadcast(least), "at", "left")  # at most a row a bucket
    filled = every.select("at", F.least(F.coalesce("least", F.lit(SIZE)), F.lit(SIZE)).alias("least"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "least"))), lambda x: x["least"])).scalar()


def job_bucket(job_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")


def sized_items(blocks: DataFrame, chunks: DataFrame, jobs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The blocks and chunks that are too large, with the limits of their job's current row.

    Keys and lengths of the items above the floor of their job's bucket (see :func:`limit_floor`) are joined with the
    limits. What exceeds them is brought to the texts in the scan while its keys are few enough to broadcast
    (``MOST_KEYS``, counted first); beyond that, the texts above the floor are shuffled to the keys.
    """
    limits = current_rows(jobs, F.col("options.chunk_size_tokens").alias("s"), F.col("options.chunk_overlap_tokens").alias("o"))
    size = F.greatest(F.coalesce("s", F.lit(SIZE)), F.lit(LEAST_SIZE))
    limits = limits.select(F.col("id").alias("job_id"), size.alias("size"), F.greatest(F.coalesce("o", F.lit(OVERLAP)), F.lit(0)).alias("overlap"))
    one = blocks.select(F.lit("block").alias("src"), F.col("block_key").alias("rec_key"), "job_id", "kind", "text")
    kind = F.when(F.size("kinds") == 1, F.element_at("kinds", 1))
    two = chunks.select(F.lit("chunk").alias("src"), F.col("chunk_key").alias("rec_key"), "job_id", kind.alias("kind"), "text")
    able = one.unionByName(two).filter(estimate(F.col("text")) > F.get(limit_floor(limits, buckets), job_bucket(F.col("job_id"), buckets)))
    short = able.select("src", "rec_key", "job_id", estimate(F.col("text")).alias("n")).join(limits, "job_id", "left")
    large = short.withColumn("size", F.coalesce("size", F.lit(SIZE))).withColumn("overlap", F.coalesce("overlap", F.lit(OVERLAP))).filter("n > size")
    keys = cut_lineage(large.select(F.col("src").alias("s_"), F.col("rec_key").alias("k_"), F.col("job_id").alias("j_"), "size", "overlap").distinct())
    few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    same = (F.col("src") == F.col("s_")) & F.col("rec_key").eqNullSafe(F.col("k_")) & F.col("job_id").eqNullSafe(F.col("j_"))
    return able.join(F.broadcast(keys) if few else keys, same).drop("s_", "k_", "j_")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_items(sized_items(table(spark, sf, "blocks"), table(spark, sf, "chunks"), table(spark, sf, "jobs")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces(spark, sf).filter("piece_no > 0").select("src", "rec_key").distinct()
