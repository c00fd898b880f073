"""Problems 6, 8 and 9: encoding the corpus, token budgets, and filling fixed-capacity containers.

Defined results: a null and an empty text have no ids and zero tokens; a blank text is encoded like any other; rows of
equal content are separate items; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.bpe import CUTS, PIECES, Memo, encoder
from docmill.llm.language import language_code
from docmill.llm.ranking import collected, most_frequent
from docmill.session import cut_lineage, table

SLICE = 512  # texts in memory at once in a Python worker


def vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcast text of a vocabulary file (1.6 MB, fixed whatever the corpus). Read on the driver alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def slices(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(part.schema.get_field_index(key)), part.column(part.schema.get_field_index(text)).to_pylist()


# ---------------------------------------------------------------- problem 8


def encode_ids(df: DataFrame, key: str, text: str, vocab_path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row by the tokenization automaton. One pass, no shuffle."""
    vocab = vocabulary(df.sparkSession, vocab_path)
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab.value).encode
        for keys, texts in slices(batches, key, text):
            ids = [encode(t) for t in texts]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str, ids: str = "ids", vocab_path: str | None = None) -> DataFrame:
    """The inverse of :func:`encode_ids`: ``key`` and ``text``; an empty or null list gives an empty text."""
    vocab = vocabulary(df.sparkSession, vocab_path)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(vocab.value).automaton.decode
        for keys, lists in slices(batches, key, ids):
            yield pa.RecordBatch.from_arrays([keys, pa.array([decode(x or []) for x in lists], pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, vocab_path: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; one pass, no shuffle."""
    vocab = vocabulary(df.sparkSession, vocab_path)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocab.value).count
        for keys, texts in slices(batches, key, text):
            yield pa.RecordBatch.from_arrays([keys, pa.array([count(t) for t in texts], pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, schema)


# ---------------------------------------------------------------- problem 6


def piece_counts(items: DataFrame) -> DataFrame:
    """Distinct pieces of the corpus with their tokens: (piece, n_tokens, n).

    Tasks pre-aggregate the pieces they see; a piece then goes to the partition of its first characters, where the
    sorted pieces are walked as a prefix trie: the automaton's state after the prefix shared with the piece before is
    kept and only the rest is read. Only distinct pieces are shuffled, so a frequent piece or prefix is not a hot key.
    """
    spark = items.sparkSession
    vocab = vocabulary(spark)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        split = Memo(lambda w: PIECES.findall(" " + w), 200_000)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
            seen.clear()
            return batch

        for texts in (part.to_pylist() for batch in batches for part in (batch.column(0).slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))):
            words: Counter[str] = Counter()
            for text in texts:
                if text:
                    parts = CUTS.split(text)
                    for p in PIECES.findall(parts[0]):
                        seen[p] += 1
                    words.update(parts[1:])
            for word, n in words.items():
                for p in split[word]:
                    seen[p] += n
            if len(seen) > 400_000:
                yield out()
        yield out()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = encoder(vocab.value).automaton
        word, path, start, count = "", [-1], [0], [0]
        for batch in batches:
            texts, tokens = batch.column(0).to_pylist(), []
            for text in texts:
                new = automaton.spell(text)
                same, most = 0, min(len(new), len(word))
                while same < most and new[same] == word[same]:
                    same += 1
                del path[same + 1 :], start[same + 1 :], count[same + 1 :]
                automaton.extend(new, path, start, count)
                word = new
                tokens.append(count[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int32()), batch.column(1)], names=["piece", "n_tokens", "n"])

    found = items.select("text").mapInArrow(pieces, "piece string, n long")
    distinct = found.groupBy("piece").agg(F.sum("n").alias("n"))
    trie = distinct.repartition(F.substring("piece", 1, 4)).sortWithinPartitions("piece")
    return trie.mapInArrow(walk, "piece string, n_tokens int, n long")


def text_tokens(items: DataFrame, hot_pieces: int = 100_000) -> DataFrame:
    """``items`` with ``n_tokens`` in place of ``text``: terminal counts joined back to the items, one row each.

    ``hot_pieces`` bounds the broadcast: the counts of that many most frequent pieces (about 2 MB, whatever the corpus)
    are added in the scan; every other piece is joined by a shuffle on the piece. Both give exact counts; no item is
    dropped. The rows of the scan are numbered and written once, and everything after reads what was written, so another
    split of the input, or an executor that is lost, can't change an item's number.
    """
    spark = items.sparkSession
    counts = cut_lineage(piece_counts(items.select("text")))
    hot = {r["piece"]: r["n_tokens"] for r in most_frequent(counts, "n", hot_pieces).select("piece", "n_tokens").collect()}
    sent = spark.sparkContext.broadcast(hot)
    kept = [f for f in items.schema.fields if f.name != "text"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def of(text: str) -> tuple[int, tuple[str, ...]]:
            sum_, cold = 0, []
            for p in PIECES.findall(text):
                n = known.get(p)
                if n is None:
                    cold.append(p)
                else:
                    sum_ += n
            return sum_, tuple(cold)

        memo = Memo(lambda w: of(" " + w), 200_000)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                totals, ends, pieces, times = [], [0], [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    total, cold = 0, Counter()
                    if text:
                        words = CUTS.split(text)
                        total, head = of(words[0])
                        cold.update(head)
                        for n, rest in map(memo.__getitem__, words[1:]):
                            total += n
                            if rest:
                                cold.update(rest)
                    totals.append(total)
                    pieces += cold
                    times += cold.values()
                    ends.append(len(pieces))
                cold_ = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(times, pa.int64())], names=["piece", "times"])
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cold_)], names=[*(f.name for f in kept), "hot_", "cold_"])

    schema = T.StructType([*kept, T.StructField("hot_", T.LongType()), T.StructField("cold_", T.ArrayType(T.StructType([T.StructField("piece", T.StringType()), T.StructField("times", T.LongType())])))])
    rows = cut_lineage(items.select(*[f"`{f.name}`" for f in kept], "text").mapInArrow(look_up, schema).withColumn("item_", F.monotonically_increasing_id()))
    cold = rows.select("item_", F.inline("cold_")).join(counts.select("piece", "n_tokens"), "piece")
    more = cold.groupBy("item_").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("more_"))
    both = rows.drop("cold_").join(more, "item_", "left")
    return both.select(*[f"`{f.name}`" for f in kept], (F.col("hot_") + F.coalesce("more_", F.lit(0))).alias("n_tokens"))


def label(column: Column) -> Column:
    return F.coalesce(language_code(column), F.lit("und"))


def token_budget(documents: DataFrame, jobs: DataFrame, uploads: DataFrame, pages: DataFrame) -> DataFrame:
    """Token totals per slice: (scope, source, lang, domain, kind, n_items, n_tokens).

    Scope ``document``: per source, language and domain of ``documents``. Scope ``job``: per language and file kind, of
    current, succeeded jobs that weren't answered from an earlier job; each page once; the stored ``token_count`` isn't
    used. Nulls in a slice column form a slice of their own; labels are two-letter codes, ``und`` where none is usable.
    """
    none = F.lit(None).cast("string")
    docs = documents.select(F.lit("document").alias("scope"), "source", label(F.col("lang")).alias("lang"), "domain", none.alias("job_id"), F.lit(None).cast("long").alias("page_key"), "text")
    page = pages.select(F.lit("job").alias("scope"), none.alias("source"), none.alias("lang"), none.alias("domain"), "job_id", "page_key", "text")
    tokens = cut_lineage(text_tokens(docs.unionByName(page)))
    doc_part = tokens.filter("scope = 'document'").groupBy("source", "lang", "domain").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    per_job = tokens.filter("scope = 'job'").groupBy("job_id", "page_key").agg(F.max("n_tokens").alias("n_tokens"))
    per_job = per_job.groupBy("job_id").agg(F.sum("n_tokens").alias("n_tokens"))
    now = current_rows(jobs, "status", "cached_from_job_id", "document_id", F.col("language.code").alias("code"))
    now = now.filter("status = 'SUCCEEDED' and cached_from_job_id is null")
    kinds = uploads.select(F.col("id").alias("document_id"), "kind").groupBy("document_id").agg(F.max("kind").alias("kind"))
    job_part = now.join(per_job, now["id"] == per_job["job_id"]).join(kinds, "document_id", "left")
    job_part = job_part.groupBy(label(F.col("code")).alias("lang"), "kind").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    first = doc_part.select(F.lit("document").alias("scope"), "source", "lang", "domain", none.alias("kind"), "n_items", "n_tokens")
    return first.unionByName(job_part.select(F.lit("job").alias("scope"), none.alias("source"), "lang", none.alias("domain"), "kind", "n_items", "n_tokens"))


def current_rows(jobs: DataFrame, *columns: Column | str) -> DataFrame:
    """The current row of each job: of those with the latest ``loaded_at`` the greatest; identical rows count once.

    A partial aggregation, so a job with very many rows is no hot key. Rows without an id are left out.
    """
    named = jobs.filter("id is not null").select("id", "loaded_at", *columns)
    best = named.groupBy("id").agg(F.max(F.struct(*[F.col(c) for c in named.columns if c != "id"])).alias("row"))
    return best.select("id", "row.*")


# ---------------------------------------------------------------- problem 9


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets that minimise total padding, by dynamic programming.

    ``sizes`` ascending and distinct. ``cost(i, j)`` is what items i..j lack to the size of j; the best split point
    moves right with j, so each layer is filled by divide and conquer.
    """
    n = len(sizes)
    if n <= buckets:
        return [int(x) for x in sizes]
    items = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    mass = np.concatenate([[0], np.cumsum(sizes * counts)]).astype(np.int64)
    best = np.concatenate([[0], sizes * items[1:] - mass[1:]])  # one bucket over the first j sizes
    back = np.zeros((buckets, n + 1), np.int32)
    for layer in range(1, buckets):
        new = np.full(n + 1, np.iinfo(np.int64).max // 2, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + sizes[j - 1] * (items[j] - items[i]) - (mass[j] - mass[i])
            k = int(np.argmin(cost))
            new[j], back[layer, j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
    bounds, j = [], n
    for layer in range(buckets - 1, -1, -1):
        if j == 0:
            break
        bounds.append(int(sizes[j - 1]))
        j = int(back[layer, j])
    return sorted(set(bounds))


def container_plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """How batches are formed from the buckets: rows (bucket, first rank, items a container, containers, first container).

    Each container is opened by items of one bucket, as many as its token budget holds at the bucket's bound; what then
    remains of the budget takes items of smaller buckets, largest first. Whole runs of equal containers are planned at
    once, so the plan has a few rows a bucket, whatever the number of items.
    """
    left, rank, plan, container = list(counts), [0] * len(counts), [], 0
    for b in range(len(bounds) - 1, -1, -1):
        while left[b] > 0:
            room, use = capacity, []
            for c in range(b, -1, -1):
                if left[c] and bounds[c] <= room:
                    k = min(room // max(bounds[c], 1), left[c])
                    use.append((c, k))
                    room -= k * bounds[c]
            times = min(left[c] // k for c, k in use)
            for c, k in use:
                plan.append((c, rank[c], k, times, container))
                rank[c] += k * times
                left[c] -= k * times
            container += times
    return plan


def pack(items: DataFrame, capacities: dict[str, int], key: str = "doc_id", buckets: int = 96, rank_parts: int = 64) -> DataFrame:
    """Assign items (``key``, ``n_tokens``) to containers of each capacity.

    Columns: container_name, ``key``, piece_no, start_token, n_tokens, container_id. An item above the capacity is cut
    into pieces of exactly the capacity and a rest; no other item is cut. Items without tokens (null or empty text) take
    no space and get no row. ``buckets`` bounds the padding: sizes are rounded up to an optimal bucket bound only for
    planning, real sizes fill the container. The histogram brought to the driver has at most ``capacity`` rows.
    Items of a bucket are numbered in ``rank_parts`` hashed parts with offsets, so a hot bucket is never one task.
    """
    spark = items.sparkSession
    parts = []
    for name, capacity in sorted(capacities.items()):
        n = F.col("n_tokens")
        cut = items.filter("n_tokens > 0").select(F.lit(name).alias("container_name"), key, "n_tokens", F.explode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))).alias("piece_no"))
        start = F.col("piece_no").cast("long") * capacity
        parts.append(cut.select("container_name", key, "piece_no", start.alias("start_token"), F.least(n - start, F.lit(capacity).cast("long")).alias("n_tokens")))
    if not parts:
        return items.select(F.lit("").alias("container_name"), key, F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_token"), "n_tokens", F.lit(0).cast("long").alias("container_id")).limit(0)
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    histogram = pieces.groupBy("container_name", "n_tokens").count().toPandas()
    bounds_rows, plan_rows = [], []
    for name, capacity in capacities.items():
        own = histogram[histogram["container_name"] == name].sort_values("n_tokens")
        if not len(own):
            continue
        sizes, counts = own["n_tokens"].to_numpy(np.int64), own["count"].to_numpy(np.int64)
        bounds = bucket_bounds(sizes, counts, buckets)
        at = np.searchsorted(bounds, sizes)
        held = np.bincount(at, counts, minlength=len(bounds)).astype(np.int64).tolist()
        bounds_rows += [(name, int(s), int(b)) for s, b in zip(sizes, at)]
        plan_rows += [(name, *row) for row in container_plan(bounds, held, capacity)]
    sized = spark.createDataFrame(bounds_rows or [("", 0, 0)], "container_name string, n_tokens long, bucket int")
    group = ["container_name", "bucket", "part"]
    hashed = F.pmod(F.xxhash64(F.col(key), F.col("piece_no")), F.lit(rank_parts))
    ranked = pieces.join(F.broadcast(sized), ["container_name", "n_tokens"]).withColumn("part", hashed)
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy(*group).orderBy(key, "piece_no")) - 1
    ranked = ranked.withColumn("inside", inside)
    sums = ranked.groupBy(*group).count()
    offset = F.sum("count").over(Window.partitionBy("container_name", "bucket").orderBy("part")) - F.col("count")
    sums = sums.withColumn("offset", offset).drop("count")  # at most capacities x buckets x rank_parts rows
    ranked = ranked.join(F.broadcast(sums), group).withColumn("rank", F.col("inside") + F.col("offset"))
    plan = spark.createDataFrame([((n, b), (int(f), int(k), int(t), int(c))) for n, b, f, k, t, c in plan_rows] or [(("", 0), (0, 1, 1, 0))], "slot struct<name string, bucket int>, run struct<first long, k long, times long, container long>")
    plan = plan.groupBy("slot").agg(F.sort_array(F.collect_list("run")).alias("runs")).select(F.col("slot.name").alias("container_name"), F.col("slot.bucket").alias("bucket"), "runs")
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(plan), ["container_name", "bucket"]).withColumn("run", run)
    container = F.col("run.container") + F.floor((F.col("rank") - F.col("run.first")) / F.col("run.k"))
    return placed.select("container_name", key, F.col("piece_no"), "start_token", "n_tokens", container.cast("long").alias("container_id"))


# ---------------------------------------------------------------- queries


def p6_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return token_budget(table(spark, sf, "documents"), table(spark, sf, "jobs"), table(spark, sf, "uploads"), table(spark, sf, "page_results"))


def p6_document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_tokens) of every message."""
    return text_tokens(table(spark, sf, "documents").select("doc_id", "text"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_ids(table(spark, sf, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    tokens = cut_lineage(count_tokens(table(spark, sf, "documents"), "doc_id", "text"))
    sizes = {r["container_name"]: r["capacity_tokens"] for r in collected(table(spark, sf, "pack_sizes"), 1_000, "container sizes")}
    return pack(tokens, {k: v for k, v in sizes.items() if k and v and v > 0})
