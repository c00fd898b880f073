"""Pages to documents, and what is derived from a document's Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.markdown import as_udf, from_lines

#: Public separators of the data contract (fixed values).
PAGE_BREAK = "\n\f\n"
MOST_HEADINGS = 200
OUTLINE = r"(?m)(?d)^(#{1,6})[ \t]+(.+)$"
RULE = r"(?m)(?d)^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"


def ordered(*columns: Column) -> Column:
    """Values of a group in the order of their first column, as an array of structs. A job has at most some hundred
    pages, so a group is one document's worth of text."""
    return F.sort_array(F.collect_list(F.struct(*columns)))


def pages_of(number: Column, body: Column) -> Column:
    """A job's pages in order, each number once with its greatest body: repeated rows are dropped inside the array, so
    texts are shuffled by job alone."""
    found = F.sort_array(F.collect_set(F.struct(number.alias("number"), body.alias("body"))))
    return F.filter(found, lambda p, i: ~F.coalesce(F.get(found, i + 1)["number"].eqNullSafe(p["number"]) & (i + 1 < F.size(found)), F.lit(False)))


def document_texts(pages: DataFrame) -> DataFrame:
    """(job_id, n_pages, text): texts of a job's pages in page order, joined by the page break; a page that is stored
    repeatedly counts once. One shuffle."""
    parts = pages.groupBy("job_id").agg(pages_of(F.col("number"), F.col("text")).alias("parts"))
    return parts.select("job_id", F.size("parts").cast("long").alias("n_pages"), F.array_join(F.transform("parts", lambda p: F.coalesce(p["body"], F.lit(""))), PAGE_BREAK).alias("text"))


def document_markdown(pages: DataFrame, markdown: str | None = None) -> DataFrame:
    """(job_id, n_pages, markdown): pages as Markdown, under page markers where there are several. One shuffle."""
    body = as_udf(from_lines)(F.col("text"))
    body = F.coalesce(F.col(markdown), body) if markdown else body
    shown = pages.select("job_id", "number", body.alias("body_"))
    parts = shown.groupBy("job_id").agg(pages_of(F.col("number"), F.col("body_")).alias("parts")).withColumn("n_pages", F.size("parts").cast("long"))
    text = lambda p: F.coalesce(p["body"], F.lit(""))
    marked = F.transform("parts", lambda p: F.when(F.col("n_pages") > 1, F.concat(F.lit("<!-- page: "), p["number"].cast("string"), F.lit(" -->\n\n"), text(p))).otherwise(text(p)))
    return parts.select("job_id", "n_pages", T.normalize_markdown(F.array_join(marked, "\n\n")).alias("markdown"))


def outline(markdown: Column) -> Column:
    """array<struct<level, title>> of the headings, the first 200; also of those inside code blocks."""
    marks = F.regexp_extract_all(markdown, F.lit(OUTLINE), F.lit(1))
    titles = F.regexp_extract_all(markdown, F.lit(OUTLINE), F.lit(2))
    return F.slice(F.transform(F.arrays_zip(marks.alias("m"), titles.alias("t")), lambda h: F.struct(F.length(h["m"]).alias("level"), T.strip(h["t"]).alias("title"))), 1, MOST_HEADINGS)


def table_count(markdown: Column) -> Column:
    return F.size(F.regexp_extract_all(markdown, F.lit(RULE), F.lit(0))).cast("long")


def text_statistics(text: Column) -> list[Column]:
    """char_count, word_count, line_count, token_count and reading_min (unrounded) of a text."""
    return [
        F.length(text).cast("long").alias("char_count"), T.word_count(text).alias("word_count"), T.line_count(text).alias("line_count"), T.estimate_tokens(text).alias("token_count"), (T.word_count(text) / T.WORDS_A_MINUTE).alias("reading_min"),
    ]


def page_statistics(pages: DataFrame) -> DataFrame:
    """Per job: pages, pages by method as a map, mean confidence; each page once."""
    once = pages.groupBy("job_id", "number").agg(F.max(F.struct("method", "ocr_confidence")).alias("p")).select("job_id", "number", "p.*")
    methods = once.groupBy("job_id", "method").agg(F.count("*").alias("n"), F.sum("ocr_confidence").alias("s"), F.count("ocr_confidence").alias("c"))
    entry = F.struct(F.coalesce("method", F.lit("unknown")).alias("key"), F.col("n").alias("value"))
    return methods.groupBy("job_id").agg(F.sum("n").alias("page_count"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("methods"), (F.sum("s") / F.sum("c")).alias("mean_confidence"))


def forward_fill_pages(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Adds ``page`` to lines: the number of the last page marker at or before each line, else 1."""
    mark = F.regexp_extract(F.trim(F.col(line)), r"^<!-- page: (\d+) -->$", 1)
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("page", F.coalesce(F.last(F.when(mark != "", mark.cast("int")), ignorenulls=True).over(window), F.lit(1)))


def line_offsets(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Adds ``char_start``: characters of the lines before, with their line ends."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("char_start", F.coalesce(F.sum(F.length(line) + 1).over(window), F.lit(0)).cast("long"))


def heading_paths(blocks: DataFrame) -> DataFrame:
    """(job_id, block_index, path): titles of the open headings after each heading block.

    The last heading of each level is carried forward, and one is open where no heading of a lesser level came after it:
    six running values in one sort of a job's headings, however many there are.
    """
    heads = blocks.filter("kind = 'heading'").select("job_id", "block_index", "level", T.strip(F.regexp_replace("text", r"^#{1,6}\s+|\s*#*$", "")).alias("title")).distinct()
    window = Window.partitionBy("job_id").orderBy("block_index", "title").rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("block_index", "title"))
    held = heads.withColumn("at", number)
    last = [F.last(F.when(F.col("level") == n, F.struct("at", "title")), ignorenulls=True).over(window).alias(f"h{n}") for n in range(1, 7)]
    held = held.select("job_id", "block_index", "level", *last)
    open_ = [F.when((F.col("level") >= n) & (F.col(f"h{n}.at") > F.greatest(F.lit(0), F.lit(0), *[F.coalesce(f"h{k}.at", F.lit(0)) for k in range(1, n)])), F.col(f"h{n}.title")) for n in range(1, 7)]
    return held.select("job_id", "block_index", F.filter(F.array(*open_), lambda t: t.isNotNull()).alias("path"))


def number_ranges(df: DataFrame, key: str, number: str) -> DataFrame:
    """(key, first, last) of the runs of consecutive numbers (islands)."""
    ranked = df.select(key, number).filter(F.col(number).isNotNull()).distinct().withColumn("island", F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number)))
    return ranked.groupBy(key, "island").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("island")


def range_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))


def largest_gap(df: DataFrame, key: str, low: str, high: str, width: int) -> DataFrame:
    """(key, gap, cut) of the widest empty stretch between intervals; of equal ones the first; keys without one are left
    out. The reach of the intervals before is a running maximum over buckets of ``width`` and inside each bucket, so a
    key with very many intervals is sorted in many tasks."""
    cut = df.select(key, low, high).filter(F.col(low).isNotNull()).withColumn("part", F.floor(F.col(low) / width))
    far = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cut.groupBy(key, "part").agg(F.max(high).alias("own")).withColumn("earlier", F.max("own").over(far)).drop("own")
    before = Window.partitionBy(key, "part").orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reach = cut.withColumn("inside", F.max(high).over(before)).join(earlier, [key, "part"]).withColumn("reach", F.greatest("inside", "earlier"))
    gaps = reach.withColumn("gap", F.col(low) - F.col("reach")).filter("gap > 0")
    best = gaps.groupBy(key).agg(F.max(F.struct(F.col("gap"), (-F.col(low)).alias("o"), ((F.col(low) + F.col("reach")) / 2).alias("cut"))).alias("b"))
    return best.select(key, "b.gap", "b.cut")


def merged_lists(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, first, text): neighbouring list items joined by line ends, other parts as they are (islands)."""
    item = F.regexp_like(text, F.lit(r"^(?:- |\d+\. )"))
    window = Window.partitionBy(key).orderBy(order)
    start = F.when(item & F.coalesce(F.lag(item).over(window), F.lit(False)), 0).otherwise(1)
    islands = parts.withColumn("start_", start).withColumn("island_", F.sum("start_").over(window))
    grouped = islands.groupBy(key, "island_").agg(F.min(order).alias("first"), ordered(F.col(order).alias("o"), F.col(text).alias("t")).alias("p"))
    return grouped.select(key, "first", F.array_join(F.transform("p", lambda p: p["t"]), "\n").alias("text"))
