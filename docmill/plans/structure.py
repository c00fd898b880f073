"""Queries of documents, blocks, chunks, layout and scores. The SQL side builds Markdown, blocks and chunks anew: lines by
windows, packing by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import chunking, documents, layout, scoring
from docmill.plans.registry import PG, RE_SPACE, jobs_now, query, strip_sql, tokens_sql
from docmill.session import table

NL = "chr(10)"
NUMBERED, BULLET = r"^\(?(\d{1,3})[.)]" + f"[{RE_SPACE}]+", "^[•●▪◦‣∙·\\-–—*]" + f"[{RE_SPACE}]+"
BREAKS = r"[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINE_SQL = f"list_filter(list_transform(string_split_regex(par, '{BREAKS}'), lambda x: {strip_sql('x')}), lambda x: x <> '')"
ITEM_SQL = f"CASE WHEN regexp_matches(x, '{NUMBERED}') THEN regexp_replace(x, '{NUMBERED}', '\\1. ') ELSE regexp_replace(x, '{BULLET}', '- ') END"
#: (job_id, n_pages, md): whole documents as Markdown.
DOCS = f"""{PG}, body AS (SELECT job_id, number, array_to_string(list_filter(list_transform(string_split_regex({strip_sql("coalesce(text, '')")}, '\\n[{RE_SPACE}]*\\n'), lambda par: array_to_string(list_transform({LINE_SQL}, lambda x: {ITEM_SQL}), {NL})), lambda p: p <> ''), {NL} || {NL}) AS b FROM pg),
docs0 AS (SELECT job_id, count(*) AS n_pages, string_agg(CASE WHEN n > 1 THEN '<!-- page: ' || number || ' -->' || {NL} || {NL} || b ELSE b END, {NL} || {NL} ORDER BY number) AS md FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM body) GROUP BY job_id),
docs AS (SELECT job_id, n_pages, {strip_sql("regexp_replace(regexp_replace(md, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS md FROM docs0)"""
#: Blocks by runs of lines of one kind; a fence is open after an odd number of fence lines.
BLOCKS = f"""ln0 AS (SELECT job_id, md, unnest(string_split(md, {NL})) AS line, generate_subscripts(string_split(md, {NL}), 1) AS i FROM docs),
ln1 AS (SELECT job_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY job_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, {strip_sql('line')} AS s FROM ln0),
ln2 AS (SELECT *, CASE WHEN s LIKE '```%' THEN 1 ELSE 0 END AS f, sum(CASE WHEN s LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY i) AS fs FROM ln1),
ln3 AS (SELECT *, CASE WHEN f = 1 OR fs % 2 = 1 THEN 'code' WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^<!-- page: \\d+ -->$') THEN 'marker' WHEN regexp_matches(s, '^#{{1,6}}[{RE_SPACE}]+.+$') AND regexp_matches(regexp_replace(s, '[{RE_SPACE}]*#*$', ''), '^#{{1,6}}[{RE_SPACE}]+.') THEN 'heading' WHEN s LIKE '|%' THEN 'table' ELSE 'prose' END AS k FROM ln2),
ln4 AS (SELECT *, CASE WHEN lag(k) OVER w IS DISTINCT FROM k OR k IN ('heading', 'marker') OR (k = 'code' AND f = 1 AND fs % 2 = 1) THEN 1 ELSE 0 END AS st FROM ln3 WINDOW w AS (PARTITION BY job_id ORDER BY i)),
ln5 AS (SELECT *, sum(st) OVER (PARTITION BY job_id ORDER BY i) AS g, coalesce(last_value(CASE WHEN k = 'marker' THEN regexp_extract(s, '(\\d+)', 1)::INT END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY i), 1) AS page FROM ln4),
bl0 AS (SELECT job_id, g, any_value(k) AS k, min(page) AS page, min(pos) AS char_start, max(pos + length(line)) AS char_end, regexp_replace(regexp_replace(string_agg(line, {NL} ORDER BY i), '^\\n+', ''), '\\n+$', '') AS t FROM ln5 WHERE k NOT IN ('blank', 'marker') GROUP BY job_id, g),
bl1 AS (SELECT job_id, g, page, char_start, char_end, CASE WHEN k = 'prose' THEN CASE WHEN regexp_matches({strip_sql('t')}, '^(?:[-*+]|\\d+\\.)[{RE_SPACE}]') THEN 'list' ELSE 'paragraph' END ELSE k END AS kind, CASE WHEN k = 'heading' THEN {strip_sql('t')} ELSE t END AS t FROM bl0),
bl2 AS (SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract(t, '^(#+)', 1)) ELSE 0 END AS level, {tokens_sql('length(t)')} AS tokens, row_number() OVER (PARTITION BY job_id ORDER BY g) - 1 AS bi,
 CASE WHEN kind = 'heading' THEN {strip_sql(f"regexp_replace(regexp_replace(t, '^#{{1,6}}[{RE_SPACE}]+', ''), '[{RE_SPACE}]*#*$', '')")} END AS title FROM bl1)"""


@query(f"""WITH {DOCS} SELECT job_id, n_pages, md5(md) AS digest FROM docs""")
def document_markdowns(spark: SparkSession, sf: str) -> DataFrame:
    return documents.document_markdown(table(spark, sf, "page_results")).select("job_id", "n_pages", F.md5("markdown").alias("digest"))


@query(f"""WITH {DOCS}, {BLOCKS} SELECT job_id, kind, page::INT AS page, char_start, char_end, level::INT AS level, tokens::INT AS tokens, md5(t) AS digest FROM bl2""")
def document_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of whole documents, each with its page, range and tokens."""
    made = documents.document_markdown(table(spark, sf, "page_results")).select("job_id", F.inline(chunking.parse_blocks("markdown")))
    return made.select("job_id", "kind", "page", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "level", "tokens", F.md5("text").alias("digest"))


OPEN_PATH = "SELECT h.job_id, h.bi, list(g.title ORDER BY g.bi) AS path FROM bl2 h JOIN bl2 g ON g.job_id = h.job_id AND g.kind = 'heading' AND g.bi <= h.bi WHERE NOT EXISTS (SELECT 1 FROM bl2 k WHERE k.job_id = h.job_id AND k.kind = 'heading' AND k.bi > g.bi AND k.bi <= h.bi AND k.level <= g.level) GROUP BY ALL"
#: Chunks: oversized blocks cut by a walk over their units, blocks packed by a walk over a job's parts, texts by one over its chunks.
CHUNKS = f"""sz0 AS (SELECT id, arg_max(struct_pack(s := options.chunk_size_tokens, o := options.chunk_overlap_tokens), loaded_at) AS r FROM jobs WHERE id IS NOT NULL GROUP BY id),
sz1 AS (SELECT d.job_id, greatest(32, coalesce(r.s, 512)) AS size, greatest(0, coalesce(r.o, 64)) AS o FROM docs d LEFT JOIN sz0 ON sz0.id = d.job_id), sz AS (SELECT job_id, size, least(o, size // 2) AS ov, size - least(o, size // 2) AS budget FROM sz1),
hp AS ({OPEN_PATH}), bb AS (SELECT b.*, coalesce(hp.path, []) AS path, sz.size, sz.ov, sz.budget, CASE WHEN b.kind = 'table' AND len(string_split(t, {NL})) > 2 AND regexp_matches(trim(replace(string_split(t, {NL})[2], '|', '')), '^[-: ]*$') THEN 2 ELSE 0 END AS hd,
 CASE WHEN b.kind IN ('table', 'code') THEN chr(10) ELSE ' ' END AS glue FROM bl2 b JOIN sz ON sz.job_id IS NOT DISTINCT FROM b.job_id LEFT JOIN hp ON hp.job_id IS NOT DISTINCT FROM b.job_id AND hp.bi = b.bi),
ov0 AS (SELECT *, list_filter(CASE kind WHEN 'table' THEN string_split(t, {NL})[hd + 1:] WHEN 'code' THEN string_split(t, {NL}) ELSE string_split(regexp_replace({strip_sql('t')}, '([.!?¡¿…])[{RE_SPACE}]+', '\\1' || chr(1), 'g'), chr(1)) END, lambda u: u <> '') AS units,
 CASE WHEN hd > 0 THEN array_to_string(string_split(t, {NL})[1:2], {NL}) ELSE '' END AS head FROM bb WHERE tokens > budget),
wk AS (WITH RECURSIVE w AS (SELECT job_id, bi, 1 AS u, 0 AS run, length(units[1]) AS cur FROM ov0 WHERE len(units) > 0
 UNION ALL SELECT w.job_id, w.bi, u + 1, CASE WHEN full_ THEN run + 1 ELSE run END, CASE WHEN full_ THEN n ELSE cur + 1 + n END FROM (SELECT w.*, length(o.units[w.u + 1]) AS n, {tokens_sql('(w.cur + 1 + length(o.units[w.u + 1]))')} + {tokens_sql('length(o.head)')} > o.budget AS full_ FROM w JOIN ov0 o ON o.job_id = w.job_id AND o.bi = w.bi WHERE w.u < len(o.units)) w) SELECT * FROM w),
rn AS (SELECT w.job_id, w.bi, w.run, CASE WHEN o.hd > 0 THEN any_value(o.head) || {NL} ELSE '' END || CASE WHEN any_value(o.glue) = ' ' THEN array_to_string(list(o.units[w.u] ORDER BY w.u), ' ') ELSE array_to_string(list(o.units[w.u] ORDER BY w.u), {NL}) END AS txt FROM wk w JOIN ov0 o ON o.job_id = w.job_id AND o.bi = w.bi GROUP BY w.job_id, w.bi, w.run, o.hd),
pt0 AS (SELECT r.job_id, r.bi, r.run, p, CASE WHEN o.kind <> 'table' AND {tokens_sql('length(txt)')} > o.budget THEN substr(txt, (p * 4 * o.budget + 1)::BIGINT, (4 * o.budget)::BIGINT) ELSE txt END AS txt FROM rn r JOIN ov0 o ON o.job_id = r.job_id AND o.bi = r.bi, LATERAL (SELECT unnest(generate_series(0, CASE WHEN o.kind <> 'table' AND {tokens_sql('length(r.txt)')} > o.budget THEN (length(r.txt) - 1) // (4 * o.budget) ELSE 0 END)) AS p)),
pt1 AS (SELECT job_id, bi, run, p, txt FROM pt0 UNION ALL SELECT job_id, bi, 0, 0, t FROM bb WHERE tokens <= budget),
pt AS (SELECT p.job_id, p.txt, b.kind, b.page, b.char_start, b.char_end, b.path, b.size, b.ov, b.budget, {tokens_sql('length(p.txt)')} AS tok, row_number() OVER (PARTITION BY p.job_id ORDER BY p.bi, p.run, p.p) - 1 AS i FROM pt1 p JOIN bb b ON b.job_id = p.job_id AND b.bi = p.bi),
sums AS (SELECT job_id, list_prepend(0::HUGEINT, list(c ORDER BY i)) AS cs, count(*) AS n FROM (SELECT job_id, i, sum(tok) OVER (PARTITION BY job_id ORDER BY i) AS c FROM pt) GROUP BY job_id),
pk AS (WITH RECURSIVE s AS (SELECT job_id, 0::BIGINT AS i, 0::BIGINT AS b, 0::HUGEINT AS held, -1::BIGINT AS lc, NULL::BIGINT AS ea, NULL::BIGINT AS eb FROM sums
 UNION ALL SELECT job_id, i + 1, CASE WHEN e > b THEN e ELSE b END, CASE WHEN e > b THEN cs[i + 1] - cs[e + 1] WHEN e IS NOT NULL AND (kind <> 'heading' OR held < size // 4) THEN cs[i + 1] - cs[b + 1] ELSE held END + cost, CASE WHEN kind <> 'heading' THEN i ELSE lc END, CASE WHEN e > b THEN b END, CASE WHEN e > b THEN e END
 FROM (SELECT *, CASE WHEN i > b AND kind = 'heading' AND held >= size // 4 THEN CASE WHEN lc >= b THEN i ELSE b END WHEN i > b AND held + cost > budget THEN greatest(b, lc + 1) END AS e FROM (SELECT s.job_id, s.i, s.b, s.held, s.lc, p.kind, p.size, p.budget, m.cs, p.tok + CASE WHEN s.i > s.b THEN 1 ELSE 0 END AS cost FROM s JOIN pt p ON p.job_id = s.job_id AND p.i = s.i JOIN sums m ON m.job_id = s.job_id))) SELECT * FROM s),
rg0 AS (SELECT job_id, ea AS a, eb AS b FROM pk WHERE ea IS NOT NULL UNION ALL SELECT pk.job_id, pk.b, m.n FROM pk JOIN sums m ON m.job_id = pk.job_id AND m.n = pk.i WHERE pk.lc >= pk.b),
rg AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY a) - 1 AS ci FROM rg0),
ck0 AS (SELECT r.job_id, r.ci, string_agg(p.txt, {NL} || {NL} ORDER BY p.i) AS body, min(p.page) AS page_start, max(p.page) AS page_end, arg_min(p.char_start, p.i) AS char_start, arg_max(p.char_end, p.i) AS char_end, arg_min(p.kind, p.i) AS first_kind, arg_min(p.path, p.i) FILTER (WHERE p.kind <> 'heading') AS path,
 arg_max(p.kind, p.i) FILTER (WHERE p.kind <> 'heading') AS last_kind, array_to_string(list_sort(list_distinct(list(p.kind) FILTER (WHERE p.kind <> 'heading'))), ',') AS kinds, any_value(p.ov) AS ov FROM rg r JOIN pt p ON p.job_id = r.job_id AND p.i >= r.a AND p.i < r.b GROUP BY r.job_id, r.ci),
ck1 AS (SELECT *, coalesce(ov > 0 AND lag(last_kind) OVER w IN ('paragraph', 'list') AND first_kind IN ('paragraph', 'list') AND lag(path[1:1]) OVER w = path[1:1], false) AS joins FROM ck0 WINDOW w AS (PARTITION BY job_id ORDER BY ci)),
tx AS (WITH RECURSIVE x AS (SELECT job_id, ci, body AS txt, '' AS tail FROM ck1 WHERE ci = 0
 UNION ALL SELECT job_id, ci, CASE WHEN tail <> '' THEN {strip_sql("(tail || chr(10) || chr(10) || body)")} ELSE body END, tail FROM (SELECT c.job_id, c.ci, c.body, CASE WHEN c.joins THEN {strip_sql(f"CASE WHEN length(x.txt) <= 4 * c.ov THEN x.txt WHEN regexp_matches(right(x.txt, (4 * c.ov)::BIGINT), '[{RE_SPACE}]') THEN regexp_replace(right(x.txt, (4 * c.ov)::BIGINT), '^[^{RE_SPACE}]*[{RE_SPACE}]', '') ELSE '' END")} ELSE '' END AS tail FROM x JOIN ck1 c ON c.job_id = x.job_id AND c.ci = x.ci + 1)) SELECT * FROM x)"""


@query(f"""WITH {DOCS}, {BLOCKS}, {CHUNKS} SELECT c.job_id, c.ci::INT AS chunk_index, ({tokens_sql('length(txt)')})::INT AS token_count, page_start::INT AS page_start, page_end::INT AS page_end, char_start, char_end, kinds, ({tokens_sql('length(tail)')})::INT AS overlap_tokens, array_to_string(path, ' / ') AS path, md5(txt) AS digest
 FROM ck1 c JOIN tx ON tx.job_id = c.job_id AND tx.ci = c.ci""")
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as Markdown, chunked with the options of their job's current row."""
    marked = documents.document_markdown(table(spark, sf, "page_results").filter("job_id is not null"))
    sizes = jobs_now(spark, sf, F.col("options.chunk_size_tokens").alias("size"), F.col("options.chunk_overlap_tokens").alias("overlap"))
    both = marked.join(sizes, marked["job_id"] == sizes["id"], "left")
    made = chunking.chunk_documents(both, "job_id", "markdown", F.col("size"), F.col("overlap"))
    return made.select("job_id", "chunk_index", "token_count", "page_start", "page_end", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.array_join("kinds", ",").alias("kinds"), "overlap_tokens", F.array_join("heading_path", " / ").alias("path"), F.md5("text").alias("digest"))


@query("SELECT NULL::VARCHAR AS job_id, NULL::INT AS chunk_index, NULL::VARCHAR AS broken WHERE false")
def chunk_rules_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents that break a rule; there are none. Indices follow each other, ranges lie in the document,
    pages don't run back, table parts start with their header, an overlap is the end of the chunk before and starts at a
    word, and no chunk is larger than its limit by more than the tolerance."""
    marked = documents.document_markdown(table(spark, sf, "page_results").filter("job_id is not null"))
    sizes = jobs_now(spark, sf, F.col("options.chunk_size_tokens").alias("s"), F.col("options.chunk_overlap_tokens").alias("o"))
    both = marked.join(sizes, marked["job_id"] == sizes["id"], "left")
    each = both.select("job_id", "markdown", F.greatest(F.lit(32), F.coalesce("s", F.lit(512))).alias("limit"), chunking.chunk_markdown("markdown", F.col("s"), F.col("o")).alias("c"))
    before = F.get(F.col("c"), F.col("i") - 1)
    seen = each.select("job_id", F.length("markdown").alias("n"), "limit", "c", F.posexplode("c").alias("i", "x")).select("*", "x.*", before.alias("before"))
    tail = F.split_part("text", F.lit("\n\n"), F.lit(1))
    rules = {
        "index": F.col("chunk_index") != F.col("i"), "range": (F.col("char_start") < 0) | (F.col("char_end") > F.col("n")) | (F.col("char_start") >= F.col("char_end")), "pages": F.col("page_start") > F.col("page_end"),
        "order": F.col("before").isNotNull() & (F.col("char_start") < F.col("before.char_start")), "size": (F.col("token_count") > F.col("limit") + 16) & ~F.array_contains("kinds", "table"),
        "header": (F.array_join("kinds", ",") == "table") & F.regexp_like("text", F.lit(r"\|")) & ~F.regexp_like("text", F.lit(r"(?m)^\|[\s:|-]*\|?\s*$")) & F.regexp_like(F.substring(F.col("text"), 1, 1), F.lit(r"\|")) & (F.size(F.split("text", "\n")) > 2),
        "overlap": (F.col("overlap_tokens") > 0) & ~F.contains(F.replace(F.col("before.text"), F.lit("\n\n"), F.lit("\n")), F.replace(tail, F.lit("\n\n"), F.lit("\n"))),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda r: r.isNotNull())
    return seen.select("job_id", F.col("i").alias("chunk_index"), F.explode(broken).alias("broken"))


@query(r"""WITH h AS (SELECT DISTINCT job_id, block_index, level, text FROM blocks WHERE kind = 'heading'), t AS (SELECT job_id, block_index, level, trim(regexp_replace(regexp_replace(text, '^#{1,6}\s+', ''), '\s*#*$', '')) AS title FROM h)
SELECT a.job_id, a.block_index, string_agg(b.title, ' / ' ORDER BY b.block_index, b.title) AS path FROM t a JOIN t b ON b.job_id = a.job_id AND (b.block_index, b.title) <= (a.block_index, a.title)
WHERE NOT EXISTS (SELECT 1 FROM t k WHERE k.job_id = a.job_id AND (k.block_index, k.title) > (b.block_index, b.title) AND (k.block_index, k.title) <= (a.block_index, a.title) AND k.level <= b.level) GROUP BY a.job_id, a.block_index, a.title""")
def block_heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = documents.heading_paths(table(spark, sf, "blocks").filter("job_id is not null"))
    return paths.select("job_id", "block_index", F.array_join("path", " / ").alias("path"))


@query(r"""WITH b AS (SELECT block_key, max(text) AS text FROM blocks GROUP BY block_key), h AS (SELECT block_key, regexp_extract_all(text, '(?m)^(#{1,6})[ \t]+(.+)$', 1)[1:200] AS m, regexp_extract_all(text, '(?m)^(#{1,6})[ \t]+(.+)$', 2)[1:200] AS t FROM b)
SELECT block_key, len(m) AS headings, list_max(list_transform(m, lambda x: length(x))) AS deepest, md5(array_to_string(list_transform(t, lambda x: trim(x)), chr(10))) AS titles FROM h WHERE len(m) > 0""")
def block_outline(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "blocks").groupBy("block_key").agg(F.max("text").alias("text"))
    found = once.select("block_key", documents.outline(F.col("text")).alias("o")).filter(F.size("o") > 0)
    return found.select("block_key", F.size("o").cast("long").alias("headings"), F.array_max(F.transform("o", lambda h: h["level"])).cast("long").alias("deepest"), F.md5(F.array_join(F.transform("o", lambda h: h["title"]), "\n")).alias("titles"))


@query(f"""WITH p AS (SELECT page_key, max(text) AS text FROM page_results GROUP BY page_key HAVING max(text) IS NOT NULL) SELECT page_key, md5(array_to_string(list_sort(regexp_extract_all(text, '[^{RE_SPACE}]+')), ' ')) AS words FROM p""")
def page_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as boxes of a monospaced layout, put in reading order by recursive cuts: no word is lost or made."""
    once = table(spark, sf, "page_results").groupBy("page_key").agg(F.max("text").alias("text")).filter("text is not null")
    boxes = once.select("page_key", layout.boxes_of_text("text").alias("boxes"))
    words = F.regexp_extract_all(layout.page_reading_order("boxes"), F.lit(f"[^{RE_SPACE}]+"), F.lit(0))
    return boxes.select("page_key", F.md5(F.array_join(F.array_sort(words), " ")).alias("words"))


# ------------------------------------------------------------------ layout over pages made of small tables


def nation_boxes(spark: SparkSession, sf: str, tall: float = 10.0) -> DataFrame:
    """A page for each region: its name across the page, then two columns of its nations, by odd and even keys."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    from pyspark.sql import Window

    column = F.col("n_nationkey") % 2
    row = F.row_number().over(Window.partitionBy("r_name", column).orderBy("n_nationkey"))
    left = F.when(column == 0, 0.0).otherwise(300.0)
    cells = nations.select(F.col("r_name").alias("page"), left.alias("x0"), (left + 120).alias("x1"), (20 + row * 15).cast("double").alias("y0"), (30 + row * 15).cast("double").alias("y1"), F.concat(F.lit("• "), F.initcap("n_name")).alias("text"))
    heads = nations.select("r_name").distinct().select(F.col("r_name").alias("page"), F.lit(0.0).alias("x0"), F.lit(420.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(tall).alias("y1"), F.initcap("r_name").alias("text"))
    return cells.unionByName(heads)


INITCAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
REGION_ITEMS = f"SELECT r_name AS page, {INITCAP.format('r_name')} AS head, string_agg('{{0}}' || {INITCAP.format('n_name')}, {{1}} ORDER BY n_nationkey % 2, n_nationkey) AS items FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


@query(f"WITH p AS ({REGION_ITEMS.format('• ', NL)}) SELECT page, head || {NL} || items AS text FROM p")
def columns_in_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    pages = layout.boxes_by_page(nation_boxes(spark, sf), "page")
    return pages.select("page", layout.page_reading_order("boxes").alias("text"))


@query(f"WITH p AS ({REGION_ITEMS.format('- ', NL + ' || ' + NL)}) SELECT page, '# ' || head || {NL} || {NL} || items AS text FROM p")
def columns_as_markdown(spark: SparkSession, sf: str) -> DataFrame:
    pages = layout.boxes_by_page(nation_boxes(spark, sf, tall=18.0), "page")
    return pages.select("page", layout.page_reading_markdown("boxes").alias("text"))


def nation_spans(spark: SparkSession, sf: str) -> DataFrame:
    """A digital page for each region: a large title, a wrapped paragraph, and an unruled table of its nations."""
    from pyspark.sql import Window

    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", F.initcap("n_name").alias("n"))
    row = F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey"))
    span = lambda block, x, y, size, text, bold=F.lit(False), wide=200.0: F.struct(block.cast("int").alias("block"), F.lit(x).alias("x0"), y.cast("double").alias("y0"), F.lit(x + wide).alias("x1"), (y + size).cast("double").alias("y1"), F.lit(size).alias("size"), text.alias("text"), bold.alias("bold"))
    regions = nations.select("r_name").distinct()
    head = regions.select("r_name", F.inline(F.array(span(F.lit(0), 0.0, F.lit(0), 20.0, F.initcap("r_name"), wide=400.0), span(F.lit(1), 0.0, F.lit(40), 10.0, F.lit("This page is about the re-"), wide=400.0), span(F.lit(1), 0.0, F.lit(55), 10.0, F.lit("gion and lists all of its nations with their keys."), wide=400.0))))
    cells = nations.select("r_name", row.alias("row"), "n_nationkey", "n").select("r_name", F.inline(F.array(span(F.col("row") + 2, 0.0, 100 + F.col("row") * 20, 10.0, F.col("n"), wide=100.0), span(F.col("row") + 2, 300.0, 100 + F.col("row") * 20, 10.0, F.col("n_nationkey").cast("string"), wide=20.0))))
    return head.unionByName(cells).withColumn("page", F.lit(1)).withColumnRenamed("r_name", "doc_id")


@query(f"""WITH n AS (SELECT r_name, n_nationkey, {INITCAP.format('n_name')} AS n, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT r_name, string_agg('| ' || n || ' | ' || n_nationkey || ' |' || CASE WHEN i = 1 THEN {NL} || '|---|---|' ELSE '' END, {NL} ORDER BY i) AS rows FROM n GROUP BY r_name)
SELECT r_name AS doc_id, '# ' || {INITCAP.format('r_name')} || {NL} || {NL} || 'This page is about the region and lists all of its nations with their keys.' || {NL} || {NL} || rows AS markdown FROM t""")
def digital_pages_as_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Spans with sizes to Markdown: font profile, visual lines, headings, reflowed prose and an unruled table."""
    return layout.pages_markdown(nation_spans(spark, sf)).select("doc_id", "markdown")


@query("""WITH s AS (SELECT n_regionkey AS doc_id, 10.0 AS size, sum(3 * length(n_name)) AS n FROM nation GROUP BY ALL UNION ALL SELECT n_regionkey, 10.0 + n_nationkey % 5, sum(length(n_name)) FROM nation WHERE n_nationkey % 5 > 1 GROUP BY ALL), g AS (SELECT doc_id, size, sum(n) AS n FROM s GROUP BY ALL), t AS (SELECT doc_id, arg_max(size, n) AS body, sum(n) AS total FROM g GROUP BY doc_id)
SELECT t.doc_id, t.body::DOUBLE AS body, coalesce((SELECT array_to_string(list(g.size ORDER BY g.size DESC)[1:3], ',') FROM g WHERE g.doc_id = t.doc_id AND g.size >= 1.15 * t.body AND g.n < 0.3 * t.total), '') AS levels FROM t""")
def font_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Names thrice as body text and once in other sizes: the body size and the heading sizes of each region."""
    nation = table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("page"), "n_nationkey", "n_name")
    body = nation.select("doc_id", "page", F.lit(10.0).alias("size"), F.repeat("n_name", F.lit(3)).alias("text"))
    names = nation.filter("n_nationkey % 5 > 1").select("doc_id", "page", (10.0 + F.col("n_nationkey") % 5).alias("size"), F.col("n_name").alias("text"))
    found = layout.font_profile(body.unionByName(names))
    return found.select("doc_id", "body", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"))


@query("""WITH w AS (SELECT o_custkey % 7 AS page, o_orderkey % 3 AS block, o_orderkey % 2 AS par, o_orderkey % 5 AS line, o_orderkey AS word, o_orderpriority AS text, CASE WHEN o_orderkey % 4 = 0 THEN -1.0 ELSE o_orderkey % 100 END AS conf FROM orders), l AS (SELECT page, block, par, line, string_agg(text, ' ' ORDER BY word) AS t FROM w GROUP BY ALL), q AS (SELECT page, block, par, string_agg(t, chr(10) ORDER BY line) AS t FROM l GROUP BY ALL)
SELECT q.page, md5(string_agg(t, chr(10) || chr(10) ORDER BY block, par)) AS digest, (SELECT round(avg(conf), 1) FROM w WHERE w.page = q.page AND conf >= 0) AS confidence FROM q GROUP BY q.page""")
def words_regrouped(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as recognised words: lines, paragraphs and the mean confidence of each page."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    words = o.select((F.col("o_custkey") % 7).alias("page"), (key % 3).alias("block"), (key % 2).alias("par"), (key % 5).alias("line"), key.alias("word"), F.col("o_orderpriority").alias("text"), F.when(key % 4 == 0, -1.0).otherwise(key % 100).alias("conf"))
    out = layout.regrouped_words(words, "page")
    return out.select("page", F.md5("text").alias("digest"), "confidence")


@query("""SELECT o_custkey % 7 AS page, round(100 * avg(o_orderkey % 97 / 97.0), 1) AS confidence, round(avg(CASE WHEN o_orderkey % 11 > 1.5 * (o_orderkey % 13) THEN 1.0 ELSE 0.0 END), 6) AS vertical FROM orders GROUP BY 1""")
def recognition_quality(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    boxes = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("page"), (key % 13).cast("double").alias("width"), (key % 11).cast("double").alias("height"), ((key % 97) / 97.0).alias("score"))
    out = layout.recognition_quality(boxes, "page")
    return out.select("page", "confidence", F.round("vertical", 6).alias("vertical"))


@query("""WITH i AS (SELECT l_orderkey % 50 AS page, l_quantity AS x0, l_quantity + l_linenumber * 10 AS x1, l_linenumber AS y0, l_linenumber + l_quantity / 10 AS y1 FROM lineitem), a AS (SELECT page, greatest(least(x1, 60) - greatest(x0, 0), 0) * greatest(least(y1, 8) - greatest(y0, 0), 0) AS area FROM i)
SELECT page, round(least(sum(area) / 480.0, 1), 6) AS coverage, least(sum(area) / 480.0, 1) > 0.6 AS mostly_image FROM a GROUP BY page""")
def image_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as pictures on pages, and which pages are to be recognised as they have little text of their own."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    images = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), q.alias("x0"), (q + n * 10).alias("x1"), n.alias("y0"), (n + q / 10).alias("y1"), F.lit(60.0).alias("page_width"), F.lit(8.0).alias("page_height"))
    covered = layout.image_coverage(images, ["page"])
    return covered.select("page", F.round("coverage", 6).alias("coverage"), layout.needs_recognition(F.lit("auto"), F.lit("thirty visible characters are here"), F.col("coverage")).alias("mostly_image"))


@query(f"""WITH p AS (SELECT page_key, max(coalesce(text, '')) AS text, max(coalesce(method, 'unknown')) AS method, max(ocr_confidence) AS c FROM page_results GROUP BY page_key), m AS (SELECT page_key, text, CASE WHEN page_key % 3 = 0 THEN 'force' WHEN page_key % 3 = 1 THEN 'auto' ELSE 'off' END AS mode, coalesce(c % 1, 0) AS coverage FROM p)
SELECT page_key, mode = 'force' OR (mode = 'auto' AND (length(regexp_replace(text, '[ \\t\\n\\x0b\\x0c\\r]', '', 'g')) < 25 OR (coverage > 0.6 AND length(text) < 200))) AS needs, CASE WHEN length(text) > 300 THEN 'native' ELSE 'recognised' END AS kept FROM m""")
def pages_to_recognise(spark: SparkSession, sf: str) -> DataFrame:
    """Which pages go to a recogniser, and whether their own text or a recognised one of 300 characters is kept."""
    once = table(spark, sf, "page_results").groupBy("page_key").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("ocr_confidence").alias("c"))
    mode = F.element_at(F.array(F.lit("force"), F.lit("auto"), F.lit("off")), (F.col("page_key") % 3 + 1).cast("int"))
    richer = layout.richer_text(F.col("text"), F.lit("r" * 300))
    return once.select("page_key", layout.needs_recognition(mode, F.col("text"), F.coalesce(F.col("c") % 1, F.lit(0.0))).alias("needs"), F.when(richer == F.col("text"), "native").otherwise("recognised").alias("kept"))


# ------------------------------------------------------------------ scores over documents with known differences


@query("""WITH n AS (SELECT r_name, n_nationkey % 3 <> 0 AS kept, n_nationkey % 4 = 1 AS deep, lower(n_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT r_name, count(*) AS want, count(*) FILTER (WHERE kept) AS got, count(*) FILTER (WHERE kept AND NOT deep) AS hit FROM n GROUP BY r_name)
SELECT r_name AS region, round(coalesce(hit / nullif(got, 0), 0), 6) AS heading_precision, round(hit / want, 6) AS heading_recall, round(coalesce(2 * hit / nullif(got + want, 0), 0), 6) AS heading_f1, round(got / want, 6) AS heading_recall_any_level, round(got / want, 6) AS list_recall,
 round((2 + 2 * got) / (2 + 2 * got)::DOUBLE, 6) AS table_precision, round((2 + 2 * got) / (2 + 2 * want)::DOUBLE, 6) AS table_recall, round(2.0 * (2 + 2 * got) / (4 + 2 * got + 2 * want), 6) AS table_f1, 1.0 AS tables_detected, 1.0 AS tables_expected FROM c""")
def structure_scores_of_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A document of headings, list and table for each region against one that lacks every third nation and sets others
    at a deeper level, so every score follows from counts."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key, kept = F.col("n_nationkey"), F.col("n_nationkey") % 3 != 0
    row = F.struct(key.alias("k"), F.md5("n_name").alias("n"))
    lists = n.groupBy("r_name").agg(F.sort_array(F.collect_list(row)).alias("all"), F.sort_array(F.collect_list(F.when(kept, row))).alias("some"))

    def markdown(rows: str, deeper: bool):
        mark = lambda x: F.when((x["k"] % 4 == 1) & F.lit(deeper), F.lit("#### ")).otherwise(F.lit("## "))
        parts = [F.transform(rows, lambda x: F.concat(mark(x), x["n"])), F.transform(rows, lambda x: F.concat(F.lit("- "), x["n"])), F.array(F.lit("| name | key |\n|---|---|")), F.transform(rows, lambda x: F.concat(F.lit("| "), x["n"], F.lit(" | "), x["k"].cast("string"), F.lit(" |")))]
        return F.array_join(F.flatten(F.array(*parts)), "\n")

    pairs = lists.select(F.col("r_name").alias("region"), markdown("all", False).alias("expected"), markdown("some", True).alias("found"))
    scores = scoring.structure_scores(pairs, "region")
    return scores.select("region", *[F.round(c, 6).alias(c) for c in scores.columns[1:] if c not in ("cer", "bow_f1")])


@query("""WITH p AS (SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS a, lower(replace(c_name, '0', '') || ' ' || c_mktsegment) AS b FROM customer)
SELECT c_custkey, round(levenshtein(a, b) / length(a), 6) AS cer, round(least(levenshtein(a, b) / length(a), 1), 6) AS scored_cer FROM p""")
def text_scores_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Character error rates by the column function and by the scorer, over marks that are no text."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("a"), F.concat_ws(" ", F.replace("c_name", F.lit("0"), F.lit("")), "c_mktsegment").alias("b"))
    pairs = c.select("c_custkey", F.lower("a").alias("a"), F.lower("b").alias("b"), F.concat(F.lit("# **"), "a", F.lit("**")).alias("expected"), F.concat(F.lit("- `"), "b", F.lit("`\n<!-- no text -->")).alias("found"))
    scores = scoring.structure_scores(pairs, "c_custkey").select("c_custkey", F.round("cer", 6).alias("scored_cer"))
    return pairs.select("c_custkey", F.round(scoring.cer(F.col("a"), F.col("b")), 6).alias("cer")).join(scores, "c_custkey")


@query("""WITH w AS (SELECT o_orderkey, string_split(lower(o_orderpriority || ' clerk ' || o_orderstatus), ' ') AS x, string_split(lower(o_orderpriority || ' ' || o_orderstatus), ' ') AS y FROM orders)
SELECT o_orderkey, round(1.0 / len(x), 6) AS wer, round(2.0 * len(y) / (len(x) + len(y)), 6) AS bow_f1 FROM w""")
def word_scores_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Word error rate and bag F1 where one word is missing."""
    o = table(spark, sf, "orders").select("o_orderkey", F.lower(F.concat_ws(" ", "o_orderpriority", F.lit("clerk"), "o_orderstatus")).alias("x"), F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("y"))
    n, m = F.size(F.split("x", " ")), F.size(F.split("y", " "))
    return o.select("o_orderkey", F.round(scoring.wer("x", "y"), 6).alias("wer"), F.round(scoring.f1(m, n, m), 6).alias("bow_f1"))


@query("""WITH n AS (SELECT n_nationkey, n_name, n_name || 'S' AS longer, reverse(n_name) AS turned FROM nation) SELECT n_nationkey, length(n_name) > 3 AND 200.0 * length(n_name) / (2 * length(n_name) + 1) >= 90 AS near, n_name = turned AS same FROM n""")
def names_alike(spark: SparkSession, sf: str) -> DataFrame:
    """A name against itself with a letter more, and against itself turned round."""
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", scoring.alike("n_name", F.concat("n_name", F.lit("S"))).alias("near"), (scoring.alike("n_name", F.reverse("n_name")) & (F.col("n_name") == F.reverse("n_name"))).alias("same"))
