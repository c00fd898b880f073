"""Queries of Markdown builders, readers, format detection and sinks. Files are made of the tables' rows inside the plan and
read as any file would be; the SQL side writes down what has to come out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import markdown as M
from docmill.functions import text as T
from docmill.functions.arrow import arrow_udf
from docmill.operators import documents
from docmill.plans.registry import RE_SPACE, query, strip_sql
from docmill.session import shared_folder, table
from docmill.sources import extract, files, formats

NL = "chr(10)"


# ------------------------------------------------------------------ builders as columns


@query(f"""WITH b AS (SELECT block_key, max(text) AS text FROM blocks GROUP BY block_key) SELECT block_key, {strip_sql("regexp_replace(replace(text, '|', chr(92) || '|'), '[" + RE_SPACE + "]+', ' ', 'g')")} AS cell FROM b""")
def escaped_cells(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "blocks").groupBy("block_key").agg(F.max("text").alias("text"))
    return once.select("block_key", T.escape_cell(F.col("text")).alias("cell"))


@query(f"""WITH b AS (SELECT block_key, max(text) AS text FROM blocks GROUP BY block_key), f AS (SELECT block_key, text, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0) + 1)) AS fence FROM b)
SELECT block_key, md5(fence || 'txt' || {NL} || regexp_replace(text, '[{RE_SPACE}]+$', '') || {NL} || fence) AS digest FROM f""")
def fenced_blocks(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "blocks").groupBy("block_key").agg(F.max("text").alias("text"))
    return once.select("block_key", F.md5(T.fenced(F.col("text"), "txt")).alias("digest"))


@query(f"""WITH b AS (SELECT block_key, max(text) AS text FROM blocks GROUP BY block_key) SELECT block_key, md5({strip_sql("regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS normal,
 md5(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?m)^#{{1,6}}[ \\t]+', '', 'g'), '(?m)^\\|?[ \\t:|-]+\\|?$', '', 'g'), '|', ' '), '[*_`]{{1,3}}', '', 'g'), '[ \\t]+', ' ', 'g')) AS bare FROM b""")
def markdown_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks as normal Markdown and as rough text."""
    once = table(spark, sf, "blocks").groupBy("block_key").agg(F.max("text").alias("text"))
    return once.select("block_key", F.md5(T.normalize_markdown(F.col("text"))).alias("normal"), F.md5(T.strip_markdown(F.col("text"))).alias("bare"))


@query("""WITH b AS (SELECT chunk_key, max(text) AS text FROM chunks GROUP BY chunk_key) SELECT chunk_key, md5(regexp_replace(text, '([\\p{L}\\p{N}_])- ([\\p{L}\\p{N}_])', '\\1\\2', 'g')) AS digest FROM b""")
def hyphens_joined(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "chunks").groupBy("chunk_key").agg(F.max("text").alias("text"))
    return once.select("chunk_key", F.md5(T.join_hyphenated(F.col("text"))).alias("digest"))


@query("""SELECT id, regexp_replace(format('{:,}', max(size_bytes)), ' ', '') AS size, regexp_replace(regexp_replace(regexp_extract(max(original_filename), '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1'), '[^\\x00-\\x7f]|"', '', 'g') AS stem FROM uploads GROUP BY id""")
def file_names_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes with thousands separators, and names fit for a download (an empty one is called document)."""
    once = table(spark, sf, "uploads").groupBy("id").agg(F.max("original_filename").alias("name"), F.max("size_bytes").alias("bytes"))
    stem = T.download_name(F.col("name"))
    return once.select("id", T.thousands(F.col("bytes")).alias("size"), F.when((stem == "document") & ~F.contains(F.col("name"), F.lit("document")), "").otherwise(stem).alias("stem"))


def rows_of_regions(spark: SparkSession, sf: str) -> DataFrame:
    """(region, rows): the nations of each region in order, as an array of (key, name)."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))).alias("rows"))
    return rows.withColumnRenamed("r_name", "region")


def joined(form: Callable[[Column], Column], glue: str = "\n") -> Column:
    return F.array_join(F.transform("rows", form), glue)


ROWS = "n AS (SELECT r_name AS region, n_nationkey AS k, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey)"
TABLE_SQL = f"'| key | name |' || {NL} || '|---|---|' || {NL} || string_agg('| ' || k || ' | ' || n || ' |', {NL} ORDER BY k)"


@arrow_udf("string")
def as_table(keys: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([M.pipe_table([["key", "name"], *zip(k, n), [" ", None]]) for k, n in zip(keys, names)], dtype=object)


@query(f"WITH {ROWS} SELECT region, {TABLE_SQL} AS markdown FROM n GROUP BY region")
def pipe_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = rows_of_regions(spark, sf)
    return rows.select("region", as_table(F.transform("rows", lambda r: r["k"]), F.transform("rows", lambda r: r["n"])).alias("markdown"))


@query(f"WITH {ROWS} SELECT region, string_agg(chr(92) || '# ' || n || {NL} || chr(92) || '> ' || k || {NL} || '- ' || lower(n) || {NL} || k || '. last', {NL} || {NL} ORDER BY k) AS markdown FROM n GROUP BY region")
def plain_text_as_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that must not turn into headings and quotes; bullets and numbers become list items."""
    text = joined(lambda r: F.concat(F.lit("# "), r["n"], F.lit("\n> "), r["k"].cast("string"), F.lit("\n• "), F.lower(r["n"]), F.lit("\n"), r["k"].cast("string"), F.lit(")  last")), "\n\n \n")
    return rows_of_regions(spark, sf).select("region", M.as_udf(M.from_plain)(text).alias("markdown"))


# ------------------------------------------------------------------ readers


def read_back(made: DataFrame, key: str) -> DataFrame:
    """(key, number, kind, error_code, text, markdown) of files (key, path, content)."""
    named = made.select(F.concat_ws("/", F.col(key).cast("string"), "path").alias("path"), "content")
    pages = extract.extract_pages(named)
    return pages.select(F.split_part("path", F.lit("/"), F.lit(1)).alias(key), "number", "kind", "error_code", "text", "markdown", "metadata", "warnings")


def file(path: str, text: Column) -> list[Column]:
    return [F.lit(path).alias("path"), F.encode(text, "utf-8").alias("content")]


@query(f"WITH {ROWS} SELECT region, 'text' AS kind, {TABLE_SQL} AS markdown, 'key;name' || {NL} || string_agg(k || ';' || n, {NL} ORDER BY k) AS text FROM n GROUP BY region")
def csv_files(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("key;name\n"), joined(lambda r: F.concat(r["k"].cast("string"), F.lit(";"), r["n"])), F.lit("\n"))
    return read_back(rows_of_regions(spark, sf).select("region", *file("nations.csv", text)), "region").select("region", "kind", "markdown", "text")


@query(f"""WITH {ROWS} SELECT region, 'text' AS kind, '```json' || {NL} || '{{' || {NL} || '  "nations": [' || {NL} || string_agg('    "' || n || '"', ',' || {NL} ORDER BY k) || {NL} || '  ]' || {NL} || '}}' || {NL} || '```' AS markdown FROM n GROUP BY region""")
def json_files(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit('{"nations": ["'), joined(lambda r: r["n"], '", "'), F.lit('"]}'))
    return read_back(rows_of_regions(spark, sf).select("region", *file("nations.json", text)), "region").select("region", "kind", "markdown")


@query(f"""WITH {ROWS} SELECT region, 'html' AS kind, '# ' || region || {NL} || {NL} || '## Nations' || {NL} || {NL} || string_agg('- ' || n, {NL} ORDER BY k) || {NL} || {NL} || {TABLE_SQL} AS markdown, region AS title, '1' AS tables, 'en' AS lang FROM n GROUP BY region""")
def html_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a title, a list and a table; scripts leave no trace."""
    head = F.concat(F.lit("<!DOCTYPE html><html lang='en'><head><title>"), F.col("region"), F.lit("</title><script>var x = 1;</script></head><body><h2>Nations</h2><ul>"))
    items = joined(lambda r: F.concat(F.lit("<li>"), r["n"], F.lit("</li>")), "")
    cells = joined(lambda r: F.concat(F.lit("<tr><td>"), r["k"].cast("string"), F.lit("</td><td>"), r["n"], F.lit("</td></tr>")), "")
    text = F.concat(head, items, F.lit("</ul><table><tr><th>key</th><th>name</th></tr>"), cells, F.lit("</table></body></html>"))
    pages = read_back(rows_of_regions(spark, sf).select("region", *file("nations.html", text)), "region")
    return pages.select("region", "kind", "markdown", *[F.col("metadata")[k].alias(k) for k in ("title", "tables", "lang")])


@query(f"WITH {ROWS} SELECT region, 'rtf' AS kind, string_agg(n || ' – ' || k || '!', {NL} ORDER BY k) AS text FROM n GROUP BY region")
def rtf_files(spark: SparkSession, sf: str) -> DataFrame:
    """Control words, a font table, a Unicode sign with its stand-in and a byte in hexadecimal."""
    text = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}"), joined(lambda r: F.concat(F.lit("{\\b "), r["n"], F.lit("} \\u8211? "), r["k"].cast("string"), F.lit("\\'21")), "\\par\n"), F.lit("}"))
    return read_back(rows_of_regions(spark, sf).select("region", *file("nations.rtf", text)), "region").select("region", "kind", "text")


@query(f"""WITH {ROWS} SELECT region, number, CASE number WHEN 1 THEN '# Nations of ' || region || {NL} || {NL} || '| Field | Value |' || {NL} || '|---|---|' || {NL} || '| From | ana@ex.org |' || {NL} || '| To | bo@ex.org |' || {NL} || '| Subject | Nations of ' || region || ' |' || {NL} || {NL} || string_agg('- ' || n, {NL} ORDER BY k) || {NL} || {NL} || '## Attachments' || {NL} || {NL} || '- list.csv (text/csv, ' || (9 + sum(2 + length(k::VARCHAR) + length(n))) || ' bytes)'
 ELSE '## Attachment: list.csv' || {NL} || {NL} || {TABLE_SQL} END AS markdown FROM n, (SELECT unnest([1, 2]) AS number) GROUP BY region, number""")
def mail_files(spark: SparkSession, sf: str) -> DataFrame:
    """A mail with a list as its body and a table as its attachment."""
    body = joined(lambda r: F.concat(F.lit("• "), r["n"]))
    rows = F.concat(F.lit("key,name\n"), joined(lambda r: F.concat(r["k"].cast("string"), F.lit(","), r["n"])), F.lit("\n"))
    head = F.concat(F.lit('From: Ana <ana@ex.org>\nTo: bo@ex.org\nSubject: Nations of '), F.col("region"), F.lit('\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="x"\n\n--x\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'))
    text = F.concat(head, body, F.lit('\n\n--x\nContent-Type: text/csv; charset="utf-8"\nContent-Disposition: attachment; filename="list.csv"\n\n'), rows, F.lit("\n--x--\n"))
    return read_back(rows_of_regions(spark, sf).select("region", *file("mail.eml", text)), "region").select("region", "number", "markdown")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in parts.items():
            archive.writestr(name, content)
    return out.getvalue()


def docx_of(region: str, rows: list[tuple[int, str]]) -> bytes:
    paragraph = lambda style, t: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    lists = "".join(paragraph("ListBullet", n) for _, n in rows)
    cells = "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in [("key", "name"), *rows])
    head = f'<w:hdr {W}><w:p><w:r><w:t>Page head</w:t></w:r></w:p></w:hdr>'
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{paragraph('Title', region)}{paragraph('Heading1', 'Nations')}{lists}<w:tbl>{cells}</w:tbl></w:body></w:document>", "word/header1.xml": head})


def pptx_of(region: str, rows: list[tuple[int, str]]) -> bytes:
    shape = lambda t, y, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slides = {f"ppt/slides/slide{i}.xml": f"<p:sld {A}>{shape('key ' + str(k), 900)}{shape(n, 10, kind='<p:ph type=%stitle%s/>' % (chr(34), chr(34)))}</p:sld>" for i, (k, n) in enumerate(rows, 1)}
    return zipped({"ppt/presentation.xml": "<x/>", **slides})


def xlsx_of(region: str, rows: list[tuple[int, str]]) -> bytes:
    cells = "".join(f'<row><c r="A{i}"><v>{k}</v></c><c r="B{i}" t="inlineStr"><is><t>{n}</t></is></c><c r="C{i}" t="b"><v>{k % 2}</v></c><c r="D{i}" s="1"><v>{45000 + k}.5</v></c></row>' for i, (k, n) in enumerate(rows, 2))
    head = '<row><c r="A1" t="inlineStr"><is><t>key</t></is></c><c r="B1" t="inlineStr"><is><t>name</t></is></c><c r="C1" t="inlineStr"><is><t>odd</t></is></c><c r="D1" t="inlineStr"><is><t>on</t></is></c></row>'
    book = f'<workbook {S}><sheets><sheet name="{region}" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    styles = f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    return zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{head}{cells}</sheetData></worksheet>"})


OFFICE = {"docx": docx_of, "pptx": pptx_of, "xlsx": xlsx_of}


def office_files(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    @arrow_udf("binary")
    def made(regions: pd.Series, keys: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([OFFICE[kind](r, list(zip((int(x) for x in k), n))) for r, k, n in zip(regions, keys, names)], dtype=object)

    rows = rows_of_regions(spark, sf)
    content = made("region", F.transform("rows", lambda r: r["k"]), F.transform("rows", lambda r: r["n"]))
    return read_back(rows.select("region", F.lit(f"nations.{kind}").alias("path"), content.alias("content")), "region")


@query(f"""WITH {ROWS} SELECT region, 'docx' AS kind, '# ' || region || {NL} || {NL} || '## Nations' || {NL} || {NL} || string_agg('- ' || n, {NL} ORDER BY k) || {NL} || {NL} || {TABLE_SQL} AS markdown, 'Page head' || {NL} || region || {NL} || 'Nations' || {NL} || string_agg(n, {NL} ORDER BY k) || {NL} || 'key' || chr(9) || 'name' || {NL} || string_agg(k || chr(9) || n, {NL} ORDER BY k) AS text FROM n GROUP BY region""")
def word_files(spark: SparkSession, sf: str) -> DataFrame:
    return office_files(spark, sf, "docx").select("region", "kind", "markdown", "text")


@query(f"""WITH {ROWS}, s AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY k) AS number FROM n) SELECT region, number::INT AS number, '## Slide ' || number || ': ' || n || {NL} || {NL} || 'key ' || k AS markdown, n || {NL} || 'key ' || k AS text FROM s""")
def slide_files(spark: SparkSession, sf: str) -> DataFrame:
    return office_files(spark, sf, "pptx").select("region", "number", "markdown", "text")


@query(f"""WITH {ROWS}, v AS (SELECT *, CASE WHEN k % 2 = 1 THEN 'True' ELSE 'False' END AS odd, strftime(TIMESTAMP '1899-12-30 12:00:00' + to_days((45000 + k)::INT), '%Y-%m-%d %H:%M:%S') AS d FROM n)
SELECT region, '## Sheet: ' || region || {NL} || {NL} || '| key | name | odd | on |' || {NL} || '|---|---|---|---|' || {NL} || string_agg('| ' || k || ' | ' || n || ' | ' || odd || ' | ' || d || ' |', {NL} ORDER BY k) AS markdown, '# ' || region || {NL} || 'key' || chr(9) || 'name' || chr(9) || 'odd' || chr(9) || 'on' || {NL} || string_agg(k || chr(9) || n || chr(9) || odd || chr(9) || d, {NL} ORDER BY k) AS text FROM v GROUP BY region""")
def sheet_files(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, texts, truth values and dates of a sheet."""
    return office_files(spark, sf, "xlsx").select("region", "markdown", "text")


#: What a file of each kind starts with, for detection (fixed values of the formats).
STARTS = {"pdf": b"%PDF-1.7 x", "image": b"\x89PNG\r\n\x1a\n x", "text": b"only words here", "html": b"<!DOCTYPE html><p>x</p>", "rtf": b"{\\rtf1 x}", "eml": b"From: a@b.org\nTo: c@d.org\nSubject: x\n\nbody"}


@query("""WITH u AS (SELECT id, max(kind) AS kind, max(original_filename) AS name FROM uploads GROUP BY id), e AS (SELECT *, lower(regexp_extract(name, '[^.](\\.[^./\\\\]*)$', 1)) AS ext FROM u), d AS (SELECT *, CASE WHEN kind IN ('docx', 'pptx', 'xlsx') THEN kind WHEN ext = '.eml' AND kind IN ('text', 'html') AND kind = 'text' THEN 'eml' ELSE kind END AS found FROM e)
SELECT id, found AS kind, CASE found WHEN 'pdf' THEN ext <> '.pdf' WHEN 'image' THEN ext NOT IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.webp', '.bmp', '.gif') WHEN 'text' THEN ext NOT IN ('.txt', '.md', '.markdown', '.csv', '.tsv', '.log', '.json', '.xml') WHEN 'html' THEN ext NOT IN ('.html', '.htm', '.xhtml') WHEN 'eml' THEN ext <> '.eml' ELSE ext <> '.' || found END AS warned FROM d WHERE name IS NOT NULL""")
def formats_detected(spark: SparkSession, sf: str) -> DataFrame:
    """Each upload as a file of its kind under its own name: what it is by content, and whether the name is told off."""
    once = table(spark, sf, "uploads").groupBy("id").agg(F.max("kind").alias("kind"), F.max("original_filename").alias("name")).filter("name is not null")
    made = {**STARTS, **{k: OFFICE[k]("x", [(1, "y")]) for k in OFFICE}}
    content = F.create_map(*[F.lit(x) for pair in made.items() for x in (pair[0], bytearray(pair[1]))])[F.col("kind")]
    found = once.select("id", formats.detect_format(content, F.col("name")).alias("d"))
    return found.select("id", "d.kind", (F.size("d.warnings") > 0).alias("warned"))


@query("""WITH p AS (SELECT page_key, max(text) AS text FROM page_results GROUP BY page_key HAVING max(text) IS NOT NULL) SELECT page_key, CASE WHEN page_key % 10 = 0 THEN 'CORRUPTED_FILE' END AS error_code FROM p""")
def bad_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as text files, every tenth replaced by control bytes: errors are columns, nothing is thrown."""
    once = table(spark, sf, "page_results").groupBy("page_key").agg(F.max("text").alias("text")).filter("text is not null")
    clean = F.regexp_replace("text", r"[\x00-\x08\x0e-\x1f]", "")
    content = F.when(F.col("page_key") % 10 == 0, F.lit("\x00\x01\x02\x03")).otherwise(F.concat(F.lit("x "), clean))
    pages = read_back(once.select("page_key", *file("page.txt", content)), "page_key")
    return pages.select(F.col("page_key").cast("long").alias("page_key"), "error_code")


# ------------------------------------------------------------------ sinks, written and read again


@query("""SELECT DISTINCT job_id, chunk_index, id, md5(text) AS digest FROM chunks""")
def chunks_as_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "chunks")
    files.write_chunks(table(spark, sf, "chunks").distinct(), folder)
    back = spark.read.schema("job_id string, chunk_index int, id string, text string").json(folder)
    return back.select("job_id", "chunk_index", "id", F.md5("text").alias("digest"))


@query("""SELECT sha256, left(sha256, 2) AS prefix FROM uploads WHERE sha256 IS NOT NULL GROUP BY sha256""")
def contents_stored_once(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads written by content in two runs; the second finds most contents there."""
    folder = shared_folder(spark, "contents")
    uploads = table(spark, sf, "uploads").filter("sha256 is not null").select("sha256", "kind")
    files.write_by_content(uploads.filter("kind <> 'pdf'"), folder)
    files.write_by_content(uploads, folder)
    return spark.read.parquet(folder).select("sha256", F.col("prefix").cast("string").alias("prefix"))


@query("""SELECT event, count(*) AS n FROM job_events GROUP BY event""")
def events_appended(spark: SparkSession, sf: str) -> DataFrame:
    """The audit log written in two appends."""
    folder = shared_folder(spark, "events")
    log = table(spark, sf, "job_events")
    files.append_events(log.filter("level = 'info'"), folder)
    files.append_events(log.filter("level <> 'info' or level is null"), folder)
    return spark.read.parquet(folder).groupBy("event").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT id, arg_max(status, loaded_at) AS status, arg_max(worker_id, loaded_at) AS worker_id FROM jobs WHERE id IS NOT NULL GROUP BY id) SELECT id, status, worker_id IS NULL AS without_worker FROM c""")
def results_as_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls stay in a JSON result, so every key is there."""
    from docmill.operators.current import current_jobs

    folder = shared_folder(spark, "results")
    jobs = current_jobs(table(spark, sf, "jobs"), "status", "worker_id")
    files.write_texts(jobs.select(files.result_json("id", "status", "worker_id").alias("line")), "line", folder)
    lines = spark.read.text(folder)
    return lines.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.status").alias("status"), F.contains("value", F.lit('"worker_id":null')).alias("without_worker"))


@query("""SELECT kind, count(DISTINCT id) AS files FROM uploads GROUP BY kind""")
def report_as_csv(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "report")
    files.write_report(table(spark, sf, "uploads").groupBy("kind").agg(F.countDistinct("id").alias("files")), folder)
    return spark.read.schema("kind string, files long").option("header", "true").csv(folder)


@query(f"""WITH c AS (SELECT kind, count(DISTINCT id) AS files FROM uploads WHERE kind IS NOT NULL GROUP BY kind) SELECT '| kind | files |' || {NL} || '|---|---|' || {NL} || string_agg('| ' || kind || ' | ' || files || ' |', {NL} ORDER BY kind) AS report FROM c""")
def report_as_markdown(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "uploads").filter("kind is not null").groupBy("kind").agg(F.countDistinct("id").alias("files"))
    return files.markdown_report(counted, "kind")


@query("""WITH u AS (SELECT DISTINCT sha256 FROM uploads WHERE sha256 IS NOT NULL), k AS (SELECT DISTINCT sha256 FROM uploads WHERE kind = 'pdf') SELECT 'sha256/' || left(sha256, 2) || '/' || sha256 AS key FROM u WHERE sha256 NOT IN (SELECT sha256 FROM k WHERE sha256 IS NOT NULL)""")
def files_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Keys without a file where only PDFs are stored."""
    keys = table(spark, sf, "uploads").filter("sha256 is not null").select(T.document_key(F.col("sha256"), F.lit("")).alias("key"), "kind")
    stored = keys.filter("kind = 'pdf'").select(F.col("key").alias("path"))
    return files.missing_files(keys.select("key").distinct(), stored)


@query("""SELECT job_id, count(*) AS n FROM (SELECT DISTINCT id, job_id FROM job_events WHERE job_id IS NOT NULL) GROUP BY job_id""")
def messages_of_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events in broker envelopes, and the jobs their ids name."""
    from docmill.operators import lifecycle

    log = table(spark, sf, "job_events").filter("job_id is not null").select("id", "job_id").distinct()
    raw = F.to_json(F.struct(F.struct(F.concat_ws(".", "job_id", F.col("id").cast("string")).alias("id")).alias("headers")))
    return log.select(lifecycle.job_id_of_message(raw).alias("job_id")).groupBy("job_id").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ lines, lists, statistics


@query("""WITH l AS (SELECT job_id, number, CASE WHEN number % 3 = 1 THEN '<!-- page: ' || number || ' -->' ELSE 'text' END AS line FROM (SELECT DISTINCT job_id, number FROM page_results WHERE number IS NOT NULL AND job_id IS NOT NULL))
SELECT job_id, number, coalesce(max(CASE WHEN number % 3 = 1 THEN number END) OVER (PARTITION BY job_id ORDER BY number), 1)::INT AS page FROM l""")
def pages_forward_filled(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "page_results").filter("number is not null and job_id is not null").select("job_id", "number").distinct()
    lines = lines.withColumn("line", F.when(F.col("number") % 3 == 1, F.concat(F.lit("<!-- page: "), F.col("number").cast("string"), F.lit(" -->"))).otherwise("text"))
    return documents.forward_fill_pages(lines, "job_id", "number", "line").select("job_id", "number", "page")


@query("""WITH b AS (SELECT job_id, block_index, max(kind) AS kind, max(text) AS text FROM blocks WHERE kind IS NOT NULL AND job_id IS NOT NULL GROUP BY ALL), p AS (SELECT job_id, block_index, CASE WHEN kind IN ('list', 'heading') THEN '- ' || md5(text) ELSE md5(text) END AS t, kind IN ('list', 'heading') AS item FROM b),
g AS (SELECT *, sum(CASE WHEN item AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY block_index) AS island FROM (SELECT *, lag(item) OVER (PARTITION BY job_id ORDER BY block_index) AS before FROM p)) SELECT job_id, min(block_index) AS first, string_agg(t, chr(10) ORDER BY block_index) AS text FROM g GROUP BY job_id, island""")
def lists_merged(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "blocks").filter("kind is not null and job_id is not null").groupBy("job_id", "block_index").agg(F.max("kind").alias("kind"), F.max("text").alias("text"))
    parts = once.withColumn("t", F.when(F.col("kind").isin("list", "heading"), F.concat(F.lit("- "), F.md5("text"))).otherwise(F.md5("text")))
    return documents.merged_lists(parts, "job_id", "block_index", "t")


@query("""WITH p AS (SELECT job_id, number, max(struct_pack(m := method, c := ocr_confidence)) AS p FROM page_results WHERE job_id IS NOT NULL GROUP BY job_id, number) SELECT job_id, count(*) AS pages, count(DISTINCT coalesce(p.m, 'unknown')) AS methods, round(avg(p.c), 6) AS confidence FROM p GROUP BY job_id""")
def page_statistics(spark: SparkSession, sf: str) -> DataFrame:
    found = documents.page_statistics(table(spark, sf, "page_results").filter("job_id is not null"))
    return found.select("job_id", F.col("page_count").alias("pages"), F.size("methods").cast("long").alias("methods"), F.round("mean_confidence", 6).alias("confidence"))
