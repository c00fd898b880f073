from pyspark.sql import functions as F

from docmill.functions import entities, markdown as M
from docmill.functions import text as T


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_markdown_builders():
    assert M.pipe_table([["a", "b|c"], ["1", None]]) == "| a | b\\|c |\n|---|---|\n| 1 |  |"
    assert M.from_lines("• one\n• two\n\n1) first") == "- one\n- two\n\n1. first"
    assert M.from_plain("# not a heading\nline").startswith("\\# not a heading")
    assert M.code_block("a ``` b").startswith("````\n")
    assert M.from_json('{"a": [1, 2]}') == ('```json\n{\n  "a": [\n    1,\n    2\n  ]\n}\n```', True)
    assert M.from_json("{")[1] is False
    table, facts = M.from_csv("item;qty\nx;1\n")
    assert table.startswith("| item | qty |") and facts == {"rows": 2, "columns": 2, "delimiter": ";"}
    assert M.pipe_table([[str(i)] for i in range(2105)]).endswith("*(table truncated after 2000 rows)*")


def test_html():
    text, md, facts = M.from_html("<html lang=en><head><title>Async</title><script>console.log(1)</script></head><body><h2>Sub</h2><p>Hi <b>you</b> <a href='u'>l</a></p><ul><li>a<li>b</ul><table><tr><th>x</th></tr><tr><td>1</td></tr></table></body></html>")
    assert md.startswith("# Async\n\n## Sub") and "**you**" in md and "[l](u)" in md and "- a\n- b" in md and "| x |" in md
    assert "console" not in text + md and facts["links"] == 1 and facts["tables"] == 1 and facts["lang"] == "en"


def test_columns(spark):
    row = one(spark, "a\r\nb  \n\n\n\nc　", T.normalize_text(F.col("t")), T.word_count(F.col("t")), T.line_count(F.col("t")), T.estimate_tokens(F.lit("")))
    assert row[0] == "a\nb\n\nc" and row[1] == 3 and row[3] == 0
    assert one(spark, "One. Two! Año… tres", T.sentences(F.col("t")))[0] == ["One.", "Two!", "Año…", "tres"]
    assert one(spark, "exam- ple", T.join_hyphenated(F.col("t")))[0] == "example"
    assert one(spark, "x/Report.PDF", T.extension(F.col("t")))[0] == ".pdf"
    assert one(spark, "a|b  c", T.escape_cell(F.col("t")))[0] == "a\\|b c"
    assert one(spark, "a ```` b", T.fenced(F.col("t")))[0].startswith("`````")
    assert one(spark, "ab cd " * 200, T.tail(F.col("t"), 2))[0] == "ab cd"
    assert one(spark, None, T.normalize_text(F.col("t")), T.estimate_tokens(F.col("t")))[0] is None


def test_entities(spark):
    said = "Write to ana@ex.org by 2026-05-04 or 12 de sep 2026, pay $1,250.00, call +52 55 1234 5678, see https://x.org/a."
    found = one(spark, said, entities.all_entities(F.col("t")))[0]
    assert found["emails"] == ["ana@ex.org"] and found["urls"] == ["https://x.org/a"]
    assert found["dates"] == ["2026-05-04", "12 de sep 2026"] and found["amounts"] == ["$1,250.00"] and found["phone_numbers"] == ["+52 55 1234 5678"]
    assert one(spark, "nothing", entities.all_entities(F.col("t")))[0] == {}


def test_entities_keep_to_word_boundaries(spark):
    def of(text, kind):
        return one(spark, text, entities.entities(F.col("t"), kind))[0]

    assert of("555-123-4567 555-765-4321 555-111-2222", "phone_numbers") == ["555-123-4567", "555-765-4321", "555-111-2222"]
    assert of("Phone:+529991234567, x5551234567", "phone_numbers") == ["+529991234567"] and of("555\n123\n4567", "phone_numbers") == ["555\n123\n4567"]
    assert of("2024-01-0212 and 2024-01-02.", "dates") == ["2024-01-02"] and of("on 12 sep. 2026, 3 de ago de 2025", "dates") == ["12 sep. 2026", "3 de ago de 2025"]
    assert of("100 Europeans A1234 EUR", "amounts") == [] and of("1,150.00 MXN, €12.50. US$ 30", "amounts") == ["1,150.00 MXN", "€12.50", "US$ 30"]
    assert of("é.a@x-y.org- and a.b@c.d-.ef", "emails") == ["é.a@x-y.org", "a.b@c.d-.ef"] and of("xhttp://a http://b/(c)", "urls") == ["http://b/"]
    said = "Pay $1,150.00 MXN to ops@example.com by 2026-10-01, call +52 999 123 4567. https://x.io/a"
    assert one(spark, said, entities.all_entities(F.col("t")))[0] == {"emails": ["ops@example.com"], "urls": ["https://x.io/a"], "dates": ["2026-10-01"], "amounts": ["$1,150.00"], "phone_numbers": ["+52 999 123 4567"]}
