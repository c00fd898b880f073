import io
import zipfile
from email.message import EmailMessage

from docmill.engine import Engine, InvalidOptions, check_options
from docmill.sources import extract, formats

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), content)
    return out.getvalue()


def docx():
    p = lambda s, t: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    return packed(word__document_DOT_xml=f"<w:document {W}><w:body>{p('Title', 'Plan')}{p('Heading1', 'Part')}{p('Normal', 'Words here')}{p('ListBullet', 'one')}{p('ListBullet', 'two')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl></w:body></w:document>")


def pptx():
    def box(text, y):
        return f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    return packed(ppt__presentation_DOT_xml="<x/>", ppt__slides__slide1_DOT_xml=f"<p:sld {A}>{box('below', 900)}{box('above', 10)}</p:sld>", ppt__slides__slide2_DOT_xml=f"<p:sld {A}>{box('second', 1)}</p:sld>")


def xlsx():
    book = f'<workbook {S}><sheets><sheet name="Sales" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    sheet = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    return packed(xl__workbook_DOT_xml=book, xl___rels__workbook_DOT_xml_DOT_rels=rels, xl__worksheets__sheet1_DOT_xml=sheet, xl__sharedStrings_DOT_xml=f"<sst {S}><si><t>head</t></si></sst>")


def eml():
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "Ana <ana@ex.org>", "bo@ex.org", "Invoice", "Fri, 21 Aug 2026 04:04:24 +0200"
    m.set_content("See the table.\n")
    m.add_attachment("item,qty\nx,1\n", subtype="csv", filename="prices.csv")
    m.add_attachment(b"MZ\0\1\2", maintype="application", subtype="octet-stream", filename="tool.exe")
    return m.as_bytes()


def test_detection():
    cases = [(b"%PDF-1.7", "a.pdf", "pdf"), (b"\x89PNG\r\n\x1a\n", "a.png", "image"), (docx(), "a.docx", "docx"), (pptx(), "a.pptx", "pptx"), (xlsx(), "a.zip", "xlsx"), (eml(), "a.eml", "eml"), (b"{\\rtf1 x}", "a.rtf", "rtf"), (b"<!DOCTYPE html><p>", "a.html", "html"), (b"just text", "a.md", "text")]
    for content, name, kind in cases:
        assert formats.detect(content, name)["kind"] == kind, name
    wrong = formats.detect(b"only words here", "photo.png")
    assert wrong["kind"] == "text" and wrong["warnings"]
    assert formats.detect(b"MZ\0\0\1\2", "a.exe")["error_code"] == "UNSUPPORTED_FORMAT"


def test_readers():
    def md(content, name):
        info, pages = extract.extract_file(content, name)
        assert info["error_code"] is None, info
        return [p["markdown"] for p in pages]

    assert "# Plan" in md(docx(), "a.docx")[0] and "- one\n- two" in md(docx(), "a.docx")[0] and "| 1 | 2 |" in md(docx(), "a.docx")[0]
    assert md(pptx(), "a.pptx") == ["## Slide 1\n\nabove\n\nbelow", "## Slide 2\n\nsecond"]
    assert md(xlsx(), "a.xlsx") == ["## Sheet: Sales\n\n| head |  | 3 |\n|---|---|---|\n| in |  |  |"]
    mail = md(eml(), "m.eml")
    assert mail[0].startswith("# Invoice") and "| From | ana@ex.org |" in mail[0] and "tool.exe" in mail[0] and "skipped" in mail[0] and "| item | qty |" in mail[1]
    assert md(b"{\\rtf1{\\fonttbl{\\f0 Arial;}}The \\b pipeline\\b0  is ready\\'21\\par Next}", "a.rtf") == ["The pipeline is ready!\nNext"]
    assert "é" in md("café crème déjà vu où".encode("latin-1") * 9, "a.txt")[0]


def test_errors_stay_inside():
    assert extract.extract_file(b"%PDF-1.4", "a.pdf")[0]["error_code"] == "NO_ADAPTER"
    assert extract.extract_file(b"PK\3\4broken", "a.docx")[0]["error_code"] == "UNSUPPORTED_FORMAT"
    info, pages = extract.extract_file(b"", "a.txt")  # an empty text file is one empty page, or unsupported
    assert info["error_code"] == "UNSUPPORTED_FORMAT" or [p["text"] for p in pages] == [""]


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello there. Mail ana@ex.org.")
    (tmp_path / "copy.txt").write_text("Hello there. Mail ana@ex.org.")
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "c.bin").write_bytes(b"\0\1\2\3")
    out = Engine(spark, str(tmp_path)).ingest(str(tmp_path))
    assert out["pages"].count() == 2 and out["errors"].count() == 1 and out["chunks"].count() == 2
    samples = spark.createDataFrame([("en", "There is a note and the mail is here. Hello there to you."), ("es", "Hay una nota y el correo está aquí para usted.")], "lang string, text string")
    rows = Engine(spark, str(tmp_path)).ingest(str(tmp_path), samples)["documents"].collect()
    assert any((r["entities"] or {}).get("emails") == ["ana@ex.org"] and r["language"]["code"] == "en" and r["chunk_count"] == 1 for r in rows)
    assert all(r["tokenizer"] == "estimate:chars/4" for r in rows)


def test_options():
    assert check_options(language="en,es")["language"] == "en+es"
    for bad in ({"chunk_size_tokens": 63}, {"chunk_overlap_tokens": 512}, {"ocr_mode": "x"}):
        try:
            check_options(**bad)
        except InvalidOptions:
            continue
        raise AssertionError(bad)


def test_engine_reads(spark, small):
    from datetime import datetime, timezone

    engine = Engine(spark, small)
    stats = engine.stats(1440, datetime(2026, 8, 20, tzinfo=timezone.utc))
    assert stats["status_counts"].count() == 6 and stats["timeline"].count() >= 24
    job = engine.jobs(status="SUCCEEDED", limit=1).first()["id"]
    assert engine.job(job).count() == 1 and engine.events(job).count() > 0 and engine.formats().count() == 9


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (400).to_bytes(4, "big") + (300).to_bytes(4, "big")


def test_pictures_in_office_files():
    picture = f'<w:p><w:r><w:drawing><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="r1"/></w:drawing></w:r></w:p>'
    body = f"<w:document {W}><w:body><w:p><w:r><w:t>Words</w:t></w:r></w:p>{picture}{picture}</w:body></w:document>"
    rels = '<Relationships><Relationship Id="r1" Target="media/a.png"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in (("word/document.xml", body), ("word/_rels/document.xml.rels", rels), ("word/media/a.png", PNG)):
            z.writestr(name, content)
    seen = []
    extract.register_adapter("image", lambda raw, info: seen.append(1) or [{"number": 1, "text": "INV-1\n\ntotal", "markdown": "", "method": "ocr:x", "ocr_confidence": 90.0}])
    try:
        info, pages = extract.extract_file(out.getvalue(), "a.docx")
        assert "Words\n\n> **[Text in image]**\n>\n> INV-1\n>\n> total" in pages[0]["markdown"] and "INV-1" in pages[0]["text"] and len(seen) == 1
        assert info["metadata"]["embedded_images_ocr"] == "1" and info["metadata"]["embedded_images_mean_confidence"] == "90.0" and pages[0]["method"] == "parser+ocr"
        assert "INV-1" not in extract.extract_file(out.getvalue(), "a.docx", {"ocr_mode": "off"})[1][0]["text"]
    finally:
        extract.ADAPTERS.pop("image")
    assert extract.picture_size(PNG) == (400, 300) and extract.picture_size(b"") == (0, 0)


def test_pdf_pages_around_plugged_parts():
    from docmill.sources import recognise

    def span(text, y, size=10.0, bold=False):
        return {"x0": 0.0, "x1": 300.0, "y0": y, "y1": y + size, "text": text, "size": size, "bold": bold, "block": int(y > 20)}

    long = "Words of a page that has a text layer of its own."
    native = [{"text": f"Title\n{long}", "spans": [span("Title", 0.0, 18.0), span(long, 40.0)], "coverage": 0.0, "picture": lambda: b"1"}, {"text": " ", "spans": [], "coverage": 1.0, "picture": lambda: b"2"}, {"text": f"{long} {long}", "spans": [span("lost", 0.0)], "coverage": 0.0, "picture": lambda: b"3"}]
    recognise.plug("parser", lambda raw: native)
    recognise.plug("recogniser", lambda raw: {"text": "read text", "confidence": 41.0, "engine": "e", "rotated": 90})
    try:
        info, pages = extract.extract_file(b"%PDF-1.7", "a.pdf", {"ocr_mode": "auto"})
        assert [p["method"] for p in pages] == ["text_layer", "ocr:e", "text_layer"] and pages[0]["markdown"].startswith("# Title")
        assert pages[2]["markdown"] == f"{long} {long}" and len(info["warnings"]) == 3
        assert [p["method"] for p in extract.extract_file(b"%PDF-1.7", "a.pdf", {"ocr_mode": "off"})[1]] == ["text_layer"] * 3
        assert {p["method"] for p in extract.extract_file(b"%PDF-1.7", "a.pdf", {"ocr_mode": "force"})[1]} == {"ocr:e"}
        recognise.plug("layout", lambda raw, a, b, whole: [{"text": f"p{i}", "markdown": f"# p{i}"} for i in range(a, b + 1)])
        assert [p["method"] for p in extract.extract_file(b"%PDF-1.7", "a.pdf", {"pipeline": "layout"})[1]] == ["layout:plugged", "layout:plugged+ocr", "layout:plugged"]
        frames = extract.extract_file(PNG, "a.png")[1]
        assert frames[0]["text"] == "read text" and extract.extract_file(PNG, "a.png", {"ocr_mode": "off"})[1][0]["method"] == "none"
    finally:
        recognise.PLUGGED.clear()
    assert recognise.page_list([1, 2, 3, 5]) == "1-3, 5"


def test_mail_facts():
    info, _ = extract.extract_file(eml(), "m.eml")
    import json

    held = json.loads(info["metadata"]["attachments"])
    assert [(a["filename"], a["processed"]) for a in held] == [("prices.csv", True), ("tool.exe", False)] and "message_id" in info["metadata"]


def test_tags_of_a_camera():
    import struct

    from docmill.sources import exif

    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        tags = [(0x010F, 2, 9, 62), (0x0112, 3, 1, None), (0x9999, 2, 4, 0)]
        body = b"".join(struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", 6, 0) if at is None else struct.pack(order + "I", at)) for t, k, n, at in tags)
        tiff = mark + struct.pack(order + "IH", 8, len(tags)) + body + b"\0" * (62 - 8 - 2 - len(body)) + b"Maker Co\0"
        jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
        assert exif.facts(jpeg) == exif.facts(tiff) == {"Make": "Maker Co", "Orientation": "6"}
    assert exif.facts(b"") == exif.facts(b"\xff\xd8\xff") == exif.facts(b"II*\0\xff\xff\xff\xff") == {}
