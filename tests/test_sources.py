"""Parsers: plain text, Markdown, tables in Markdown, HTML, and files built here."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellumspark import schemas
from vellumspark.functions import text as T
from vellumspark.operators import tables
from vellumspark.sources import files, markdown, plain


def docs(spark, *texts):
    return spark.createDataFrame([(k, f"d{k}", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")


def test_text_blocks(spark):
    got = plain.text_sections(docs(spark, "  hello   world  \n\n  foo   bar  ", "", "a\r\n\r\n\r\nb\rc", "\n\n \n\n", None)).orderBy("doc_id", "section_ord").collect()
    assert [(r.doc_id, r.section_ord, r.text) for r in got] == [(0, 0, "hello world"), (0, 1, "foo bar"), (2, 0, "a"), (2, 1, "b c")]
    assert all(r.heading is None and r.level == 0 and r.metadata == {"source": r.source} for r in got)


def test_markdown_levels_and_preamble(spark):
    text = "intro\n# A ##\nbody a\n### C\n## B\nbody b\n#### D\nlast\n# E"
    got = markdown.markdown_sections(docs(spark, text, "plain words", "")).orderBy("doc_id", "section_ord").collect()
    shown = [(r.text, r.heading, r.level, r.parent_headings) for r in got if r.doc_id == 0]
    assert shown == [("intro", None, 0, []), ("body a", "A", 1, []), ("C", "C", 3, ["A"]), ("body b", "B", 2, ["A"]), ("last", "D", 4, ["A", "B"]), ("E", "E", 1, [])]
    assert [(r.text, r.heading) for r in got if r.doc_id == 1] == [("plain words", None)]
    assert not [r for r in got if r.doc_id == 2]


def test_page_sections_restart_headings_and_find_tables(spark):
    rows = [(1, "f.pdf", 1, "# One\nsay\n| a | b |\n|---|---|\n| 1 | 2 |\nend", None), (1, "f.pdf", 2, "## Two\nmore", None)]
    pages = spark.createDataFrame(rows, "doc_id long, source string, page int, text string, figures array<struct<image_path:string,caption:string,page:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
    got = markdown.page_sections(pages).orderBy("section_ord").collect()
    assert [(r.page, r.content_type, r.text, r.heading) for r in got] == [(1, "text", "say", "One"), (1, "table", "| a | b |\n|---|---|\n| 1 | 2 |", "One"), (1, "text", "end", "One"), (2, "text", "more", "Two")]
    assert got[1].table_data.headers == ["a", "b"] and got[1].table_data.rows == [["1", "2"]]
    assert got[3].parent_headings == []


def test_single_table_line_is_text(spark):
    got = markdown.table_blocks(docs(spark, "x\n| only |\ny")).orderBy("block").collect()
    assert [(r.kind, r.text) for r in got] == [("text", "x"), ("text", "| only |"), ("text", "y")]


@pytest.mark.parametrize(
    ("headers", "rows", "caption"),
    [(["P", "R"], [["A", "1"], ["B"]], "Cap"), ([], [["x", "y"], ["z", " ", "w"]], ""), (["H"], [], ""), ([], [], "Only")],
)
def test_tables_agree_with_python(spark, headers, rows, caption):
    df = spark.createDataFrame([((headers, rows, caption),)], "t struct<headers:array<string>,rows:array<array<string>>,caption:string>")
    got = df.select(tables.to_markdown(F.col("t")).alias("m"), tables.to_text(F.col("t")).alias("x")).first()
    assert got.m == files.table_text({"headers": headers, "rows": rows, "caption": caption})
    names = headers or [f"Field_{k + 1}" for k in range(len(rows[0]) if rows else 0)]
    items = [f"Table ({caption}):"] if caption else []
    items += [x for x in (", ".join(f"{h}: {v}" for h, v in zip(names, r, strict=False) if v.strip()) for r in rows) if x]
    assert got.x == (" | ".join(items) if rows else caption)


def test_html_sections():
    page = "<html><head><title>t</title></head><body><script>var x='</p>';</script><h1>Top</h1><p>One<p>Two <b>bold</b>.</p><table><caption>Cap</caption><tr><th>H1</th><th>H2</th></tr><tr><td>1</td><td>2</td></tr></table><h2>Sub</h2><img src=a.png alt='A pic'><li>skipped</li></body></html>"
    got = list(files.html_file("p.html", page))
    assert [(s["content_type"], s["text"], s["heading"], s["parent_headings"]) for s in got[:2]] == [("text", "One", "Top", ["Top"]), ("text", "Twobold.", "Top", ["Top"])]
    assert got[2]["table_data"] == {"headers": ["H1", "H2"], "rows": [["1", "2"]], "caption": "Cap"}
    assert (got[3]["content_type"], got[3]["text"], got[3]["parent_headings"]) == ("figure", "Figure: A pic", ["Top", "Sub"])
    assert len(got) == 4


def test_html_plain_text(spark):
    df = spark.createDataFrame([("<p>a<br>b</p> &amp; <script>x</script>",)], "h string")
    assert df.select(plain.html_plain_text(F.col("h"))).first()[0] == "a b &amp; x"


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
RID = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx():
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", "H1") + p("Under title") + p("Odd", "HX") + p("Under odd") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="HX"><w:name w:val="Heading odd"/></w:style></w:styles>'
    return _zip(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def test_docx():
    got = list(files.docx_file("x.docx", docx()))
    assert [(s["text"], s["heading"], s["parent_headings"]) for s in got[:2]] == [("Under title", "Title", ["Title"]), ("Under odd", "Odd", ["Odd"])]
    assert got[2]["table_data"] == {"headers": ["a", "b"], "rows": [["1", "2"]], "caption": ""}


def pptx():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda t, kind: f'<p:sp><p:nvSpPr><p:nvPr>{f"""<p:ph type="{kind}"/>""" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda *s: f"<p:sld {ns}>{''.join(s)}</p:sld>"
    show = f'<p:presentation {ns} {RID}><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:presentation>'
    rels = f'<Relationships {REL}><Relationship Id="r1" Target="slides/s1.xml"/><Relationship Id="r2" Target="slides/s2.xml"/></Relationships>'
    return _zip(**{"ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/s1.xml": slide(), "ppt/slides/s2.xml": slide(shape("Head", "title"), shape("Point", ""))})


def test_pptx():
    got = list(files.pptx_file("x.pptx", pptx()))
    assert [(s["text"], s["heading"]) for s in got] == [("Point", "Head"), ("", "Slide 2")]


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = f'<workbook {ns} {RID}><sheets><sheet name="S" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>'
    rels = f'<Relationships {REL}><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>'
    return _zip(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": f"<sst {ns}><si><t>sh</t></si></sst>", "xl/worksheets/a.xml": sheet, "xl/worksheets/b.xml": f"<worksheet {ns}/>"})


def test_xlsx():
    got = list(files.xlsx_file("x.xlsx", xlsx()))
    assert [s["table_data"] for s in got] == [{"headers": ["sh", "", "in"], "rows": [["", "2.5", ""]], "caption": "S"}]


def test_parse_files_of_all_kinds(spark, tmp_path):
    contents = {
        "a.txt": b"one\n\ntwo",
        "b.MD": b"# H\nbody",
        "c.csv": "\ufeffName,Age\nAnn, 3 \n,\nBob\n".encode(),
        "d.json": '{"k": "\u00e9"}'.encode(),
        "e.xml": b"<r>head<c>in</c>tail</r>",
        "f.html": b"<h1>T</h1><p>x",
        "g.epub": _zip(**{"b.xhtml": "<p>second</p>", "a.html": "<style>s</style><p>first</p>", "x.css": "no"}),
        "h.docx": docx(),
        "i.pptx": pptx(),
        "j.xlsx": xlsx(),
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = files.parse_files(files.read_files(spark, str(tmp_path))).orderBy("source", "section_ord").collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert set(by) == set(contents)
    assert [r.text for r in by["a.txt"]] == ["one", "two"]
    assert by["b.MD"][0].heading == "H"
    assert by["c.csv"][0].table_data.rows == [["Ann", "3"], ["Bob"]] and by["c.csv"][0].heading == "c"
    assert by["d.json"][0].text == '{\n  "k": "\\u00e9"\n}'
    assert by["e.xml"][0].text == "head\nin\ntail"
    assert [r.text for r in by["g.epub"]] == ["s first", "second"] and by["g.epub"][0].metadata["epub_file"] == "a.html"
    (tmp_path / "z.xyz").write_bytes(b"?")
    with pytest.raises(ValueError, match="xyz"):
        files.parse_files(files.read_files(spark, str(tmp_path)))


def test_own_format(spark, tmp_path):
    (tmp_path / "q.own").write_bytes(b"abc")
    files.register(".own", lambda df: plain.as_sections(df, text=F.upper(F.decode("content", "UTF-8"))))
    try:
        assert files.parse_files(files.read_files(spark, str(tmp_path))).first().text == "ABC"
    finally:
        files._OWN.clear()


def test_words_and_sentences(spark):
    df = spark.createDataFrame([("\u00c9t\u00e9 a_b \u00bd x\u00b2! Is it? yes.no  end",)], "t string")
    got = df.select(T.words(F.col("t")).alias("w"), T.sentences(F.col("t")).alias("s"), T.word_count(F.col("t")).alias("n")).first()
    assert got.w == ["\u00e9t\u00e9", "a_b", "\u00bd", "x\u00b2", "is", "it", "yes", "no", "end"] and got.n == 9
    assert got.s == ["\u00c9t\u00e9 a_b \u00bd x\u00b2!", "Is it?", "yes.no  end"]


def test_names(spark):
    df = spark.createDataFrame([("/a/b/c.tar.GZ",), (".hidden",), ("plain",)], "p string")
    got = df.select(T.file_name(F.col("p")).alias("n"), T.file_suffix(F.col("p")).alias("x"), T.file_stem(F.col("p")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("c.tar.GZ", ".gz", "c.tar"), (".hidden", "", ".hidden"), ("plain", "", "plain")]


def small_pdf(*pages, packed=True):
    import zlib

    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} >>"]
    parts = [o.encode() for o in objects]
    for k, content in enumerate(pages):
        data = zlib.compress(content) if packed else content
        parts.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>".encode())
        parts.append(f"<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n".encode() + p + b"\nendobj\n" for k, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = (b"BT /F1 12 Tf 72 700 Td (# Head) Tj 0 -14 Td [(Some) -300 (te) 20 (xt \\(here\\))] TJ ET", b"BT 72 700 Td (Second p\\351ge) Tj T* <4142> Tj ET")


def test_pdf_pages():
    from vellumspark.sources import pdf

    for packed in (True, False):
        assert pdf.pages(small_pdf(*PAGES, packed=packed)) == ["# Head\nSome text (here)", "Second p\u00e9ge\nAB"]
    assert pdf.pages(small_pdf()) == []
    with pytest.raises(ValueError):
        pdf.pages(b"no such file")


def test_pdf_files_are_sections(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(small_pdf(*PAGES))
    (tmp_path / "b.PDF").write_bytes(small_pdf(b"BT (| a | b |) Tj T* (| --- | --- |) Tj T* (| 1 | 2 |) Tj ET"))
    rows = files.parse_files(files.read_files(spark, str(tmp_path))).orderBy("source", "section_ord").collect()
    assert [(r.source, r.page, r.heading, r.content_type) for r in rows] == [("a.pdf", 1, "Head", "text"), ("a.pdf", 2, None, "text"), ("b.PDF", 1, None, "table")]
    assert rows[0].text == "Some text (here)" and rows[2].table_data.rows == [["1", "2"]]
    files.register(".pdf", files.pdf_branch(lambda data: ["# Own\nfrom a tool"]))
    try:
        assert {r.text for r in files.parse_files(files.read_files(spark, str(tmp_path))).collect()} == {"from a tool"}
    finally:
        files._OWN.pop(".pdf")


def test_sections_of_many_documents_leave_in_few_batches(spark):
    kind = to_arrow_schema(StructType.fromDDL(schemas.SECTIONS))
    every = pa.RecordBatch.from_pylist([{"doc_id": k, "source": f"{k}.json", "content": b'{"a": [1, null]}'} for k in range(5000)])
    got = list(files.section_batches(files.json_file, iter([every.slice(0, 4000), every.slice(4000)]), kind))
    assert len(got) == 3 and max(map(len, got)) == files.BATCH_ROWS
    assert [d for b in got for d in b.column(0).to_pylist()] == list(range(5000))
    assert got[2].column("metadata").to_pylist()[-1] == [("source", "4999.json")] and got[2].column("page")[0].as_py() is None


def test_ids_of_parsed_documents_stay_exact_beside_a_null(spark):
    # as floating-point numbers, which a column with a null became, these two ids are one
    rows = [(2**53, "a.json", "1"), (2**53 + 1, "b.json", "2"), (None, "c.json", "3"), (4, None, "{}")]
    df = spark.createDataFrame(rows, "doc_id long, source string, content string").coalesce(1).where("source is not null")
    got = files.parse_with(files.json_file, df.withColumn("content", F.encode("content", "UTF-8"))).collect()
    assert sorted((r.source, r.doc_id, r.text) for r in got) == [("a.json", 2**53, "1"), ("b.json", 2**53 + 1, "2"), ("c.json", None, "3")]


def test_long_pages_end_a_batch_by_their_characters(spark, monkeypatch):
    monkeypatch.setattr(files, "BATCH_CHARS", 1000)
    kind = to_arrow_schema(StructType.fromDDL(schemas.SECTIONS))
    every = pa.RecordBatch.from_pylist([{"doc_id": k, "source": "u", "content": f"<h1>T{k}</h1>" + "<p>" + "x" * 300 + "<p>y"} for k in range(6)])
    got = list(files.section_batches(files.html_file, iter([every]), kind))
    assert [len(b) for b in got] == [7, 5]
    assert [(d, o) for b in got for d, o in zip(b.column("doc_id").to_pylist(), b.column("section_ord").to_pylist(), strict=True)] == [(k, o) for k in range(6) for o in (0, 1)]
