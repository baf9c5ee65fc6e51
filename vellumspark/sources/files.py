"""Files of many formats as sections: a branch for each format over binaryFile, joined by union.

Text and Markdown stay in built-in expressions. The others need a parser of their own, all from the standard library,
and run in mapInArrow. PDF pages are read by pdf.pages(), or by a layout tool that writes Markdown (pdf_branch()).
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellumspark import schemas
from vellumspark.functions import text as T
from vellumspark.sources import markdown, pdf, plain

# --- sections in Python ---------------------------------------------------------------------------------------


def _stem(name: str) -> str:
    return name[: name.rindex(".")] if "." in name[1:] else name


def _table(headers: list[str], rows: list[list[str]], caption: str = "") -> dict:
    return {"headers": headers, "rows": rows, "caption": caption}


def table_text(table: dict) -> str:
    """A table's Markdown, as tables.to_markdown writes it."""
    headers = table["headers"] or [f"Col {k}" for k in range(1, 1 + (len(table["rows"][0]) if table["rows"] else 0))]
    if not table["headers"] and not table["rows"]:
        return ""
    wide = len(headers)
    grid = [headers, ["---"] * wide, *[(row + [""] * wide)[:wide] for row in table["rows"]]]
    lead = f"**Table: {table['caption']}**\n\n" if table["caption"] else ""
    return lead + "\n".join("| " + " | ".join(cells) + " |" for cells in grid)


def _section(text: str, **more: object) -> dict:
    base = {"text": text, "heading": None, "level": 0, "page": None, "parent_headings": [], "content_type": "text", "table_data": None, "figures": [], "metadata": {}}
    return base | more


class _Outline:
    """The headings in force. They name themselves among the parents, which doubles a breadcrumb's tail."""

    def __init__(self) -> None:
        self.held: list[tuple[int, str]] = []

    def enter(self, level: int, title: str) -> None:
        self.held = [h for h in self.held if h[0] < level] + [(level, title)]

    def place(self) -> dict:
        level, heading = self.held[-1] if self.held else (0, None)
        return {"heading": heading, "level": level, "parent_headings": [t for _, t in self.held]}


def csv_file(name: str, data: bytes) -> Iterator[dict]:
    """The first row as headers, blank rows left out, ragged ones kept."""
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""))]
    if rows:
        table = _table(rows[0], [r for r in rows[1:] if any(r)], name)
        yield _section(table_text(table), heading=_stem(name), level=1, content_type="table", table_data=table)


def json_file(name: str, data: bytes) -> Iterator[dict]:
    yield _section(json.dumps(json.loads(data.decode()), indent=2), heading=_stem(name), level=1)


def xml_file(name: str, data: bytes) -> Iterator[dict]:
    """Text of the elements in order of their start tags; an element's tail comes ahead of its children's text."""
    said = (t.strip() for e in ElementTree.fromstring(data).iter() for t in (e.text, e.tail) if t)
    yield _section("\n".join(t for t in said if t), heading=_stem(name), level=1)


class _HtmlSections(HTMLParser):
    """Paragraphs, tables and images of the body under their headings.

    A block element's tag closes an open paragraph, which HTML allows to be left open. Text of inline elements is joined
    without blanks; text outside of headings, paragraphs and tables is left out.
    """

    _BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul body html li".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[dict] = []
        self.outline = _Outline()
        self.open: str | None = None
        self.said: list[str] = []
        self.silent = 0
        self.table: dict | None = None
        self.depth = 0
        self.row: list[str] | None = None
        self.cell: tuple[str, list[str]] | None = None

    def _text(self) -> str:
        text, self.said = "".join(s.strip() for s in self.said), []
        return text

    def finish(self) -> None:
        """End the open heading or paragraph."""
        if self.open is None:
            return
        kind, self.open = self.open, None
        text = self._text()
        if text and kind == "p":
            self.sections.append(_section(text, **self.outline.place()))
        elif text:
            self.outline.enter(int(kind[1]), text)

    def _end_cell(self) -> None:
        if self.cell is None or self.table is None:
            return
        (kind, said), self.cell = self.cell, None
        text = "".join(s.strip() for s in said)
        if kind == "th":
            self.table["headers"].append(text)
        elif kind == "caption":
            self.table["caption"] = self.table["caption"] or text
        elif self.row is not None:
            self.row.append(text)

    def _end_row(self) -> None:
        self._end_cell()
        if self.table is not None and self.row:
            self.table["rows"].append(self.row)
        self.row = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "head", "title", "template"):
            self.silent += tag not in ("head",)
            return
        if tag == "body":
            self.silent = 0
        if tag in self._BLOCK:
            self.finish()
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.table = _table([], [])
        elif self.table is not None and tag == "tr":
            self._end_row()
            self.row = []
        elif self.table is not None and tag in ("td", "th", "caption"):
            self._end_cell()
            self.cell = (tag, [])
        elif tag == "p" or re.fullmatch("h[1-6]", tag):
            self.open, self.said = tag, []
        elif tag == "img":
            found = {k: v or "" for k, v in attrs}
            source, caption = found.get("src", ""), found.get("alt", "") or found.get("title", "")
            if source or caption:
                figure = {"image_path": source, "caption": caption, "page": None, "bbox": None}
                self.sections.append(_section(f"Figure: {caption}" if caption else f"Image: {source}", **self.outline.place(), content_type="figure", figures=[figure]))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "title", "template"):
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self._end_row()
                table, self.table = self.table, None
                if table and (table["headers"] or table["rows"]):
                    self.sections.append(_section(table_text(table), **self.outline.place(), content_type="table", table_data=table))
        elif self.table is not None and tag == "tr":
            self._end_row()
        elif self.table is not None and tag in ("td", "th", "caption"):
            self._end_cell()
        elif tag == self.open or (self.open and tag in self._BLOCK and tag != "p"):
            self.finish()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.cell is not None:
            self.cell[1].append(data)
        elif self.open is not None:
            self.said.append(data)


def html_file(name: str, data: bytes | str) -> Iterator[dict]:
    parser = _HtmlSections()
    parser.feed(data if isinstance(data, str) else data.decode("utf-8", "replace"))
    parser.close()
    parser.finish()
    yield from parser.sections


class _AllText(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.said: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.said.append(data.strip())


def epub_file(name: str, data: bytes) -> Iterator[dict]:
    """A section for each page of the book, by the pages' names, with all their text."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        for member in sorted(n for n in book.namelist() if re.search(r"\.x?html?$", n, re.I)):
            parser = _AllText()
            parser.feed(book.read(member).decode("utf-8", "ignore"))
            text = " ".join(parser.said)
            if text.strip():
                yield _section(text, heading=_stem(member.rsplit("/", 1)[-1]), level=1, metadata={"epub_file": member})


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _word_text(node: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(e.text or "" if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in node.iter())


def docx_file(name: str, data: bytes) -> Iterator[dict]:
    """Paragraphs and tables of the body; styles named "heading N" (N not a number: 1) set the outline."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in parts.namelist():
            for s in ElementTree.fromstring(parts.read("word/styles.xml")).iter(f"{_W}style"):
                title = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = title.get(f"{_W}val") if title is not None else ""
    outline = _Outline()
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            text = _word_text(node).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            named = "" if style is None else styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")).lower()
            if not text:
                continue
            if named.startswith("heading"):
                level = named.removeprefix("heading").strip()
                outline.enter(int(level) if level.isdigit() else 1, text)
            else:
                yield _section(text, **outline.place())
        elif node.tag == f"{_W}tbl":
            rows = [["\n".join(_word_text(p) for p in c.iter(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                table = _table(rows[0], rows[1:])
                yield _section(table_text(table), **outline.place(), content_type="table", table_data=table)


def _related(parts: zipfile.ZipFile, of: str) -> dict[str, str]:
    """Targets of a part's relations by id, as names in the archive."""
    folder, _, own = of.rpartition("/")
    path = f"{folder}/_rels/{own}.rels"
    if path not in parts.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(parts.read(path)):
        target = r.get("Target", "")
        out[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
    return out


def pptx_file(name: str, data: bytes) -> Iterator[dict]:
    """A section for each slide, in the show's order: its paragraphs but the title; slides without text have one too."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        related = _related(parts, "ppt/presentation.xml")
        show = ElementTree.fromstring(parts.read("ppt/presentation.xml"))
        for k, slide in enumerate(show.iter(f"{_P}sldId")):
            tree = ElementTree.fromstring(parts.read(related[slide.get(f"{_R}id")]))
            title, said = "", []
            for shape in tree.iter(f"{_P}sp"):
                paragraphs = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in shape.iter(f"{_A}p")]
                kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                if not title and kind is not None and kind.get("type") in ("title", "ctrTitle"):
                    title = "\n".join(paragraphs).strip()
                said += paragraphs
            text = "\n".join(p for p in said if p and p != title)
            yield _section(text, heading=title or f"Slide {k + 1}", level=1, metadata={"slide_index": str(k)})


def xlsx_file(name: str, data: bytes) -> Iterator[dict]:
    """A table for each sheet with any cell: values as they are stored, the first row as headers."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        shared = []
        if "xl/sharedStrings.xml" in parts.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        related = _related(parts, "xl/workbook.xml")
        for sheet in ElementTree.fromstring(parts.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            grid: dict[int, dict[int, str]] = {}
            for r, row in enumerate(ElementTree.fromstring(parts.read(related[sheet.get(f"{_R}id")])).iter(f"{_S}row")):
                for c, cell in enumerate(row.iter(f"{_S}c")):
                    letters = re.match("[A-Z]+", cell.get("r", ""))
                    column = c
                    if letters:
                        column = 0
                        for x in letters[0]:
                            column = column * 26 + ord(x) - 64
                        column -= 1
                    value = cell.find(f"{_S}v")
                    text = "" if value is None else value.text or ""
                    kind = cell.get("t")
                    if kind == "s" and text:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                    elif kind == "b":
                        text = "True" if text == "1" else "False"
                    grid.setdefault(r, {})[column] = text.strip()
            wide = max((max(r, default=-1) for r in grid.values()), default=-1) + 1
            rows = [[grid[r].get(c, "") for c in range(wide)] for r in sorted(grid)]
            rows = [r for r in rows if any(r)]
            if rows:
                table = _table(rows[0], rows[1:], sheet.get("name"))
                yield _section(table_text(table), heading=sheet.get("name"), level=1, content_type="table", table_data=table, metadata={"sheet_name": sheet.get("name")})


PARSERS: dict[str, Callable[[str, bytes], Iterator[dict]]] = {
    ".csv": csv_file,
    ".json": json_file,
    ".xml": xml_file,
    ".html": html_file,
    ".htm": html_file,
    ".epub": epub_file,
    ".docx": docx_file,
    ".pptx": pptx_file,
    ".xlsx": xlsx_file,
}
TEXT_SUFFIXES = (".txt", ".text", ".log")
MARKDOWN_SUFFIXES = (".md", ".markdown", ".mdx")
#: Branches added by register(): suffix to a function of (doc_id, source, content) giving sections.
_OWN: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(suffix: str, branch: Callable[[DataFrame], DataFrame]) -> None:
    """A format of the caller's own, in place of a built-in one of the same suffix."""
    _OWN[suffix.lower()] = branch


def supported() -> set[str]:
    return {*PARSERS, *TEXT_SUFFIXES, *MARKDOWN_SUFFIXES, ".pdf", *_OWN}


def pdf_branch(pages: Callable[[bytes], list[str]] = pdf.pages) -> Callable[[DataFrame], DataFrame]:
    """A branch for PDF files by a function of a file's bytes that gives its pages' Markdown; to be registered for ".pdf"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc_id, source, k, text) for doc_id, source, content in batch.itertuples(index=False) for k, text in enumerate(pages(content), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "page", "text"])

    def branch(docs: DataFrame) -> DataFrame:
        read = docs.select("doc_id", "source", "content").mapInPandas(run, "doc_id long, source string, page int, text string")
        return markdown.page_sections(read.withColumn("figures", F.lit(None).cast(schemas.SECTION_FIELDS["figures"])))

    return branch


# --- in Spark -------------------------------------------------------------------------------------------------


#: Sections and characters that a parser's batch of results ends at, and documents that are taken out of Arrow at a time.
BATCH_ROWS, BATCH_CHARS, TAKEN = 2048, 8 << 20, 256


def section_batches(parser: Callable[[str, bytes], Iterator[dict]], batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sections of batches of (doc_id, source, content), many documents to a batch: one for each costs more than its parsing."""

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kind], schema=kind)

    rows, chars = [], 0
    for batch in batches:
        for low in range(0, len(batch), TAKEN):
            for doc_id, source, content in zip(*(c.to_pylist() for c in batch.slice(low, TAKEN).columns), strict=True):
                for k, s in enumerate(parser(source, content)):
                    rows.append({"doc_id": doc_id, "source": source, "section_ord": k} | s | {"metadata": [*({"source": source} | s["metadata"]).items()]})
                    chars += len(s["text"])
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield batch_of(rows)
                        rows, chars = [], 0
    if rows:
        yield batch_of(rows)


def parse_with(parser: Callable[[str, bytes], Iterator[dict]], docs: DataFrame) -> DataFrame:
    """Sections of documents (doc_id, source, content) by a parser of single files."""
    kind = to_arrow_schema(StructType.fromDDL(schemas.SECTIONS))
    return docs.select("doc_id", "source", "content").mapInArrow(lambda batches: section_batches(parser, batches, kind), schemas.SECTIONS)


def _by_suffix(name: str, data: bytes) -> Iterator[dict]:
    return PARSERS[name[name.rindex(".") :].lower()](name, data)


def html_sections(docs: DataFrame) -> DataFrame:
    """Sections of HTML texts (doc_id, source, text)."""
    return parse_with(html_file, docs.withColumnRenamed("text", "content"))


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, source, path, suffix, content). The id is a hash of the path; a path that isn't there fails."""
    found = spark.read.format("binaryFile").load(list(paths))
    return found.select(F.xxhash64("path").alias("doc_id"), T.file_name(F.col("path")).alias("source"), "path", T.file_suffix(F.col("path")).alias("suffix"), "content")


def parse_files(found: DataFrame) -> DataFrame:
    """Sections of files, each by its suffix; a suffix that nobody parses fails the query before it runs."""
    suffixes = {r["suffix"] for r in found.select("suffix").distinct().collect()}
    if unknown := suffixes - supported():
        raise ValueError(f"no parser for {', '.join(sorted(unknown))}")
    parts = []

    def branch(own: set[str], parse: Callable[[DataFrame], DataFrame]) -> None:
        if own & suffixes:
            parts.append(parse(found.where(F.col("suffix").isin(*sorted(own & suffixes)))))

    def as_text(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "source", F.decode("content", "UTF-8").alias("text"))

    # one branch for all that Python parses, so that the files are read no more than three times
    branch(set(TEXT_SUFFIXES) - set(_OWN), lambda df: plain.text_sections(as_text(df)))
    branch(set(MARKDOWN_SUFFIXES) - set(_OWN), lambda df: markdown.markdown_sections(as_text(df)))
    branch(set(PARSERS) - set(_OWN), lambda df: parse_with(_by_suffix, df))
    for suffix, own in ({".pdf": pdf_branch()} | _OWN).items():
        branch({suffix}, own)
    out = parts[0] if parts else plain.text_sections(found.select("doc_id", "source", F.lit("").alias("text")))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
