"""Tables as Markdown, as sentences, and from Markdown lines. A table is struct(headers, rows, caption)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions import text as T


def _headers(table: Column, prefix: str) -> Column:
    """The headers, or numbered ones for the first row's cells."""
    width = F.coalesce(F.size(F.get(table["rows"], F.lit(0))), F.lit(0))
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(width, F.lit(0))), lambda i: i > 0)
    made = F.transform(numbers, lambda i: F.concat(F.lit(prefix), i.cast("string")))
    return F.when(F.size(table["headers"]) > 0, table["headers"]).otherwise(F.when(F.size(table["rows"]) > 0, made).otherwise(F.array().cast("array<string>")))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def to_markdown(table: Column) -> Column:
    """A Markdown table under its caption; cells are cut or filled up to the headers' number; empty without any cell."""
    headers = _headers(table, "Col ")
    fill: Callable[[Column], Column] = lambda row: F.transform(headers, lambda _, i: F.coalesce(F.get(row, i), F.lit("")))
    body = F.concat(F.array(_line(headers), _line(F.transform(headers, lambda _: F.lit("---")))), F.transform(table["rows"], lambda row: _line(fill(row))))
    caption = F.when(F.coalesce(table["caption"], F.lit("")) != "", F.concat(F.lit("**Table: "), table["caption"], F.lit("**\n\n"))).otherwise("")
    return F.when((F.size(table["headers"]) == 0) & (F.size(table["rows"]) == 0), F.lit("")).otherwise(F.concat(caption, F.array_join(body, "\n")))


def to_text(table: Column) -> Column:
    """Rows as "header: cell" lists for search; the caption alone where there are no rows."""
    headers = _headers(table, "Field_")

    def sentence(row: Column) -> Column:
        paired = F.transform(headers, lambda h, i: F.when(T.strip(F.get(row, i)) != "", F.concat(h, F.lit(": "), F.get(row, i))))
        return F.array_join(F.filter(paired, lambda p: p.isNotNull()), ", ")

    lead = F.when(F.coalesce(table["caption"], F.lit("")) != "", F.array(F.concat(F.lit("Table ("), table["caption"], F.lit("):")))).otherwise(F.array().cast("array<string>"))
    items = F.concat(lead, F.filter(F.transform(table["rows"], sentence), lambda s: s != ""))
    return F.when(F.size(table["rows"]) == 0, F.coalesce(table["caption"], F.lit(""))).otherwise(F.array_join(items, " | "))


def from_markdown_lines(lines: Column) -> Column:
    """Header line, a separator that is skipped, and rows with any cell."""
    cells: Callable[[Column], Column] = lambda line: F.transform(F.slice(F.split(line, r"\|"), F.lit(2), F.greatest(F.size(F.split(line, r"\|")) - 2, F.lit(0))), T.strip)
    rows = F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), cells)
    return F.struct(cells(lines[0]).alias("headers"), F.filter(rows, lambda r: F.exists(r, lambda c: c != "")).alias("rows"), F.lit("").alias("caption"))
