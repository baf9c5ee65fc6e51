"""Markdown: headings with their hierarchy, and table blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import tables
from vellumspark.sources.plain import as_sections

_HEADING = r"(?md)^(#{1,6})\s+(.+?)(?:\s+#*)?$"
_START, _MID, _END = "\u0001", "\u0002", "\u0003"


def heading_stacks(headings: Column, include_self: bool = False) -> Column:
    """For an array of struct(level, title): for each, the titles above it (or with itself), outermost first.

    A stack's levels rise, so taking off all that aren't above a new heading is filtering by level.
    """
    entry = "struct<level:int,title:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        above = F.filter(acc["stack"], lambda x: x["level"] < h["level"])
        now = F.concat(above, F.array(F.struct(h["level"].cast("int").alias("level"), h["title"].alias("title"))))
        shown = F.transform(now if include_self else above, lambda x: x["title"])
        return F.struct(now.alias("stack"), F.concat(acc["out"], F.array(shown)).alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])


def _split(text: Column) -> tuple[Column, Column]:
    """(text before the first heading, array of struct(level, title, body))."""
    # one left-to-right replacement marks headings, as the pattern may reach over a line's end
    marked = F.regexp_replace(F.translate(text, _START + _MID + _END, ""), _HEADING, f"{_START}$1{_MID}$2{_END}")
    parts = F.split(marked, _START)

    def heading(p: Column) -> Column:
        return F.struct(F.length(F.substring_index(p, _MID, 1)).alias("level"), T.strip(F.substring_index(F.substring_index(p, _END, 1), _MID, -1)).alias("title"), T.strip(F.regexp_replace(p, f"(?s)^[^{_END}]*{_END}", "")).alias("body"))

    return T.strip(parts[0]), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), heading)


def markdown_sections(docs: DataFrame, page: Column | None = None, include_self: bool = False) -> DataFrame:
    """A section for each heading, and one for what comes before the first. docs: doc_id, source, text.

    A heading without a body has its title as text. Fenced code is not told apart from text.
    """
    before, found = _split(T.unix_newlines(F.col("text")))
    rows = docs.withColumn("_before", before).withColumn("_found", found)
    rows = rows.withColumn("_above", heading_stacks(F.col("_found"), include_self))
    own = F.transform(F.arrays_zip("_found", "_above"), lambda z: F.struct(F.coalesce(T.nonempty(z["_found"]["body"]), z["_found"]["title"]).alias("text"), z["_found"]["title"].alias("heading"), z["_found"]["level"].alias("level"), z["_above"].alias("above")))
    lead = F.array(F.struct(F.col("_before").alias("text"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("above")))
    every = F.concat(F.when(F.col("_before") != "", lead).otherwise(F.slice(lead, 1, 0)), own)
    page = F.lit(None) if page is None else page
    rows = rows.select("doc_id", "source", page.cast("int").alias("_page"), F.posexplode(every).alias("ord", "s"))
    return as_sections(rows, section_ord=F.col("ord"), text=F.col("s.text"), heading=F.col("s.heading"), level=F.col("s.level"), parent_headings=F.col("s.above"), page=F.col("_page"))


def table_blocks(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, block, kind, text, table_data): runs of lines that do or don't start and end with a pipe. docs: keys, text.

    A run of one such line is text. Blocks count from 0.
    """
    rows = docs.select(*keys, F.posexplode(T.lines(F.col("text"))).alias("n", "line")).withColumn("trimmed", T.strip(F.col("line")))
    rows = rows.withColumn("is_row", F.col("trimmed").startswith("|") & F.col("trimmed").endswith("|"))
    order = Window.partitionBy(*keys).orderBy("n")
    change = F.coalesce((F.col("is_row") != F.lag("is_row").over(order)).cast("int"), F.lit(0))
    rows = rows.withColumn("change", change).withColumn("block", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    shown = F.when(F.col("is_row"), F.col("trimmed")).otherwise(F.col("line"))
    blocks = rows.groupBy(*keys, "block", "is_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", shown.alias("line")))), lambda x: x["line"]).alias("ls"))
    is_table = F.col("is_row") & (F.size("ls") >= 2)
    return blocks.select(*keys, "block", F.when(is_table, "table").otherwise("text").alias("kind"), F.array_join("ls", "\n").alias("text"), F.when(is_table, tables.from_markdown_lines(F.col("ls"))).alias("table_data"))


def page_sections(pages: DataFrame) -> DataFrame:
    """Sections of paged Markdown, as extracted from a PDF: headings restart on every page, tables are sections.

    pages: doc_id, source, page, text, figures (may be null): a page's figures go with every section of it.
    """
    base = markdown_sections(pages.withColumn("text", T.strip(F.col("text"))), page=F.col("page"))
    blocks = table_blocks(base.select("doc_id", "page", "section_ord", "text"), ("doc_id", "page", "section_ord"))
    blocks = blocks.withColumnRenamed("text", "b_text").withColumnRenamed("table_data", "b_table")
    rows = base.drop("figures", "table_data").join(blocks, ["doc_id", "page", "section_ord"])
    rows = rows.join(pages.select("doc_id", "page", "figures"), ["doc_id", "page"])
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "section_ord", "block")) - 1
    rows = rows.withColumn("ord", ordinal)
    kept = {k: F.col(k) for k in ("heading", "level", "page", "parent_headings", "metadata")}
    return as_sections(rows, **kept, section_ord=F.col("ord"), content_type=F.col("kind"), table_data=F.col("b_table"), figures=F.coalesce("figures", F.array()), text=F.col("b_text"))
