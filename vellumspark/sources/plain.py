"""Plain text and tag-stripped HTML as sections, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark import schemas
from vellumspark.functions import text as T


def as_sections(df: DataFrame, **fields: Column) -> DataFrame:
    """The columns of a section; those not given are empty. df has doc_id and source."""
    defaults = {
        "section_ord": F.lit(0),
        "heading": F.lit(None),
        "level": F.lit(0),
        "page": F.lit(None),
        "parent_headings": F.array(),
        "content_type": F.lit("text"),
        "table_data": F.lit(None),
        "figures": F.array(),
        "metadata": F.create_map(F.lit("source"), F.col("source")),
    }
    return df.select("doc_id", "source", *[(fields.get(k, defaults.get(k))).cast(t).alias(k) for k, t in schemas.SECTION_FIELDS.items()])


def text_sections(docs: DataFrame) -> DataFrame:
    """Blocks between blank lines, white space folded, empty ones left out. docs: doc_id, source, text."""
    blocks = F.filter(F.transform(F.split(T.unix_newlines(F.col("text")), "\n{2,}"), T.collapse), lambda b: b != "")
    rows = docs.select("doc_id", "source", F.posexplode(blocks).alias("ord", "block"))
    return as_sections(rows, section_ord=F.col("ord"), text=F.col("block"))


def html_plain_text(html: Column) -> Column:
    """Tags become blanks and white space is folded; scripts and entities stay as they are."""
    return T.collapse(F.regexp_replace(html, "<[^>]+>", " "))


def html_plain_sections(docs: DataFrame) -> DataFrame:
    """One section a page, for trees that aren't wanted. docs: doc_id, source, text."""
    return as_sections(docs, text=html_plain_text(F.col("text")))
