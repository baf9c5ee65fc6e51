"""Schemas of sections, tables and figures."""

from __future__ import annotations

TABLE = "struct<headers:array<string>,rows:array<array<string>>,caption:string>"
FIGURE = "struct<image_path:string,caption:string,page:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
#: What a parser yields for each section, after the document's own columns.
SECTION_FIELDS = {
    "section_ord": "int",
    "text": "string",
    "heading": "string",
    "level": "int",
    "page": "int",
    "parent_headings": "array<string>",
    "content_type": "string",
    "table_data": TABLE,
    "figures": f"array<{FIGURE}>",
    "metadata": "map<string,string>",
}
SECTIONS = "doc_id long, source string, " + ", ".join(f"{k} {v}" for k, v in SECTION_FIELDS.items())
