"""Column functions on text. All are built-in expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as Java's regular expressions name it.
_WS = r"(?U)\s"
#: A word: letters, digits and _ of any script. \w alone is ASCII here.
WORD = r"[\p{L}\p{N}_]+"
#: Ends of lines as text editors know them.
_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


#: The characters that _WS matches, for functions that take a set of them.
_BLANKS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind, in two steps from the ends; a pattern would look at every blank."""
    return F.btrim(text, F.lit(_BLANKS))


def collapse(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{_WS}+", " "))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def words(text: Column) -> Column:
    """Lower-case words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows . ! or ?, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?]){_WS}+"), strip), lambda s: s != "")


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one isn't a line."""
    split = F.split(text, _LINE_END)
    return F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """Lower-case, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def nonempty(text: Column) -> Column:
    """null for an empty string."""
    return F.nullif(text, F.lit(""))
