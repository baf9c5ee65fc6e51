"""Site template removal from web pages: subtrees that recur across many pages of a host go, the rest becomes text.

Every element's subtree has a hash made of its tag, its attributes, its text (blanks folded) and its children's hashes.
Spark counts, by host, on how many distinct pages each hash occurs: pages of one payload are one page, and so are pages of
one url. A subtree is a template where that is at least `min_pages` and at least `min_share` of the host's distinct pages;
the outermost template subtrees of a page are deleted. html, head, body and void elements are never templates themselves,
and an inline element stays where the block that holds it stays and has words of its own. What is left of the body is
written as text: block elements end lines, blanks are folded, entities are decoded; script, style, template and noscript
have no text.

A page is parsed once, from left to right in time proportional to its length: what comes out is its pieces of text and, for
each element, its hash and the pieces it spans. That is saved; counting reads the hashes, deletion the rest.

The parser follows HTML's habits as far as text needs: void elements, script and style as raw text, comments, omitted
end tags of p, li, dt, dd, option, tr, td and th, end tags without a start ignored, elements left open closed at the end.

Templates are broadcast while they are at most `broadcast_templates` (8 bytes each); more of them are joined to the pages
through the pages' own hashes. Both give the same rows.

Defined results: a null or empty page has empty text. A null url, or one without a host, has no host, and nothing of
such a page is removed. Host names don't depend on case; ports and users don't count. Null ids and repeated rows are pages
like any other, one result each. Pages are taken whole at any depth. Extra columns are ignored. No pages give no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_PAGES = 3
MIN_SHARE = 0.1
BROADCAST_TEMPLATES = 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title"))
_SILENT = frozenset(("script", "style", "noscript", "template", "head", "title"))
_KEPT = frozenset(("html", "head", "body"))
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes these open elements, if no element of the second set lies between.
_CLOSES = {t: (frozenset(("p",)), frozenset(("table", "button"))) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_CLOSES |= {
    "li": (frozenset(("li", "p")), frozenset(("ul", "ol"))),
    "dt": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th", "p")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "p")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th", "p")), frozenset(("tr", "table"))),
}
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")


#: Kinds of elements.
_OTHER, _IS_BLOCK, _IS_SILENT = 0, 1, 2
_KIND = {tag: _IS_BLOCK for tag in _BLOCK} | {tag: _IS_SILENT for tag in _SILENT}
_OWNERLESS = -1


@dataclass
class Page:
    """A parsed page. tokens: texts (decoded, blanks folded) and line ends, in order, and the element that holds each.

    By element, in the order in which they start: tag, digest, parent, kind, and the tokens [start, end) that it spans, its
    own line ends included. Element 0 is the page itself.
    """

    tokens: list[str]
    owner: list[int]
    tag: list[str]
    digest: list[int]
    parent: list[int]
    kind: list[int]
    start: list[int]
    end: list[int]


#: What swallows the rest of a page that doesn't close it.
_OPEN_END = re.compile(r"<!--|<!\[CDATA\[")


def parse(page: str) -> Page:
    tokens, owner, tags, digests, parents, kinds, starts, ends = [], [], ["#root"], [0], [_OWNERLESS], [_OTHER], [0], [0]
    parts: list[list[str]] = [[]]  # of each open element: what its hash is made of
    stack = [0]
    depths: defaultdict[str, list[int]] = defaultdict(list)  # the depths at which each tag is open, ascending
    silent = 0  # open elements without text
    at, stop = 0, page.rfind(">") + 1

    def add(text: str) -> None:
        folded = _BLANKS.sub(" ", text)
        parts[-1].append("\0" + folded)
        if not silent:
            tokens.append(_BLANKS.sub(" ", html.unescape(text)) if "&" in text else folded)
            owner.append(stack[-1])

    def close_to(depth: int) -> None:
        nonlocal silent
        while len(stack) > depth:
            own = stack[-1]
            kind, tag = kinds[own], tags[own]
            if kind == _IS_SILENT:
                silent -= 1
            elif (kind == _IS_BLOCK or tag == "br") and not silent:
                tokens.append("\n")
                owner.append(own)
            stack.pop()
            depths[tag].pop()
            ends[own] = len(tokens)
            digest = digests[own] = xxhash.xxh3_64_intdigest("".join(parts.pop()).encode("utf-8", "surrogatepass"))
            parts[-1].append(f"\1{digest:x}")

    while match := _TOKEN.search(page, at, stop):
        first, last = match.span()
        if first > at:
            add(page[at:first])
        at = last
        end, tag, attributes, end_2, tag_2, attributes_2 = match.groups()
        if tag is None:
            end, tag, attributes = end_2, tag_2, attributes_2
            if tag is None:
                if page.startswith("<![CDATA[", first):
                    if not page.endswith("]]>", first, last):
                        at = len(page)
                    add(page[first + 9 : at].removesuffix("]]>"))
                elif page.startswith("<!--", first) and not page.endswith("-->", first, last):
                    at = len(page)
                continue
        tag = tag.lower()
        if end:
            if depths[tag]:
                close_to(depths[tag][-1])
            continue
        if tag in _CLOSES:
            own, walls = _CLOSES[tag]
            if any(depths[t] for t in own):
                wall = max((depths[w][-1] for w in walls if depths[w]), default=0)
                least = min((x[k] for t in own if (x := depths[t]) and (k := bisect_right(x, wall)) < len(x)), default=None)
                if least is not None:
                    close_to(least)
        kind = _KIND.get(tag, _OTHER)
        new = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        kinds.append(kind)
        starts.append(len(tokens))
        ends.append(0)
        digests.append(0)
        parts.append([tag, "\0", _BLANKS.sub(" ", attributes.rstrip("/").strip()) if attributes else ""])
        depths[tag].append(len(stack))
        stack.append(new)
        if kind == _IS_SILENT:
            silent += 1
        elif (kind == _IS_BLOCK or tag == "br") and not silent:
            tokens.append("\n")
            owner.append(new)
        if tag in _VOID or (attributes.endswith("/") and tag not in _RAW):
            close_to(len(stack) - 1)
        elif tag in _RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            last = found.start() if found else len(page)
            if last > at:
                add(page[at:last])
            at = last
    if at < len(page):
        rest = page[at:]
        while opened := _OPEN_END.search(rest):
            if opened.start():
                add(rest[: opened.start()])
            rest = "" if opened[0] == "<!--" else rest[opened.end() :]
        if rest:
            add(rest)
    close_to(1)
    ends[0] = len(tokens)
    return Page(tokens, owner, tags, digests, parents, kinds, starts, ends)


def _running(page: Page, gone: np.ndarray) -> np.ndarray:
    """Inline elements of gone that lie in running text: in a block that stays and has words outside of gone elements."""
    n = len(page.tag)
    block, kept, dead = [0] * n, [True] * n, [False] * n
    for k in range(1, n):
        p = page.parent[k]
        is_block = page.kind[k] == _IS_BLOCK
        dead[k] = dead[p] or page.kind[k] == _IS_SILENT or (is_block and bool(gone[k]))
        block[k] = k if is_block else block[p]
        kept[k] = not gone[k] and (is_block or kept[p])
    words = {block[o] for o, text in zip(page.owner, page.tokens, strict=True) if kept[o] and not dead[o] and any(map(str.isalnum, text))}
    return np.array([k for k in np.flatnonzero(gone) if not dead[k] and page.kind[k] == _OTHER and block[k] in words], np.int64)


def text_of(page: Page, gone: np.ndarray | None = None) -> tuple[str, int]:
    """Text of what isn't deleted, and the number of deleted subtrees. gone: by element, whether it is to be deleted."""
    out, removed, at = [], 0, 0
    if gone is not None and gone.any():
        gone = gone.copy()
        gone[_running(page, gone)] = False
        inside = [False] * len(page.tag)
        for k in range(1, len(page.tag)):
            if inside[page.parent[k]]:
                inside[k] = True
                continue
            if gone[k]:
                removed += 1
                inside[k] = True
                out += page.tokens[at : page.start[k]]
                out.append("\n" if page.kind[k] == _IS_BLOCK else " ")
                at = page.end[k]
            elif page.kind[k] == _IS_SILENT:
                inside[k] = True
    out += page.tokens[at:]
    lines = (_BLANKS.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), removed


def keys_of(host: str, page: Page) -> np.ndarray:
    """A key of host and hash for each element but the page itself; 0 for those that may not be templates."""
    seed = xxhash.xxh3_64_intdigest(host)
    own = np.array(page.digest[1:], np.uint64)
    keys = common.mix(own ^ np.uint64(seed)).view(np.int64)
    if not host:
        keys[:] = 0
    keys[[k for k, tag in enumerate(page.tag[1:]) if tag in _KEPT or tag in _VOID]] = 0
    return keys


def host(url: Column) -> Column:
    """Lower-case host name; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def packed(page: Page) -> tuple[str, bytes]:
    """A page's tokens as one string, and the numbers of its elements and tokens."""
    n = len(page.tag)
    start, end, owner = np.array(page.start), np.array(page.end), np.array(page.owner, np.int64)
    # as differences, which are small: the table is compressed
    numbers = np.concatenate([[n], np.arange(n) - np.array(page.parent), page.kind, np.diff(start, prepend=0), end - start, np.diff(owner, prepend=0)])
    small = np.abs(numbers).max() < 1 << 15
    return "\0".join(t.replace("\0", "\ufffd") for t in page.tokens), numbers.astype(np.int16 if small else np.int32).tobytes() + bytes([int(small)])


def unpacked(tokens: str, numbers: bytes) -> Page:
    rest = np.frombuffer(numbers[:-1], np.int16 if numbers[-1] else np.int32).astype(np.int64)
    n, rest = int(rest[0]), rest[1:]
    up, kind, start, size = rest[: 4 * n].reshape(4, n)
    start, owner = np.cumsum(start), np.cumsum(rest[4 * n :]).tolist()
    return Page(tokens.split("\0") if owner else [], owner, [""] * n, [], (np.arange(n) - up).tolist(), kind.tolist(), start.tolist(), (start + size).tolist())


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, page, url, keys, tokens, numbers): pages parsed; page and url are hashes of payload and url. To be saved."""
    common.tune(pages.sparkSession)
    rows = common.pick(pages, i=id_col, u=url_col, h=html_col).select(F.col("i").cast("long").alias("page_id"), F.col("u").cast("string").alias("u"), F.col("h").cast("string").alias("html"))
    rows = rows.select("page_id", host(F.col("u")).alias("host"), F.xxhash64("html").alias("page"), F.xxhash64("u").alias("url"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tokens, numbers = [], [], []
            for name, text in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                page = parse(text or "")
                keys.append(keys_of(name, page).tobytes())
                said, told = packed(page)
                tokens.append(said)
                numbers.append(told)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(keys, pa.binary()), pa.array(tokens, pa.string()), pa.array(numbers, pa.binary())], names=["page_id", "host", "page", "url", "keys", "tokens", "numbers"])

    return rows.mapInArrow(run, "page_id long, host string, page long, url long, keys binary, tokens string, numbers binary")


def page_keys(rows: DataFrame, *extra: str) -> DataFrame:
    """(host, key, *extra) for each distinct subtree of each row. rows: (host, keys, *extra)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(k, np.int64)) for k in batch.column(1).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(k) for k in found]))
            made = pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), *[batch.column(2 + k).take(row) for k in range(len(extra))]], names=["host", "key", *extra])
            yield made.filter(pc.not_equal(made.column(1), 0))

    schema = ", ".join(["host string", "key long", *[f"{c} {dict(rows.dtypes)[c]}" for c in extra]])
    return rows.select("host", "keys", *extra).mapInArrow(run, schema)


def templates(rows: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(key): subtrees that recur on min_pages distinct pages and min_share of the distinct pages of their host.

    rows: parsed(), saved. Rows of one payload become one page, named by the least of their urls; pages that have one name
    count once.
    """
    distinct = rows.where("host <> ''").groupBy("host", "page").agg(F.first("keys").alias("keys"), F.min("url").alias("name"))
    counts = page_keys(distinct, "name").groupBy("host", "key").agg(F.countDistinct("name").alias("n")).where(F.col("n") >= min_pages)
    names = rows.where("host <> ''").groupBy("host", "page").agg(F.min("url").alias("name"))
    whole = names.groupBy("host").agg(F.countDistinct("name").alias("pages")).toDF("of", "pages")
    return counts.join(whole, F.col("host") == F.col("of")).where(F.col("n") >= F.col("pages") * min_share).select("key")


def _extract(shared: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over (page_id, host, keys, tokens, numbers), or with each page's own template keys where shared is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            lists = batch.column(5).to_pylist() if shared is None else [None] * len(batch)
            for keys, tokens, numbers, own in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), lists, strict=True):
                wanted = np.sort(np.array(own or [], np.int64)) if shared is None else shared.value
                keys = np.frombuffer(keys, np.int64)
                gone = None
                if len(wanted) and len(keys):
                    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                    gone = np.append(False, (wanted[at] == keys) & (keys != 0))
                text, n = text_of(unpacked(tokens, numbers), gone)
                texts.append(text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["page_id", "host", "text", "n_removed"])

    return run


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_templates: int = BROADCAST_TEMPLATES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, text, n_removed): the text of each page without its host's templates."""
    spark = pages.sparkSession
    saved = common.Saved(spark, "templates")
    rows = saved.put(parsed(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "parsed")
    known = saved.put(templates(rows, min_pages, min_share), "keys")
    schema = "page_id long, host string, text string, n_removed int"
    shown = ("page_id", "host", "keys", "tokens", "numbers")
    if known.count() <= broadcast_templates:
        shared = spark.sparkContext.broadcast(np.sort(known.toArrow()["key"].to_numpy()))
        return rows.select(*shown).mapInArrow(_extract(shared), schema)
    lists = page_keys(rows, "row").join(known, "key", "left_semi").groupBy("row").agg(F.collect_list("key").alias("own")).toDF("at", "own")
    return rows.join(lists, F.col("row") == F.col("at"), "left").select(*shown, "own").mapInArrow(_extract(None), schema)
