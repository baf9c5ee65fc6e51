"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy.

For each document and each n, the share of its characters inside n-grams of words that occur more than once in it, and
the share inside lines that occur more than once. Words are runs of bytes other than ASCII white space; the characters
measured are those inside words. Texts are taken whole.

Defined results: a null or blank text has coverage 0 throughout and is rejected (it holds no words). Null ids and
repeated rows are measured like any other row, one result per row. Equal lines count wherever they stand; blank lines
do not. Extra columns are ignored by measure() and dropped by filter_documents(). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Greatest coverage that a document may have, by n-gram length in words.
GRAM_LIMITS = {3: 0.6, 5: 0.5, 8: 0.45}
#: The same for lines that occur more than once.
LINE_LIMIT = 0.5


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    ranked = np.sort(keys)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    # a bitmap over 20 bits of the key leaves few keys to search for
    low = np.uint64((1 << 20) - 1)
    bitmap = np.zeros(1 << 20, bool)
    bitmap[twice & low] = True
    out = bitmap[keys & low]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(twice, keys[at]), len(twice) - 1)
    out[at] = twice[place] == keys[at]
    return out


def _share(covered: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By document, the share of its words' characters that lies in covered words."""
    summed = np.zeros((2, len(size) + 1), np.int64)
    np.cumsum(size, out=summed[0, 1:])
    np.cumsum(np.where(covered, size, 0), out=summed[1, 1:])
    whole, part = (s[first[1:]] - s[first[:-1]] for s in summed)
    return part / np.maximum(whole, 1)


def coverage(data: np.ndarray, offsets: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a piece, by document: words, coverage for each length, coverage by lines."""
    w = common.words(data, offsets, common.NOT_BLANK)
    size, doc = common.characters(data, w.start, w.end), w.doc()
    salt = common.mix(np.arange(len(offsets), dtype=np.uint64))
    shares = []
    for n in lengths:
        keys, at = w.grams(n)
        at = at[repeated(keys ^ salt[doc[at]])]
        depth = np.bincount(at, minlength=len(size) + n) - np.bincount(at + n, minlength=len(size) + n)
        shares.append(_share(np.cumsum(depth)[: len(size)] > 0, size, w.first))
    # a line's hash is made of its words in order, so blanks at its ends and between words don't matter
    number = np.searchsorted(np.flatnonzero(data == 10), w.start) + doc
    head = np.flatnonzero(np.diff(number, prepend=-1)) if len(number) else np.zeros(0, np.int64)
    place = np.arange(len(size)) - np.repeat(head, np.diff(np.append(head, len(size))))
    power = common.powers(0x9E3779B97F4A7C15, int(place.max(initial=0)) + 1)
    line = np.add.reduceat(w.hash * power[place], head) if len(head) else np.zeros(0, np.uint64)
    again = repeated(common.mix(line) ^ salt[doc[head]])
    lines = _share(np.repeat(again, np.diff(np.append(head, len(size)))), size, w.first)
    return np.diff(w.first), shares, lines


def _names(lengths: list[int]) -> list[str]:
    return [f"dup_{n}gram_share" for n in lengths]


def measure(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, words, coverages (rounded to 6 places) and whether the rules keep it."""
    limits = GRAM_LIMITS if limits is None else limits
    common.tune(docs.sparkSession)
    lengths = sorted(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in common.pieces(batch.column(1)):
                n, shares, lines = coverage(data, offsets, lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n.astype(np.int64)), *map(pa.array, shares), pa.array(lines)], names=["i", "n", *_names(lengths), "l"])

    chosen = common.pick(docs, i=id_col, t=text_col).select(F.col("i").cast("long"), F.col("t").cast("string"))
    schema = "i long, n long, " + ", ".join(f"{c} double" for c in _names(lengths)) + ", l double"
    found = chosen.mapInArrow(run, schema)
    keep = F.col("n") > 0
    for n, name in zip(lengths, _names(lengths), strict=True):
        keep &= F.col(name) <= limits[n]
    return found.select(F.col("i").alias("doc_id"), F.col("n").alias("n_words"), *[F.round(c, 6).alias(c) for c in _names(lengths)], F.round("l", 6).alias("dup_line_share"), (keep & (F.col("l") <= line_limit)).alias("keep"))


def filter_documents(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of documents and texts as they were.

    The rules run inside the scan: each row is judged where it is, without a shuffle or a join.
    """
    limits = GRAM_LIMITS if limits is None else limits
    common.tune(docs.sparkSession)
    lengths = sorted(limits)
    docs = common.documents(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, data, offsets in common.pieces(batch.column("text")):
                n, shares, lines = coverage(data, offsets, lengths)
                good = (n > 0) & (lines <= line_limit)
                for k, x in zip(lengths, shares, strict=True):
                    good &= x <= limits[k]
                keep.append(good)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)

