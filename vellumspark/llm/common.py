"""Shared pieces of the training-data operators: byte-level tokens in numpy, saved tables, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Text is looked at in pieces of about this many bytes, so that numpy's work arrays stay in cache.
PIECE_BYTES = 1 << 20
PIECE_ROWS = 1 << 15

#: Rows of an Arrow batch. Documents are a few KB, at times a hundred; the default of 10,000 is too much for a worker.
BATCH_ROWS = 2000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_POLY = 0x5851F42D4C957F2D
_POLY_INV = pow(_POLY, -1, 1 << 64)


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows; leaves a smaller setting alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of df by name, under the names that are asked for: pick(df, i="doc_id").

    A column of exactly that name counts, the first one where it is there twice; else one that differs in case alone.
    Columns are taken by place, so that others of a like name do no harm.
    """
    names = df.columns
    lower = [n.lower() for n in names]
    place = {}
    for out, name in wanted.items():
        if name not in names and name.lower() not in lower:
            raise ValueError(f"there is no column {name}")
        place[out] = names.index(name) if name in names else lower.index(name.lower())
    numbered = df.toDF(*[f"column_{k}" for k in range(len(names))])
    return numbered.select(*[F.col(f"column_{k}").alias(out) for out, k in place.items()])


def documents(df: DataFrame) -> DataFrame:
    """The columns of documents."""
    return pick(df, **{c: c for c in DOCUMENT_COLUMNS})


# --- numpy text -----------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an uint64 array."""
    x = x + _MULT
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}
#: Powers kept in a worker, for each base. Longer texts are hashed in stretches of this length.
POWERS = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to POWERS of them are kept in the worker and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if len(have) <= POWERS:
            _POWERS[base] = have
    return have[:n]


def _class_table(separators: bytes | None) -> np.ndarray:
    """True where a byte belongs to a word. None: letters, digits, _ and all bytes beyond ASCII."""
    if separators is not None:
        table = np.ones(256, bool)
        table[list(separators)] = False
        return table
    table = np.zeros(256, bool)
    table[128:] = True
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z"), ("_", "_")):
        table[ord(low) : ord(high) + 1] = True
    return table


IN_WORD = _class_table(None)
NOT_BLANK = _class_table(b" \t\n\r\x0b\x0c")


@dataclass
class Words:
    """Words of some documents. start and end are byte places in data; first has a document's first word, and one more."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hash of each run of n words that lies in one document, and the run's first word."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rolled = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            rolled *= _MULT
            rolled += self.hash[k : total - n + 1 + k]
        left = self.first[1:][self.doc()[: total - n + 1]]
        at = np.flatnonzero(np.arange(total - n + 1) + n <= left)
        return mix(rolled[at]), at


def pieces(texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of an Arrow string array: (first row, row after the last, bytes, offsets into them).

    A null has no bytes. A document is never cut: one longer than piece_bytes is a piece of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, min(int(np.searchsorted(offsets, offsets[row] + piece_bytes, "right")) - 1, row + PIECE_ROWS))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of (byte + 1) * _POLY ** place in the word, for each word; a stretch of data at a time.

    The arrays that are as long as the data are those of one stretch, whatever the length of a text.
    """
    out = np.zeros(len(start), np.uint64)
    first = 0
    for low in range(0, len(data), POWERS):
        part = data[low : low + POWERS]
        summed = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_POLY, len(part)), out=summed[1:])
        # words that touch the stretch; one that began before it goes on where it was cut
        stop = np.searchsorted(start, low + len(part))
        at = slice(first, stop)
        a, b = np.maximum(start[at] - low, 0), np.minimum(end[at] - low, len(part))
        shift = powers(_POLY_INV, POWERS)[a]
        if stop > first and start[first] < low:
            shift[0] = pow(_POLY, low - int(start[first]), 1 << 64)
        out[at] += (summed[b] - summed[a]) * shift
        first = stop - 1 if stop and end[stop - 1] > low + len(part) else stop
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IN_WORD) -> Words:
    """Words of a piece, with a polynomial rolling hash of each word's bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    starts, ends = inside[1:-1] > inside[:-2], inside[1:-1] > inside[2:]
    # a document's first byte starts a word even where the document before ends in one
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    edges = edges[inside[edges + 1] & inside[edges]]
    starts[edges], ends[edges - 1] = True, True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), mix(_hashes(data, start, end) + (end - start).astype(np.uint64)))


def characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Characters (not bytes) of UTF-8 data in each word."""
    out = end - start
    if len(data) and int(data.max()) >= 0x80:
        more = np.flatnonzero((data & 0xC0) == 0x80)
        out = out - (np.searchsorted(more, end) - np.searchsorted(more, start))
    return out


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


# --- saved tables ---------------------------------------------------------------------------------------------

_OWN_DIRS: list[str] = []


@atexit.register
def _remove_own() -> None:
    for path in _OWN_DIRS:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a folder of our own only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN_DIRS:
            _OWN_DIRS.append(tempfile.mkdtemp(prefix="vellumspark-"))
        folder = f"file://{_OWN_DIRS[0]}"
    return folder.rstrip("/")


class Saved:
    """Tables written to the shared folder: they cut lineage and outlive executors. drop() removes those named."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


# --- connected components -------------------------------------------------------------------------------------


class Forest:
    """Union-find over 0..n-1 whose roots are each set's least member; find works on whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if (up == root).all():
                break
            root = up
        self.parent[x] = root
        return root

    def join(self, members: np.ndarray) -> None:
        """All members become one set."""
        roots = np.unique(self.find(members))
        if len(roots) > 1:
            self.parent[roots] = roots[0]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each member of a becomes one set with that at its place in b."""
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _forest_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (member, least member) of the components of all edges of the partition."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    table = pa.concat_tables(tables)
    a, b = (table[c].to_numpy() for c in ("u", "v"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:  # least-label hooking with pointer jumping, whole arrays at a time
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
    keep = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(names[label[keep]])], names=["u", "v"])


def components(edges: DataFrame, saved: Saved, one_task_edges: int = 4_000_000) -> DataFrame:
    """(u, v): every node that isn't the least of its connected component, with that least node.

    edges (u, v) are longs without nulls; loops and repeats do no harm. Few edges (one_task_edges, 16 bytes each) are
    joined in one task; more of them by rounds of large-star and small-star over the cluster. Both give the same rows.
    """
    edges = saved.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    if edges.count() <= one_task_edges:
        return saved.put(edges.coalesce(1).mapInArrow(_forest_edges, "u long, v long"), "components")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    turn, was = 0, None
    while (now := state(edges)) != was:
        was, turn = now, turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved.put(large.where("u <> v").distinct(), f"large-{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = saved.put(small.where("u <> v").distinct(), f"edges-{turn}")
        saved.drop(f"large-{turn}", f"edges-{turn - 1}")
        edges = new
    return edges
