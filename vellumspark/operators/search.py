"""Retrieval over a chunks table for many queries at once: BM25, dense, fusion, filters, expansion, reranking.

Queries are a DataFrame (query_id, query[, embedding]). Hits are rows (query_id, chunk_id, score, ...) with rank from 0.
Ranks are by scores rounded to 10 places, then by the chunk's ordinal, so the order of summation can't turn them round.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark import workspace
from vellumspark.config import RetrievalConfig
from vellumspark.functions import text as T
from vellumspark.operators.rows import embed_text

K1, B, RRF_K = 1.5, 0.75, 60
OKAPI_FLOOR = 0.25
PLACES = 10


def search_text(text: Column, keywords: Column, entities: Column, summary: Column, context: Column) -> Column:
    """All that the lexical leg reads of a chunk."""
    return F.concat_ws(" ", text, F.array_join(keywords, " "), F.array_join(entities, " "), summary, context)


# --- BM25 -----------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """blocks (some chunks with their words, an inverted index of their own), terms (term, df), totals (one row: n, avgdl),
    repeated (the chunk_keys that several chunks have, or that are null). Write them once, read often."""

    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame
    repeated: DataFrame

    @staticmethod
    def load(spark, path: str) -> Index:  # noqa: ANN001
        return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("blocks", "terms", "totals", "repeated")))

    @property
    def postings(self) -> DataFrame:
        """(chunk_key, term, tf, dl) of all words."""
        kind = self.blocks.schema["keys"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks_of(batches):
                yield pa.RecordBatch.from_arrays([block.keys.take(pa.array(block.at)), block.words.take(pa.array(np.repeat(np.arange(len(block.df)), block.df))), pa.array(block.tf), pa.array(block.dl[block.at])], names=["chunk_key", "term", "tf", "dl"])

        return self.blocks.select(*_BLOCK).mapInArrow(run, f"chunk_key {kind}, term string, tf int, dl int")


_WORD = re.compile(r"\w+")
#: Postings and chunks that a block ends at, and texts that are taken out of Arrow at a time.
BLOCK_POSTINGS, BLOCK_CHUNKS, TAKEN = 1 << 19, 4096, 256
_BLOCK = ("keys", "dl", "words", "df", "at", "tf")


@dataclass
class _Block:
    """keys and dl by chunk; words (sorted) and df by word; at (a chunk's place in the block) and tf by word and chunk."""

    keys: pa.Array
    dl: np.ndarray
    words: pa.Array
    df: np.ndarray
    at: np.ndarray
    tf: np.ndarray


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for k in range(len(batch)):
            row = {c: batch.column(c)[k] for c in _BLOCK}
            numbers = {c: np.frombuffer(row[c].as_buffer(), np.int32) for c in ("dl", "at", "tf")}
            yield _Block(keys=row["keys"].values, words=row["words"].values, df=row["df"].values.to_numpy(zero_copy_only=False), **numbers)


def counted_words(chunks: DataFrame, key: str, text: Column) -> DataFrame:
    """Blocks of chunks as they are read, with the words of each: keys, dl, words, df, at, tf as in _Block, n_words.

    A chunk's words are counted where it is read: what leaves the scan is an index of some chunks, without a shuffle.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dl, ids, term, tf, per = [], [], {}, [], [], []

        def block() -> pa.RecordBatch:
            words = sorted(ids)
            place = np.empty(len(ids), np.int32)
            place[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))] = np.arange(len(words), dtype=np.int32)
            by = place[np.array(term, np.int64)]
            order = np.argsort(by, kind="stable")
            at = np.repeat(np.arange(len(dl), dtype=np.int32), per)[order]
            numbers = [np.array(dl, np.int32), at, np.array(tf, np.int32)[order]]
            row = {"keys": pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)), "words": pa.array([words], pa.list_(pa.string())), "df": pa.array([np.bincount(by, minlength=len(words))], pa.list_(pa.int32())), "n_words": pa.array([sum(dl)], pa.int64())}
            row |= {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("dl", "at", "tf"), numbers, strict=True)}
            return pa.RecordBatch.from_arrays([row[c] for c in (*_BLOCK, "n_words")], names=[*_BLOCK, "n_words"])

        for batch in batches:
            for low in range(0, len(batch), TAKEN):
                part = batch.slice(low, TAKEN)
                for k, said in enumerate(part.column(1).to_pylist()):
                    count = Counter(_WORD.findall(said or ""))
                    keys.append(part.column(0).slice(k, 1))
                    dl.append(count.total())
                    per.append(len(count))
                    term += [ids.setdefault(w, len(ids)) for w in count]
                    tf += count.values()
                    if len(term) >= BLOCK_POSTINGS or len(dl) >= BLOCK_CHUNKS:
                        yield block()
                        keys, dl, ids, term, tf, per = [], [], {}, [], [], []
        if dl:
            yield block()

    schema = f"keys array<{kind}>, dl binary, words array<string>, df array<int>, at binary, tf binary, n_words long"
    return chunks.select(F.col(key).alias("chunk_key"), F.lower(text)).mapInArrow(run, schema)


def build_index(chunks: DataFrame, key: str, text: Column, path: str | None = None) -> Index:
    """An inverted index in blocks of chunks; chunks without words count towards n and the mean length. The texts are read
    and split once, and no posting is shuffled.

    It is saved at path, or in the workspace: the blocks, then what is counted from them.
    """
    spark = chunks.sparkSession
    path = path or workspace.folder(spark)
    # a row is a few MB: row groups are measured after each, not after the hundredth
    small = {"parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8}
    counted_words(chunks, key, text).write.mode("overwrite").options(**small).parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    said = blocks.select(F.explode(F.arrays_zip("words", "df")).alias("w")).groupBy(F.col("w.words").alias("term")).agg(F.sum("w.df").alias("df"))
    said.write.mode("overwrite").parquet(f"{path}/terms")
    n = F.coalesce(F.sum(F.size("keys")), F.lit(0)).cast("long")
    blocks.agg(n.alias("n"), F.coalesce(F.sum("n_words") / F.sum(F.size("keys")), F.lit(0.0)).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")
    keys = blocks.select(F.explode("keys").alias("chunk_key")).groupBy("chunk_key").agg(F.count("*").alias("rows"))
    keys.where("rows > 1 or chunk_key is null").select("chunk_key").write.mode("overwrite").parquet(f"{path}/repeated")
    return Index.load(spark, path)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): a word that a query repeats counts that often."""
    return queries.select("query_id", F.explode(T.words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _idf(okapi: bool) -> Column:
    """A term's weight by df and n; okapi: without the +1, so that words of more than half of the chunks are below 0."""
    n, df = F.col("n").cast("double"), F.col("df").cast("double")
    return F.log(n - df + 0.5) - F.log(df + 0.5) if okapi else F.log((n - df + 0.5) / (df + 0.5) + 1.0)


#: Words of queries, repeated keys and candidates, in rows, up to which they are sent to every task; and queries that are
#: scored at a time.
SENT_ROWS, SCORED_QUERIES = 1 << 20, 256


def query_weights(index: Index, queries: DataFrame, okapi: bool = False) -> DataFrame:
    """(query_id, term, w, avgdl): the words of queries that the index has, by their weight.

    okapi: the classical weights; those below 0 become a quarter of the mean over all terms of the index.
    """
    terms = query_terms(queries).join(index.terms, "term").crossJoin(F.broadcast(index.totals))
    idf = _idf(okapi)
    if okapi:
        mean = index.terms.crossJoin(F.broadcast(index.totals)).agg(F.avg(idf).alias("mean_idf"))
        terms = terms.crossJoin(F.broadcast(mean))
        idf = F.when(idf < 0, OKAPI_FLOOR * F.col("mean_idf")).otherwise(idf)
    return terms.select("query_id", "term", (idf * F.col("times") * (K1 + 1)).alias("w"), "avgdl")


def bm25_scores(index: Index, queries: DataFrame, okapi: bool = False) -> DataFrame:
    """(query_id, chunk_key, raw): all positive scores, by a join: for more queries than can be sent to every task."""
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("w") * tf / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return index.postings.join(query_weights(index, queries, okapi), "term").groupBy("query_id", "chunk_key").agg(F.sum(part).alias("raw")).where("raw > 0")


class _Asked:
    """Words of queries by word: of each the queries, by number, and its weight there. From (query_id, term, w)."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.ids = rows["query_id"].unique()
        self.words = rows["term"].unique()
        by = pc.index_in(rows["term"], self.words).to_numpy()
        order = np.argsort(by, kind="stable")
        self.query = pc.index_in(rows["query_id"], self.ids).to_numpy()[order]
        self.w = rows["w"].to_numpy()[order]
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(by, minlength=len(self.words)))])

    def scores(self, block: _Block, part: np.ndarray | None, low: int) -> np.ndarray:
        """(chunks, queries from low on): sums over the words that both have, of weights times part (None: 1).

        They are added up word by word in the words' order, so a score is the same in the last digit in every block.
        """
        wide = min(SCORED_QUERIES, len(self.ids) - low)
        out = np.zeros(len(block.dl) * wide)
        place = pc.fill_null(pc.index_in(block.words, self.words), -1).to_numpy()
        ends = np.cumsum(block.df)
        for word in np.flatnonzero(place >= 0):
            own = slice(self.begins[place[word]], self.begins[place[word] + 1])
            query, w = self.query[own] - low, self.w[own]
            mine = (query >= 0) & (query < wide)
            if not mine.all():
                query, w = query[mine], w[mine]
            said = slice(ends[word] - block.df[word], ends[word])
            where = block.at[said].astype(np.int64)[:, None] * wide + query
            # a chunk and a query meet once in a word, so no place is named twice
            out[where] += w if part is None else part[said, None] * w
        return out.reshape(len(block.dl), wide)


class _Best:
    """The top_k rows of each query so far, by rounded score and then by key."""

    def __init__(self, queries: int, top_k: int):
        self.n, self.k, self.size = queries, top_k, 0
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        #: The rounded score of the last of them; 0 where there are fewer.
        self.floor = np.zeros(queries)

    def add(self, query: np.ndarray, keys: pa.Array, score: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, keys, score))
            self.size += len(query)

    def grown(self) -> bool:
        return self.size > 2 * self.n * self.k

    def cut(self) -> None:
        if not self.parts:
            return
        query, score = (np.concatenate([p[k] for p in self.parts]) for k in (0, 2))
        keys = pa.concat_arrays([p[1] for p in self.parts])
        shown = np.round(score, PLACES)
        order = pc.sort_indices(pa.table({"q": query, "s": shown, "k": keys}), sort_keys=[("q", "ascending"), ("s", "descending"), ("k", "ascending")], null_placement="at_start").to_numpy()
        by = query[order]
        kept = order[np.arange(len(by)) - np.searchsorted(by, by, "left") < self.k]
        self.parts, self.size = [(query[kept], keys.take(pa.array(kept)), score[kept])], len(kept)
        count = np.bincount(query[kept], minlength=self.n)
        last = np.cumsum(count) - 1
        full = count == self.k
        self.floor[full] = shown[kept[last[full]]]

    def batch(self, ids: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
        """(query_id, chunk_key, score under that name)."""
        self.cut()
        for query, keys, score in self.parts:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), keys, pa.array(score)], names=["query_id", "chunk_key", name])


def _block_best(index: Index, rows: pa.Table, repeated: pa.Array, top_k: int, kind: str) -> DataFrame:
    """(query_id, chunk_key, raw): of each task's blocks every query's top_k; of chunks that share a key all."""
    spark, mean = index.blocks.sparkSession, rows["avgdl"][0].as_py()
    asked = spark.sparkContext.broadcast(_Asked(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = asked.value
        best, begun = _Best(len(own.ids), top_k), False
        for block in _blocks_of(batches):
            tf, dl = block.tf.astype(float), block.dl[block.at].astype(float)
            part = tf / (tf + K1 * (1 - B + B * dl / mean))
            shared = pc.is_in(block.keys, repeated).to_numpy(zero_copy_only=False)
            for low in range(0, len(own.ids), SCORED_QUERIES):
                raw = own.scores(block, part, low)
                if shared.any():
                    c, q = np.nonzero(raw * shared[:, None])
                    yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(q + low)), block.keys.take(pa.array(c)), pa.array(raw[c, q])], names=["query_id", "chunk_key", "raw"])
                    raw[shared] = 0.0
                shown = np.round(raw, PLACES)
                least = best.floor[low : low + raw.shape[1]]
                if len(raw) > top_k:
                    least = np.maximum(least, np.partition(shown, len(raw) - top_k, axis=0)[len(raw) - top_k])
                c, q = np.nonzero((shown >= least) & (raw > 0))
                best.add(q + low, block.keys.take(pa.array(c)), raw[c, q])
            if not begun or best.grown():
                best.cut()
                begun = True
        yield from best.batch(own.ids, "raw")

    return index.blocks.select(*_BLOCK).mapInArrow(run, f"query_id {kind}, chunk_key {index.blocks.schema['keys'].dataType.elementType.simpleString()}, raw double")


def ranked(hits: DataFrame, score: str, *ties: Column | str, limit: int | None = None, rank: str = "rank") -> DataFrame:
    """hits with a rank from 0 by query; no more than limit of them."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, PLACES).desc(), *ties)
    out = hits.withColumn(rank, F.row_number().over(order))
    return (out.where(F.col(rank) <= limit) if limit is not None else out).withColumn(rank, F.col(rank) - 1)


def bm25_search(index: Index, queries: DataFrame, top_k: int = 20, okapi: bool = False) -> DataFrame:
    """(query_id, chunk_key, rank, bm25_score): scores over the best one's.

    The words of up to SENT_ROWS go to every task, which scores its blocks and lets go of each query's top_k.
    """
    weights = query_weights(index, queries, okapi)
    rows, repeated = weights.limit(SENT_ROWS + 1).toArrow(), index.repeated.limit(SENT_ROWS + 1).toArrow()
    if max(len(rows), len(repeated)) > SENT_ROWS:
        scored = bm25_scores(index, queries, okapi)
    elif not len(rows):
        scored = weights.join(index.repeated, F.lit(False)).select("query_id", "chunk_key", F.col("w").alias("raw"))
    else:
        scored = _block_best(index, rows, repeated["chunk_key"].combine_chunks(), top_k, weights.schema["query_id"].dataType.simpleString())
        if len(repeated):
            scored = scored.groupBy("query_id", "chunk_key").agg(F.sum("raw").alias("raw")).where("raw > 0")
    top = ranked(scored, "raw", "chunk_key", limit=top_k)
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return top.select("query_id", "chunk_key", F.col("rank").cast("int").alias("rank"), (F.col("raw") / best).alias("bm25_score"))


def _with_all_words(index: Index, rows: pa.Table, kind: str) -> DataFrame:
    """(query_id, chunk_key): chunks that have all words of a query. rows: query_id, term, w (1)."""
    asked = index.blocks.sparkSession.sparkContext.broadcast(_Asked(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = asked.value
        need = np.bincount(own.query, minlength=len(own.ids))
        for block in _blocks_of(batches):
            for low in range(0, len(own.ids), SCORED_QUERIES):
                had = own.scores(block, None, low)
                c, q = np.nonzero(had == need[low : low + had.shape[1]])
                yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(q + low)), block.keys.take(pa.array(c))], names=["query_id", "chunk_key"])

    return index.blocks.select(*_BLOCK).mapInArrow(run, f"query_id {kind}, chunk_key {index.blocks.schema['keys'].dataType.elementType.simpleString()}")


def containing(docs: DataFrame, passages: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_key): documents that contain a passage as it stands. docs: chunk_key, text; passages: query_id, query.

    Candidates are the documents that have all words of the passage's inside, which the index names (for more passages than
    can be sent to every task, those with its rarest word); they alone are searched. The first and last word may be parts
    of words in a document, so a passage without others is searched for everywhere.
    """
    ws = T.words(F.col("query"))
    asked = passages.select("query_id", "query", F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 2, F.lit(0))).alias("inside"))
    inside = asked.select("query_id", F.explode("inside").alias("term")).distinct()
    rows = inside.withColumn("w", F.lit(1.0)).limit(SENT_ROWS + 1).toArrow()
    if len(rows) > SENT_ROWS:
        # a word that no document has settles it: nothing contains the passage
        words = inside.join(index.terms, "term", "left")
        rare = words.groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
        candidates = index.postings.select("chunk_key", "term").join(rare, "term").select("query_id", "chunk_key")
    else:
        candidates = _with_all_words(index, rows, inside.schema["query_id"].dataType.simpleString()) if len(rows) else inside.join(index.repeated, F.lit(False)).select("query_id", "chunk_key")
        candidates = workspace.kept(candidates)
        if candidates.count() <= SENT_ROWS:
            # else the texts of all documents would be shuffled
            candidates = F.broadcast(candidates)
    held = docs.select("chunk_key", "text").join(candidates, "chunk_key")
    hinted = held.join(asked.select("query_id", "query"), "query_id").where(F.col("text").contains(F.col("query")))
    bare = asked.where(F.size("inside") == 0).select("query_id", "query")
    everywhere = docs.select("chunk_key", "text").join(bare, F.col("text").contains(F.col("query")))
    return hinted.select("query_id", "chunk_key").unionByName(everywhere.select("query_id", "chunk_key"))


# --- dense ----------------------------------------------------------------------------------------------------

#: Bytes of query vectors (8 a number) up to which they are sent to every task as one matrix; more of them are dealt out in
#: blocks of up to that size, and the vectors in blocks of VECTOR_BYTES, a task for each pair of blocks. Each block of queries
#: takes a copy of all vectors, so smaller blocks are made up to QUERY_BLOCKS only.
BROADCAST_BYTES = 64 << 20
VECTOR_BYTES = 64 << 20
QUERY_BLOCKS = 16
#: Queries and vectors whose scores are held at a time.
TILE_QUERIES, TILE_VECTORS = 512, 8192


def _as_matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _units(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Rows over their length in single precision; zeros stay."""
    with np.errstate(all="ignore"):
        return (x / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)


class _Nearest:
    """Each query's top_k of the vectors that were met so far, by score and then by key.

    Products in single precision say which vectors can be among them; these alone are scored in double precision, row by row, as
    a product of matrices adds up in an order that hangs on its shape.
    """

    def __init__(self, q: np.ndarray, top_k: int):
        self.q, self.top_k, self.best = q, top_k, _Best(len(q), top_k)
        self.norm = np.sqrt((q**2).sum(1))
        self.unit = _units(q, self.norm)
        # of products and sums of numbers that single precision rounds
        self.slack = (q.shape[1] + 8) * 2.0**-23
        self.begun = False

    def meet(self, x: np.ndarray, keys: pa.Array) -> None:
        norm = np.sqrt((x**2).sum(1))
        unit = _units(x, norm)
        # the small term in a score counts where vectors are very short
        short = np.min(self.norm[self.norm > 0], initial=np.inf) * np.min(norm[norm > 0], initial=np.inf) < 1e-2
        for low in range(0, len(self.q), TILE_QUERIES):
            about = self.unit[low : low + TILE_QUERIES] @ unit.T
            if short:
                both = self.norm[low : low + TILE_QUERIES, None] * norm
                about *= (both / (both + 1e-10)).astype(np.float32)
            floor = self.best.floor[low : low + TILE_QUERIES]
            least = np.where(floor > 0, floor, 0.0) - self.slack
            few = np.flatnonzero(floor <= 0)
            if len(few) and about.shape[1] > self.top_k:
                at = about.shape[1] - self.top_k
                # numbers that aren't there say nothing about the others
                own = np.nan_to_num(about[few], nan=-2.0, posinf=-2.0, neginf=-2.0)
                least[few] = np.maximum(least[few], np.partition(own, at, axis=1)[:, at] - 2 * self.slack)
            # in single precision, and no more than it was
            r, c = np.nonzero(about >= np.nextafter(least.astype(np.float32), np.float32(-3))[:, None])
            for begin in range(0, len(r), 1 << 17):
                self._score(low + r[begin : begin + (1 << 17)], c[begin : begin + (1 << 17)], x, norm, keys)
                if self.best.grown():
                    self.best.cut()
        if not self.begun:
            self.best.cut()
            self.begun = True

    def _score(self, r: np.ndarray, c: np.ndarray, x: np.ndarray, norm: np.ndarray, keys: pa.Array) -> None:
        own = np.einsum("ij,ij->i", self.q[r], x[c]) / (self.norm[r] * norm[c] + 1e-10)
        kept = (own > 0) & (np.round(own, PLACES) >= self.best.floor[r])
        self.best.add(r[kept], keys.take(pa.array(c[kept])), own[kept])

    def meet_all(self, column: pa.Array, keys: pa.Array) -> None:
        for low in range(0, len(column), TILE_VECTORS):
            part = column.slice(low, TILE_VECTORS)
            self.meet(_as_matrix(part, len(part)), keys.slice(low, TILE_VECTORS))


def _block_search(vectors: DataFrame, asked: pa.Table, top_k: int, schema: str) -> DataFrame:
    """Each task's vectors against the matrix of queries."""
    ids = asked["query_id"].combine_chunks()
    shared = vectors.sparkSession.sparkContext.broadcast(_as_matrix(asked["q"], len(asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Nearest(shared.value, top_k)
        for batch in batches:
            found.meet_all(batch.column(1), batch.column(0))
        yield from found.best.batch(ids, "dense_score")

    return vectors.select("chunk_key", "embedding").mapInArrow(run, schema)


def _grid_search(vectors: DataFrame, asked: DataFrame, top_k: int, schema: str, q_blocks: int, v_blocks: int) -> DataFrame:
    """Blocks of vectors against blocks of queries: each query meets each vector in one task, and leaves its top_k there."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb")).withColumn("vb", every(v_blocks))
    held = vectors.select("chunk_key", "embedding", F.pmod(F.xxhash64("chunk_key"), F.lit(v_blocks)).cast("int").alias("v_vb")).withColumn("v_qb", every(q_blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if len(left) and len(right):
            found = _Nearest(_as_matrix(left["q"], len(left)), top_k)
            for column, keys in zip(right["embedding"].chunks, right["chunk_key"].chunks, strict=True):
                found.meet_all(column, keys)
            made = list(found.best.batch(left["query_id"].combine_chunks(), "dense_score"))
        empty = pa.table({"query_id": left["query_id"][:0], "chunk_key": right["chunk_key"][:0], "dense_score": pa.array([], pa.float64())})
        return pa.Table.from_batches(made) if made else empty

    return queries.groupBy("qb", "vb").cogroup(held.groupBy("v_qb", "v_vb")).applyInArrow(meet, schema)


def dense_search(vectors: DataFrame, queries: DataFrame, top_k: int = 20, dims: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, chunk_key, rank, dense_score): the best positive cosines over all vectors, exactly.

    vectors: chunk_key, embedding; queries: query_id, embedding; all of dims numbers (None: those of the first query).
    """
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q is not null")
    held = vectors.select("chunk_key", F.col("embedding").cast("array<float>")).where("embedding is not null")
    if dims is None:
        first = asked.select(F.size("q").alias("n")).first()
        dims = first["n"] if first else 0
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_key {held.schema['chunk_key'].dataType.simpleString()}, dense_score double"
    size = asked.count() * dims * 8
    if not size:
        return vectors.sparkSession.createDataFrame([], schema.replace("dense_score", "rank int, dense_score"))
    if size <= broadcast_bytes:
        scored = _block_search(held, asked.toArrow(), top_k, schema)
    else:
        blocks = min(-(-size // broadcast_bytes), max(QUERY_BLOCKS, -(-size // BROADCAST_BYTES)))
        scored = _grid_search(held, asked, top_k, schema, blocks, -(-held.count() * dims * 8 // VECTOR_BYTES) or 1)
    top = ranked(scored, "dense_score", "chunk_key", limit=top_k)
    return top.select("query_id", "chunk_key", F.col("rank").cast("int").alias("rank"), "dense_score")


# --- fusion ---------------------------------------------------------------------------------------------------


def fuse(dense: DataFrame, bm25: DataFrame, config: RetrievalConfig | None = None) -> DataFrame:
    """(query_id, chunk_key, rank, score, dense_score, bm25_score): weighted reciprocal ranks, summed.

    Ties go to the dense list's order, then to the lexical one's.
    """
    config = config or RetrievalConfig()
    legs = []
    for name, leg, weight in (("dense", dense, config.vector_weight), ("bm25", bm25, config.bm25_weight)):
        legs.append(leg.select("query_id", "chunk_key", (F.lit(float(weight)) / (RRF_K + 1 + F.col("rank"))).alias("part"), *[(F.col(f"{n}_score") if n == name else F.lit(None).cast("double")).alias(f"{n}_score") for n in ("dense", "bm25")], *[(F.col("rank") if n == name else F.lit(None).cast("int")).alias(f"{n}_rank") for n in ("dense", "bm25")]))
    summed = legs[0].unionByName(legs[1]).groupBy("query_id", "chunk_key").agg(F.sum("part").alias("score"), *[F.coalesce(F.max(f"{n}_score"), F.lit(0.0)).alias(f"{n}_score") for n in ("dense", "bm25")], *[F.max(f"{n}_rank").alias(f"{n}_rank") for n in ("dense", "bm25")])
    out = ranked(summed, "score", F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return out.select("query_id", "chunk_key", F.col("rank").cast("int").alias("rank"), "score", "dense_score", "bm25_score")


# --- filters --------------------------------------------------------------------------------------------------


def _as_text(value: object) -> str:
    return str(value).lower()


def matches(chunks: DataFrame, filters: dict[str, object]) -> Column:
    """True where every named column equals its value as text, whatever the case; a null is "none", and a column that
    isn't there matches nothing."""
    kinds = dict(chunks.dtypes)
    rule = F.lit(True)
    for name, expected in filters.items():
        if name not in kinds:
            return F.lit(False)
        shown = F.col(name).cast("string")
        if kinds[name] in ("double", "float"):
            # whole numbers carry .0, as Python shows them
            shown = F.when(F.col(name) == F.floor(name), F.concat(F.floor(name).cast("string"), F.lit(".0"))).otherwise(shown)
        rule &= F.coalesce(F.lower(shown), F.lit("none")) == F.lit(_as_text(expected))
    return rule


def filtered(hits: DataFrame, chunks: DataFrame, filters: dict[str, object], key: str = "chunk_key") -> DataFrame:
    """Hits whose chunk matches, ranked anew. It works on what fusion kept of the legs' lists, not ahead of them."""
    kept = hits.join(chunks.where(matches(chunks, filters)).select(key), key, "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


# --- expansion ------------------------------------------------------------------------------------------------


def expand(hits: DataFrame, chunks: DataFrame, parents: bool = False, neighbors: int = 0, cross_document: bool = False) -> DataFrame:
    """hits and, after them, their section's other chunks (0.9 of the score) and up to `neighbors` chunks on either side
    (0.85) that no hit named first. A walk ends where chunks isn't contiguous. Sections are a document's own unless
    cross_document. hits: query_id, chunk_key, rank, score, dense_score, bm25_score; chunks: chunk_key, doc_id,
    chunk_index, section_id.
    """
    # hits are named several times below, and each time would search anew
    hits = workspace.kept(hits)
    run = Window.partitionBy("doc_id").orderBy("chunk_index")
    placed = chunks.select("chunk_key", "doc_id", "chunk_index", "section_id").withColumn("island", F.col("chunk_index") - F.row_number().over(run))
    own = hits.join(placed, "chunk_key").withColumnsRenamed({"chunk_key": "from_key", "chunk_index": "at"})
    other = placed.withColumnsRenamed({c: f"o_{c}" for c in placed.columns})
    found = []
    if parents:
        same = F.col("section_id") == F.col("o_section_id")
        if not cross_document:
            same &= F.col("doc_id") == F.col("o_doc_id")
        found.append(own.join(other, same).select("query_id", F.col("o_chunk_key").alias("chunk_key"), F.col("rank").alias("by"), F.lit(0).alias("kind"), F.struct("o_doc_id", "o_chunk_index").alias("step"), (F.col("score") * 0.9).alias("score"), "dense_score", "bm25_score"))
    if neighbors > 0:
        # each hit names the places that it asks for, so the join brings these chunks and no others of the document
        steps = F.explode(F.filter(F.sequence(F.lit(-neighbors), F.lit(neighbors)), lambda d: d != 0))
        wanted = own.withColumn("by_step", steps).withColumn("place", F.col("at") + F.col("by_step"))
        near = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("place") == F.col("o_chunk_index")) & (F.col("island") == F.col("o_island"))
        walked = wanted.join(other, near)
        found.append(walked.select("query_id", F.col("o_chunk_key").alias("chunk_key"), F.col("rank").alias("by"), F.when(F.col("by_step") < 0, 1).otherwise(2).alias("kind"), F.struct(F.lit(0).cast("long").alias("o_doc_id"), F.abs("by_step").alias("o_chunk_index")).alias("step"), (F.col("score") * 0.85).alias("score"), F.lit(0.0).alias("dense_score"), F.lit(0.0).alias("bm25_score")))
    base = hits.select("query_id", "chunk_key", F.col("rank").alias("by"), F.lit(-1).alias("kind"), F.struct(F.lit(0).cast("long").alias("o_doc_id"), F.lit(0).alias("o_chunk_index")).alias("step"), "score", "dense_score", "bm25_score")
    if not found:
        return base.select("query_id", "chunk_key", F.col("by").alias("rank"), "score", "dense_score", "bm25_score", F.lit("hit").alias("via"))
    more = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    more = more.join(hits.select("query_id", "chunk_key"), ["query_id", "chunk_key"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_key").orderBy("by", "kind", "step"))
    more = more.withColumn("first", first).where("first = 1").drop("first")
    every = base.unionByName(more)
    # hits in their order first, then what each of them brought
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("kind") < 0, 0).otherwise(1), "by", "kind", "step")
    via = F.when(F.col("kind") < 0, "hit").when(F.col("kind") == 0, "section").otherwise("neighbor")
    return every.select("query_id", "chunk_key", (F.row_number().over(order) - 1).cast("int").alias("rank"), "score", "dense_score", "bm25_score", via.alias("via"))


# --- reranking ------------------------------------------------------------------------------------------------


def rerank_by(hits: DataFrame, score: Column, top_k: int = 5) -> DataFrame:
    """hits by an expression instead of their score; ties keep their order."""
    scored = hits.withColumn("rerank_score", score.cast("double")).withColumnRenamed("rank", "_was")
    return ranked(scored, "rerank_score", "_was", limit=top_k).withColumn("score", F.col("rerank_score")).withColumn("rank", F.col("rank").cast("int")).drop("_was")


def rerank_with(hits: DataFrame, model: Callable[[str, list[str]], list[float]], top_k: int = 5) -> DataFrame:
    """The same by a function of a query and its candidates' texts, a call for each query. hits: query, text besides."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        if group["query"].iloc[0]:
            group["score"] = group["rerank_score"] = [float(s) for s in model(group["query"].iloc[0], list(group["text"]))]
            group = group.sort_values("score", ascending=False, kind="stable")
        group = group.head(top_k).copy()
        group["rank"] = range(len(group))
        return group

    rows = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    return rows.groupBy("query_id").applyInPandas(run, rows.schema)


# --- all of it ------------------------------------------------------------------------------------------------


def overlap(query: str, texts: list[str]) -> list[float]:
    """A reranker that needs no model: the share of the query's distinct words that a text has."""
    asked = set(_WORD.findall(query.lower()))
    return [len(asked & set(_WORD.findall(t.lower()))) / max(1, len(asked)) for t in texts]


def known(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits of a caller's own leg; a chunk_key that chunks doesn't have fails the query."""
    both = hits.join(chunks.select(F.col("chunk_key").alias("k_key")).distinct(), F.col("chunk_key") == F.col("k_key"), "left")
    named = F.when(F.col("k_key").isNotNull(), F.col("chunk_key")).otherwise(F.raise_error(F.concat(F.lit("the dense leg named a chunk that isn't there: "), F.coalesce(F.col("chunk_key").cast("string"), F.lit("null")))))
    return both.withColumn("chunk_key", named).drop("k_key")


def hybrid_search(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, config: RetrievalConfig | None = None, top_k: int = 10, filters: dict[str, object] | None = None, index: Index | None = None, dense: Callable[[DataFrame, int], DataFrame] | None = None, reranker: Callable[[str, list[str]], list[float]] | None = None, cross_document: bool = False, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Hits of every query: both legs to 3 top_k, fusion, filters, cut, reranking, expansion.

    chunks: the chunks table with contextual_text. vectors: chunk_key, embedding, for queries with an embedding; embed: a
    text column to a vector column, for chunks without vectors and queries without an embedding (functions.embedding.hashed()
    needs no model); dense: another leg, a function of queries and a limit, whose chunks must all be there. With none of
    them, the lexical leg is alone.
    """
    config = config or RetrievalConfig()
    keyed = chunks.withColumn("chunk_key", F.col("chunk_id"))
    asked = queries.where(T.strip(F.coalesce("query", F.lit(""))) != "")
    if embed is not None and dense is None:
        if vectors is None:
            vectors = workspace.kept(keyed.select("chunk_key", embed(embed_text(F.col("contextual_text"), F.col("text"))).alias("embedding")))
        if "embedding" not in asked.columns:
            asked = workspace.kept(asked.withColumn("embedding", embed(F.col("query"))))
    index = index or build_index(keyed, "chunk_key", search_text(F.col("text"), F.col("keywords"), F.col("entities"), F.col("summary"), F.col("parent_context")))
    lexical = bm25_search(index, asked, 3 * top_k)
    if dense is not None:
        near = known(dense(asked, 3 * top_k), keyed)
    elif vectors is not None:
        near = dense_search(vectors, asked, 3 * top_k)
    else:
        near = lexical.select("query_id", "chunk_key", "rank", F.col("bm25_score").alias("dense_score")).where(F.lit(False))
    hits = fuse(near, lexical, config)
    if filters:
        hits = filtered(hits, keyed, filters)
    hits = hits.where(F.col("rank") < top_k)
    if reranker is not None:
        shown = hits.join(keyed.select("chunk_key", embed_text(F.col("contextual_text"), F.col("text")).alias("text")), "chunk_key").join(asked.select("query_id", "query"), "query_id")
        hits = rerank_with(shown, reranker, config.reranker_top_k).drop("text", "query")
    else:
        hits = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    scores = hits.select("query_id", "chunk_key", "rerank_score")
    if config.expand_parents or config.expand_neighbors:
        out = expand(hits, keyed, config.expand_parents, config.expand_neighbors, cross_document)
    else:
        out = hits.drop("rerank_score").withColumn("via", F.lit("hit"))
    return out.join(scores, ["query_id", "chunk_key"], "left")


def shown(hits: DataFrame) -> DataFrame:
    """hits as they are shown to people: scores to four places."""
    return hits.withColumns({c: F.round(c, 4) for c in ("score", "dense_score", "bm25_score", "rerank_score") if c in hits.columns})


def batches_of(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of up to size rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
