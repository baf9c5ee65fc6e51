"""Language-model scores from a weighted backoff automaton over the bytes of UTF-8 text.

All runs of up to ORDER bytes of all texts of the corpus are counted. They are smoothed by interpolated absolute
discounting: with c the count of context h and byte w, C that of h before any byte and d the number of bytes that follow h,

    p(w | h) = (c - D) / C + b(h) p(w | h less its first byte),   b(h) = D d / C,

and below single bytes p is 1/256. Every run counts, however rare. Contexts become states, runs become arcs with log p,
and each state has a failure arc of weight log b(h) to the state of its longest proper suffix. A text is read once, left
to right: the state is carried, each byte adds the weight of its arc and of the failure arcs taken before it. The state
after ORDER - 1 bytes depends on these bytes alone, so a worker reads thousands of stretches of _STRETCH bytes side by side
in numpy, each after ORDER - 1 bytes of lead-in whose weights don't count.

No task holds the whole automaton. Texts lie in blocks of about block_bytes; a block is scored by the part of the automaton
that its own runs can reach: the runs of its texts that the corpus has, with the counts of the whole corpus. Every weight
is made from these counts alone in double precision, so a text has the same score in any block, and the automaton may be of
any size. What is gathered (runs by block, then counts by run) grows with the corpus.

Defined results: a null or empty text has 0 bytes, log-probability 0 and a null rate. A text is read from the start state
and its end isn't predicted. Null ids and repeated rows are counted and scored like any other row. Texts are taken whole.
Extra columns are ignored. Without any text the model is uniform. Scores don't depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 5
DISCOUNT = 0.75
#: Bytes of text that are scored together; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
_STRETCH = 512
_PIECE = 4 << 20
_PAD = 256  # the symbol after a text's last byte
_BITS = 9
#: A run of k bytes is the number k in the bits from here on, and the bytes below.
_LENGTH = 8 * ORDER


# --- counts ---------------------------------------------------------------------------------------------------


def _windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The run of ORDER symbols from each byte on, as an integer of 9 bits a symbol; _PAD beyond the text."""
    ends = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes left in the text
    symbols = np.concatenate([data.astype(np.int64), np.zeros(ORDER, np.int64)])
    out = np.zeros(len(data), np.int64)
    for k in range(ORDER):
        out = (out << _BITS) | np.where(ends > k, symbols[k : k + len(data)], _PAD)
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def runs(windows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of 1 to ORDER bytes and their counts, from distinct windows in ascending order; run 0, the empty one, comes first."""
    keys, counts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    gram = np.zeros(len(windows), np.int64)
    for k in range(1, ORDER + 1):
        symbol = (windows >> (_BITS * (ORDER - k))) & ((1 << _BITS) - 1)
        gram = (gram << 8) | symbol
        inside = symbol < _PAD
        windows, gram, n = windows[inside], gram[inside], n[inside]
        if not len(gram):
            break
        first = np.flatnonzero(np.diff(gram, prepend=-1))
        keys.append((k << _LENGTH) | gram[first])
        counts.append(np.add.reduceat(n, first))
    return np.concatenate(keys), np.concatenate(counts)


def blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES, with_texts: bool = True) -> DataFrame:
    """(block, doc_id, t, run, n): the rows themselves under their block (run is null), and each block's runs with counts.

    rows: (doc_id, t). To be saved: the block of a row hangs on the order in which a task reads.
    """
    common.tune(rows.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 24, 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def rest(names: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(names, names=["block", "doc_id", "t", "run", "n"])

        def counted() -> pa.RecordBatch:
            keys, n = runs(*_merged(parts)) if parts else (np.zeros(1, np.int64), np.zeros(1, np.int64))
            return rest([pa.array(np.full(len(keys), block)), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.string()), pa.array(keys), pa.array(n)])

        for batch in batches:
            for low, high, data, offsets in common.pieces(batch.column(1)):
                if filled and filled + len(data) > block_bytes:
                    yield counted()
                    block, filled, parts, waiting = block + 1, 0, [], 0
                filled += len(data)
                if len(data):
                    keys, n = np.unique(_windows(data, offsets), return_counts=True)
                    parts.append((keys, n))
                    waiting += len(keys)
                    if waiting > 3_000_000:
                        parts = [_merged(parts)]
                        waiting = len(parts[0][0])
                if with_texts:
                    size = high - low
                    yield rest([pa.array(np.full(size, block)), batch.column(0).slice(low, size), batch.column(1).slice(low, size), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())])
        if parts:
            yield counted()

    return rows.mapInArrow(walk, "block long, doc_id long, t string, run long, n long")


def model(counted: DataFrame) -> DataFrame:
    """(run, n, total, followers): counts of the corpus' runs, and what they are as contexts (null: nothing follows).

    counted: (run, n), saved.
    """
    own = counted.groupBy("run").agg(F.sum("n").alias("n"))
    k = F.shiftright("run", _LENGTH)
    context = F.when(k <= 1, F.lit(0).cast("long")).otherwise(F.shiftleft(k - 1, _LENGTH).bitwiseOR(F.shiftright(F.col("run").bitwiseAND((1 << _LENGTH) - 1), 8)))
    contexts = own.where(k > 0).groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("followers"))
    return own.join(contexts, F.col("run") == F.col("context"), "left").select("run", "n", "total", "followers")


# --- the automaton --------------------------------------------------------------------------------------------


@dataclass
class Automaton:
    """States are numbered by length of context, then by context; state 0 is the empty one and has an arc for each byte.

    Arcs lie in order of state and byte. bits has 256 bits a state, one for each byte that it has an arc for, and rank the
    number of arcs before each 64 of them, so an arc is found by counting bits.
    """

    fail: np.ndarray
    backoff: np.ndarray
    bits: np.ndarray
    rank: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow failure arcs until each state has an arc for its byte, and take that."""
        bit = np.left_shift(np.uint64(1), (byte & 63).astype(np.uint64))
        word = (state << 2) | (byte >> 6)
        have = self.bits[word]
        lost = np.flatnonzero((have & bit) == 0)
        total = None
        if len(lost):
            state, total = state.copy(), np.zeros(len(state))
            while len(lost):
                total[lost] += self.backoff[state[lost]]
                state[lost] = self.fail[state[lost]]
                word[lost] = (state[lost] << 2) | (byte[lost] >> 6)
                have[lost] = self.bits[word[lost]]
                lost = lost[(have[lost] & bit[lost]) == 0]
        at = self.rank[word] + np.bitwise_count(have & (bit - np.uint64(1)))
        return self.target[at], self.weight[at] if total is None else total + self.weight[at]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-probability of each text of a piece."""
        n, lead = len(data), ORDER - 1
        scores = np.zeros(len(offsets) - 1)
        if not n:
            return scores
        lanes = -(-n // _STRETCH)
        padded = np.zeros(lead + lanes * _STRETCH, np.uint8)
        padded[lead : lead + n] = data
        start = np.zeros(len(padded), bool)
        start[lead + offsets[:-1][offsets[:-1] < n]] = True
        shape, strides = (lanes, lead + _STRETCH), (_STRETCH, 1)
        byte = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, shape, strides).T)
        going = np.ascontiguousarray(~np.lib.stride_tricks.as_strided(start, shape, strides).T)
        out = np.empty((_STRETCH, lanes))
        state = np.zeros(lanes, np.int64)
        for t in range(lead + _STRETCH):
            state = state * going[t]  # a text begins at state 0
            state, weight = self._step(state, byte[t].astype(np.int64))
            if t >= lead:
                out[t - lead] = weight
        out = np.ascontiguousarray(out.T).ravel()[:n]
        some = np.flatnonzero(np.diff(offsets))
        # summed text by text, so that a text's neighbours in the piece don't touch its last digits
        scores[some] = np.add.reduceat(out, offsets[some])
        return scores


def build(run: np.ndarray, n: np.ndarray, total: np.ndarray, followers: np.ndarray, discount: float = DISCOUNT) -> Automaton:
    """The automaton of runs as in model(): of all of them, or of all substrings of some texts. total 0: not a context."""
    order = np.argsort(run)
    run, n, total, followers = run[order], n[order].astype(float), total[order].astype(float), followers[order].astype(float)
    cut = np.searchsorted(run, [k << _LENGTH for k in range(ORDER + 2)])
    level = [slice(cut[k], cut[k + 1]) for k in range(ORDER + 1)]
    gram = [run[level[k]] & ((1 << _LENGTH) - 1) for k in range(ORDER + 1)]
    whole = total[0] if len(run) and run[0] == 0 else 0.0
    p = np.full(256, (discount * followers[0] / whole if whole else 1.0) / 256)
    if whole:
        p[gram[1]] += (n[level[1]] - discount) / whole
    contexts, backoff = [np.zeros(1, np.int64)], [np.zeros(1)]
    grams, probability = [np.arange(256)], [p]
    for k in range(1, ORDER):
        is_context = total[level[k]] > 0
        held, whole = gram[k][is_context], total[level[k]][is_context]
        b = discount * followers[level[k]][is_context] / whole
        contexts.append(held)
        backoff.append(np.log(b))
        longer = gram[k + 1]
        at = np.searchsorted(held, longer >> 8)
        low = probability[-1][np.searchsorted(grams[-1], longer & ((1 << 8 * k) - 1))]
        grams.append(longer)
        probability.append((n[level[k + 1]] - discount) / whole[at] + b[at] * low)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])

    def state_of(g: np.ndarray, size: int) -> np.ndarray:
        """The state of the longest suffix, of at most `size` bytes, that is a context."""
        out = np.zeros(len(g), np.int64)
        todo = np.arange(len(g))
        for length in range(min(size, ORDER - 1), 0, -1):
            held = contexts[length]
            if not len(held) or not len(todo):
                continue
            key = g[todo] & ((1 << 8 * length) - 1)
            at = np.minimum(np.searchsorted(held, key), len(held) - 1)
            found = held[at] == key
            out[todo[found]] = base[length] + at[found]
            todo = todo[~found]
        return out

    fail = np.concatenate([state_of(c, length - 1) if length else np.zeros(1, np.int64) for length, c in enumerate(contexts)])
    arc = np.concatenate([(base[size] + np.searchsorted(contexts[size], g >> 8)) * 256 + (g & 255) for size, g in enumerate(grams)])
    target = np.concatenate([state_of(g, size + 1) for size, g in enumerate(grams)])
    bits = np.zeros(4 * base[-1], np.uint64)
    np.bitwise_or.at(bits, arc >> 6, np.left_shift(np.uint64(1), (arc & 63).astype(np.uint64)))
    return Automaton(fail, np.concatenate(backoff), bits, np.searchsorted(arc, np.arange(len(bits)) * 64), np.log(np.concatenate(probability)), target)


# --- scores ---------------------------------------------------------------------------------------------------


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].fill_null(0).combine_chunks().to_numpy(zero_copy_only=False)


def score(docs: DataFrame, corpus: DataFrame | None = None, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, log_prob, bits_per_byte), a row for each row of docs, under the model of all of corpus.

    Without corpus the model is that of docs: each text is then part of what it is measured by.
    """
    saved = common.Saved(docs.sparkSession, "lm")

    def chosen(df: DataFrame) -> DataFrame:
        return common.pick(df, doc_id=id_col, t=text_col).select(F.col("doc_id").cast("long"), F.col("t").cast("string"))

    laid = saved.put(blocks(chosen(docs), block_bytes), "blocks")
    own = laid.where("run is not null").select("block", "run", "n")
    counted = own if corpus is None else saved.put(blocks(chosen(corpus), block_bytes, False), "corpus").where("run is not null")
    known = saved.put(model(counted.select("run", "n")), "model")
    # a run is in a block once, so a run of all texts has as many rows here as there are blocks
    arcs = own.select("block", "run").toDF("at", "run").join(known, "run")

    def read(texts: pa.Table, reached: pa.Table) -> pa.Table:
        automaton = build(*(_numbers(reached, c) for c in ("run", "n", "total", "followers")), discount)
        made = []
        for batch in texts.combine_chunks().to_batches():
            for low, high, data, offsets in common.pieces(batch.column("t"), _PIECE):
                made.append(pa.table({"doc_id": batch.column("doc_id").slice(low, high - low), "n": pa.array(np.diff(offsets)), "lp": pa.array(automaton.score(data, offsets))}))
        return pa.concat_tables(made) if made else pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "lp": pa.array([], pa.float64())})

    texts = laid.where("run is null").select("block", "doc_id", "t")
    found = texts.groupBy("block").cogroup(arcs.groupBy("at")).applyInArrow(read, "doc_id long, n long, lp double")
    n, lp = F.col("n"), F.col("lp")
    return found.select("doc_id", n.alias("n_bytes"), F.round(lp, 3).alias("log_prob"), F.when(n > 0, F.round(-lp / n / math.log(2), 5)).alias("bits_per_byte"))
