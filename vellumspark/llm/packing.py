"""Best-fit packing of documents into training sequences, mended by a swap-based local search.

Documents are cut into full sequences of `capacity` tokens and a rest; full pieces are bins of their own. Rests are
packed by best fit, longest first. Then the local search works on the bins that aren't full: it moves a rest to another
bin, exchanges one for one, or two for one, whenever that increases the sum of squared fills, until bins are empty or no
such step is left: the fuller bin grows, or the emptier one by more than the fuller one's lead. Every step raises the sum,
which is bounded, so the search ends by itself; there is no limit on steps.

Packing is done shard by shard: a row's shard is a hash of its id and of its place in the saved table of lengths, so rows
without an id, or of one id, lie in all shards. There are as many shards as the tokens ask for, so a shard has about
`shard_bins` bins at any size of the data. At most one bin a shard is left that a whole-corpus packing could save, less than 1
in shard_bins.

Tokens are runs of characters other than white space. Defined results: null and empty texts have no tokens and no row.
Documents without an id are packed under a null id. Rows that repeat an id are packed each, told apart by `copy` (0, 1,
...). Ties in length go by id, then copy. Which bin a row is in hangs on the order in which the table is read; a bin is never
overfull, and no row is lost. Extra columns are ignored. No documents give no bins.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, mixing

CAPACITY = 2048
SHARD_BINS = 1024


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in sizes: each, longest first, goes to the fullest bin that has room; ties to the oldest bin."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, bin), ascending
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(free, (sizes[k], -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        if room > sizes[k]:
            bisect.insort(free, (room - sizes[k], b))
    return bins


def _step(fuller: list[int], other: list[int], sizes: list[int], room: int, lead: int) -> tuple[list[int], list[int]] | None:
    """The best move or exchange that brings 1 to `room` tokens into the first bin: (out of it, out of the other).

    lead: fill of the first bin less that of the other; where it is below 0, more than that must be brought. The gain rises with the tokens moved, so the best is
    the greatest transfer. Among equals, a move before one-for-one before two-for-one before one-for-two.
    """
    best, found = 0, None

    def offer(shift: int, out: list[int], into: list[int]) -> None:
        nonlocal best, found
        if best < shift <= room and lead + shift > 0:
            best, found = shift, (out, into)

    into = sorted((sizes[k], k) for k in other)
    out = sorted((sizes[k], k) for k in fuller)
    into_sizes, out_sizes = [s for s, _ in into], [s for s, _ in out]

    def greatest(pool: list[tuple[int, int]], keys: list[int], most: int, apart: int | None = None) -> tuple[int, int] | None:
        at = bisect.bisect_right(keys, most) - 1
        if at >= 0 and pool[at][1] == apart:
            at -= 1
        return pool[at] if at >= 0 else None

    if (one := greatest(into, into_sizes, room)) is not None:
        offer(one[0], [], [one[1]])
    for s, k in out:  # one for one
        if best == room:
            return found
        if (one := greatest(into, into_sizes, room + s)) is not None:
            offer(one[0] - s, [k], [one[1]])
    for s, k in out:  # two of the other bin for one of this
        for t, j in into:
            if best == room:
                return found
            if (one := greatest(into, into_sizes, room + s - t, j)) is not None:
                offer(one[0] + t - s, [k], [j, one[1]])
    for t, j in into:  # one of the other bin for two of this
        for s, k in out:
            if best == room:
                return found
            # the pair's sum is to be at least t - room and as near to that as can be
            at = bisect.bisect_left(out_sizes, t - room - s)
            if at < len(out) and out[at][1] == k:
                at += 1
            if at < len(out):
                offer(t - s - out[at][0], [k, out[at][1]], [j])
    return found


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills until no move or exchange between two underfull bins does; drop empty bins."""
    fill = [sum(sizes[k] for k in b) for b in bins]
    stamp = [0] * len(bins)
    tried: dict[tuple[int, int], tuple[int, int]] = {}
    moved = True
    while moved:
        moved = False
        open_bins = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (fill[k], k))
        for other in open_bins:  # emptiest first: it is the one to be emptied
            for fuller in reversed(open_bins):
                if fuller == other or fill[fuller] < fill[other] or not 0 < fill[fuller] < capacity or not fill[other]:
                    continue
                pair = (min(fuller, other), max(fuller, other))
                state = (stamp[pair[0]], stamp[pair[1]])
                if tried.get(pair) == state:
                    continue
                step = _step(bins[fuller], bins[other], sizes, capacity - fill[fuller], fill[fuller] - fill[other])
                if step is None:  # the other way, if the emptier bin can overtake
                    back = _step(bins[other], bins[fuller], sizes, capacity - fill[other], fill[other] - fill[fuller])
                    step = back and (back[1], back[0])
                if step is None:
                    tried[pair] = state
                    continue
                out, into = step
                bins[fuller] = [k for k in bins[fuller] if k not in out] + into
                bins[other] = [k for k in bins[other] if k not in into] + out
                shift = sum(sizes[k] for k in into) - sum(sizes[k] for k in out)
                fill[fuller] += shift
                fill[other] -= shift
                stamp[fuller] += 1
                stamp[other] += 1
                moved = True
    return [b for b in bins if b]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_bins: int = SHARD_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, place, doc_id, copy, first_token, n_tokens): a row for each piece, in its place in its bin."""
    if capacity < 1 or shard_bins < 1:
        raise ValueError("capacity and shard_bins must be 1 or more")
    rows = common.pick(docs, doc_id=id_col, t=text_col).select(F.col("doc_id").cast("long"), mixing.tokens(F.col("t").cast("string")).alias("n")).where("n > 0")
    # lengths are a few bytes a document: saved, so that the texts are read once and a row keeps its place
    rows = common.Saved(docs.sparkSession, "packing").put(rows.withColumn("at", F.monotonically_increasing_id()), "lengths")
    total = F.broadcast(rows.agg(F.ceil(F.sum("n") / F.lit(float(capacity) * shard_bins)).cast("long").alias("shards")))
    rows = rows.crossJoin(total).select("doc_id", "n", "at", F.pmod(F.xxhash64("doc_id", "at"), "shards").alias("shard"))
    # copies are numbered over the shards: a hot id has a row a shard here, whatever its rows are
    before = F.sum("count").over(Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    ahead = rows.groupBy("shard", "doc_id").count().withColumn("before", before).where("before > 0").select("shard", "doc_id", "before").toDF("in_shard", "of", "before")

    def numbered(table: pa.Table, ahead: pa.Table) -> pa.Table:
        """The shard's rows by id and length, with copy: their number among those of their id."""
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("at", "ascending")])
        # a null id is told from the number that stands in its place
        told = lambda c: (c.fill_null(0).to_numpy(), c.is_null().to_numpy())
        ids, empty = told(table["doc_id"])
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (empty[1:] != empty[:-1])]))
        copy = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        earlier = dict(zip(zip(*(x.tolist() for x in told(ahead["of"])), strict=True), ahead["before"].to_pylist(), strict=True))
        if earlier:
            offset = np.array([earlier.get(k, 0) for k in zip(ids[first].tolist(), empty[first].tolist(), strict=True)])
            copy = copy + np.repeat(offset, np.diff(np.append(first, len(ids))))
        return table.append_column("copy", pa.array(copy))

    def run(table: pa.Table, ahead: pa.Table) -> pa.Table:
        table = numbered(table, ahead)
        n = table["n"].to_numpy()
        full, rest = n // capacity, n % capacity
        owner = np.repeat(np.arange(len(n)), full)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        of = np.flatnonzero(rest)
        bins = pack_sizes([int(x) for x in rest[of]], capacity)
        order = [k for b in bins for k in sorted(b)]
        at = of[order] if order else np.zeros(0, np.int64)
        row = np.concatenate([owner, at]).astype(np.int64)
        counts = [len(b) for b in bins]
        number = np.concatenate([np.arange(len(owner)), len(owner) + np.repeat(np.arange(len(bins)), counts)]).astype(np.int64)
        place = np.concatenate([np.zeros(len(owner), int), *[np.arange(c) for c in counts]]).astype(np.int32)
        shard = table["shard"][0].as_py()
        return pa.table(
            {
                "bin_id": pa.array(number + (shard << 32)),
                "place": pa.array(place),
                "doc_id": table["doc_id"].take(pa.array(row)),
                "copy": table["copy"].take(pa.array(row)),
                "first_token": pa.array(np.concatenate([part * capacity, full[at] * capacity]).astype(np.int64)),
                "n_tokens": pa.array(np.concatenate([np.full(len(owner), capacity), rest[at]]).astype(np.int64)),
            }
        )

    return rows.groupBy("shard").cogroup(ahead.groupBy("in_shard")).applyInArrow(run, "bin_id long, place int, doc_id long, copy long, first_token long, n_tokens long")
