"""SimHash near-duplicates by exact comparison of tiles of fingerprints, in numpy.

A fingerprint has 192 bits in three words: each bit is the sign of the votes of the hashes of all distinct runs of three
words. Words are lower-cased runs of letters, digits, _ and bytes beyond ASCII. Two documents are linked if their
fingerprints differ in at most `radius` bits; classes are the connected components of that relation.

Pairs are found by windows, without loss: of two fingerprints within 44 bits one word differs in at most 14, and in that
word one of five parts in at most 2. So for each part rows are put in buckets by its bits, each bucket meets those within
two bits of its own, and a fifth of all pairs is compared, in one word; those within 14 there are compared in all. A pair
that several windows see counts in the first. Tiles are even, by hash; where a radius is so wide, or a tile so small, that
windows spare nothing, every pair of it is compared. Nothing is capped or sampled.

Equal fingerprints are folded before the comparison, so a hot text of thousands of copies costs one row there. Each pair of
tiles yields a spanning forest of its matches and a number of links by fingerprint, not the matches, so a large class of
copies costs linear output.

Defined results: classes() has a row for each id. Null, empty and blank texts are classes of their own without links, and
rows without an id have no row; deduplicate() keeps both. A text with no word but other characters is one shingle of its
own. A text of one or two words is one shingle. Rows that repeat a doc_id count as one document (of its texts that aren't
blank the least size, then the least fingerprint stands for it) and stay or go together. Ties: the least doc_id of a class
names it and stays. Extra columns are ignored by classes() and dropped by deduplicate(). No documents give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 44
WORDS = 3
SHINGLE = 3
#: Fingerprints in a tile, and tasks below which a pair of tiles is dealt out by windows. The layout doesn't change the result.
LEAST_TILE, MOST_TILE, LEAST_TASKS = 2048, 524288, 128

PRINT = tuple(f"fp_{k}" for k in range(WORDS))
_ROW = np.dtype([*((c, "<u8") for c in PRINT), ("id", "<i8"), ("copies", "<i8")])
#: Pairs looked at in one go, candidates of a row among them, and pairs held until they are confirmed.
_BLOCK, _WIDTH, _HELD = 1 << 16, 1 << 14, 1 << 16
#: Pairs of a block from which on numpy looks for them.
_FEW = 128
#: numpy's buffer, in elements: rows of fewer than half of it are copied there before they are broadcast, which takes longer than the work.
_BUFFER = 128
#: Parts of a word that are tried; three parts are of at most 22 bits, so that bounds of buckets stay small.
_PARTS = (0, 3, 4, 5, 6, 8)
#: For each byte, its bits as eight bytes of 0 or 1.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).copy().view(np.uint64).ravel()


_SALTS = (0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C)


def bits_of(keys: np.ndarray) -> np.ndarray:
    """The words of shingles' bits, a row a shingle; the first is the key itself."""
    return np.stack([keys, *(common.mix(keys ^ np.uint64(salt)) for salt in _SALTS)], axis=1)


def fingerprint(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a piece: fingerprints (documents x WORDS, uint64) and numbers of shingles; 0 shingles where a text is blank."""
    docs = len(offsets) - 1
    w = common.words(data, offsets)
    n_words = np.diff(w.first)
    keys, at = w.grams(SHINGLE)
    doc = w.doc()[at]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):  # all words of a short text are one shingle
        head = w.hash[w.first[short]]
        keys = np.concatenate([keys, common.mix(head * np.uint64(31) + np.where(n_words[short] > 1, w.hash[w.first[short] + n_words[short] - 1], 0).astype(np.uint64))])
        doc = np.concatenate([doc, short])
    bare = np.flatnonzero(n_words == 0)
    if len(bare):
        signs = common.words(data, offsets, common.NOT_BLANK)
        some = bare[np.diff(signs.first)[bare] > 0]
        if len(some):
            hashed = [np.bitwise_xor.reduce(common.mix(signs.hash[signs.first[d] : signs.first[d + 1]] + np.arange(signs.first[d + 1] - signs.first[d], dtype=np.uint64))) for d in some]
            keys, doc = np.concatenate([keys, np.array(hashed, np.uint64)]), np.concatenate([doc, some])
    # a shingle counts once in a document: the document's number in the piece goes into the key's high 16 bits
    room = np.uint64(48)
    keys = np.sort((doc.astype(np.uint64) << room) | (keys >> np.uint64(16)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]  # np.unique takes several times as long
    doc, keys = (keys >> room).astype(np.int64), common.mix(keys & ((np.uint64(1) << room) - np.uint64(1)))
    sizes = np.bincount(doc, minlength=docs)
    out = np.zeros((docs, WORDS), np.uint64)
    if not len(keys):
        return out, sizes
    first = np.concatenate([[0], np.cumsum(sizes)])
    # votes in bytes: a word of eight byte lanes for each byte of a shingle's bits, added up over at most 255 shingles, then over a document
    cuts = np.unique(np.concatenate([first[:-1][sizes > 0], *[np.arange(first[d], first[d + 1], 255) for d in np.flatnonzero(sizes > 255)]]))
    votes = np.zeros((len(cuts), 64 * WORDS), np.uint8)
    step = 512
    for low in range(0, len(cuts), step):
        a, b = cuts[low], cuts[low + step] if low + step < len(cuts) else len(keys)
        own = bits_of(keys[a:b])
        lanes = _SPREAD[own.view(np.uint8).reshape(len(own), 8 * WORDS)]
        votes[low : low + step] = np.add.reduceat(lanes, cuts[low : low + step] - a, axis=0).view(np.uint8)
    some = np.flatnonzero(sizes)
    total = np.add.reduceat(votes, np.searchsorted(cuts, first[some]), axis=0, dtype=np.int64)
    # a tie takes the bit of the shingle of least hash, so that ties don't lean one way
    least = np.minimum.reduceat(keys, first[some])
    tie = np.unpackbits(bits_of(least).view(np.uint8), axis=1)
    out[some] = np.packbits(total * 2 + tie > sizes[some][:, None], axis=1).view(np.uint64)
    return out, sizes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp_0, fp_1, fp_2, size) of each row that has an id; size 0 where the text is blank."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in common.pieces(common.lowered(batch.column(1))):
                prints, sizes = fingerprint(data, offsets)
                prints = prints.view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(prints[:, k].copy()) for k in range(WORDS)), pa.array(sizes.astype(np.int32))], names=["doc_id", *PRINT, "size"])

    chosen = common.pick(docs, i=id_col, t=text_col).select(F.col("i").cast("long"), F.col("t").cast("string")).where("i is not null")
    return chosen.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in PRINT)}, size int")


class Window(NamedTuple):
    """Pairs that differ in at most `most` bits of the words, and in at most `near` of the first word's `width` bits from `low` on."""

    words: tuple[int, ...]
    most: int
    low: int
    width: int
    near: int

    def keys(self, word: np.ndarray) -> np.ndarray:
        return (word >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)

    def sees(self, apart: np.ndarray) -> np.ndarray:
        """Of exclusive-ors of the first word."""
        return (np.bitwise_count(self.keys(apart)) <= self.near) & (np.bitwise_count(apart) <= self.most)


def _even(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


def windows(radius: int, rows: int, parts: int | None = None) -> list[Window]:
    """Windows of which at least one sees each pair within the radius; the number of parts of a word that is cheapest for tiles of that many rows.

    Bits that are dealt out, radius + 1 of them, leave some word with fewer than it was dealt, and in it some part: were
    all at theirs or more, the pair would be radius + 1 bits apart. 0 parts: one window that sees every pair.
    """
    if parts is None:
        return min((windows(radius, rows, n) for n in _PARTS), key=lambda found: _nanoseconds(found, rows))
    if not parts:
        return [Window((0, 1), radius, 0, 0, 0)]
    found = []
    for word, most in enumerate(_even(radius + 1, WORDS)):
        low = 0
        for width, near in zip(_even(64, parts), _even(most, parts), strict=True):
            if near:
                found.append(Window((word,), most - 1, low, width, near - 1))
            low += width
    return found


def _nanoseconds(found: list[Window], rows: int) -> float:
    """About what a tile of random fingerprints takes: for each filled bucket, its calls, its ball, its candidates and its pairs."""
    total = 0.0
    for w in found:
        filled, ball = min(1 << w.width, rows), sum(math.comb(w.width, k) for k in range(w.near + 1))
        others = ball * rows / (1 << w.width)
        total += filled * (60e3 + 10 * ball + 6 * others) + rows * others * 1.8 * len(w.words)
    return total


def ball(width: int, near: int) -> np.ndarray:
    """All values of that many bits of which at most `near` are set, 0 first."""
    return np.sort(np.concatenate([np.array([sum(1 << k for k in c) for c in combinations(range(width), n)], np.int64) for n in range(min(near, width) + 1)]))


def _places(flags: bytearray, n: int) -> np.ndarray:
    """Of the first n flags, places of those that are set. Few are looked for one by one, which numpy takes several times as long for."""
    found, at = [], flags.find(1, 0, n)
    while at >= 0:
        found.append(at)
        if len(found) == _FEW:
            return np.frombuffer(flags, bool, n).nonzero()[0]
        at = flags.find(1, at + 1, n)
    return np.array(found, np.int64)


def _matches(a: np.ndarray, b: np.ndarray, radius: int, same: bool, plan: list[Window], chosen: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) within the radius that a chosen window of the plan is the first to see; same: b is a, and each pair is reported once."""
    if not len(a) or not len(b):
        return
    side_a, side_b = ([np.ascontiguousarray(x[c]) for c in PRINT] for x in (a, b))
    work = np.empty(_BLOCK, np.uint64)
    count, more, flags = np.empty(_BLOCK, np.uint8), np.empty(_BLOCK, np.uint8), bytearray(_BLOCK)
    near = np.frombuffer(flags, bool)
    run = np.arange(len(b))

    def confirm(r: np.ndarray, s: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        for w in plan[:at]:
            fresh = ~w.sees(side_a[w.words[0]][r] ^ side_b[w.words[0]][s])
            r, s = r[fresh], s[fresh]
            if not len(r):
                return r, s
        good = sum(np.bitwise_count(x[r] ^ y[s]).astype(np.int64) for x, y in zip(side_a, side_b, strict=True)) <= radius
        return r[good], s[good]

    for at in chosen:
        w = plan[at]
        own, other = w.keys(side_a[w.words[0]]), w.keys(side_b[w.words[0]])
        order_a, order_b = (np.argsort(x.astype(np.uint16) if w.width <= 16 else x, kind="stable") for x in (own, other))  # 16 bits are sorted in linear time
        sorted_a, sorted_b = ([x[k][order] for k in w.words] for x, order in ((side_a, order_a), (side_b, order_b)))
        values, first = np.unique(own[order_a], return_index=True)
        bounds = np.searchsorted(other[order_b], np.arange((1 << w.width) + 1, dtype=np.uint64))
        around, most, hits, held = ball(w.width, w.near), np.uint8(w.most), [], 0
        for v, low, high in zip(values.astype(np.int64).tolist(), first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
            near_by = around ^ v
            if same:  # the value itself stays first
                near_by = near_by[near_by >= v]
            start = bounds[near_by]
            size = bounds[near_by + 1] - start
            ends = np.cumsum(size)
            total = int(ends[-1])
            if not total:
                continue
            place = np.repeat(start - ends + size, size) + run[:total]
            others = [x[place] for x in sorted_b]
            width = min(total, _WIDTH)
            step = max(1, _BLOCK // width)
            for i in range(low, high, step):
                k = min(step, high - i)
                for j in range(i - low if same else 0, total, width):
                    n = min(width, total - j)
                    x, c, m, hit = (z[: k * n].reshape(k, n) for z in (work, count, more, near))
                    np.bitwise_xor(sorted_a[0][i : i + k, None], others[0][j : j + n], out=x)
                    np.bitwise_count(x, out=c)
                    for mine, theirs in zip(sorted_a[1:], others[1:], strict=True):
                        np.bitwise_xor(mine[i : i + k, None], theirs[j : j + n], out=x)
                        np.bitwise_count(x, out=m)
                        np.add(c, m, out=c)
                    np.less_equal(c, most, out=hit)
                    flat = _places(flags, k * n)
                    if len(flat):
                        r, s = flat // n + i, place[flat % n + j]
                        if same:
                            r, s = r[s > r], s[s > r]
                        hits.append((r, s))
                        held += len(r)
                        if held >= _HELD:
                            yield confirm(order_a[np.concatenate([r for r, _ in hits])], order_b[np.concatenate([s for _, s in hits])], at)
                            hits, held = [], 0
        if held:
            yield confirm(order_a[np.concatenate([r for r, _ in hits])], order_b[np.concatenate([s for _, s in hits])], at)


def compare(a: np.ndarray, b: np.ndarray | None, radius: int, plan: list[Window] | None = None, chosen: Iterable[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tiles, or of one where b is None: star edges (id, least id) that span the matches, and (id, documents linked).

    Of the matches that the chosen windows of a plan are the first to see; all windows together count each match once.
    """
    plan = plan or windows(radius, len(a))
    chosen = range(len(plan)) if chosen is None else chosen
    if b is None:
        every, shift, found = a, 0, _matches(a, a, radius, True, plan, chosen)
    else:
        every, shift, found = np.concatenate([a, b]), len(a), _matches(a, b, radius, False, plan, chosen)
    ranked = np.argsort(every["id"], kind="stable")  # the forest's roots are least places, so places follow ids
    place = np.empty(len(every), np.int64)
    place[ranked] = np.arange(len(every))
    links = np.zeros(len(every), np.int64)
    forest = common.Forest(len(every))
    usual = np.setbufsize(_BUFFER)
    try:
        for r, s in found:
            s = s + shift
            np.add.at(links, r, every["copies"][s])
            np.add.at(links, s, every["copies"][r])
            forest.link(place[r], place[s])
    finally:
        np.setbufsize(usual)
    root = forest.find(np.arange(len(every)))
    keep = np.flatnonzero(root != np.arange(len(every)))
    ids = every["id"][ranked]
    linked = np.flatnonzero(links)
    return ids[keep], ids[root[keep]], every["id"][linked], links[linked]


def pair_links(prints: DataFrame, radius: int = RADIUS, tile_rows: int | None = None) -> DataFrame:
    """(u, v, links): edges whose components are those of all near pairs, and rows without v that number u's links.

    prints: (id, fp_0, fp_1, fp_2, copies), one row a fingerprint, saved.
    """
    spark = prints.sparkSession
    rows = prints.count()
    if not rows:
        return spark.createDataFrame([], "u long, v long, links long")
    plan = windows(radius, min(rows, tile_rows or MOST_TILE))
    if not tile_rows:  # without buckets the number of tiles alone makes the tasks
        tile_rows = MOST_TILE if plan[0].width else min(MOST_TILE // 4, max(LEAST_TILE, rows // 16))
    n_tiles = -(-rows // tile_rows)
    n_pairs = n_tiles * (n_tiles + 1) // 2
    slices = min(len(plan), -(-LEAST_TASKS // n_pairs)) if tile_rows > LEAST_TILE and rows > LEAST_TILE else 1
    # the pairs are made in Spark: the driver holds nothing of their number
    pairs = spark.range(n_tiles).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(n_tiles - 1).cast("long"))).alias("j"))
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).withColumn("pair", (F.col("i") * n_tiles + F.col("j")) * slices + F.col("slice"))
    pairs = pairs.withColumn("same", F.col("i") == F.col("j"))
    sides = pairs.select(F.col("i").alias("tile"), "pair", "slice", "same", F.lit(0).alias("side")).unionByName(pairs.where("not same").select(F.col("j").alias("tile"), "pair", "slice", "same", F.lit(1).alias("side")))
    tiled = prints.select(F.pmod(F.xxhash64(*PRINT), F.lit(n_tiles)).cast("long").alias("tile"), *PRINT, "id", "copies")

    def pack(table: pa.Table) -> pa.Table:
        rows = np.empty(len(table), _ROW)
        for name in _ROW.names:
            rows[name] = table[name].to_numpy().view(_ROW[name])
        return pa.table({"tile": table["tile"][:1], "rows": pa.array([rows.tobytes()], pa.binary())})

    packed = tiled.groupBy("tile").applyInArrow(pack, "tile long, rows binary")

    def meet(table: pa.Table) -> pa.Table:
        found = dict(zip(table["side"].to_pylist(), table["rows"], strict=True))
        # a tile that no fingerprint fell into has no row
        a, b = (np.frombuffer(found[s].as_buffer(), _ROW) if s in found else np.empty(0, _ROW) for s in (0, 1))
        u, v, linked, links = compare(a, None if table["same"][0].as_py() else b, radius, plan, range(table["slice"][0].as_py(), len(plan), slices))
        return pa.table({"u": pa.array(np.concatenate([u, linked])), "v": pa.concat_arrays([pa.array(v), pa.nulls(len(linked), pa.int64())]), "links": pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(links)])})

    # a task per pair or few: the comparison is the work here, so the number is asked for and not left to row sizes
    tasks = min(n_pairs * slices, 4096)
    return packed.join(sides, "tile").select("pair", "slice", "same", "side", "rows").repartition(tasks, "pair").groupBy("pair").applyInArrow(meet, "u long, v long, links long")


def classes(docs: DataFrame, radius: int = RADIUS, tile_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): every document, the least id of its class, and the number of documents within the radius."""
    saved = common.Saved(docs.sparkSession, "simhash")
    own = fingerprints(docs, id_col, text_col).groupBy("doc_id").agg(F.min(F.struct((F.col("size") == 0).alias("blank"), "size", *PRINT)).alias("p")).select("doc_id", "p.*")
    own = saved.put(own, "prints")
    # texts that are blank are told apart from a fingerprint of zeros
    folded = saved.put(own.where("not blank").groupBy(*PRINT).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "folded")
    found = saved.put(pair_links(folded, radius, tile_rows), "links")
    groups = common.components(found.where("v is not null").select("u", "v"), saved)
    links = found.where("v is null").groupBy(F.col("u").alias("l_id")).agg(F.sum("links").alias("links"))
    # each fingerprint's class and links, at its own size, then a join by fingerprint: a hot one has a row a document there
    judged = folded.join(groups, F.col("id") == F.col("u"), "left").join(links, F.col("id") == F.col("l_id"), "left")
    judged = judged.select(*PRINT, F.coalesce("v", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = own.where("not blank").join(judged, list(PRINT)).select("doc_id", "class_id", "n_links")
    return whole.unionByName(own.where("blank").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


#: Ids of documents that go, in bytes, up to which they are broadcast; more of them are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs, one document of each class: the columns of documents, texts as they were."""
    saved = common.Saved(docs.sparkSession, "dropped")
    gone = saved.put(classes(docs, **options).where("doc_id <> class_id").select("doc_id"), "gone")
    small = gone.count() * 16 <= BROADCAST_BYTES
    return common.documents(docs).join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
