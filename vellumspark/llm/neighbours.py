"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by HASHES Gaussian projections, floor((a.v + b) / w), to a cell. Every row is
indexed; queries are the rows whose id is divisible by `every` (1: all of them). In each table a query visits its own cell and the perturbed cells (each coordinate less or more by one, or as it is) in
ascending estimated cost, the summed squared distance of its projections to the boundaries to be crossed: the order of
success probability for p-stable projections. PROBES cells are visited. All vectors of all visited cells are candidates;
their exact distances decide. w is WIDTH times the root mean squared distance of the vectors to their mean.

The work is laid out by blocks: rows of a table that share the first few coordinates of their cells, split by hash where
they are more than BLOCK_ROWS. A query goes once to each block that holds a cell it visits, and the block reports its K
nearest among the visited cells, which is all that the K nearest overall can need. The layout doesn't change the result.

Defined results: rows with null ids, null vectors, nulls or non-finite numbers in them, or a length that isn't the most
frequent one (the longer among equals), are left out. Of rows that repeat an id, the least vector counts. A vector isn't
its own neighbour, but equal vectors of other ids are, at distance 0. Ties go to the lesser id. A vector with fewer than K
candidates has fewer rows. Extra columns are ignored. No vectors give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 10
TABLES = 2
HASHES = 4
PROBES = 40
WIDTH = 2.0
BLOCK_ROWS = 8192
SEED = 20
_OFFSET = 1 << 9  # coordinates are kept as 10 bits


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dims)


def _projections(dims: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(tables, dims, hashes)), rng.uniform(size=(tables, hashes))


def probe_order(place: np.ndarray, probes: int) -> np.ndarray:
    """place: where in its cell (0..1) each query's projections lie. Perturbations (queries x probes x hashes), best first."""
    moves = np.array(list(itertools.product((0, -1, 1), repeat=place.shape[1])))
    cost = np.zeros((len(place), len(moves)))
    for j in range(place.shape[1]):
        cost += np.where(moves[:, j] < 0, place[:, j, None] ** 2, np.where(moves[:, j] > 0, (1 - place[:, j, None]) ** 2, 0))
    return moves[np.argsort(cost, axis=1, kind="stable")[:, :probes]]


def codes(cells: np.ndarray) -> np.ndarray:
    """Cells (... x hashes) as integers, ten bits a coordinate; far cells are folded, which can only add candidates."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for j in range(cells.shape[-1]):
        out = (out << 10) | ((cells[..., j] + _OFFSET) & 1023)
    return out


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of usable rows, one an id, and the vectors' length (0: there are none)."""
    rows = common.pick(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long"), F.col("v").cast("array<float>")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    best = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if best is None:
        return rows, 0
    return rows.where(F.size("v") == best["dims"]).groupBy("id").agg(F.min("v").alias("v")), best["dims"]


def _nearest(index: pa.Table, queries: pa.Table, dims: int, k: int) -> pa.Table:
    """The k nearest rows of index, among those in cells it visits, of each query."""
    ids, x = index["id"].to_numpy(), _matrix(index["v"].combine_chunks(), dims)
    cell_names, cell = np.unique(index["code"].to_numpy(), return_inverse=True)
    q_ids, q, visits = queries["id"].to_numpy(), _matrix(queries["v"].combine_chunks(), dims), queries["visits"].combine_chunks()
    found_q, found_i, found_d = [], [], []
    squares = (x.astype(np.float64) ** 2).sum(1)
    lengths = np.diff(visits.offsets.to_numpy())
    flat = visits.flatten().to_numpy()
    at = np.minimum(np.searchsorted(cell_names, flat), len(cell_names) - 1)
    owner = np.repeat(np.arange(len(q)), lengths)
    real = cell_names[at] == flat
    owner, at = owner[real], at[real]
    step = max(1, (4 << 20) // max(1, len(x)))
    for low in range(0, len(q), step):
        part = q[low : low + step]
        inside = np.zeros((len(part), len(cell_names)), bool)
        a, b = np.searchsorted(owner, [low, low + len(part)])
        inside[owner[a:b] - low, at[a:b]] = True
        own = (part.astype(np.float64) ** 2).sum(1)
        d = (squares.astype(np.float32)[None, :] + own.astype(np.float32)[:, None]) - 2 * (part @ x.T)
        d[~inside[:, cell]] = np.inf
        d[q_ids[low : low + step, None] == ids[None, :]] = np.inf
        # single precision finds who may be among the k nearest, with room for its error; the exact distances decide
        reach = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(part), np.inf, np.float32)
        slack = 1e-5 * (own + squares.max(initial=0.0)).astype(np.float32)
        r, c = np.nonzero((d <= (reach + slack)[:, None]) & np.isfinite(d))
        exact = ((part[r].astype(np.float64) - x[c].astype(np.float64)) ** 2).sum(1)
        order = np.lexsort((ids[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, r, "left")
        keep = np.arange(len(r)) - first < k
        found_q.append(q_ids[low + r[keep]])
        found_i.append(ids[c[keep]])
        found_d.append(np.sqrt(exact[keep]))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({"query_id": join(found_q, np.int64), "neighbour_id": join(found_i, np.int64), "d": join(found_d, np.float64)})


def neighbours(vectors: DataFrame, k: int = K, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, width: float = WIDTH, block_rows: int = BLOCK_ROWS, seed: int = SEED, every: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, neighbour_id, rank, distance): up to k neighbours, rank from 1, of every vector whose id `every` divides."""
    spark = vectors.sparkSession
    common.tune(spark)
    saved = common.Saved(spark, "neighbours")
    rows, dims = clean(vectors, id_col, vector_col)
    if not dims:
        return spark.createDataFrame([], "query_id long, neighbour_id long, rank int, distance double")
    rows = saved.put(rows, "vectors")
    # the spread of all vectors: mean of squared norms less squared norm of the mean; one row of dims + 2 numbers
    means = rows.agg(F.count("*").alias("n"), F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("sq"), *[F.avg(F.get("v", F.lit(j))).alias(f"m{j}") for j in range(dims)]).first()
    spread = max(means["sq"] - sum(means[f"m{j}"] ** 2 for j in range(dims)), 0.0) ** 0.5
    w = width * spread or 1.0
    a, b = _projections(dims, tables, hashes, seed)
    # leading coordinates of a cell that name a block: about three cells in use a coordinate
    lead = 0
    while lead < hashes and means["n"] > block_rows * 3**lead:
        lead += 1
    shift = 10 * (hashes - lead)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims).astype(np.float64)
            for t in range(tables):
                place = x @ a[t] / w + b[t]
                cell = np.floor(place).astype(np.int64)
                code = codes(cell)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code >> shift), batch.column(0), batch.column(1), pa.array(code)], names=["t", "block", "id", "v", "code"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims).astype(np.float64)
            for t in range(tables):
                place = x @ a[t] / w + b[t]
                cell = np.floor(place).astype(np.int64)
                visits = codes(cell[:, None, :] + probe_order(place - cell, probes))
                row = np.repeat(np.arange(len(x)), visits.shape[1])
                flat = visits.ravel()
                ranked = np.lexsort((flat, row))
                row, flat = row[ranked], flat[ranked]
                start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(flat >> shift, prepend=-1) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(flat)).astype(np.int32)), pa.array(flat))
                own = pa.array(row[start])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), t, np.int32)), pa.array(flat[start] >> shift), batch.column(0).take(own), batch.column(1).take(own), lists], names=["t", "block", "id", "v", "visits"])

    index = rows.mapInArrow(hashed, "t int, block long, id long, v array<float>, code long")
    # blocks are few beside the rows, but grow with them: Spark itself decides whether to broadcast their sizes
    sizes = saved.put(index.groupBy("t", "block").count().select("t", "block", F.ceil(F.col("count") / block_rows).cast("int").alias("parts")), "blocks")
    index = index.join(sizes, ["t", "block"]).select("t", "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v", "code")
    asked = rows if every == 1 else rows.where(F.col("id") % every == 0)
    queries = asked.mapInArrow(probed, "t int, block long, id long, v array<float>, visits array<long>").join(sizes, ["t", "block"])
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("t", "block", "part", "id", "v", "visits")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        return _nearest(left, right, dims, k)

    near = index.groupBy("t", "block", "part").cogroup(queries.groupBy("t", "block", "part")).applyInArrow(meet, "query_id long, neighbour_id long, d double")
    # a neighbour found in several tables has the same exact distance in each
    merged = near.groupBy("query_id", "neighbour_id").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "neighbour_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank", F.round("d", 6).alias("distance"))
