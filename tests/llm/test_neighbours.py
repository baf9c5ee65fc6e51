"""Recall against brute force, exact distances, and rows that can't be searched."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import neighbours as nn


def brute(x, ids, k):
    out = {}
    for a in range(len(x)):
        d = np.sqrt(((x - x[a]) ** 2).sum(1))
        order = sorted((b for b in range(len(x)) if b != a), key=lambda b: (d[b], ids[b]))[:k]
        out[ids[a]] = [(ids[b], round(float(d[b]), 6)) for b in order]
    return out


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<float>")


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
    return out


@pytest.mark.parametrize("kind", ["uniform", "clusters", "scaled"])
def test_recall(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 64))
    if kind == "uniform":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "clusters":
        x = x * 0.1 + rng.normal(size=(12, 64))[rng.integers(0, 12, 1500)]
    else:
        x = x * 500 + 1000
    x = x.astype(np.float32).astype(float)
    want, got = brute(x, list(range(1500)), 10), listed(nn.neighbours(frame(spark, x)))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    assert hits / 15000 >= 0.9
    exact = {q: dict(v) for q, v in brute(x, list(range(1500)), 1499).items()}
    assert all(abs(d - exact[q][i]) < 1e-5 * max(1, d) for q, v in list(got.items())[:50] for i, d in v)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, size):
    rows = sorted(spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    want, got = brute(x, ids, 10), listed(nn.neighbours(frame(spark, x, ids)))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    assert hits / (10 * len(ids)) >= 0.94


def test_layout_does_not_matter(spark):
    x = np.random.default_rng(1).normal(size=(400, 8))
    one = listed(nn.neighbours(frame(spark, x), k=5))
    assert one == listed(nn.neighbours(frame(spark, x), k=5, block_rows=20))


def test_all_probes_are_exact(spark):
    x = np.random.default_rng(2).normal(size=(200, 6)).astype(np.float32).astype(float)
    got = listed(nn.neighbours(frame(spark, x), k=4, tables=1, hashes=1, probes=3, width=50.0))
    want = brute(x, list(range(200)), 4)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_probe_order_is_by_cost():
    place = np.random.default_rng(3).uniform(size=(20, 3))
    moves = nn.probe_order(place, 27)
    for p, m in zip(place, moves, strict=True):
        cost = [sum(x**2 if d < 0 else (1 - x) ** 2 if d > 0 else 0 for x, d in zip(p, row, strict=True)) for row in m]
        assert cost == sorted(cost) and not m[0].any() and len({tuple(r) for r in m}) == 27


def test_ties_repeats_and_bad_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (3, [9.0, 9.0]), (4, [1.0, 0.0]), (None, [0.0, 0.0]), (5, None), (6, []), (7, [float("nan"), 0.0]), (8, [None, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = listed(nn.neighbours(df, k=2))
    assert got[1] == [(2, 0.0), (3, 0.0)] and got[3] == [(1, 0.0), (2, 0.0)] and set(got) <= {1, 2, 3, 4}
    wide = df.withColumns({c: F.lit("z") for c in ("id", "v", "t", "block", "code")})
    assert listed(nn.neighbours(wide.toDF(*[*wide.columns[:-1], "EMBEDDING"]), k=2)) == got
    assert nn.neighbours(df.where("false")).count() == 0 and nn.neighbours(df.where("vec_id = 5")).count() == 0
    assert nn.neighbours(df.where("vec_id = 1")).count() == 0
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(40)], "vec_id long, embedding array<float>")
    assert [i for i, _ in listed(nn.neighbours(same, k=3))[20]] == [0, 1, 2]


def test_queries_are_a_stated_share_against_all_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    every, some = listed(nn.neighbours(df)), listed(nn.neighbours(df, every=20))
    assert some == {q: v for q, v in every.items() if q % 20 == 0} and len(some) == 100
