"""Scores against a plain model of the same smoothing, in any layout of blocks."""

import math
from collections import Counter

import numpy as np
import pytest

from vellumspark.llm import langmodel as lm

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "", None, "été", "the cat ate the rat " * 40, "zq", "the cat sat on the mat", "x" * 3000]


def plain_counts(texts):
    n = Counter()
    for t in texts:
        b = (t or "").encode()
        for k in range(1, lm.ORDER + 1):
            n.update(b[i : i + k] for i in range(len(b) - k + 1))
    return n


def plain_model(texts):
    n = plain_counts(texts)
    followed, followers = Counter(), Counter()
    for g, c in n.items():
        followed[g[:-1]] += c
        followers[g[:-1]] += 1

    def p(h, w):
        low = 1 / 256 if not h else p(h[1:], w)
        if h not in followed:
            return low
        own = max(n[h + w] - lm.DISCOUNT, 0) / followed[h]
        return own + lm.DISCOUNT * followers[h] / followed[h] * low

    return p


def plain_score(p, text):
    b = (text or "").encode()
    return sum(math.log(p(b[max(0, i - lm.ORDER + 1) : i], b[i : i + 1])) for i in range(len(b)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize("block_bytes", [lm.BLOCK_BYTES, 1, 60])
def test_scores_are_the_plain_model(docs, block_bytes):
    p = plain_model(TEXTS)
    assert sum(p(b"the ", bytes([w])) for w in range(256)) == pytest.approx(1)
    assert sum(p(b"qqqq", bytes([w])) for w in range(256)) == pytest.approx(1)
    got = {r.doc_id: r for r in lm.score(docs, block_bytes=block_bytes).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].log_prob == pytest.approx(plain_score(p, t), abs=6e-4), k
        assert got[k].n_bytes == len((t or "").encode())
    assert got[2].bits_per_byte is None and got[3].bits_per_byte is None


@pytest.mark.parametrize("block_bytes", [lm.BLOCK_BYTES, 1])
def test_other_texts_than_the_corpus(spark, docs, block_bytes):
    said = ["the unseen \x00 漢字 bat", "sat", "qz", "été zqx the cat sat on the xq mat"]
    other = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    p = plain_model(TEXTS)
    got = {r.doc_id: r.log_prob for r in lm.score(other, docs, block_bytes=block_bytes).collect()}
    for k, t in enumerate(said):
        assert got[k] == pytest.approx(plain_score(p, t), abs=6e-4), k


def test_layout_does_not_change_a_digit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    one = rows(lm.score(docs))
    assert one == rows(lm.score(docs.repartition(3), block_bytes=50_000))
    assert len(one) == docs.count()


def test_runs_are_counted(spark, docs):
    for frame, size in ((docs, lm.BLOCK_BYTES), (docs.repartition(5), 40)):
        rows = lm.blocks(frame.selectExpr("doc_id", "text as t"), size).where("run is not null").groupBy("run").sum("n").collect()
        got = {(r.run & (1 << 40) - 1).to_bytes(5, "big")[5 - (r.run >> 40) :]: r["sum(n)"] for r in rows if r.run}
        assert got == plain_counts(TEXTS)


def test_automaton_of_a_part_has_the_weights_of_the_whole():
    texts = [(t or "").encode() for t in TEXTS]
    made = lambda coded: (np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))

    def table(coded):
        return lm.runs(*np.unique(lm._windows(*made(coded)), return_counts=True))

    run, n = table(texts)
    stats = {}
    for r, c in zip(run[1:].tolist(), n[1:].tolist(), strict=True):
        k, g = r >> 40, r & (1 << 40) - 1
        total, d = stats.get(((k - 1) << 40 | g >> 8) if k > 1 else 0, (0, 0))
        stats[((k - 1) << 40 | g >> 8) if k > 1 else 0] = (total + c, d + 1)
    total, d = (np.array([stats.get(r, (0, 0))[j] for r in run.tolist()]) for j in (0, 1))
    whole = lm.build(run, n, total, d)
    for t in texts:
        keep = np.isin(run, table([t])[0])
        part = lm.build(run[keep], n[keep], total[keep], d[keep])
        assert part.score(*made([t])).tolist() == whole.score(*made([t])).tolist()
    assert np.isfinite(whole.score(*made([bytes(range(256)) * 5]))).all()


def test_awkward_rows(awkward, crowded, empty):
    got = sorted(map(str, lm.score(awkward).collect()))
    assert len(got) == awkward.count() and sorted(map(str, lm.score(crowded).collect())) == got
    assert lm.score(empty).count() == 0
    assert lm.score(awkward, empty).where("n_bytes > 0 and abs(bits_per_byte - 8) > 1e-4").count() == 0
