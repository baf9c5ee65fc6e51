"""Mixing and packing against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from vellumspark.llm import mixing, packing


def slow_mix(rows, weights, targets, budget):
    """rows: (id, source, tokens), a text of so many w. Copies by id."""
    return slow_mix_texts([(i, "w " * n, s) for i, s, n in rows], weights, targets, budget)


def slow_mix_texts(rows, weights, targets, budget, seed=mixing.SEED):
    """rows: (id, text, source). Copies by id."""
    md5 = {i: hashlib.md5(t.encode()).hexdigest() for i, t, _ in rows}
    rows = [(i, s, len(t.split())) for i, t, s in rows]
    per = defaultdict(int)
    for _, s, n in rows:
        per[s] += n
    whole = sum(targets.get(s, 0) for s in per)
    out = {}
    for s, have in per.items():
        if not have or not targets.get(s):
            continue
        room = math.floor(budget * round(targets[s] / whole, 9))
        epochs, room = divmod(room, have)

        def key(i):
            u = (int(hashlib.md5(f"{seed}:{i}:{md5[i]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return -math.log(u) / weights.get(i, 1.0)

        own, run, going = sorted((key(i), i, n) for i, t, n in rows if t == s), 0, True
        for _, i, n in own:
            run += n
            going &= run <= room
            if epochs + going:
                out[i] = epochs + going
    return out


@pytest.mark.parametrize("ranges", [0, 1, 1024])
@pytest.mark.parametrize("budget", [0, 500, 5000, 20000])
def test_mix_is_the_plain_loop(spark, ranges, budget):
    rng = random.Random(budget)
    rows = [(k, rng.choice("aaaab"), rng.randint(0, 30)) for k in range(400)] + [(900, "zero", 0), (901, "untold", 5)]
    weights = {k: rng.choice([0.01, 0.2, 1.0, 3.0]) for k in range(0, 400, 2)}
    docs = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    w = spark.createDataFrame(list(weights.items()), "doc_id long, weight double")
    targets = {"a": 1.0, "b": 2.0, "zero": 1.0}
    got = mixing.sample(docs, w, targets, budget, ranges=ranges).collect()
    assert {r.doc_id: r.copies for r in got} == slow_mix(rows, weights, targets, budget)


def test_heavier_documents_come_first(spark):
    docs = spark.createDataFrame([(k, "s", "w") for k in range(2000)], "doc_id long, source string, text string")
    w = spark.createDataFrame([(k, 4.0 if k % 2 else 1.0) for k in range(2000)], "doc_id long, weight double")
    got = mixing.sample(docs, w, {"s": 1.0}, 400).collect()
    odd = sum(r.doc_id % 2 for r in got)
    assert len(got) == 400 and 0.7 < odd / 400 < 0.9


def test_mix_awkward(awkward, crowded, empty, spark):
    w = spark.createDataFrame([(1, 0.0), (7, None), (None, 1.0), (8, -3.0)], "doc_id long, weight double")
    got = mixing.sample(awkward, w, {"a": 1.0, "b": 1.0, "c": 1.0, "": 1.0}, 10**5).collect()
    assert sorted(map(str, mixing.sample(crowded, w, {"a": 1.0, "b": 1.0, "c": 1.0, "": 1.0}, 10**5).collect())) == sorted(map(str, got))
    done = mixing.mix_documents(crowded, w, budget_tokens=10**6)
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert done.count() > awkward.count()
    assert mixing.sample(empty, w).count() == mixing.mix_documents(empty, w).count() == 0


def test_ranges_are_even_for_every_weight(spark):
    from pyspark.sql import functions as F

    drawn = spark.range(20_000).select(F.lit("s").alias("s"), F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.lit("h").alias("h"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("m"))
    for weight in (100.0, 1.0, 0.1, 0.01, 1e-6):
        key = -F.log(mixing.draw(F.col("doc_id"), F.col("h"), 1)) / weight
        most = drawn.select(F.floor(F.log(key) * mixing.RANGES).alias("r")).groupBy("r").count().agg(F.max("count")).first()[0]
        assert most <= 30


def test_repeated_rows_stay_within_the_budget(spark):
    """A third of all rows are one row, another third one id with texts of its own, and some have no id."""
    rows = [(7, "same words here", "en", "s", 1)] * 100 + [(8, "text w" + " w" * (k % 9) + str(k), "en", "s", 1) for k in range(100)] + [(None, f"no id {k}", "en", "s", 1) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, weight double")
    whole = sum(len(r[1].split()) for r in rows)
    for budget in (0, 50, 301, whole - 1, whole, whole + 77, 3 * whole):
        got = Counter((r.doc_id, r.text) for r in mixing.mix_documents(docs, none, targets={"s": 1.0}, budget_tokens=budget).collect())
        taken = sum(len(t.split()) * n for (_, t), n in got.items())
        assert taken <= budget and taken >= budget - 300 - 20
        assert got[(7, "same words here")] % 100 == 0


def test_copies_are_rows(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "a", 7), (2, "x", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    w = spark.createDataFrame([], "doc_id long, weight double")
    got = Counter(r.doc_id for r in mixing.mix_documents(docs, w, targets={"a": 1.0, "b": 1.0}, budget_tokens=8).collect())
    assert got == {1: 2, 2: 4}


def test_label_weights(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.weight for r in mixing.label_weights(labels).collect()}
    assert got == pytest.approx({1: 2.0, 2: 0.5, 3: 0.05, 4: 1.0})


# --- packing --------------------------------------------------------------------------------------------------

SIZES = st.lists(st.integers(1, 40), max_size=60)


@settings(max_examples=120, deadline=None)
@given(SIZES)
def test_packing_is_sound_and_locally_best(sizes):
    first = packing.best_fit(sizes, 40)
    bins = packing.local_search([list(b) for b in first], sizes, 40)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    fill = [sum(sizes[k] for k in b) for b in bins]
    assert all(0 < f <= 40 for f in fill)
    square = lambda bs: sum(sum(sizes[k] for k in b) ** 2 for b in bs)
    assert len(bins) <= len(first) and square(bins) >= square(first)
    # no move, one-for-one or two-for-one between underfull bins helps any more
    for a in range(len(bins)):
        for b in range(len(bins)):
            if a == b or fill[a] == 40 or fill[b] == 40 or fill[a] < fill[b]:
                continue
            ones = lambda x: [(), *[(k,) for k in x], *[(i, j) for i in x for j in x if i < j]]
            for out in ones(bins[a]):
                for into in ones(bins[b]):
                    if (len(out), len(into)) not in ((0, 1), (1, 1), (1, 2), (2, 1)):
                        continue
                    shift = sum(sizes[k] for k in into) - sum(sizes[k] for k in out)
                    assert not (0 < shift <= 40 - fill[a]), (bins[a], bins[b], out, into)


def slow_best_fit(sizes, capacity):
    bins, room = [], []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(room[b], b) for b in range(len(bins)) if room[b] >= sizes[k]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(k)
        room[b] -= sizes[k]
    return bins


@settings(max_examples=80, deadline=None)
@given(SIZES)
def test_best_fit_is_the_plain_loop(sizes):
    assert packing.best_fit(sizes, 40) == slow_best_fit(sizes, 40)


def test_packed_documents_come_back(spark):
    sizes = {k: (k * 37) % 150 for k in range(300)} | {1000: 1000}
    docs = spark.createDataFrame([(k, "w " * n) for k, n in sizes.items()], "doc_id long, text string")
    for shard_bins in (4, 1000):
        got = packing.pack(docs, 100, shard_bins).collect()
        by_bin, by_doc = defaultdict(list), defaultdict(list)
        for r in got:
            by_bin[r.bin_id].append(r)
            by_doc[r.doc_id].append(r)
        assert max(sum(r.n_tokens for r in b) for b in by_bin.values()) <= 100
        assert all(sorted(r.place for r in b) == list(range(len(b))) for b in by_bin.values())
        for k, n in sizes.items():
            spans = sorted((r.first_token, r.n_tokens) for r in by_doc[k])
            assert sum(x for _, x in spans) == n and [s for s, _ in spans] == [100 * j for j in range(len(spans))]
    assert len(by_bin) <= -(-sum(sizes.values()) // 100) + 1


def test_pack_awkward(awkward, crowded, empty):
    got = sorted(map(str, packing.pack(awkward).collect()))
    assert sorted(map(str, packing.pack(crowded).collect())) == got and packing.pack(empty).count() == 0
    rows = packing.pack(awkward).collect()
    assert {r.copy for r in rows if r.doc_id == 6} == {0, 1} and not [r for r in rows if r.doc_id in (2, 3, 4)]
    assert sum(r.n_tokens for r in rows if r.doc_id == 10) == len(prose(10, 30000).split())
    with pytest.raises(ValueError):
        packing.pack(awkward, 0)


def test_rows_without_an_id_or_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(None, "w " * (1 + k % 90)) for k in range(2000)] + [(5, "w " * (1 + k % 70)) for k in range(1000)], "doc_id long, text string")
    rows = packing.pack(docs, 100, 20).collect()
    shards = Counter(r.bin_id >> 32 for r in rows)
    assert len(shards) > 40 and max(shards.values()) < 200
    for i, n in ((None, 2000), (5, 1000)):
        assert sorted({r.copy for r in rows if r.doc_id == i}) == list(range(n))
    fill = Counter()
    for r in rows:
        fill[r.bin_id] += r.n_tokens
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(1 + k % 90 for k in range(2000)) + sum(1 + k % 70 for k in range(1000))


def test_steps_into_the_emptier_bin():
    sizes = [5] * 12 + [59]
    done = packing.local_search([list(range(12)), [12]], sizes, 100)
    assert sorted(sum(sizes[k] for k in b) for b in done) == [20, 99]
