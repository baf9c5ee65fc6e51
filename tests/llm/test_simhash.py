"""Near copies: fingerprints and groups against brute force."""

import random

import numpy as np
import pytest

from tests.llm.conftest import WORDS, prose
from vellumspark.llm import common, simhash


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def slow_classes(ids, prints, radius):
    """(least id of its class, number of links) of each document, by comparing all pairs."""
    parent, links = {i: i for i in ids}, {i: 0 for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            apart = int(np.bitwise_count(prints[a] ^ prints[b]).sum())
            if apart <= radius:
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: (find(i), links[i]) for i in ids}


def random_rows(n, near, seed):
    """Fingerprints at random, the last ones some bits away from the first ones; near: how many bits, for each."""
    rng = np.random.default_rng(seed)
    rows = np.empty(n, simhash._ROW)
    for c in simhash.PRINT:
        rows[c] = rng.integers(0, 2**64, n, dtype=np.uint64)
    rows["id"], rows["copies"] = rng.permutation(n), rng.integers(1, 3, n)
    for k, bits in enumerate(near):
        for bit in rng.choice(192, bits, replace=False).tolist():
            rows[simhash.PRINT[bit // 64]][k] ^= np.uint64(1 << bit % 64)
        for c in simhash.PRINT:
            rows[c][n - 1 - k] = rows[c][k]
        for bit in rng.choice(192, bits, replace=False).tolist():
            rows[simhash.PRINT[bit // 64]][n - 1 - k] ^= np.uint64(1 << bit % 64)
    return rows


def slow_pairs(rows, radius):
    """Places of all pairs within the radius."""
    for k in range(len(rows)):
        apart = sum(np.bitwise_count(rows[c][k] ^ rows[c][k + 1 :]).astype(int) for c in simhash.PRINT)
        yield from ((k, k + 1 + int(j)) for j in np.flatnonzero(apart <= radius))


def slow_links(rows, radius):
    out = {}
    for p in slow_pairs(rows, radius):
        for a, b in (p, p[::-1]):
            out[int(rows["id"][a])] = out.get(int(rows["id"][a]), 0) + int(rows["copies"][b])
    return out


@pytest.mark.parametrize("radius", [0, 10, 44, 60])
def test_windows_lose_no_pair_and_count_each_once(radius):
    """For each number of parts; all windows at once, one by one, and between two tiles."""
    rows = random_rows(1400, [*range(1, 64)] * 5, radius)
    rows = rows[np.unique(rows[list(simhash.PRINT)], return_index=True)[1]]
    want = slow_links(rows, radius)
    across = {p for p in slow_pairs(rows, radius) if p[0] < 700 <= p[1]}
    assert radius == 0 or len(want) > 40
    for parts in simhash._PARTS if radius <= 44 else (0, 5, 8):  # wide balls take long
        plan = simhash.windows(radius, len(rows), parts)
        u, v, ids, links = simhash.compare(rows, None, radius, plan)
        assert dict(zip(ids.tolist(), links.tolist(), strict=True)) == want
        total = {}
        for k in range(len(plan)):
            _, _, ids, links = simhash.compare(rows, None, radius, plan, [k])
            for i, n in zip(ids.tolist(), links.tolist(), strict=True):
                total[i] = total.get(i, 0) + n
        assert total == want
        found = [p for r, s in simhash._matches(rows[:700], rows[700:], radius, False, plan, range(len(plan))) for p in zip(r.tolist(), (s + 700).tolist(), strict=True)]
        assert len(found) == len(across) and set(found) == across


def test_most_pairs_are_not_looked_at(monkeypatch):
    """Fewer words are compared than there are pairs; in large tiles a fifth of them."""
    rows, taken, count = random_rows(40_000, [30] * 20, 5), [0], np.bitwise_count

    def counted(x, *args, **kwargs):
        taken[0] += np.size(x)
        return count(x, *args, **kwargs)

    monkeypatch.setattr(np, "bitwise_count", counted)
    ids = simhash.compare(rows, None, simhash.RADIUS)[2]
    assert taken[0] < len(rows) ** 2 / 2 and len(ids) >= 10
    assert sum(len(simhash.ball(w.width, w.near)) / 2**w.width for w in simhash.windows(simhash.RADIUS, simhash.MOST_TILE)) < 0.2


@pytest.mark.parametrize("tile_rows", [7, None])
def test_classes_through_windows_are_brute_force(spark, monkeypatch, tile_rows):
    """Small tables compare all pairs; here they go through buckets too. Of tiles of 7 some may be empty."""
    plan = simhash.windows(simhash.RADIUS, 1, 5)
    monkeypatch.setattr(simhash, "windows", lambda *_: plan)
    texts = [prose(k % 20, 40) if k < 20 else edited(prose(k % 20, 40), 0.03 * (k % 5), k) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = {r.doc_id: np.array([r[c] for c in simhash.PRINT], np.int64).view(np.uint64) for r in simhash.fingerprints(df).collect()}
    want = slow_classes(sorted(own), [own[i] for i in sorted(own)], simhash.RADIUS)
    got = {r.doc_id: (r.class_id, r.n_links) for r in simhash.classes(df, tile_rows=tile_rows).collect()}
    assert got == want and any(c != i for i, (c, _) in got.items())


def test_windows_over_tiles_and_slices(spark, monkeypatch):
    rows = random_rows(3000, [*range(1, 40)] * 5, 7)
    rows = rows[np.unique(rows[list(simhash.PRINT)], return_index=True)[1]]
    want, plan = slow_links(rows, simhash.RADIUS), simhash.windows(simhash.RADIUS, 1, 5)
    monkeypatch.setattr(simhash, "windows", lambda *_: plan)
    monkeypatch.setattr(simhash, "LEAST_TILE", 100)
    monkeypatch.setattr(simhash, "LEAST_TASKS", 12)
    prints = spark.createDataFrame([tuple(r) for r in zip(*(rows[c].view(np.int64).tolist() for c in simhash._ROW.names), strict=True)], "fp_0 long, fp_1 long, fp_2 long, id long, copies long")
    for tile_rows in (None, 1100):
        got = {}
        for r in simhash.pair_links(prints, tile_rows=tile_rows).where("v is null").collect():
            got[r.u] = got.get(r.u, 0) + r.links
        assert got == want


@pytest.mark.parametrize("tile_rows", [7, 50, None])
@pytest.mark.parametrize("radius", [0, 10, 44, 90])
def test_groups_are_brute_force(spark, tile_rows, radius):
    texts = [prose(k % 40, 30 + 3 * (k % 40)) if k < 40 else edited(prose(k % 40, 30 + 3 * (k % 40)), 0.03 * (k % 5), k) for k in range(120)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    own = {r.doc_id: r for r in simhash.fingerprints(df).collect()}
    ids = sorted(own)
    prints = [np.array([own[i][c] for c in simhash.PRINT], np.int64).view(np.uint64) for i in ids]
    want = slow_classes(ids, prints, radius)
    got = {r.doc_id: (r.class_id, r.n_links) for r in simhash.classes(df, radius=radius, tile_rows=tile_rows).collect()}
    assert got == want


def test_pairs_of_very_different_sizes_are_not_skipped(spark):
    """A text, and the same with a third more: within the radius or not, by bits alone."""
    texts = [prose(k, 90) for k in range(30)] + [prose(k, 90) + " " + prose(k + 500, 60) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = {r.doc_id: np.array([r[c] for c in simhash.PRINT], np.int64).view(np.uint64) for r in simhash.fingerprints(df).collect()}
    want = slow_classes(sorted(own), [own[i] for i in sorted(own)], simhash.RADIUS)
    got = {r.doc_id: (r.class_id, r.n_links) for r in simhash.classes(df).collect()}
    assert got == want and any(c != i for i, (c, _) in got.items())


def test_hot_texts_count_their_copies(spark):
    texts = ["one and the same text again"] * 300 + ["another text stands here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.class_id, r.n_links) for r in simhash.classes(df).collect()}
    assert got == {(0, 299), (300, 0)}


def test_near_copies_are_caught_and_clean_texts_left(spark):
    clean = [(k, prose(k, 150)) for k in range(200)]
    shared = prose(999, 60)  # a passage that two otherwise different texts hold
    clean += [(200, shared + " " + prose(200, 150)), (201, shared + " " + prose(201, 150))]
    copies = [(1000 + k, edited(prose(k, 150), 0.03, k)) for k in range(100)] + [(2000, prose(5, 150)), (2001, prose(5, 150).upper())]
    df = spark.createDataFrame(clean + copies, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in simhash.classes(df).collect()}
    assert not [i for i, c in got.items() if i < 1000 and c != i]
    assert sum(got.get(1000 + k) == k for k in range(100)) >= 98 and got[2000] == got[2001] == 5


def test_fingerprint_is_the_sign_of_votes():
    texts = ["a b c d e f g", "A B C", "one two", "solo", "", "&&&"]
    data, offsets = (np.frombuffer("".join(t.lower() for t in texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    prints, sizes = simhash.fingerprint(data, offsets)
    assert sizes.tolist() == [5, 1, 1, 1, 0, 1]
    w = common.words(data, offsets)
    keys, at = w.grams(3)
    keys = np.array(sorted({int(k) >> 16 for k in keys[w.doc()[at] == 0]}), np.uint64)
    keys = common.mix(keys)
    bits = np.unpackbits(simhash.bits_of(keys).view(np.uint8), axis=1).astype(int)
    assert np.array_equal(np.packbits(bits.sum(0) * 2 > len(keys)).view(np.uint64), prints[0])


def test_votes_beyond_255_shingles():
    text = prose(4, 2000).encode()
    prints, sizes = simhash.fingerprint(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w = common.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    keys = common.mix(np.unique(w.grams(3)[0] >> np.uint64(16)))
    bits = np.unpackbits(simhash.bits_of(keys).view(np.uint8), axis=1).astype(int)
    tie = np.unpackbits(simhash.bits_of(keys.min()[None]).view(np.uint8)).astype(int)
    assert sizes[0] == len(keys) and np.array_equal(np.packbits(bits.sum(0) * 2 + tie > len(keys)).view(np.uint64), prints[0])


def test_components_both_ways(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame(edges, "u long, v long")
    rows = lambda limit: sorted(tuple(r) for r in common.components(df, common.Saved(spark, "test"), limit).collect())
    one = rows(10**6)
    assert one == rows(0) and dict(one)[460] == 400


def test_awkward_rows(awkward, crowded, empty):
    got = sorted(tuple(r) for r in simhash.classes(awkward).collect())
    assert got == sorted([(i, i, int(i == 1)) for i in (1, 2, 3, 4, 6, 8, 9, 10, 11)] + [(7, 1, 1)])
    assert sorted(tuple(r) for r in simhash.classes(crowded).collect()) == got
    kept = simhash.deduplicate(crowded)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == awkward.count() - 1
    assert simhash.classes(empty).count() == simhash.deduplicate(empty).count() == 0


def test_removed_ids_too_many_to_broadcast(awkward, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    assert simhash.deduplicate(awkward).count() == awkward.count() - 1


def test_flags_are_found_few_or_many():
    rng = np.random.default_rng(3)
    for share in (0, 0.0001, 0.01, 0.5, 1):
        flags = bytearray(rng.random(40_000) < share)
        for n in (0, 1, 39_999, 40_000):
            assert simhash._places(flags, n).tolist() == np.frombuffer(flags, bool, n).nonzero()[0].tolist()


def test_fingerprints_take_one_sort_of_their_shingles(monkeypatch):
    """Words come from one scan; numpy's set functions, which took most of the time, aren't called on whole pieces."""
    texts = [prose(k, 200) for k in range(40)] + ["x" * 30, "y", "", "&", "ends", "starts é"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    taken, unique, union = [0], np.unique, np.union1d

    def counted(what):
        def run(*args, **kwargs):
            taken[0] += sum(np.size(x) for x in args)
            return what(*args, **kwargs)

        return run

    monkeypatch.setattr(np, "unique", counted(unique))
    monkeypatch.setattr(np, "union1d", counted(union))
    w = common.words(data, offsets)
    prints, sizes = simhash.fingerprint(data, offsets)
    assert taken[0] < len(w.hash) / 10
    for k, text in enumerate(texts):  # texts that touch each other are told apart
        own = np.frombuffer(text.encode(), np.uint8)
        alone, size = simhash.fingerprint(own, np.array([0, len(own)]))
        assert size[0] == sizes[k] and np.array_equal(alone[0], prints[k])
