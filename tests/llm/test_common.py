"""Words and their hashes against plain loops; very long texts."""

import random

import numpy as np
import pytest

from vellumspark.llm import common, licences, quality, simhash


def piece(texts):
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])


def slow_hash(word):
    h = 0
    for k, b in enumerate(word):
        h = (h + (b + 1) * pow(common._POLY, k, 1 << 64)) % (1 << 64)
    return int(common.mix(np.array([(h + len(word)) % (1 << 64)], np.uint64))[0])


@pytest.mark.parametrize("stretch", [1 << 20, 16, 1])
def test_hashes_are_the_plain_sum(monkeypatch, stretch):
    monkeypatch.setattr(common, "POWERS", stretch)
    rng = random.Random(stretch)
    texts = ["".join(rng.choice("ab é漢 \n") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["x" * 100, "", "end"]
    data, offsets = piece(texts)
    w = common.words(data, offsets, common.NOT_BLANK)
    want = [x.encode() for t in texts for x in t.split()]
    assert [data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == want
    assert w.hash.tolist() == [slow_hash(x) for x in want]
    assert common.characters(data, w.start, w.end).tolist() == [len(x.decode()) for x in want]


def test_a_very_long_text_takes_memory_in_proportion():
    """Ten million bytes, once of words and once without a blank: some tens of bytes for each, nothing kept afterwards."""
    import tracemalloc

    for text in ("word" * 2 + " " + "é" * 3 + " ") * 600_000, "x" * 9_000_000:
        data, offsets = piece([text])
        for work in (lambda d, o: quality.coverage(d, o, [3, 5, 8]), simhash.fingerprint, lambda d, o: licences.paragraphs(d, o)):
            tracemalloc.start()
            work(data, offsets)
            kept, most = tracemalloc.get_traced_memory()
            tracemalloc.stop()
            assert most < 45 * len(data) + (96 << 20), (work, most / len(data))
            assert kept < 40 << 20
