"""Repetition coverage against brute force."""

from collections import Counter

import pytest

from tests.llm.conftest import AWKWARD, prose
from vellumspark.llm import common, quality


def brute(text, n):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    count = Counter(grams)
    inside = set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            inside.update(range(k, k + n))
    whole = sum(map(len, words))
    return sum(len(words[k]) for k in inside) / whole if whole else 0.0


def brute_lines(text):
    lines = [tuple(x.encode().split()) for x in (text or "").split("\n")]
    count = Counter(lines)
    size = lambda x: sum(len(w.decode()) for w in x)
    whole = sum(map(size, lines))
    return sum(size(x) for x in lines if count[x] > 1) / whole if whole else 0.0


TEXTS = ["a b c a b c", "same line\nother\n same  line \n\n\nthird", "a a a a a a a a", "été x été x été x y", prose(1, 200), prose(2, 50) + "\n" + prose(2, 50), "one", "", None, "a b\nc d\na b c d"]


@pytest.mark.parametrize("piece", [10, 1 << 20])
def test_measures_are_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(common, "PIECE_BYTES", piece)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.measure(df, {2: 0.5, 3: 0.5, 5: 0.5}).collect()}
    for k, text in enumerate(TEXTS):
        for n in (2, 3, 5):
            assert got[k][f"dup_{n}gram_share"] == pytest.approx(brute(text, n), abs=1e-6), (k, n)
        assert got[k].dup_line_share == pytest.approx(brute_lines(text), abs=1e-6), k
        assert got[k].n_words == len((text or "").split())


def test_pieces_do_not_change_results():
    import pyarrow as pa

    texts = pa.array([t for t in TEXTS])
    one = [quality.coverage(d, o, [3])[1][0].tolist() for _, _, d, o in common.pieces(texts)]
    many = [quality.coverage(d, o, [3])[1][0].tolist() for _, _, d, o in common.pieces(texts, 5)]
    assert sum(one, []) == sum(many, [])


def test_awkward_rows(awkward, crowded, empty):
    got = quality.measure(awkward).collect()
    assert len(got) == len(AWKWARD)
    keep = sorted((r.doc_id or 0) for r in got if r.keep)
    assert keep == sorted((i or 0) for i, t, *_ in AWKWARD if t and t.strip() and i != 9)
    assert sorted(map(str, quality.measure(crowded).collect())) == sorted(map(str, got))
    kept = quality.filter_documents(crowded)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(keep)
    assert quality.measure(empty).count() == quality.filter_documents(empty).count() == 0


def test_junk_goes_and_clean_stays(spark):
    df = spark.createDataFrame([(1, prose(3, 300), "en", "s", 1), (2, "buy now cheap " * 50, "en", "s", 1), (3, "\n".join(["the same line again"] * 9), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in quality.filter_documents(df).collect()] == [1]
