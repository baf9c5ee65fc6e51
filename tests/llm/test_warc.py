"""Archive and files: exact round trips."""

import gzip
import time

import pytest
from pyspark.sql import functions as F

from vellumspark.llm import warc

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (None, "http://b", "é\U0001f600"), (2, "http://a/2", "<p>x</p>"), (7, "http://long", "y" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def whole(rows):
    return rows.select(F.concat("header", "payload", "trailer").alias("w"))


def test_archive_is_exact(pages, spark, tmp_path):
    rows = warc.records(pages)
    report = warc.archive_report(rows).collect()
    assert len(report) == len(PAGES) and all(r.exact for r in report)
    assert {r.copies for r in report if r.record_id in (1, 2)} == {3} and {r.stored_from for r in report if r.record_id == 2} == {1}
    assert {r.copies for r in report if r.record_id in (3, 4)} == {2}
    warc.write_archive(rows, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    back = warc.read_archive(spark, str(tmp_path / "a"))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.w) for r in whole(rows).collect())


def test_wrong_declared_digest_is_seen(pages):
    rows = warc.records(pages).withColumn("declared", F.when(F.col("record_id") == 1, F.lit("0" * 64)).otherwise(F.col("declared")))
    assert [r.record_id for r in warc.archive_report(rows).where("not exact").collect()] == [1]


@pytest.mark.parametrize("packed", [False, True])
def test_files_round_trip(spark, pages, tmp_path, packed):
    records = [bytes(r.w) for r in whole(warc.records(pages)).collect()]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    parts = [info, *records]
    data = b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts)
    (tmp_path / "f.warc").write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path / "f.warc"))
    got = [bytes(r.w) for r in rows.orderBy("offset").select(F.concat("header", "payload", "trailer").alias("w")).collect()]
    assert got == parts
    report = warc.archive_report(rows).collect()
    assert all(r.exact for r in report) and len(report) == len(parts)
    assert rows.where("declared is not null").count() == len(records)


@pytest.mark.parametrize("data", [b"", b"junk", b"WARC/1.0\r\nno length\r\n\r\nbody", b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort", b"WARC/1.0\r\nContent-Length: 2\r\n\r\nokWARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n\r\n\r\ntail"])
def test_damaged_files_lose_nothing(data):
    assert b"".join(h + p + t for _, h, p, t, _ in warc.split_records(data)) == data


RECORD = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


def test_reading_goes_on_behind_damage():
    good = [RECORD % (len(p), p) for p in (b"one", b"two", b"three", b"")]
    broken = b"WARC/1.0\r\nContent-Lenght 3\r\n\r\nlost\r\n\r\n"
    data = good[0] + broken + good[1] + b"noise\r\n" + good[2] + good[3]
    for stretches in (data, iter([data]), iter([bytes([b]) for b in data])):
        got = list(warc.split_records(stretches))
        assert b"".join(h + p + t for _, h, p, t, _ in got) == data
        assert [p for _, h, p, _, _ in got if h] == [b"one", b"two", b"three", b""]
        assert [o for o, *_ in got] == sorted(o for o, *_ in got) and got[2][0] == len(good[0] + broken)


def test_damaged_members_are_kept_as_they_are():
    members = [gzip.compress(RECORD % (3, p), mtime=0) for p in (b"one", b"two", b"six")]
    bad = members[1][:14] + b"\xff" * 6 + members[1][20:]
    got = list(warc.split_records(warc.contents(members[0] + bad + b"\0" * 9 + members[2])))
    assert [p for _, h, p, _, _ in got if h][:1] == [b"one"] and b"six" in [p for _, h, p, _, _ in got]
    assert list(warc.split_records(warc.contents(members[0][:-9]))) == list(warc.split_records(RECORD % (3, b"one")))


def test_reading_takes_time_in_proportion():
    member = gzip.compress(RECORD % (2000, bytes(range(250)) * 8))
    plain = RECORD % (10, b"0123456789")

    def took(data):
        began = time.thread_time()
        n = sum(1 for _ in warc.split_records(warc.contents(data)))
        return time.thread_time() - began, n

    for one in (member, plain, b"x\n", b"WARC/1.0\r\n"):
        (short, n), (long, m) = (min(took(one * k) for _ in range(3)) for k in (3000, 12000))
        assert long < 9 * max(short, 0.01) and (m == 4 * n or m <= 1)


def test_empty_and_crowded(pages, spark):
    assert warc.archive_report(warc.records(pages.where("false"))).count() == 0
    wide = pages.withColumns({c: F.lit("z") for c in ("header", "payload", "u", "size", "declared", "digest")})
    wide = wide.toDF(*[*wide.columns[:-1], "HTML"])
    assert sorted(map(str, warc.archive_report(warc.records(wide)).collect())) == sorted(map(str, warc.archive_report(warc.records(pages)).collect()))
