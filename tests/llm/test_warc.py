import gzip
import hashlib
import io
import json
import zlib

import pytest

from barloom.llm import warc


def rows():
    big, other = "<p>same</p>" * 200, "é" * 500
    return [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u4", "small"), (5, "u5", "small"), (6, "u\r\n6", other), (7, "u7", other), (8, "", ""), (9, "u9", "x" * 300_000), (None, "u", big), (7, "u7", other)]


def brute(data):
    last = {}
    for k, _, h in data:
        b = (h or "").encode()
        if len(b) >= 1000 and k is not None:
            last[b] = max(last.get(b, k), k)
    out = []
    for k, _, h in data:
        b = (h or "").encode()
        to = last.get(b)
        first = to is None or to == k
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else to))
    return sorted(out, key=repr)


def test_archive_equals_brute_force(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumnRenamed("url", "url").selectExpr("*", "1 as offset", "2 as last")
    got = sorted((tuple(r) for r in warc.archive(df.repartition(3)).collect()), key=repr)
    assert got == brute(rows())
    assert warc.archive(df.limit(0)).count() == 0


def test_copies_meet_without_a_broadcast_of_all(spark):
    big = "<p>same</p>" * 200
    data = [*rows(), *((100 + i, f"u{i}", big) for i in range(300)), *((500 + i, None, f"{i // 2} " * 700) for i in range(80)), (None, None, big), (None, "n", "7 " * 700)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(6)
    want = brute(data)
    for most in (0, 10, 1000):
        out = warc.with_revisits(df, known_most=most)
        got = out.collect()
        assert all((r.html is None) == (r.refers_to is not None) for r in got)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, "response" if r.refers_to is None else "revisit", r.refers_to) for r in got), key=repr) == want
    # no task gets the rows of the payload that two thirds of the rows share
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = warc.with_revisits(df, known_most=0).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 0.5 * len(data)


def whole(parts):
    return b"".join(warc.page_record(k, "u", p, hashlib.sha1(p).hexdigest(), None) for k, p in enumerate(parts))


def test_normaliser_and_index(tmp_path):
    parts = [b"", b"a\r\n\r\nb", b"WARC/1.1\r\n" * 3, bytes(range(256)) * 40_000]
    plain = whole(parts)
    (tmp_path / "one.gz").write_bytes(gzip.compress(plain))
    index = warc.normalise(str(tmp_path / "one.gz"), str(tmp_path / "many.gz"))
    data = (tmp_path / "many.gz").read_bytes()
    assert gzip.decompress(data) == plain and len(index) == 4 and sum(r["length"] for r in index) == len(data)
    assert [json.loads(x) for x in (tmp_path / "many.gz.idx").read_text().splitlines()] == index
    with open(tmp_path / "many.gz", "rb") as f:
        for r, p in reversed(list(zip(index, parts, strict=True))):
            fields, block = warc.read_at(f, r["offset"], r["length"])
            assert warc.payload_of(block) == p and fields["warc-type"] == "response"
    # what is normal already stays as it is
    again = warc.normalise(str(tmp_path / "many.gz"), str(tmp_path / "again.gz"))
    assert again == index and not list(tmp_path.glob("*.part"))


def test_damaged_streams_are_told(tmp_path):
    data = gzip.compress(whole([b"x" * 5000, b"y"]))
    for bad in (data[:-30], data[: len(data) // 2], gzip.compress(b"no record here\r\n")):
        (tmp_path / "bad.gz").write_bytes(bad)
        with pytest.raises((ValueError, zlib.error)):
            warc.normalise(str(tmp_path / "bad.gz"), str(tmp_path / "out.gz"))
        assert not (tmp_path / "out.gz").exists() and not list(tmp_path.glob("*.part"))
    assert list(warc.records(io.BytesIO(b""))) == []


def test_long_urls(spark):
    urls = ["u" * 70_000, "v" * 3_000_000, "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(90_000)), "w"]
    data = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    assert sorted(map(tuple, warc.archive(df).collect())) == brute(data)


def test_long_lines_are_kept_or_told(tmp_path):
    for url in ("u" * 70_000, "v" * 9_000_000):
        (tmp_path / "one.gz").write_bytes(gzip.compress(warc.page_record(1, url, b"x", "d", None)))
        row, = warc.normalise(str(tmp_path / "one.gz"), str(tmp_path / "many.gz"))
        assert row["uri"] == url
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"z" * 9_000_000))))
