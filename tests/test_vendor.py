"""The vendor's pages: order, tries, limits, and the data source as a whole."""

import datetime

import pytest
from pyspark.sql import functions as F

from barloom.sources import bars as src
from barloom.sources import vendor

DAY = datetime.date(2024, 1, 1)


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def time(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def free(clock=None, n=0, seconds=15.0):
    clock = clock or Clock()
    return vendor.Limiter(n, seconds, clock.time, clock.sleep)


def pages(n, size, seen=None):
    """A vendor of n daily bars in pages of `size`, the newest first."""
    days = [DAY + datetime.timedelta(days=k) for k in range(n)][::-1]

    def get(code, page):
        if seen is not None:
            seen.append(page)
        part = days[page * size : (page + 1) * size]
        return "\n".join(f"{d:%Y%m%d},1,2,0.5,1.5,{(d - DAY).days}" for d in part) if part else None

    return get


def test_limit_holds_in_every_window():
    clock, times = Clock(), []
    limiter = free(clock, 60)
    for k in range(400):
        limiter.wait()
        times.append(clock.now)
        clock.now += (0.01, 0.4)[k % 7 == 0]
    for t in times:
        assert sum(t <= x < t + 15.0 for x in times) <= 60
    assert times[-1] > 15.0 * (400 // 60 - 1)


def test_tries_and_growing_waits():
    clock, calls = Clock(), []

    def flaky(code, page):
        calls.append(page)
        if len(calls) < 4:
            raise OSError("no answer")
        return "20240101,1,1,1,1,1"

    assert vendor.fetched(flaky, "x", 0, free(clock)) and clock.slept == [1.5, 3.0, 4.5] and len(calls) == 4

    def dead(code, page):
        calls.append(page)
        raise OSError("no answer")

    calls.clear()
    with pytest.raises(OSError):
        vendor.fetched(dead, "x", 0, free())
    assert len(calls) == 4
    clock = Clock()
    limiter = free(clock, 2, 100.0)  # tries count as requests
    with pytest.raises(OSError):
        vendor.fetched(dead, "x", 0, limiter)
    assert clock.now >= 100.0


def test_pages_go_back_no_further_than_needed():
    seen = []
    got = vendor.bars_of(pages(95, 10, seen), "x", free())
    assert [r[5] for r in got] == list(range(95)) and seen == list(range(11))
    seen.clear()
    got = vendor.bars_of(pages(95, 10, seen), "x", free(), since=DAY + datetime.timedelta(days=80))
    assert [r[5] for r in got] == list(range(80, 95)) and seen == [0, 1]
    seen.clear()
    assert len(vendor.bars_of(pages(95, 10, seen), "x", free(), most=25)) == 25 and seen == [0, 1, 2]
    got = vendor.bars_of(pages(95, 10), "x", free(), until=DAY + datetime.timedelta(days=3))
    assert [r[5] for r in got] == [0, 1, 2, 3]
    assert vendor.bars_of(pages(0, 10), "x", free()) == []


def test_readers_share_the_limit():
    assert vendor.VendorReader({"path": "x"}).share() == 15 and vendor.VendorReader({"path": "x", "requests": "0"}).share() == 0
    with pytest.raises(ValueError):
        vendor.VendorReader({"path": "x", "requests": "3"}).share()


def test_data_source(spark, sf, tmp_path):
    bars = src.daily_bars(src.table(spark, sf, "lineitem")).persist()
    vendor.write_pages(bars, str(tmp_path / "p"), page=150, buckets=3)
    spark.dataSource.register(vendor.VendorBars)
    load = lambda **o: spark.read.format("vendor_bars").options(path=str(tmp_path / "p"), buckets=3, **({"requests": 0, "pause": 0.0} | o)).load()
    rows = lambda df: sorted((int(r.code), r.d, r.o, r.h, r.l, r.c, r.v) for r in df.collect())
    assert rows(load()) == rows(bars)
    code = bars.groupBy("code").count().orderBy("count").first()
    some = load(codes=f"{code[0]},nobody", since="1996-01-01")
    assert rows(some) == rows(bars.where(f"code = {code[0]} and d >= '1996-01-01'"))
    left = load(least=code[1] + 1)
    assert {int(r.code) for r in left.select("code").distinct().collect()} == {r[0] for r in bars.groupBy("code").count().where(f"count > {code[1]}").collect()}
    # one page that can't be read leaves out its code only
    bad = spark.read.parquet(str(tmp_path / "p")).selectExpr("code", "page", f"case when code = '{code[0]}' and page = 1 then 'x' else body end as body", "bucket")
    bad.repartition(3, "bucket").write.partitionBy("bucket").parquet(str(tmp_path / "q"))
    got = spark.read.format("vendor_bars").options(path=str(tmp_path / "q"), buckets=3, requests=0, pause=0.0).load()
    assert rows(got) == rows(bars.where(f"code <> {code[0]}"))
    # within the limit: each of three readers may ask 20 times in a second
    began = datetime.datetime.now()
    assert load(requests=60, seconds=1, codes=str(code[0])).count() == code[1] and (datetime.datetime.now() - began).total_seconds() < 60


def test_pages_are_read_once(spark, tmp_path, monkeypatch):
    """Row groups are read once, however many pages are asked for in their order."""
    import pyarrow.parquet as pq

    days = spark.range(3000).select((F.col("id") % 30).alias("code"), F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 30).cast("int")).alias("d"), *[F.col("id").cast("double").alias(x) for x in "ohlcv"])
    vendor.write_pages(days, str(tmp_path / "p"), 10, 1)
    reads = []
    plain = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, k, **more: reads.append(more["columns"]) or plain(self, k, **more))
    store = vendor.PageStore(str(tmp_path / "p"), 0)
    free = vendor.Limiter(0, 1.0, None, None)
    assert sorted(store.codes(), key=int) == [str(k) for k in range(30)]
    assert [len(vendor.bars_of(store.get, c, free)) for c in store.codes()] == [100] * 30
    assert len(reads) == 2 and store.get("0", 10) is None and store.get("none", 0) is None
