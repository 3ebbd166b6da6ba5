"""Recursive averages against plain loops: many series at once, long series in chunks, series that spread over tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import recurrences as rec
from barloom.operators import indicators as ind
from barloom.operators import scans


def ema_list(values, n):
    out = [None] * len(values)
    if len(values) >= n:
        k, p = 2.0 / (n + 1), 0.0
        for v in values[:n]:
            p += v
        p /= n
        out[n - 1] = p
        for i in range(n, len(values)):
            p = values[i] * k + p * (1 - k)
            out[i] = p
    return out


def dense_list(values, n):
    full = [v for v in values if v is not None]
    return [None] * (len(values) - len(full)) + ema_list(full, n)


def tsi_lists(c):
    step = [0.0, *(b - a for a, b in zip(c, c[1:], strict=False))] if c else []
    top, bottom = dense_list(ema_list(step, 10), 30), dense_list(ema_list([abs(x) for x in step], 10), 30)
    t = [None if a is None or b is None or b == 0 else 100 * a / b for a, b in zip(top, bottom, strict=True)]
    return t, dense_list(t, 8)


def rsi_list(c, n=35):
    step = [0.0, *(b - a for a, b in zip(c, c[1:], strict=False))] if c else []
    up, down = ema_list([max(x, 0.0) for x in step], n), ema_list([max(-x, 0.0) for x in step], n)
    return [None if a is None or a + b == 0 else 100 * a / (a + b) for a, b in zip(up, down, strict=True)]


def some(sizes, seed=0):
    rng = np.random.default_rng(seed)
    parts = [np.cumsum(rng.integers(-40, 41, n)).astype(float) + 5000 for n in sizes]
    return parts, np.concatenate([*parts, []]), np.cumsum([0, *sizes])


def same(got, want, tolerance=0.0):
    want = np.array([math.nan if v is None else v for v in want])
    assert np.array_equal(np.isnan(got), np.isnan(want))
    assert np.nanmax(np.abs(got - want), initial=0.0) <= tolerance


@pytest.mark.parametrize("sizes", [[], [0], [5], [10], [60, 0, 200, 9, 35, 34, 1, 500], [100] * 50])
def test_many_series_at_once_equal_loops_bit_by_bit(sizes):
    parts, x, cuts = some(sizes)
    for n in (8, 10, 35):
        same(rec.ema(x, cuts, n), [v for p in parts for v in ema_list(p.tolist(), n)])
    t, sig = rec.tsi(x, cuts)
    both = [tsi_lists(p.tolist()) for p in parts]
    same(t, [v for a, _ in both for v in a])
    same(sig, [v for _, b in both for v in b])
    same(rec.rsi(x, cuts), [v for p in parts for v in rsi_list(p.tolist())])


def test_flat_prices_and_inner_nulls():
    flat, cuts = np.full(80, 100.0), np.array([0, 80])
    t, sig = rec.tsi(flat, cuts)
    assert np.isnan(t).all() and np.isnan(sig).all() and np.isnan(rec.rsi(flat, cuts)).all()  # a flat price has no momentum
    x = np.array([math.nan, 1.0, math.nan, 3.0, 5.0, math.nan])
    same(rec.ema_dense(x, np.array([0, 4, 6]), 2), [*dense_list([None, 1.0, None, 3.0], 2), *dense_list([5.0, None], 2)])
    t, sig = rec.tsi(np.array(some([100])[1]), np.array([0, 100]))
    assert np.flatnonzero(~np.isnan(t))[0] == 38 and np.flatnonzero(~np.isnan(sig))[0] == 45


def test_long_series_in_chunks(monkeypatch):
    parts, x, cuts = some([5000, 30, 9000])
    same(rec.ema(x, cuts, 10), [v for p in parts for v in ema_list(p.tolist(), 10)], 1e-8)
    monkeypatch.setattr(rec, "LONG", 50)
    same(rec.tsi(x, cuts)[1], [v for p in parts for v in tsi_lists(p.tolist())[1]], 1e-8)
    # the maps of two neighbouring chunks compose to the map of both
    k = rec.weight(10)
    a, b = rec.composed(x[:30], k, np.array([0, 10, 30]))
    whole = rec.composed(x[:30], k, np.array([0, 30]))[0]
    assert abs(a * (1 - k) ** 20 + b - whole) < 1e-9


def test_streaks():
    ok = np.array([True, True, False, True, True, True, True, False])
    assert rec.streak(ok, np.array([0, 4, 8]), 3).tolist() == [1, 2, 0, 1, 1, 2, 3, 0]
    assert rec.streak(ok[:0], np.array([0]), 3).tolist() == []


def frame(spark, sizes, seed=0):
    parts, _, _ = some(sizes, seed)
    rows = [(code, i, float(c)) for code, p in enumerate(parts) for i, c in enumerate(p)]
    return parts, spark.createDataFrame(rows, "code long, i long, c double").withColumn("d", F.date_add(F.lit("1990-01-01").cast("date"), F.col("i").cast("int")))


def test_one_pass_over_blocks_of_codes(spark, monkeypatch):
    monkeypatch.setattr(ind, "BLOCK", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        parts, df = frame(spark, [200, 3, 0, 150, 400, 60, 70, 70, 1, 90])
        got = ind.recursive(df.repartition(3), hold=(0.0, 50.0, 4)).orderBy("code", "d").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    both = [tsi_lists(p.tolist()) for p in parts]
    same(got.ema.to_numpy(), [v for p in parts for v in ema_list(p.tolist(), 10)])
    same(got.t.to_numpy(), [v for a, _ in both for v in a])
    same(got.t_sig.to_numpy(), [v for _, b in both for v in b])
    same(got.b.to_numpy(), [v for p in parts for v in rsi_list(p.tolist())])
    run, want = 0, []
    for code, t, b in zip(got.code, got.t, got.b, strict=True):
        run = min(4, run + 1) if t >= 0 and b >= 50 else 0
        run = min(run, 1) if want and want[-1][0] != code else run
        want.append((code, run))
    assert got.tb_hold.tolist() == [r for _, r in want] and got.tb_ok.tolist() == [r > 0 for _, r in want]


@pytest.mark.parametrize("width", [7, 40, 1000])
def test_codes_spread_over_tasks(spark, width):
    parts, df = frame(spark, [300, 20, 1, 450, 36], seed=3)
    df = df.withColumn("s_", F.lit("mine")).unionByName(df.where("code = 0").withColumn("code", F.lit(None).cast("long")).withColumn("s_", F.lit("mine")))
    got = scans.spread_averages(df.repartition(4), F.floor(F.col("i") / width)).orderBy(F.col("code").asc_nulls_last(), "d").toPandas()
    assert list(got.columns) == [*df.columns, "ema", "t", "t_sig", "b"]
    parts = [*parts, parts[0]]
    both = [tsi_lists(p.tolist()) for p in parts]
    same(got.ema.to_numpy(), [v for p in parts for v in ema_list(p.tolist(), 10)], 1e-8)
    same(got.t.to_numpy(), [v for a, _ in both for v in a], 1e-8)
    same(got.t_sig.to_numpy(), [v for _, b in both for v in b], 1e-8)
    same(got.b.to_numpy(), [v for p in parts for v in rsi_list(p.tolist())], 1e-8)


def test_one_long_code_over_many_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("code"), F.col("id").alias("d"), (F.col("id") * 7919 % 401 + 1000.0).alias("c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        out = scans.ema_over(df.withColumn("chunk", F.floor(F.col("d") / 25_000)), "code", "d", "chunk", {"m": ("c", 10)})
        got = out.withColumn("p", F.spark_partition_id()).orderBy("d").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.p.nunique() > 1
    same(got.m.to_numpy(), ema_list(got.c.tolist(), 10), 1e-8)


def test_nulls_and_empty_tables(spark):
    rows = [(1, i, None if i % 3 == 0 else float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "code long, d long, c double").withColumn("chunk", F.floor(F.col("d") / 9))
    got = scans.ema_over(df, "code", "d", "chunk", {"m": ("c", 4)}).orderBy("d").toPandas()
    want = iter(ema_list([v for *_, v in rows if v is not None], 4))
    same(got.m.to_numpy(), [None if v is None else next(want) for *_, v in rows], 1e-9)
    assert scans.ema_over(df.limit(0), "code", "d", "chunk", {"m": ("c", 4)}).count() == 0


def test_blocks_of_whole_chunks(monkeypatch):
    """A pass takes many chunks at a time, and never a part of one."""
    import pyarrow as pa

    monkeypatch.setattr(scans, "BLOCK", 50)
    sizes = [3, 60, 1, 20, 20, 20, 7]
    place = np.concatenate([np.arange(1, n + 1) for n in sizes])
    rows = pa.table({"v": np.arange(len(place)), "place": place})
    blocks = list(scans.whole(rows.to_batches(max_chunksize=8), 1))
    assert 1 < len(blocks) < len(sizes) and pa.concat_tables(blocks).equals(rows)
    assert [b.column(1)[0].as_py() for b in blocks] == [1] * len(blocks)
    x, cuts = np.random.default_rng(1).normal(size=len(place)), np.append(0, np.cumsum(sizes))
    count = np.array([0, 3, 63, 64, 0, 20, 40])
    got = scans.means(x, cuts, count, np.array([0, x[:3].sum(), 0, 0, 0, 1.5, 0]), np.full(7, 0.25), 25)
    for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        p, total, n = 0.25, [0, x[:3].sum(), 0, 0, 0, 1.5, 0][j], count[j]
        for i in range(a, b):
            n, total = n + 1, total + x[i]
            p = total / 25 if n == 25 else p + (x[i] - p) * rec.weight(25)
            assert (np.isnan(got[i]) and n < 25) or abs(got[i] - p) < 1e-12


def test_sliding_frames_in_the_averages_pass(spark):
    """shaped's means and sums are those of Spark's windows, bit by bit, nulls included."""
    from barloom.operators import shape

    rng = np.random.default_rng(8)
    rows = []
    for code, size in (("a", 90), ("b", 40), (None, 60), ("c", 3), ("d", 50)):
        for i in range(size):
            o, c = rng.uniform(10, 20, 2).tolist()
            flat = code == "d" and i < 45
            rows.append((code, i, 10.0 if flat else o, 10.0 if flat else max(o, c) + rng.uniform(), 10.0 if flat else min(o, c) - rng.uniform(), None if code == "b" and i % 7 == 3 else 10.0 if flat else c, 1.0))
    df = spark.createDataFrame(rows, "code string, d int, o double, h double, l double, c double, v double")
    names = ["code", "d", *[f"ma{n}" for n in ind.MESH], "top", "bottom", "red", "u", "u_sig", "gb", "gs", "i"]
    got = shape.shaped(df).select(names).orderBy("code", "d").collect()
    assert got == ind.rolling(df).select(names).orderBy("code", "d").collect()
