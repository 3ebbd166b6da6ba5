"""Runs, caps, thinning, sliding extremes and states against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import ledger, sets
from barloom.sources import bars as src


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_runs_in_the_order_of_arrival(spark, chunk):
    rnd = random.Random(chunk)
    ticks = [(rnd.choice("aab"), rnd.choice([1, 1, 1, 2, 3, None]), i, float(rnd.randrange(50)), 1) for i in range(400)]
    df = spark.createDataFrame(ticks, "code string, hour int, at long, price double, size int").withColumn("chunk", F.floor(F.col("at") / chunk))
    store, last = {}, {}
    for code, hour, _, price, _ in ticks:
        if code in last and last[code][0] == hour:
            bar = last[code][1]
            bar[:] = [bar[0], max(bar[1], price), min(bar[2], price), price, bar[4] + 1]
        else:
            last[code] = (hour, [price] * 4 + [1])
        store[code, hour] = last[code][1]  # what comes later is put in place of what was there
    got = {(r.code, r.hour): [r.o, r.h, r.l, r.c, r.v] for r in src.run_bars(df.repartition(3)).collect()}
    assert got == {k: v for k, v in store.items() if k[1] is not None}
    assert src.run_bars(df.limit(0)).count() == 0


def test_codes_leave_the_store_by_age(spark):
    store = spark.createDataFrame([(c, k, s) for s, c in enumerate("edcba") for k in range(2)] + [(None, 0, 9)], "code string, k int, since int")
    codes = lambda now, most: "".join(sorted({r.code for r in sets.capped(store, spark.createDataFrame([(c,) for c in now], "code string"), "since", most).collect()}))
    assert codes([], 2) == "ab" and codes(["e"], 3) == "abe" and codes(["a"], 2) == "a"  # the last one to come is a current one
    assert codes(["e", "d"], 2) == "de" and codes(["e", "d"], 1) == "de" and codes(["x", None], 10) == "abcde"
    assert sets.capped(store, spark.createDataFrame([("e",)], "code string"), "since", 1).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_thinning_is_the_greedy_walk(spark, seed):
    rnd = random.Random(seed)
    points = [(rnd.choice(["a", "b", None]), float(rnd.randrange(400)) + rnd.choice([0, 0.5])) for _ in range(200)] + [("c", 7.0)]
    df = spark.createDataFrame(points, "code string, x double")
    want = set()
    for code in ("a", "b", "c", None):
        last = None
        for x in sorted({x for c, x in points if c == code}):
            if last is None or x - last >= 11:
                want.add((code, x))
                last = x
    assert {(r.code, r.x) for r in sets.thinned(df, "code", "x", 11).collect()} == want
    assert sets.thinned(df.limit(0), "code", "x", 11).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 40, 500])
def test_sliding_extremes_by_blocks(spark, n):
    rnd = random.Random(n)
    rows = [(c, i, None if rnd.random() < 0.1 else float(rnd.randrange(30))) for c, size in (("a", 130), ("b", 39), ("c", 1)) for i in range(size)]
    df = spark.createDataFrame(rows, "code string, d int, c double").withColumn("i", F.col("d"))
    got = ind.extremes(df, n, {"lo": F.col("c")}, {"hi": F.col("c")})
    assert got.columns == ["code", "d", "c", "i", "lo", "hi"]
    for r in got.collect():
        last = [c for code, i, c in rows if code == r.code and r.d - n < i <= r.d and c is not None]
        assert (r.lo, r.hi) == ((min(last), max(last)) if last else (None, None))


def test_states_of_parts_merge_to_those_of_all(spark):
    rnd = random.Random(4)
    day = lambda k: f"2024-01-{1 + k:02d}"
    rows = [(rnd.choice(["x", "y"]), rnd.choice(["홈런", "일반"]), i % 7, day(i // 20), day(i // 20 + 1), None if i % 17 == 0 else rnd.randrange(-500, 700) / 100, rnd.choice([3, None]), rnd.choice(["장중 손절", "익절", "?"]), i) for i in range(200)]
    t = spark.createDataFrame(rows, "strategy string, grade string, code int, entry_date string, exit_date string, pnl double, days int, reason string, seq long")
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    parts = [t.where(f"seq % 3 = {k}") for k in range(3)]
    states = [f(p) for f in (ledger.day_states, ledger.reason_states) for p in parts]
    union = lambda dfs: dfs[0].unionByName(dfs[1]).unionByName(dfs[2])
    assert same(ledger.stats_of(union(states[:3])), ledger.stats_by_strategy(t))
    assert same(ledger.reasons_of(union(states[3:])), ledger.by_reason(t))
    assert same(ledger.equity_of(ledger.day_growth(t), union(states[:3])), ledger.equity(t))
    assert ledger.reasons_of(ledger.reason_states(t.limit(0))).count() == 0


def test_ties_go_by_the_universe(spark):
    from barloom.operators import signals

    members = spark.createDataFrame([(30, "a", "KOSDAQ", 9, 1), (10, "b", "KOSPI", 5, 2), (20, "c", "KOSPI", 7, 1)], "code long, name string, market string, marcap long, rank int")
    cands = spark.createDataFrame([(c, 50.0, "d") for c in (5, 10, 20, 30, 4)] + [(99, 60.0, "d")], "code long, score double, d string")
    got = signals.ranked(signals.in_universe_order(cands, members), ["d"], tie="place").orderBy("rank").collect()
    assert [r.code for r in got] == [99, 20, 10, 30, 4, 5]


def page(day, minutes, start=0):
    return "".join(f'<i data="{day}{9 + m // 60:02d}{m % 60:02d}|a|b|c|{start + m}|{(m + 1) * 10}">' for m in range(minutes))


def test_daily_switches(spark, sf, tmp_path):
    from barloom.plans import daily
    from barloom.plans.queries import bars
    from barloom.sources import vendor, versions

    b = bars(spark, sf).where("code <= 6").persist()
    vendor.write_pages(b, str(tmp_path / "pages"), page=300)
    b.write.parquet(str(tmp_path / "bars"))
    spark.createDataFrame([("1", page("20240102", 90, 100)), ("2", page("20240102", 25, 500))], "code string, text string").write.parquet(str(tmp_path / "minutes"))
    args = ["--backfill", "3", "--min-amount", "3e5"]
    assert daily.main([str(tmp_path / "pages"), str(tmp_path / "one"), "--cyprice", "--no-m60", "--minutes", str(tmp_path / "minutes"), *args]) == 3
    assert versions.manifest(spark, str(tmp_path / "one/hours"))["version"] == -1
    code = b.groupBy("code").count().first()
    rows = "\n".join(f"A{code[0]},{i},90,80,1,1,1" for i in range(code[1]))
    (tmp_path / "ext.csv").write_text("code,seq,B,T,T_sig,U,U_sig\n" + rows + "\n")
    assert daily.main([str(tmp_path / "bars"), str(tmp_path / "two"), "--cyindi", str(tmp_path / "ext.csv"), "--minutes", str(tmp_path / "minutes"), *args]) == 3
    hours = versions.read(spark, str(tmp_path / "two/hours")).orderBy("code", "hour").collect()
    assert [(r.code, r.hour.hour, r.o, r.h, r.c, r.v, r.since) for r in hours] == [("1", 9, 100.0, 159.0, 159.0, 600.0, 0), ("1", 10, 160.0, 189.0, 189.0, 300.0, 0), ("2", 9, 500.0, 524.0, 524.0, 250.0, 0)]
    daily.keep_hours(spark, daily.hours_of(spark.createDataFrame([("3", page("20240103", 30))], "code string, text string")), str(tmp_path / "two"), codes=2, most=1)
    hours = versions.read(spark, str(tmp_path / "two/hours")).orderBy("code").collect()
    assert [(r.code, r.since) for r in hours] == [("3", 1)]  # the one that came last is this run's own
