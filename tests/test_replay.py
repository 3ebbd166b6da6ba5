"""The replay in three steps against the book that plays all codes at once."""

import datetime
import random

import pandas as pd
import pytest

from barloom.config import LEGACY_TAG, TB_TAG, WEEKLY_TAG
from barloom.operators import replay

NAMES = [c.split()[0] for c in replay.LOG.split(", ")]


def whole(days, slots):
    """All of a strategy's days in one place."""
    out = []
    for tag, pdf in days.toPandas().groupby("strategy"):
        book = replay.books(tag, None, slots)
        for d, day in replay.days_of(replay.columns_of(pdf)).items():
            out += book.step(d, day)
    return sorted(out, key=lambda r: (r[0], r[1]))


def some(spark, seed, codes=14, n=60):
    rnd = random.Random(seed)
    rows = []
    for tag in (TB_TAG, LEGACY_TAG):
        by_day = {}
        for code in range(codes):
            price = 1000
            for k in range(n):
                if rnd.random() < 0.12:
                    continue  # no bar
                o = price + rnd.randrange(-60, 61)
                c = max(100, o + rnd.randrange(-90, 95))
                by_day.setdefault(k, []).append([code, o, max(o, c) + rnd.randrange(60), min(o, c) - rnd.randrange(60), c])
                price = c
        for k, day in by_day.items():
            rnd.shuffle(day)
            best = rnd.randrange(0, 7)
            for i, (code, o, h, low, c) in enumerate(day):
                rank = i + 1 if i < best else None
                rows.append((tag, code, datetime.date(2024, 1, 1) + datetime.timedelta(days=k), o, h, low, c, rnd.choice([1.0, 3.9, 5.5, 8.5]) if rnd.random() < 0.3 else 1.0, rnd.choice([-4.0, 1.0, 1.0]), rnd.choice([15.0, 22.0, 40.0, 40.0]), rnd.choice([55.0, 61.0, 80.0, 80.0]), rnd.choice([-5.0, 1.0, 1.0, 1.0]), rnd.random() > 0.1, 990, rnd.random() > 0.3, rnd.choice([0.1, 0.9]), 70.5 - i if rank else None, rank, "일반" if rank else None))
    return spark.createDataFrame(rows, "strategy string, " + replay.DAY)


def plain(rows):
    return [tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in rows]


@pytest.mark.parametrize("seed,slots", [(1, 3), (2, 1), (3, 10), (4, 4)])
def test_equals_one_book_over_all_codes(spark, seed, slots):
    days = some(spark, seed).persist()
    got = plain(sorted((tuple(r) for r in replay.replay(days.repartition(5), slots).select(*NAMES).collect()), key=lambda r: (r[0], r[1])))
    want = plain(whole(days, slots))
    assert len(want) > 40 and got == want


def test_more_candidates_than_slots_and_empty_tables(spark):
    days = some(spark, 9, codes=30, n=25).persist()
    assert plain(sorted((tuple(r) for r in replay.replay(days, 2).collect()), key=lambda r: (r[0], r[1]))) == plain(whole(days, 2))
    assert replay.replay(days.limit(0)).count() == 0 and replay.replay(days.where("rank is null")).count() == 0


def test_the_weekly_rule(spark):
    rnd, rows = random.Random(3), []
    for k in range(40):
        codes = [c for c in range(5) if rnd.random() > 0.1]
        rnd.shuffle(codes)
        best = rnd.randrange(0, 4)
        for i, c in enumerate(codes):
            p = 1000 + rnd.randrange(100)
            rows.append((WEEKLY_TAG, c, datetime.date(2024, 1, 1) + datetime.timedelta(days=k), p, p + 9, p - rnd.choice([5, 150]), p + 2, rnd.choice([None, 3.0, 30.0]), 50.0, i + 1 if i < best else None, ""))
    days = spark.createDataFrame(rows, "strategy string, " + replay.WEEK).persist()
    got = plain(sorted((tuple(r) for r in replay.replay(days, 2).collect()), key=lambda r: r[1]))
    assert got == plain(whole(days, 2)) and len(got) > 20
