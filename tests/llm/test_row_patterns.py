"""Row patterns against a plain backtracking search, over many small tasks and over segments that no task holds whole."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import row_patterns

SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, row long"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain(rows):
    """Letters by trying A (D|U)* P D* row by row."""
    out = []
    seen = {r for r in rows if r[1] is not None and r[2] is not None}
    cents = lambda v: None if v is None or not math.isfinite(v) or abs(v) > 9e13 else math.floor(v * 100 + 0.5)
    low = -(1 << 63)
    order = lambda r: (r[2], r[1], low if r[0] is None else r[0], low if cents(r[4]) is None else cents(r[4]), (r[3] == "view") + 2 * (r[3] not in (None, "error")))
    byc = {}
    for r in sorted(seen, key=order):
        byc.setdefault(r[2], []).append(r)
    for client, rs in byc.items():
        c = [cents(r[4]) for r in rs]
        near = [i > 0 and c[i] is not None and c[i - 1] is not None and rs[i][1] - rs[i - 1][1] <= datetime.timedelta(minutes=15) for i in range(len(rs))]
        good = [r[3] not in (None, "error") for r in rs]
        letter = ["D" if near[i] and good[i] and c[i] < c[i - 1] else "U" if near[i] and good[i] and c[i] > c[i - 1] else "" for i in range(len(rs))]
        i, no = 0, 0
        while i < len(rs):
            best = None
            if c[i] is not None:
                j = i + 1
                while j < len(rs) and letter[j]:
                    j += 1
                for p in range(min(j, len(rs) - 1), i, -1):  # the longest first, then shorter ones
                    if near[p] and rs[p][3] == "view" and c[p] >= c[i]:
                        e = p
                        while e + 1 < len(rs) and letter[e + 1] == "D":
                            e += 1
                        best = (p, e)
                        break
            if best is None:
                i += 1
                continue
            p, e = best
            no += 1
            letters = "A" + "".join(letter[i + 1 : p]) + "P" + "D" * (e - p)
            assert re.fullmatch("A[DU]*PD*", letters)
            out.append((client, no, rs[i][0], rs[e][0], e - i + 1, sum(c[i : e + 1]), letters))
            i = e
    return sorted(out, key=repr)


def same(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("labels", F.lit("mine")).withColumn("n_rows", F.lit(1))
    got = sorted((tuple(r) for r in row_patterns.find(df, **more).collect()), key=repr)
    assert got == plain(rows)
    return got


def some(seed, n, clients, breaks=0.15, values=40):
    rnd, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 30, 400, 900, 901]) if rnd.random() < breaks else rnd.choice([0, 5])
        kind = rnd.choice(["view", "view", "click", "purchase"]) if rnd.random() > breaks else rnd.choice(["error", None])
        value = None if rnd.random() < breaks / 5 else rnd.randrange(values) / 4 - 1
        out.append((i if rnd.random() > 0.02 else i - 1, at(t) if rnd.random() > 0.01 else None, rnd.choice(clients), kind, value, 0))
        if rnd.random() < 0.05:
            out.append(out[-1])
    return out


@pytest.mark.parametrize("seed,breaks", [(1, 0.15), (2, 0.02), (3, 0.4)])
def test_equals_a_plain_search_over_small_tasks(spark, seed, breaks):
    got = same(spark, some(seed, 900, [0, 0, 0, 1, 2, None], breaks), rows_a_task=60)
    assert len(got) > 20


def test_one_segment_over_many_tasks(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, at(i), 7, rnd.choice(["view", "click"]), float(rnd.randrange(10_000)), 0) for i in range(3000)]
    monkeypatch.setattr(row_patterns, "ROWS_AT_ONCE", 64)
    got = same(spark, rows, rows_a_task=150)
    assert max(r[4] for r in got) > 1000  # a match of most of the segment, whose length is over LONG too


def test_many_matches_in_a_long_segment(spark):
    # falling envelopes: each rise matches on its own
    rows = [(i, at(i), 1, "view", 20_000.0 - 3 * (i // 3) + (0, 2, 1)[i % 3], 0) for i in range(4000)]
    assert len(same(spark, rows, rows_a_task=500)) > 500


@pytest.mark.parametrize("seed", range(30))
def test_long_segments_take_the_same_starts(monkeypatch, seed):
    rnd = random.Random(seed)
    n = rnd.randrange(2, 60)
    values = [rnd.randrange(12) for _ in range(n)]
    sym = bytearray(b"a")
    for a, b in zip(values, values[1:], strict=False):
        view = rnd.random() < 0.4
        sym += b"P" if a == b else (b"D" if view else b"d") if b < a else (b"U" if view else b"u")
    order = sorted(range(n), key=lambda i: values[i])
    every = row_patterns.segment_matches(bytearray(sym), values, order)
    monkeypatch.setattr(row_patterns, "LONG", 1)
    assert row_patterns.segment_matches(bytearray(sym), values, order) == every


def test_edges(spark):
    rows = [
        (1, at(0), 1, "view", 1.0, 0), (2, at(900), 1, "view", 1.0, 0),  # exactly 15 minutes
        (3, at(1800.000001), 1, "view", 1.0, 0),  # a microsecond more
        (1, at(0), 2, None, 1.0, 0), (2, at(1), 2, "view", 2.0, 0), (3, at(2), 2, "error", 1.0, 0), (4, at(3), 2, "view", 5.0, 0),
        (1, at(0), 3, "view", float("nan"), 0), (2, at(1), 3, "view", float("inf"), 0), (3, at(2), 3, "view", None, 0), (4, at(3), 3, "view", 1e300, 0),
        (None, at(0), 4, "click", -0.005, 0), (None, at(1), 4, "view", 0.005, 0), (9, at(1), 4, "click", 0.0, 0),
        (5, at(5), 5, "click", 1.0, 0), (5, at(5), 5, "view", 1.0, 0), (5, at(5), 5, "view", 1.0, 1), (5, at(5), 5, "error", 1.0, 0), (5, at(5), 5, None, None, 0),
        (1, None, 6, "view", 1.0, 0), (1, at(0), None, "view", 1.0, 0),
    ]
    got = same(spark, rows)
    assert (1, 1, 1, 2, 2, 200, "AP") in got and (4, 1, None, 9, 3, 1, "APD") in got
    assert row_patterns.find(spark.createDataFrame([], SCHEMA)).count() == 0
