"""Snapshots, buy signals, scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.config import HOMERUN, LEGACY, LEGACY_TAG, LIMITS, MOMENTUM, NORMAL, TB, TB_TAG, WEEKLY, WEEKLY_TAG, Legacy
from barloom.functions.numeric import rnd


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def trunc(x: str) -> Column:
    return F.col(x).cast("long")


def complete(shaped: DataFrame, first: int = LIMITS.first_index) -> DataFrame:
    """Bars late enough in their code, with every indicator."""
    return shaped.where((F.col("i") >= first) & F.col("t").isNotNull() & F.col("b").isNotNull() & F.col("u").isNotNull() & F.col("ma30").isNotNull())


def snapshot_columns() -> list:
    return [
        "code", "d",
        trunc("c").alias("close"), trunc("o").alias("open"), trunc("h").alias("high"), trunc("l").alias("low"),
        rnd("gb", 1).alias("gbuy"), rnd("gs", 1).alias("gsell"), rnd("slope5", 1).alias("gb_slope5"), "gs_hold",
        rnd("gs_mean", 2).alias("gs_mean"), rnd("gs_std", 2).alias("gs_std"),
        rnd("t", 1).alias("t"), rnd("b", 1).alias("b"), rnd("u", 1).alias("u"),
        "red", trunc("ma30").alias("ma30"), (F.col("c") >= F.col("ma30")).alias("above_ma30"),
        rnd("chg1", 2).alias("chg1"), rnd("chg5", 2).alias("chg5"), rnd(F.coalesce("chg20", F.lit(0.0)), 2).alias("chg20"),
        rnd("wick", 2).alias("wick"), trunc("v").alias("vol"), (F.col("c") * F.col("v")).cast("long").alias("amount"),
    ]


def snapshot(shaped: DataFrame, *also: str) -> DataFrame:
    """The day's rounded indicators of each code, which exits are decided by, and other columns as they are."""
    return complete(shaped).select(*snapshot_columns(), *also)


def liquid(df: DataFrame, least: float = LIMITS.min_amount) -> DataFrame:
    return df.where(F.floor(F.col("c") * F.col("v")) >= least)


def legacy_score(p: Legacy = LEGACY) -> Column:
    points = (
        22 * F.least(F.lit(1.0), F.col("gs_hold") / p.hold_good)
        + 20 * F.greatest(F.lit(0.0), (p.gs_max - F.col("gs_mean")) / p.gs_max)
        + 14 * F.greatest(F.lit(0.0), 1 - F.col("gs_std") / p.std_max)
        + 16 * F.least(F.lit(1.0), F.col("slope5") / 12)
        + 8 * clamp((F.col("gb") - 10) / 30, 0.0, 1.0)
        + F.when(F.col("spike"), 0).otherwise(6)
        + F.when(F.col("red"), 4).otherwise(0)
        + F.when(F.col("u") >= 50, 5).otherwise(0)
        + F.when(F.col("t") >= 0, 5).otherwise(0)
    )
    return rnd(clamp(points, 0.0, 100.0), 1)


def legacy_rejects(p: Legacy = LEGACY) -> dict[str, Column]:
    """Why a bar is no candidate of the older rule, by name, in the order in which reasons count."""
    out = {
        "hold": F.col("gs_hold") < p.hold_min,
        "std": F.col("gs_std") > p.std_max,
        "rise": F.col("gb") < p.gb_min,
        "slope": F.col("slope5") < p.slope_min,
        "wick": F.col("bad_wick"),
        "down": F.col("big_down"),
        "ma30": F.col("c") < F.col("ma30"),
    }
    if p.gs_entry is not None:
        out["entry"] = F.col("gs") > p.gs_entry
    return out


def legacy_candidates(shaped: DataFrame, p: Legacy = LEGACY, least: float = LIMITS.min_amount) -> DataFrame:
    out = liquid(complete(shaped), least)
    for reject in legacy_rejects(p).values():
        out = out.where(~reject)
    return out.withColumn("score", legacy_score(p))


def evaluate(shaped: DataFrame, strict: bool = True, p: Legacy = LEGACY) -> DataFrame:
    """The variant on a code's latest bar, from its 120th on, without the entry limit; not strict: every reject is only
    named, and the score is given all the same."""
    last = F.row_number().over(W.partitionBy("code").orderBy(F.desc("d"))) == 1
    out = complete(shaped, LIMITS.first_index - 1).withColumn("last", last).where("last").drop("last")
    rejects = {k: v for k, v in legacy_rejects(p).items() if k != "entry"}
    why = F.coalesce(*[F.when(v, k) for k, v in rejects.items()])
    out = out.withColumn("reject", why).withColumn("score", legacy_score(p))
    return out.where(F.col("reject").isNull()) if strict else out


def tb_score() -> Column:
    points = 40 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("chg20", F.lit(0.0))) / 80) + 35 * F.least(F.lit(1.0), F.col("gb") / 60) + 25 * F.least(F.lit(1.0), F.col("tb_hold") / 30)
    return rnd(clamp(points, 0.0, 100.0), 1)


def grade(most: float = MOMENTUM.homerun) -> Column:
    return F.when(F.col("gs") <= most, HOMERUN).otherwise(NORMAL)


def tb_candidates(shaped: DataFrame, p: TB = MOMENTUM, least: float = LIMITS.min_amount) -> DataFrame:
    out = liquid(complete(shaped), least).where(F.col("tb_ok") & (F.col("tb_hold") >= p.hold_min) & (F.col("gs") <= p.gs_entry))
    return out.withColumns({"grade": grade(p.homerun), "timely": F.col("tb_hold") <= p.hold_timely, "score": tb_score(), "r20": rnd(F.coalesce("chg20", F.lit(0.0)), 1)})


def both(shaped: DataFrame, least: float = LIMITS.min_amount, p: Legacy = LEGACY, tb: TB = MOMENTUM, also: tuple = ()) -> DataFrame:
    """snapshot's columns, and others as they are, a row a strategy, with ok (is it a candidate that day), score and
    grade: one pass over the bars serves both rules and, later, the replay."""
    liquid_ = F.floor(F.col("c") * F.col("v")) >= least
    old = liquid_
    for reject in legacy_rejects(p).values():
        old = old & ~reject
    new = liquid_ & F.col("tb_ok") & (F.col("tb_hold") >= tb.hold_min) & (F.col("gs") <= tb.gs_entry)
    one = lambda tag, ok, score, g: F.struct(F.lit(tag).alias("strategy"), ok.alias("ok"), score.alias("score"), g.alias("grade"))
    rows = F.array(one(LEGACY_TAG, old, legacy_score(p), F.lit("")), one(TB_TAG, new, tb_score(), grade(tb.homerun)))
    return complete(shaped).select(*snapshot_columns(), *also, F.inline(rows))


def ranked(candidates: DataFrame, keys: list[str], most: int | None = None, score: str = "score", tie: str = "code") -> DataFrame:
    """Adds rank, from 1: by falling score, ties by a key that is told; cut to the best `most` where given."""
    out = candidates.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), tie)))
    return out if most is None else out.where(F.col("rank") <= most)


def is_common(name: str = "name", code: str = "code") -> Column:
    """Common shares: no special-purpose or property company by name, a code that ends in 0, no preferred share."""
    n, c = F.col(name), F.col(code).cast("string")
    bad = n.contains("스팩") | n.contains("리츠") | n.endswith("우") | n.endswith("우B") | n.endswith("우C")
    return ~bad & c.endswith("0")


def universe(listing: DataFrame, per_market: tuple = LIMITS.per_market, min_price: float = LIMITS.min_price) -> DataFrame:
    """code, name, market, marcap: the largest of each market by value, ties by code."""
    label = F.coalesce(*[F.when(F.col("market").startswith(m), m) for m, _ in per_market])
    rows = listing.withColumn("market", label).where(F.col("market").isNotNull() & (F.col("marcap") > 0) & (F.col("close") >= min_price) & is_common())
    most = F.coalesce(*[F.when(F.col("market") == m, n) for m, n in per_market])
    rank = F.row_number().over(W.partitionBy("market").orderBy(F.desc("marcap"), "code"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("code", "name", "market", F.col("marcap").cast("long").alias("marcap"), "rank")


def in_universe_order(candidates: DataFrame, members: DataFrame, per_market: tuple = LIMITS.per_market) -> DataFrame:
    """candidates with place, by which ranked() may settle ties: the order in which a universe lists its members, market
    after market, each by rank; codes that aren't in it come last, by code. members: what universe() gives."""
    from .sets import small

    market = F.coalesce(*[F.when(F.col("market") == m, i) for i, (m, _) in enumerate(per_market)])
    listed = members.select("code", F.struct(F.lit(0).alias("out"), market.alias("market"), F.col("rank").cast("long").alias("at")).alias("listed"))
    bare = F.struct(F.lit(1).alias("out"), F.lit(0).alias("market"), F.col("code").cast("long").alias("at"))
    return candidates.join(small(listed), "code", "left").withColumn("place", F.coalesce("listed", bare)).drop("listed")


def weekly_entries(day: DataFrame, week: DataFrame, gb_min: float = WEEKLY.gb_min, gs_max: float = WEEKLY.gs_max) -> DataFrame:
    """Days on which both the day's and the last whole week's lines are calm and have risen to `gb_min`, ranked by the
    day's rise line. day, week: code, d, gb and gs; a week's d is its Monday."""
    last = week.select("code", F.date_add("d", 7).alias("wk"), F.col("gb").alias("wgb"), F.col("gs").alias("wgs"))
    both = day.withColumn("wk", F.to_date(F.date_trunc("week", "d"))).join(last, ["code", "wk"])
    return ranked(both.where((F.col("gs") <= gs_max) & (F.col("wgs") <= gs_max) & (F.col("gb") >= gb_min) & (F.col("wgb") >= gb_min)), ["d"], score="gb")


def largest(listing: DataFrame, n: int = WEEKLY.breadth_codes, **more) -> DataFrame:
    """code of the n largest companies of the universe, by value, ties by code."""
    return universe(listing, **more).orderBy(F.desc("marcap"), "code").limit(n).select("code")


def breadth(returns: DataFrame, codes: DataFrame, least: float = WEEKLY.breadth_min) -> DataFrame:
    """(d, breadth, open): the share of the given codes that stand above their close of 20 bars before, and whether new
    orders may be given. Codes without so many bars don't count."""
    up = F.avg(F.when(F.col("chg20") > 0, 1.0).otherwise(0.0))
    rows = returns.where("chg20 is not null").join(F.broadcast(codes), "code", "left_semi")  # codes are limited in number
    return rows.groupBy("d").agg(up.alias("breadth")).withColumn("open", F.col("breadth") >= least)


def weekly_days(day: DataFrame, week: DataFrame, gate: DataFrame, gb_min: float = WEEKLY.gb_min) -> DataFrame:
    """What a replay of the weekly rule needs: strategy, WEEK columns; rank only where the day is an entry and the gate is
    open; days of codes with such a day, from the first one on. wgs is null until a week is whole. day: bars with gb and
    gs; week: the same of weekly bars; gate: d, open."""
    entry = weekly_entries(day, week, gb_min).join(F.broadcast(gate.where("open").select("d")), "d", "left_semi").select("code", "d", "rank")  # a row a day
    last = week.select("code", F.date_add("d", 7).alias("wk"), rnd("gs", 1).alias("wgs"))
    rows = day.withColumn("wk", F.to_date(F.date_trunc("week", "d"))).join(last, ["code", "wk"], "left").join(entry, ["code", "d"], "left")
    first = F.min(F.when(F.col("rank").isNotNull(), F.col("d"))).over(W.partitionBy("code"))
    rows = rows.withColumn("first", first).where("d >= first")
    return rows.select(F.lit(WEEKLY_TAG).alias("strategy"), F.col("code").cast("long").alias("code"), "d", trunc("o").alias("open"), trunc("h").alias("high"), trunc("l").alias("low"), trunc("c").alias("close"), "wgs", F.when(F.col("rank").isNotNull(), rnd("gb", 1)).alias("score"), F.col("rank").cast("int").alias("rank"), F.lit("").alias("grade"))


def weekly_exit(df: DataFrame, most: float = WEEKLY.week_exit, stop: float = WEEKLY.stop) -> DataFrame:
    """The documented weekly variant's exits: the week's fall line above `most`, or the close below the stop; no take.
    df: wgs, close, entry."""
    stopped = (F.col("close").cast("double") / F.col("entry") - 1) * 100 <= stop
    return df.withColumn("rule", F.when(stopped, "stop").when(F.col("wgs") > most, "weekly"))


def timing(hourly: DataFrame, p: Legacy = LEGACY) -> DataFrame:
    """A code's latest 60-minute bar: g rise and fall over 100 bars if it has 120, else 32; hold over the last 29 bars;
    ready if it holds, is calm, has risen and rises. hourly: code, d (the hour), c and the rest; codes with 60 bars."""
    from .indicators import golden, in_order, indexed
    from .shape import streak

    n = F.count(F.lit(1)).over(W.partitionBy("code"))
    out = indexed(hourly).withColumn("n", n).where("n >= 60")
    long, short = golden(100), golden(32)
    out = out.withColumns({"gb": F.when(F.col("n") >= 120, long[0]).otherwise(short[0]), "gs": F.when(F.col("n") >= 120, long[1]).otherwise(short[1])})
    out = out.withColumn("hold", streak(F.col("gs") <= p.gs_max, 29)).withColumn("seg", F.collect_list("gs").over(in_order().rowsBetween(-28, 0))).withColumn("gb4", F.lag("gb", 4).over(in_order()))
    out = out.where(F.col("i") == F.col("n") - 1)
    seg = F.slice("seg", -F.greatest("hold", F.lit(1)), F.greatest("hold", F.lit(1)))
    mean = F.aggregate(seg, F.lit(0.0), lambda a, x: a + x) / F.size(seg)
    out = out.withColumn("mean", mean).withColumn("part", seg)
    std = F.when(F.size("part") < 2, 0.0).otherwise(F.sqrt(F.aggregate("part", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("part")))
    out = out.withColumn("std", std)
    ready = (F.col("hold") >= 4) & (F.col("std") <= p.std_max) & (F.col("gb") >= p.gb_min) & (F.col("gb") > F.col("gb4"))
    return out.select("code", "d", "n", "gb", "gs", "hold", "std", ready.alias("ready"))
