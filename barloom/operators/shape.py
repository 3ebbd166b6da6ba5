"""Wicks, streaks, segments and spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.config import LEGACY, MOMENTUM, TB, Legacy
from barloom.functions.numeric import change

from .indicators import back, in_order, indexed, pressed, recursive, rows, with_golden


def wick() -> Column:
    """The upper wick over the body; a bar without a body has 999, or 0 if it has no wick either."""
    up, body = F.col("h") - F.greatest("o", "c"), F.abs(F.col("c") - F.col("o"))
    return F.when(body > 0, up / F.when(body > 0, body)).otherwise(F.when(up > 0, 999.0).otherwise(0.0))


def lately(condition: Column, bars: int) -> Column:
    """Whether the condition held on any of the last so many bars."""
    return F.max(F.coalesce(condition, F.lit(False)).cast("int")).over(rows(bars - 1)) == 1


def streak(ok: Column, cap: int) -> Column:
    """How many bars in a row, this one the last, the condition has held; capped. Needs i."""
    last_bad = F.max(F.when(~F.coalesce(ok, F.lit(False)), F.col("i"))).over(in_order().rowsBetween(W.unboundedPreceding, 0))
    return F.least(F.lit(cap), F.col("i") - F.coalesce(last_bad, F.lit(-1))).cast("int")


def tb_ok(p: TB = MOMENTUM) -> Column:
    return F.coalesce((F.col("t") >= p.t_min) & (F.col("b") >= p.b_min), F.lit(False))


def with_shape(series: DataFrame, p: Legacy = LEGACY, tb: TB = MOMENTUM) -> DataFrame:
    """Adds wick, bad_wick, big_down, gs_hold, gs_mean, gs_std, spike, slope5, chg1/5/20, tb_ok, tb_hold."""
    out = series.withColumns({
        "wick": wick(),
        "chg1": change(F.col("c"), back("c", 1)),
        "chg5": change(F.col("c"), back("c", 5)),
        "chg20": change(F.col("c"), back("c", 20)),
        "slope5": F.col("gb") - back("gb", 5),
        "gs_hold": streak(F.col("gs") <= p.gs_max, p.lookback),
        "gs_last": F.collect_list("gs").over(rows(p.lookback - 1)),
    })
    out = out.withColumns({
        "bad_wick": lately((F.col("wick") > p.wick_max) & (F.col("h") > F.col("c")), p.wick_bars),
        "big_down": lately(F.col("chg1") <= p.big_down, p.wick_bars),
        # the streak's bars, or this bar alone
        "seg": F.slice("gs_last", -F.greatest(F.col("gs_hold"), F.lit(1)), F.greatest(F.col("gs_hold"), F.lit(1))),
        "before": F.slice("gs_last", F.lit(1), F.size("gs_last") - F.col("gs_hold")),
    })
    mean = F.aggregate("seg", F.lit(0.0), lambda a, x: a + x) / F.size("seg")
    out = out.withColumn("gs_mean", mean)
    spread = F.aggregate("seg", F.lit(0.0), lambda a, x: a + (x - F.col("gs_mean")) * (x - F.col("gs_mean")))
    out = out.withColumns({
        "gs_std": F.when(F.size("seg") < 2, 0.0).otherwise(F.sqrt(spread / F.size("seg"))),
        "spike": F.coalesce((F.col("gs_hold") < p.lookback) & (F.array_max("before") > p.spike), F.lit(False)),
    })
    if "t" in series.columns:
        out = out.withColumn("tb_ok", tb_ok(tb)).withColumn("tb_hold", streak(F.col("tb_ok"), tb.hold_cap))
    return out.drop("gs_last", "seg", "before")


def shaped(bars: DataFrame, also=None, p: Legacy = LEGACY, tb: TB = MOMENTUM) -> DataFrame:
    """All indicators and shapes of bars, by one shuffle: windows first, and also(rows), which may add further ones, then
    the means and sums of sliding frames and the recursive averages with their streak. also() finds no mesh and no u."""
    out = with_shape(with_golden(indexed(bars)), p, tb)
    return recursive(pressed(also(out) if also else out), hold=(tb.t_min, tb.b_min, tb.hold_cap), sliding=True)
