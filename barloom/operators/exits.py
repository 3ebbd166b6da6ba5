"""Exit rules as columns, over snapshots joined with positions (entry, peak, days)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import LEGACY, MOMENTUM, TB, Legacy
from barloom.functions.numeric import over


def with_legacy_exit(df: DataFrame, p: Legacy = LEGACY) -> DataFrame:
    """Adds action, rule, severity: the first rule that matches, on rounded indicators."""
    peak = F.greatest("peak", "close")
    fall = (over(F.col("close").cast("double"), peak.cast("double")) - 1) * 100
    rules: list[tuple[str, Column, str]] = [
        ("gs_hard", F.col("gsell") > p.gs_hard, "청산"),
        ("big_down", F.col("chg1") <= p.exit_down, "청산"),
        ("ma30", ~F.col("above_ma30"), "청산"),
        ("gs_exit", F.col("gsell") > p.gs_exit, "청산"),
        ("gb_drop", F.col("gb_slope5") <= p.gb_drop, "청산"),
        ("trail", F.coalesce(fall <= p.trail, F.lit(False)), "청산"),
        ("days", F.col("days") >= p.max_days, "기간"),
    ]
    warn = (F.col("wick") > p.wick_max) | (F.col("gsell") > p.gs_warn) | ~F.col("red")
    rule = F.coalesce(*[F.when(c, n) for n, c, _ in rules])
    severity = F.coalesce(*[F.when(c, s) for _, c, s in rules], F.when(warn, "주의").otherwise("정상"))
    return df.withColumns({"rule": rule, "severity": severity, "action": F.when(rule.isNull(), "HOLD").otherwise("SELL")})


def with_tb_exit(df: DataFrame, p: TB = MOMENTUM) -> DataFrame:
    """Adds action, reason, severity: sold as soon as a leg is broken, with the broken legs told."""
    one = lambda x: F.format_string("%.1f", F.col(x))
    weak_t, weak_b = F.col("t") < p.t_min, F.col("b") < p.b_min
    broke = F.concat_ws(" · ", F.when(weak_t, F.concat(F.lit("T "), one("t"), F.lit(f" < {p.t_min:.0f}"))), F.when(weak_b, F.concat(F.lit("B "), one("b"), F.lit(f" < {p.b_min:.0f}"))))
    warn = F.concat_ws(" · ", F.when(F.col("t") < p.t_min + p.t_warn, F.concat(F.lit("T "), one("t"), F.lit(" 기준선 근접"))), F.when(F.col("b") < p.b_min + p.b_warn, F.concat(F.lit("B "), one("b"), F.lit(" 기준선 근접"))), F.when(F.col("gsell") > p.homerun, F.concat(F.lit("청선 "), one("gsell"))))
    sold = weak_t | weak_b
    return df.withColumns({
        "action": F.when(sold, "SELL").otherwise("HOLD"),
        "reason": F.when(sold, F.concat(broke, F.lit(" 이탈"))).when(warn == "", "T·B 유지").otherwise(warn),
        "severity": F.when(sold, "이탈").when(warn == "", "정상").otherwise("주의"),
    })


def stop_take(df: DataFrame, stop: float | None, take: float | None) -> DataFrame:
    """Adds fill and kind: an order that a bar's range sets off, the stop before the take; prices truncated. Needs entry,
    open, high, low."""
    low = F.col("entry") * (1 + stop / 100) if stop is not None else F.lit(None).cast("double")
    high = F.col("entry") * (1 + take / 100) if take is not None else F.lit(None).cast("double")
    stopped, taken = F.coalesce(F.col("low") <= low, F.lit(False)), F.coalesce(F.col("high") >= high, F.lit(False))
    fill = F.when(stopped, F.least(low, F.col("open").cast("double")).cast("long")).when(taken, F.greatest(high, F.col("open").cast("double")).cast("long"))
    return df.withColumns({"kind": F.when(stopped, "손절").when(taken, "익절"), "fill": fill})
