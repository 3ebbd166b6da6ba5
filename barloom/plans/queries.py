"""Named queries over the driver's tables, each paired with SQL in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.config import LEGACY_TAG, LIMITS, TB_TAG
from barloom.functions.numeric import rnd
from barloom.operators import exits, ledger, replay, report, scans, sets, shape, signals
from barloom.operators import indicators as ind
from barloom.sources import bars as src
from barloom.sources import shared, versions

from . import kept
from .oracle import told

FLOOR = 3e5  # the fixture's prices and sizes are small; the rule's own floor is config.LIMITS.min_amount
RISE = 8.0  # the fixture's moves are small; the rule's own rise line is config.WEEKLY.gb_min
Query = Callable[[SparkSession, str], DataFrame]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return src.dealt(src.table(spark, sf, "lineitem"), "l_suppkey")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return src.daily_bars(lines(spark, sf))


def shaped(spark: SparkSession, sf: str, also=None) -> DataFrame:
    return shape.shaped(bars(spark, sf), also)


def six(df: DataFrame, *cols: str, also: tuple = ()) -> DataFrame:
    return df.select("code", "d", *[rnd(c, 6).alias(c) for c in cols], *also)


def listing(spark: SparkSession, sf: str) -> DataFrame:
    s, n = src.table(spark, sf, "supplier"), src.table(spark, sf, "nation")
    market = F.when(F.col("n_regionkey") % 2 == 0, "KOSPI").otherwise("KOSDAQ GLOBAL")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), market.alias("market"), (F.col("s_acctbal") * 100).alias("marcap"), (F.col("s_acctbal") + 500).alias("close"))


def candidates(s: DataFrame) -> DataFrame:
    """Both rules' candidates out of one pass over the bars, ranked within each day."""
    return signals.ranked(signals.both(s, FLOOR).where("ok"), ["strategy", "d"]).select("strategy", "code", "d", "score", "grade", "rank")


def universe_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates ranked with ties in the universe's order; the fixture's companies count at any price."""
    found = signals.both(shaped(spark, sf), FLOOR).where("ok").select("strategy", "code", "d", "score")
    placed = signals.in_universe_order(found, signals.universe(listing(spark, sf), min_price=0.0))
    return signals.ranked(placed, ["strategy", "d"], tie="place").select("strategy", "d", "code", "score", "rank")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(shaped(spark, sf))


def held(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with made-up positions, opened ten bars before."""
    entry = ind.back("o", 10)
    peak = F.greatest(entry, F.max("c").over(ind.rows(10)))
    days = 10 + (F.col("code") + F.col("i")) % 40
    s = shaped(spark, sf, lambda f: f.withColumns({"entry": entry.cast("long"), "days": days, "peak": peak.cast("long")}))
    return signals.snapshot(s, "entry", "days", "peak").where("entry is not null")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Closed trades out of every signal: bought at the next open, sold ten opens later."""
    ahead = lambda x, k: F.lead(x, k).over(ind.in_order())
    new = {"entry": ahead("o", 1).cast("long"), "exit": ahead("o", 11).cast("long"), "entry_date": ahead("d", 1), "exit_date": ahead("d", 11)}
    t = signals.both(shaped(spark, sf, lambda f: f.withColumns(new)), FLOOR, also=("i", *new)).where("ok and exit is not null")
    reasons = F.array(*[F.lit(x) for x in ("장중 손절 (기준)", "장중 익절", "청선 8.1 — 5선 이탈", "보유 40일 경과 — 기간 청산", "T 19.9 < 20 이탈", "강제")])
    t = t.select("strategy", "grade", "code", "entry_date", "exit_date", "entry", "exit", rnd((F.col("exit") / F.col("entry") - 1) * 100, 2).alias("pnl"), (10 + F.col("i") % 3).cast("int").alias("days"), F.get(reasons, (F.col("i") % 6).cast("int")).alias("reason"))
    # the log's order, without numbering all rows in one place
    return t.withColumn("seq", F.unix_date("exit_date").cast("long") * 10_000_000 + F.col("code") * 10 + F.when(F.col("strategy") == LEGACY_TAG, 1).otherwise(0))


def log_of_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The trades as rows of a signal log, numbers as texts."""
    text = lambda c: F.col(c).cast("string")
    t = trades(spark, sf)
    return t.select("strategy", "grade", "code", F.lit("").alias("name"), F.lit("").alias("market"), "entry_date", F.col("exit_date").alias("date"), F.lit("SELL").alias("action"), text("entry").alias("entry_price"), text("exit").alias("price"), text("pnl").alias("pnl_pct"), text("days").alias("days_held"), F.concat("reason", F.lit(" → 종가신호, 시가 체결")).alias("reason"), F.lit("").alias("severity"), "seq")


def replay_days(spark: SparkSession, sf: str) -> DataFrame:
    return replay.ever(signals.both(shaped(spark, sf), FLOOR))


def replayed(*tags: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return replay.replay(replay_days(spark, sf).where(F.col("strategy").isin(*tags)))

    return run


def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of a running total by type and day, which sometimes falls."""
    e = src.table(spark, sf, "events")
    w = W.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.col("event_id") % 7).over(w) - F.when(F.col("event_id") % 11 == 0, 9).otherwise(0)
    return e.select(F.col("event_type").alias("code"), F.to_date("ts").alias("d"), "ts", "event_id", F.col("value").alias("price"), total.alias("total"))


def cum_volume(spark: SparkSession, sf: str) -> DataFrame:
    return src.volume_steps(running_totals(spark, sf).drop("price"), "total", ["code", "d"], ["ts", "event_id"]).drop("ts")


def universe_counts(spark: SparkSession, sf: str) -> DataFrame:
    market = F.when(F.col("market").startswith("KOSPI"), "KOSPI").otherwise("KOSDAQ")
    return listing(spark, sf).groupBy(market.alias("market")).agg(F.count(F.lit(1)).alias("n"))


def common_shares(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in ("", "스팩1호", "리츠", "우", "우B", "우C", "우D")])
    nm = F.concat("p_name", F.get(ends, (F.floor(F.col("p_partkey") / 10) % 7).cast("int")))
    return src.table(spark, sf, "part").select("p_partkey", nm.alias("nm")).withColumn("ok", signals.is_common("nm", "p_partkey"))


def overridden(spark: SparkSession, sf: str) -> DataFrame:
    b = ind.counted(ind.indexed(bars(spark, sf)))
    # of every third code as many rows as bars, of every other third one fewer
    ours = F.col("code") % 3 == 0
    ext = b.where(ours | ((F.col("code") % 3 == 1) & (F.col("i") > 0)))
    t, b_ = F.when(F.col("i") % 5 != 0, F.col("c") % 90), F.col("h") % 70
    ext = ext.select("code", F.col("i").alias("seq"), F.when(ours, t).otherwise(1.0).alias("T"), F.when(ours, b_).otherwise(1.0).alias("B"))
    return six(ind.override(ind.recursive(b), ext), "t", "b")


def union_parts(spark: SparkSession, sf: str) -> tuple:
    """Each rule's codes by their best rank, the key and the order."""
    best = shared.kept(ranked(spark, sf).groupBy("strategy", "code").agg(F.min("rank").alias("at")), "best")  # read several times
    part = lambda tag: best.where(F.col("strategy") == tag).select("code", "at")
    return [part(TB_TAG), part(LEGACY_TAG)], "code", "at"


def ordered(spark: SparkSession, sf: str) -> DataFrame:
    return sets.ordered_union(*union_parts(spark, sf))


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events").select(F.col("event_type").alias("code"), F.date_trunc("hour", "ts").alias("hour"), "value", "event_id")
    bar = lambda df: df.groupBy("code", "hour").agg(F.max("value").alias("px"))
    return sets.upsert(bar(e), bar(e.where(F.col("event_id") % 2 == 1)), "code", "hour", LIMITS.hourly_bars)


def breadth(spark: SparkSession, sf: str) -> DataFrame:
    codes = signals.largest(listing(spark, sf), min_price=0.0)
    return signals.breadth(ind.returns(bars(spark, sf)), codes).withColumn("breadth", rnd("breadth", 4))


def weekly_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly rule's days, with the fixture's rise line."""
    b = bars(spark, sf)
    week = ind.with_golden(src.weekly_bars(b).withColumnRenamed("w", "d"))
    return signals.weekly_entries(ind.with_golden(b), week, RISE).select("code", "d", rnd("gb", 6).alias("gb"), "rank")


def weekly_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly rule from entry to exit, with the fixture's rise line and the gate over all of its few companies."""
    b = bars(spark, sf)
    week = ind.with_golden(src.weekly_bars(b).withColumnRenamed("w", "d"))
    gate = signals.breadth(ind.returns(b), listing(spark, sf).select("code"))
    return replay.replay(signals.weekly_days(ind.with_golden(b), week, gate, RISE))


def alone(spark: SparkSession, sf: str) -> DataFrame:
    """The momentum rule with a book of one position for each code."""
    days = replay_days(spark, sf).where(F.col("strategy") == TB_TAG)
    log = replay.replay_alone(days)
    return log.select("code", "d", "action", "price", "entry_date", "entry_price", "days_held", rnd((F.col("price") / F.col("entry_price") - 1) * 100, 4).alias("pnl"))


def fixed_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of purchase, hold and sale of each of the trades."""
    row = lambda k, action, d, price, pnl, reason: F.struct(F.lit(k).alias("k"), F.lit(action).alias("action"), d.alias("d"), price.alias("price"), pnl.alias("pnl_pct"), reason.alias("reason"))
    zero, none = F.lit(0.0), F.lit("")
    rows = F.array(row(0, "BUY", F.col("entry_date"), F.col("entry"), zero, none), row(1, "HOLD", F.date_add("entry_date", 1), F.col("entry"), zero, none), row(2, "SELL", F.col("exit_date"), F.col("exit"), F.col("pnl"), F.col("reason")))
    t = trades(spark, sf).select("strategy", "code", "seq", F.inline(rows))
    return t.withColumns({"seq": F.col("seq") * 3 + F.col("k"), "severity": F.lit("-"), "rank": F.lit(None).cast("int")}).drop("k")


def chart_texts(b: DataFrame) -> DataFrame:
    """Charts with their arrays as texts."""
    c = report.charts(b)
    return c.select("code", "n", *[F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(x) for x in "tohlcv"])


def observed(spark: SparkSession, sf: str) -> DataFrame:
    b = shared.kept(bars(spark, sf), "bars")
    week = ind.indexed(ind.with_golden(src.weekly_bars(b).withColumnRenamed("w", "d")))
    out = report.observable(shape.shaped(b), week)
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({c: rnd(c, 6) for c in numbers})


def candidate_lists(spark: SparkSession, sf: str) -> DataFrame:
    r = shared.kept(ranked(spark, sf).select("strategy", "code", "d", "grade", "rank"), "candidates")
    c = report.candidate_lists(r, 5, 2, 40)
    return c.withColumn("codes", F.array_join(F.transform("codes", lambda v: v.cast("string")), ","))


def not_held(spark: SparkSession, sf: str) -> DataFrame:
    r = shared.kept(ranked(spark, sf).select("strategy", "code", "d", "rank"), "candidates")
    pos = r.where((F.col("code") + F.dayofmonth("d")) % 4 == 0).select("code", "strategy", "d")
    return sets.not_held(r, pos, ["code", "strategy", "d"], "rank", 5).select("strategy", "d", "code", "order")


def with_ordered(spark: SparkSession, sf: str) -> DataFrame:
    found = shared.kept(signals.both(shaped(spark, sf), FLOOR).where("ok").select("strategy", "code", "d"), "candidates")
    # the older rule's candidates are legacy_candidates
    return sets.flagged(found, found.where(F.col("strategy") == LEGACY_TAG), ["code", "d"], "ordered").select("strategy", "d", "code", "ordered")


def timing(spark: SparkSession, sf: str) -> DataFrame:
    h = src.hourly_bars(src.table(spark, sf, "events")).withColumnRenamed("hour", "d")
    return signals.timing(h).withColumns({x: rnd(x, 6) for x in ("gb", "gs", "std")})


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """cum_volume's steps, out of a stream of rows that come late and more than once."""
    e = running_totals(spark, sf).select("code", "ts", F.col("event_id").alias("id"), "price", F.col("total").cast("double").alias("total"))
    steps, _ = kept.streamed_steps(e, "12 days")
    out = versions.read(spark, steps).where("code <> ''")
    return out.select("code", "d", F.col("id").alias("event_id"), F.col("total").cast("long").alias("total"), F.col("step").cast("long").alias("step"))


def streamed_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars kept up from such a stream, their volume the steps'."""
    e = running_totals(spark, sf).select("code", "ts", F.col("event_id").alias("id"), "price", F.col("total").cast("double").alias("total"))
    _, bars_ = kept.streamed_steps(e, "12 days")
    return versions.read(spark, bars_).where("code <> ''").select("code", F.col("hour").cast("timestamp_ntz").alias("hour"), "o", "h", "l", "c", F.col("v").cast("long").alias("v"))


def capped(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly clicks of clients: a store up to April, then what came on the last three days; of the codes those stay that
    came then and the last ones that came before, 160 in all, of each the last 240 hours."""
    c = src.table(spark, sf, "clicks").where("client_id is not null and ts is not null")
    c = c.select(F.col("client_id").alias("code"), F.date_trunc("hour", "ts").alias("hour"), "value")
    bar = lambda df: df.groupBy("code", "hour").agg(F.max("value").alias("px"))
    new = bar(c.where("hour >= timestamp_ntz'2024-04-27 00:00:00'"))
    old = bar(c.where("hour < timestamp_ntz'2024-04-01 00:00:00'"))
    first = F.min("hour").over(W.partitionBy("code"))
    store = sets.upsert(old, new, "code", "hour").withColumn("since", first)
    store = sets.capped(store, new, "since").drop("since")
    return store.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy(F.desc("hour")))).where(F.col("r") <= LIMITS.hourly_bars).drop("r")


def _registry() -> dict[str, Query]:
    b = lambda f: lambda s, d: f(bars(s, d))
    x = lambda f: lambda s, d: f(shaped(s, d))
    return {
        "daily_bars": bars,
        "hourly_bars": lambda s, d: src.hourly_bars(src.table(s, d, "events")),
        "cum_to_delta_volume": cum_volume,
        "weekly_bars": b(src.weekly_bars),
        "universe_topn": lambda s, d: signals.universe(listing(s, d)),
        "universe_counts": universe_counts,
        "common_share_filter": common_shares,
        "min_history": b(lambda f: src.enough(f, 520).select("code", "d", "n")),
        "sma": b(lambda f: ind.indexed(f).select("code", "d", *[rnd(ind.sma("c", n), 6).alias(f"sma{n}") for n in (5, 20, 30)])),
        "mesh": b(lambda f: six(ind.mesh(ind.indexed(f)), "ma10", "ma35", "top", "bottom", also=("red",))),
        "golden_ratio": b(lambda f: six(ind.with_golden(f), "gb", "gs")),
        "golden_symmetric": b(lambda f: six(ind.with_golden(f, 25, "symmetric"), "gb", "gs")),
        "ultimate": b(lambda f: six(ind.ultimate(ind.indexed(f)), "u", "u_sig")),
        "returns": b(lambda f: six(ind.returns(f), "chg1", "chg5", "chg20")),
        "slope5": b(lambda f: six(ind.with_golden(f).withColumn("slope5", F.col("gb") - ind.back("gb", 5)), "slope5")),
        "ema": b(lambda f: six(ind.recursive(f), "ema")),
        "tsi": b(lambda f: six(ind.recursive(f), "t", "t_sig")),
        "rsi_b": b(lambda f: six(ind.recursive(f), "b")),
        "spread_averages": b(lambda f: six(scans.spread_averages(f, F.year("d")), "ema", "t", "t_sig", "b")),
        "wick": b(lambda f: six(f.withColumn("wick", shape.wick()), "wick")),
        "bad_wick": b(lambda f: f.withColumn("wick", shape.wick()).select("code", "d", shape.lately((F.col("wick") > 0.5) & (F.col("h") > F.col("c")), 3).alias("bad_wick"))),
        "big_down": b(lambda f: ind.returns(f).select("code", "d", shape.lately(F.col("chg1") <= -4, 3).alias("big_down"))),
        "gs_streak": b(lambda f: ind.with_golden(ind.indexed(f)).select("code", "d", shape.streak(F.col("gs") <= 5, 15).alias("gs_hold"))),
        "tb_streak": b(lambda f: ind.indexed(ind.recursive(f)).withColumn("tb_ok", shape.tb_ok()).select("code", "d", "tb_ok", shape.streak(F.col("tb_ok"), 60).alias("tb_hold"))),
        "segment_stats": b(lambda f: six(shape.with_shape(ind.with_golden(ind.indexed(f))), "gs_mean", "gs_std")),
        "spike": b(lambda f: shape.with_shape(ind.with_golden(ind.indexed(f))).select("code", "d", "spike")),
        "month_boundary": b(lambda f: ind.month_marks(f).select("code", "d", "new_month")),
        "sign_runs": b(lambda f: ind.signs(ind.recursive(f).where("t is not null"), "t").groupBy("code", "run").agg(F.count(F.lit(1)).alias("bars"), F.min("d").alias("first"), F.max("d").alias("last"))),
        "extents": b(lambda f: ind.extent(ind.ultimate(ind.indexed(f)), "u").select("code", rnd("low", 6).alias("low"), rnd("high", 6).alias("high"))),
        "snapshot": x(signals.snapshot),
        "legacy_candidates": x(lambda f: signals.legacy_candidates(f, least=FLOOR).select("code", "d", "score", "gs_hold")),
        "tb_candidates": x(lambda f: signals.tb_candidates(f, least=FLOOR).select("code", "d", "score", "tb_hold", "grade", "timely", "r20")),
        "legacy_score": x(lambda f: signals.complete(f).select("code", "d", signals.legacy_score().alias("score"))),
        "tb_score": x(lambda f: signals.complete(f).select("code", "d", signals.tb_score().alias("score"))),
        "tb_grade": x(lambda f: signals.complete(f).where("tb_ok").select("code", "d", signals.grade(5.0).alias("grade"))),
        "evaluate_lenient": x(lambda f: signals.evaluate(f, strict=False).select("code", "d", "score", "reject")),
        "timing_60m": timing,
        "day_rank": lambda s, d: ranked(s, d).select("strategy", "d", "code", "score", "rank"),
        "day_rank_universe": universe_ranked,
        "topk_per_day": lambda s, d: ranked(s, d).where("rank <= 3").select("strategy", "d", "code", "rank"),
        "legacy_exit_flags": lambda s, d: exits.with_legacy_exit(held(s, d)).select("code", "d", "rule", "action", "severity"),
        "tb_exit_flags": lambda s, d: exits.with_tb_exit(held(s, d)).select("code", "d", "action", "reason", "severity"),
        "stop_take_fill": lambda s, d: exits.stop_take(held(s, d), -7.0, 10.0).select("code", "d", "kind", "fill"),
        "candidate_meta_join": lambda s, d: sets.with_meta(ranked(s, d), listing(s, d).where(F.col("code") % 3 != 0)).select("strategy", "d", "code", "rank", "name", "market"),
        "held_anti_join": not_held,
        "ordered_flag": with_ordered,
        "indicator_override": overridden,
        "latest_trading_days": b(lambda f: sets.latest_days(f, 20, F.lit("1998-06-30").cast("date"))),
        "date_difference": b(lambda f: sets.minus(f.select("d").distinct(), f.where(F.col("code") <= 2), ["d"])),
        "ordered_union": ordered,
        "keyed_upsert": upserted,
        "fifo_closed": lambda s, d: ledger.fifo_closed(src.fills(lines(s, d))),
        "fifo_open": lambda s, d: ledger.fifo_open(src.fills(lines(s, d))),
        "ledger_kpis": lambda s, d: ledger.kpis(src.fills(lines(s, d))),
        "closed_trades": lambda s, d: ledger.closed_trades(log_of_trades(s, d)).drop("name", "market", "severity"),
        "trade_stats": lambda s, d: ledger.trade_stats(trades(s, d)),
        "stats_by_strategy": lambda s, d: ledger.stats_by_strategy(trades(s, d)),
        "by_reason": lambda s, d: ledger.by_reason(trades(s, d)),
        "equity_curve": lambda s, d: ledger.equity(trades(s, d)).select("strategy", "seq", "cum"),
        "breadth_gate": breadth,
        "weekly_signals": weekly_signals,
        "similarity_windows": b(lambda f: report.windows(f).select("code", "d", rnd("from_high", 6).alias("from_high"), rnd("from_low", 6).alias("from_low"), "bars_since_low")),
        "chart_documents": b(chart_texts),
        "chart_codes": lambda s, d: sets.first_codes(*union_parts(s, d), most=20),
        "date_tail": b(lambda f: sets.date_tail([f.where(F.col("code") % 2 == 0), f.where(F.col("code") % 2 == 1)])),
        "candidate_lists": candidate_lists,
        "observed_reports": observed,
        "evaluate_strict": x(lambda f: signals.evaluate(f).select("code", "d", "score")),
        "replay_legacy": replayed(LEGACY_TAG),
        "replay_tb": replayed(TB_TAG),
        "trade_log": replayed(LEGACY_TAG, TB_TAG),
        "replay_weekly": weekly_replayed,
        "replay_one_slot": alone,
        "vendor_scan": lambda s, d: kept.vendor_scan(s, bars(s, d), "1996-12-01"),
        "stream_volume_steps": streamed,
        "stream_hourly_bars": streamed_bars,
        "stats_kept_up": lambda s, d: kept.stats(trades(s, d)),
        "reasons_kept_up": lambda s, d: kept.reasons(trades(s, d)),
        "equity_kept_up": lambda s, d: kept.equity(trades(s, d)).select("strategy", "seq", "cum"),
        "hourly_runs": lambda s, d: kept.hourly_runs(src.table(s, d, "clicks")),
        "capped_upsert": capped,
        "long_extremes": b(lambda f: six(report.distances(ind.indexed(f)), "from_high", "from_low", also=("bars_since_low",))),
        "month_labels": b(lambda f: ind.month_labels(f).select("code", "d", rnd("x", 6).alias("x"))),
        "day_counters": lambda s, d: report.counters(fixed_log(s, d)),
        "day_report": lambda s, d: report.day_report(fixed_log(s, d)),
    }


def dated(query: Query) -> Query:
    """A query whose dates are texts, as in the SQL."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = query(spark, sf)
        return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if f.dataType.typeName() == "date"})

    return run


def queries() -> dict[str, Query]:
    return {k: dated(q) for k, q in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return told()
