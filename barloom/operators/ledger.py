"""First-in-first-out lots, closed trades and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.config import HOMERUN, LIMITS, OTHER, REASONS
from barloom.functions.numeric import over, rnd


def _segments(fills: DataFrame) -> DataFrame:
    """(code, buy, sell, qty): a code's quantities cut where a buy lot or a sale ends, each piece with its lot and its
    sale, if any. A sale beyond what is held is dropped: the running net less its running least (0 at most) is what is
    held, so the fall of that least is what a sale couldn't find. Lots and sales then lie end to end on one line of
    quantities, and one pass over their ends, from the last on, knows the lot and the sale that each piece belongs to: no
    lot is compared with every sale."""
    w = W.partitionBy("code").orderBy("d", "k")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    f = fills.where(F.col("code").isNotNull() & (F.col("qty") > 0)).withColumn("bought", F.col("side") == "buy")
    f = f.withColumn("net", F.sum(F.when(F.col("bought"), F.col("qty")).otherwise(-F.col("qty"))).over(run))
    f = f.withColumn("floor", F.least(F.lit(0.0), F.min("net").over(run)))
    missed = F.coalesce(F.lag("floor").over(w), F.lit(0.0)) - F.col("floor")
    f = f.withColumn("eff", F.when(F.col("bought"), F.col("qty")).otherwise(F.col("qty") - missed))
    part = lambda b: F.sum(F.when(F.col("bought") == b, F.col("eff")).otherwise(0.0)).over(run)
    f = f.withColumn("hi", F.when(F.col("bought"), part(True)).otherwise(part(False))).where("eff > 0")
    one = F.struct("d", "k", "price")
    f = f.select("code", "hi", F.when(F.col("bought"), one).alias("b"), F.when(~F.col("bought"), one).alias("s"))
    down = W.partitionBy("code").orderBy(F.desc("hi"))
    seen = down.rowsBetween(W.unboundedPreceding, 0)
    qty = F.col("hi") - F.coalesce(F.lead("hi").over(down), F.lit(0.0))
    f = f.select("code", F.last("b", True).over(seen).alias("buy"), F.last("s", True).over(seen).alias("sell"), qty.alias("qty"))
    return f.where("qty > 0 and buy is not null")


def fifo_closed(fills: DataFrame) -> DataFrame:
    """One row for each buy lot (or part) and the sale that closes it."""
    m = _segments(fills).where("sell is not null")
    m = m.select("code", F.col("buy.d").alias("buy_d"), F.col("buy.k").alias("buy_k"), F.col("sell.d").alias("sell_d"), F.col("sell.k").alias("sell_k"), F.col("buy.price").alias("buy_price"), F.col("sell.price").alias("sell_price"), "qty")
    pct = over(F.col("sell_price"), F.col("buy_price")) - 1
    return m.select("*", ((F.col("sell_price") - F.col("buy_price")) * F.col("qty")).alias("pnl"), rnd(pct * 100, 4).alias("pct"), F.datediff("sell_d", "buy_d").alias("days"))


def fifo_open(fills: DataFrame) -> DataFrame:
    """What is left of each buy lot."""
    return _segments(fills).where("sell is null").select("code", F.col("buy.d").alias("d"), F.col("buy.k").alias("k"), F.col("buy.price").alias("price"), "qty")


def kpis(fills: DataFrame) -> DataFrame:
    """One row: realised profit, wins, share of wins, money in open lots, fills by side, first and last date."""
    closed = fifo_closed(fills).agg(F.sum("pnl").alias("realised"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count(F.lit(1)).alias("closed"))
    closed = closed.withColumn("win_pct", rnd(over(F.col("wins") * 100.0, F.col("closed").cast("double")), 0))
    held = fifo_open(fills).agg(F.sum(F.col("qty") * F.col("price")).alias("invested"))
    sides = fills.where("code is not null and qty > 0").agg(F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") != "buy").alias("sells"), F.min("d").alias("first"), F.max("d").alias("last"))
    rows = [closed.select(F.struct("*")).scalar().alias("a"), held.select(F.struct("*")).scalar().alias("b")]
    return sides.select("*", *rows).select("a.*", "b.*", "buys", "sells", "first", "last")


# --- closed trades: strategy, grade, code, entry_date, exit_date, entry, exit, pnl, days, reason, seq


def reason_key(reason: Column | str = "reason") -> Column:
    r = F.col(reason) if isinstance(reason, str) else reason
    return F.coalesce(*[F.when(r.contains(k), k) for k in REASONS], F.lit(OTHER))


def closed_trades(log: DataFrame) -> DataFrame:
    """Sales of a signal log as trades: numbers out of texts (rows that have none are dropped), the reason cut at the first
    arrow, pnl to two places."""
    entry, exit_, pnl = (F.col(c).try_cast("double") for c in ("entry_price", "price", "pnl_pct"))
    out = log.where("action = 'SELL'").withColumns({"entry": F.coalesce(entry, F.when(F.col("entry_price") == "", 0.0)).cast("long"), "exit": F.coalesce(exit_, F.when(F.col("price") == "", 0.0)).cast("long"), "pnl": rnd(pnl, 2)})
    out = out.where("entry is not null and exit is not null and pnl is not null")
    days = F.coalesce(F.col("days_held").try_cast("int"), F.lit(0))
    return out.select("strategy", "grade", "code", "name", "market", "entry_date", F.col("date").alias("exit_date"), "entry", "exit", "pnl", days.alias("days"), F.split_part("reason", F.lit(" → "), F.lit(1)).alias("reason"), "severity", "seq")


def equity(trades: DataFrame, slots: int = LIMITS.max_positions) -> DataFrame:
    """Adds cum: each strategy's compounded return in percent, each trade having one of so many equal slots."""
    who = F.when(F.coalesce("strategy", F.lit("")) == "", OTHER).otherwise(F.col("strategy"))
    w = W.partitionBy("who").orderBy("exit_date", "code", "seq").rowsBetween(W.unboundedPreceding, 0)
    out = trades.withColumn("who", who)
    grown = F.product(1 + F.col("pnl") / 100 / slots).over(w)
    return out.withColumn("cum", rnd((grown - 1) * 100, 2)).drop("who")


def _stats(slots: int) -> list[Column]:
    n = F.count("pnl")
    share = lambda c: over(F.count_if(c) * 100.0, n.cast("double"))
    hr = F.col("grade") == HOMERUN
    hr_n = F.count_if(hr)
    return [
        n.alias("trades"), rnd(F.avg("pnl"), 2).alias("avg"), rnd(share(F.col("pnl") > 0), 1).alias("winrate"),
        rnd(F.max("pnl"), 1).alias("best"), rnd(F.min("pnl"), 1).alias("worst"),
        rnd((F.product(1 + F.col("pnl") / 100 / slots) - 1) * 100, 2).alias("cum"), rnd(F.avg("days"), 1).alias("avg_days"),
        F.min_by("exit_date", "seq").alias("first"), F.max_by("exit_date", "seq").alias("last"),
        hr_n.alias("hr_n"), rnd(F.avg(F.when(hr, F.col("pnl"))), 2).alias("hr_avg"),
        rnd(over(F.count_if(hr & (F.col("pnl") > 0)) * 100.0, hr_n.cast("double")), 1).alias("hr_win"), rnd(F.max(F.when(hr, F.col("pnl"))), 1).alias("hr_best"),
    ]


def trade_stats(trades: DataFrame, slots: int = LIMITS.max_positions) -> DataFrame:
    """One row of performance; none where there are no trades. first and last are those of the log's order (seq)."""
    return trades.agg(*_stats(slots)).where("trades > 0")


def stats_by_strategy(trades: DataFrame, slots: int = LIMITS.max_positions) -> DataFrame:
    """trade_stats of each strategy and of all (strategy ALL), in one pass over grouping sets."""
    out = trades.groupingSets([["strategy"], []], "strategy").agg(F.grouping("strategy").alias("g"), *_stats(slots))
    return out.withColumn("strategy", F.when(F.col("g") == 1, "ALL").otherwise(F.col("strategy"))).drop("g")


def by_reason(trades: DataFrame) -> DataFrame:
    """n, avg and win by the first keyword that a reason holds; rank by falling n, ties as they first come in the log."""
    out = trades.withColumn("key", reason_key()).groupBy("key").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("pnl"), 2).alias("avg"), rnd(F.count_if(F.col("pnl") > 0) * 100.0 / F.count(F.lit(1)), 0).alias("win"), F.min("seq").alias("first"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "first"))).drop("first")  # a row a keyword


# --- the same kept up a day at a time: mergeable states, a row a strategy and day, merged when they are read


def _merged(strategy: str | None) -> dict[str, Column]:
    """How states become one: from trades (strategy None) or from states."""
    hr = F.col("grade") == HOMERUN
    add = lambda name, of: F.sum(name) if strategy else of
    return {
        "n": add("n", F.count("pnl")), "rows": add("rows", F.count(F.lit(1))), "total": add("total", F.sum("pnl")), "wins": add("wins", F.count_if(F.col("pnl") > 0)),
        "best": F.max("best" if strategy else "pnl"), "worst": F.min("worst" if strategy else "pnl"),
        "days_sum": add("days_sum", F.sum("days")), "days_n": add("days_n", F.count("days")),
        "first": F.min("first" if strategy else F.struct("seq", "exit_date")), "last": F.max("last" if strategy else F.struct("seq", "exit_date")),
        "hr_n": add("hr_n", F.count_if(hr)), "hr_sum": add("hr_sum", F.sum(F.when(hr, F.col("pnl")))), "hr_k": add("hr_k", F.count(F.when(hr, F.col("pnl")))),
        "hr_wins": add("hr_wins", F.count_if(hr & (F.col("pnl") > 0))), "hr_best": F.max("hr_best") if strategy else F.max(F.when(hr, F.col("pnl"))),
        "factor": F.product("factor") if strategy else F.product(1 + F.col("pnl") / 100 / SLOTS),
    }


SLOTS = LIMITS.max_positions


def day_states(trades: DataFrame) -> DataFrame:
    """What trade_stats and equity need of each strategy's day: counts, sums, extremes, first and last trade by seq, and the
    product of growth. States of several days, or of parts of one, merge to the state of all."""
    return trades.groupBy("strategy", F.col("exit_date").alias("day")).agg(*[c.alias(k) for k, c in _merged(None).items()])


def stats_of(states: DataFrame) -> DataFrame:
    """stats_by_strategy out of day_states."""
    s = states.groupingSets([["strategy"], []], "strategy").agg(F.grouping("strategy").alias("g"), *[c.alias(k) for k, c in _merged("strategy").items()])
    per = lambda a, b: over(F.col(a), F.col(b).cast("double"))
    return s.select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col("strategy")).alias("strategy"), F.coalesce("n", F.lit(0)).alias("trades"), rnd(per("total", "n"), 2).alias("avg"), rnd(over(F.col("wins") * 100.0, F.col("n").cast("double")), 1).alias("winrate"),
        rnd("best", 1).alias("best"), rnd("worst", 1).alias("worst"), rnd((F.col("factor") - 1) * 100, 2).alias("cum"), rnd(per("days_sum", "days_n"), 1).alias("avg_days"),
        F.col("first.exit_date").alias("first"), F.col("last.exit_date").alias("last"),
        F.coalesce("hr_n", F.lit(0)).alias("hr_n"), rnd(per("hr_sum", "hr_k"), 2).alias("hr_avg"), rnd(over(F.col("hr_wins") * 100.0, F.col("hr_n").cast("double")), 1).alias("hr_win"), rnd("hr_best", 1).alias("hr_best"),
    )


def reason_states(trades: DataFrame) -> DataFrame:
    """What by_reason needs of each day."""
    return trades.groupBy(F.col("exit_date").alias("day"), reason_key().alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"), F.count("pnl").alias("k"), F.count_if(F.col("pnl") > 0).alias("wins"), F.min("seq").alias("first"))


def reasons_of(states: DataFrame) -> DataFrame:
    """by_reason out of reason_states."""
    s = states.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "total", "k", "wins")], F.min("first").alias("first"))
    s = s.select("key", "n", rnd(over(F.col("total"), F.col("k").cast("double")), 2).alias("avg"), rnd(F.col("wins") * 100.0 / F.col("n"), 0).alias("win"), "first")
    return s.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "first"))).drop("first")  # a row a keyword


def day_growth(trades: DataFrame) -> DataFrame:
    """trades with within: what a strategy has grown by since the day began, this trade included."""
    w = W.partitionBy("strategy", "exit_date").orderBy("code", "seq").rowsBetween(W.unboundedPreceding, 0)
    return trades.withColumn("within", F.product(1 + F.col("pnl") / 100 / SLOTS).over(w))


def equity_of(grown: DataFrame, states: DataFrame) -> DataFrame:
    """equity out of day_growth and day_states: what was before a day comes from its states. Strategies have names."""
    w = W.partitionBy("strategy").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    base = states.groupBy("strategy", "day").agg(F.product("factor").alias("factor")).select("strategy", F.col("day").alias("exit_date"), F.coalesce(F.product("factor").over(w), F.lit(1.0)).alias("base"))  # a row a day
    return grown.join(base, ["strategy", "exit_date"]).withColumn("cum", rnd((F.col("base") * F.col("within") - 1) * 100, 2)).drop("base", "within")
