"""Nested reports, charts and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.config import HOMERUN, LEGACY, LIMITS
from barloom.functions.numeric import over
from barloom.sources import versions

from .indicators import extremes, indexed
from .shape import streak


def counters(log: DataFrame) -> DataFrame:
    """Buys, sales, holds and fills of each strategy and day, and the positions that are open after it."""
    kind = lambda a: F.count_if(F.col("action") == a)
    days = log.groupBy("strategy", "d").agg(kind("BUY").alias("buys"), kind("SELL").alias("sells"), kind("HOLD").alias("holds"), F.count_if(F.col("action").isin("BUY", "SELL")).alias("fills"))
    w = W.partitionBy("strategy").orderBy("d").rowsBetween(W.unboundedPreceding, 0)  # a row a day
    return days.withColumn("positions", F.sum(F.col("buys") - F.col("sells")).over(w))


def day_report(log: DataFrame) -> DataFrame:
    """(d, doc): a JSON document a day, its strategies each with counters and lists of sales and purchases that were
    filled, of holds and, where the log has them, of orders for the next open, in the log's order."""
    row = F.struct("seq", "code", "price", "reason", "severity", "pnl_pct")
    order = F.struct("code", "rank", "reason", "severity")
    pick = lambda a, x: F.array_sort(F.collect_list(F.when(F.col("action") == a, x)))
    lists = {"buys": pick("BUY", row), "sells": pick("SELL", row), "holds": pick("HOLD", row), "order_buy": pick("ORDER BUY", order), "order_sell": pick("ORDER SELL", order)}
    per = log.groupBy("d", "strategy").agg(*[x.alias(k) for k, x in lists.items()])
    w = W.partitionBy("strategy").orderBy("d").rowsBetween(W.unboundedPreceding, 0)  # a row a day
    per = per.withColumn("positions", F.sum(F.size("buys") - F.size("sells")).over(w))
    counts = F.struct(F.size("buys").alias("buys"), F.size("sells").alias("sells"), F.size("holds").alias("holds"), (F.size("buys") + F.size("sells")).alias("fills"), "positions")
    docs = per.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("strategy", counts.alias("counts"), *lists))).alias("strategies"))
    return docs.select("d", F.to_json(F.struct(F.col("d").cast("string").alias("date"), "strategies")).alias("doc"))


def candidate_lists(ranked: DataFrame, latest: int = LIMITS.top_candidates, older: int = LIMITS.top_history, days: int = LIMITS.history_days) -> DataFrame:
    """(strategy, d, total, homeruns, codes): each day's best candidates by rank, `latest` of them on the last day and
    `older` on those before, of the last `days` days; total and homeruns count all."""
    kept = ranked.select("d").distinct().orderBy(F.desc("d")).limit(days)  # a row a day
    last = F.max("d").over(W.partitionBy(F.lit(0)))
    kept = F.broadcast(kept.withColumn("most", F.when(F.col("d") == last, latest).otherwise(older)))
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= F.col("most"), F.struct("rank", "code"))))
    out = ranked.join(kept, "d").groupBy("strategy", "d").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("grade") == HOMERUN).alias("homeruns"), best.alias("best"))
    return out.select("strategy", "d", "total", "homeruns", F.col("best.code").alias("codes"))


def charts(bars: DataFrame, most: int = LIMITS.chart_bars, least: int = 30) -> DataFrame:
    """(code, n, t, o, h, l, c, v): arrays of the last `most` bars, whole numbers; codes with fewer than `least` have none."""
    w = W.partitionBy("code")
    rows = bars.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("d")))).where((F.col("n") >= least) & (F.col("r") <= most))
    one = F.struct("d", *[F.col(x).cast("long").alias(x) for x in "ohlcv"])
    out = rows.groupBy("code").agg(F.array_sort(F.collect_list(one)).alias("rows"))  # at most `most` a code
    return out.select("code", F.size("rows").alias("n"), F.transform("rows", lambda r: F.date_format(r["d"], "yyyy-MM-dd")).alias("t"), *[F.col("rows")[x].alias(x) for x in "ohlcv"])


def write_log(log: DataFrame, path: str, day: str = "d") -> None:
    """Appends a log as Parquet, a folder a day."""
    log.write.mode("append").partitionBy(day).parquet(path)


def write_days(log: DataFrame, path: str, day: str = "d") -> None:
    """Writes a log's days anew, and no others: running a day twice leaves one copy."""
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


#: The log's columns in the order of its file.
CSV_COLUMNS = ("date", "strategy", "code", "name", "market", "action", "severity", "grade", "reason", "price", "score", "rank", "entry_date", "entry_price", "days_held", "pnl_pct", "gbuy", "gsell", "gs_hold", "gs_mean", "gs_std", "gb_slope5", "t", "b", "u", "red", "ma30", "chg1", "chg5", "chg20", "vol", "amount")
MARK = "\ufeff"


def append_csv(rows: DataFrame, path: str, columns: tuple = CSV_COLUMNS) -> None:
    """Appends rows to a log in CSV: folders append-000000, ... of text files, of which the first begins with a byte order
    mark and the header. One job writes header and rows aside; a rename puts them in place, so that they are there whole or
    not at all. Columns come in the file's order, others are left out, missing ones and nulls are empty; fields with
    commas, quotes or line ends are quoted."""
    spark = rows.sparkSession
    have = set(rows.columns)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in columns]
    quoted = [F.when(t.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in texts]
    lines = rows.select(F.concat_ws(",", *quoted).alias("value"))
    there = [n for n in versions.names(spark, path) if n.startswith("append-")]
    if not there:  # the first partition's file comes first by name
        lines = spark.createDataFrame([(MARK + ",".join(columns),)], "value string").coalesce(1).union(lines)
    side = f"{path}/_side-{uuid.uuid4().hex}"
    lines.write.text(side)
    versions.put(spark, side, f"{path}/append-{max((int(n[7:]) for n in there), default=-1) + 1:06d}")


def read_csv(spark, path: str, columns: tuple = CSV_COLUMNS) -> DataFrame:
    """What append_csv has written, as texts."""
    header = ",".join(columns)  # readers of text take a byte order mark away
    lines = spark.read.text(f"{path}/append-*").where(~F.col("value").isin(header, MARK + header))
    return lines.select(F.from_csv("value", ", ".join(f"`{c}` string" for c in columns), {"escape": '"'}).alias("r")).select("r.*").fillna("")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def hour_label(hour="hour"):
    """MM/DD HH and the word for hour."""
    return F.concat(F.date_format(hour, "MM/dd HH"), F.lit("시"))


def lot_sizes(orders: DataFrame, assets: float, slots: int = LIMITS.max_positions) -> DataFrame:
    """Adds qty: whole shares that an equal share of all assets buys at the price."""
    return orders.withColumn("qty", F.when(F.col("price") > 0, F.floor(F.lit(assets / slots) / F.col("price"))).otherwise(0))


def reset(spark, schema: str, *paths: str) -> None:
    """Empties tables of state."""
    for p in paths:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(p)


def windows(bars: DataFrame, n: int = 250) -> DataFrame:
    """Observed columns of the similarity report at each code's last bar: fall from the high and rise from the low of
    closes in n bars, and bars since that low."""
    out = distances(indexed(bars), n)
    last = out.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy(F.desc("d")))).where("r = 1")
    return last.select("code", "d", "from_high", "from_low", "bars_since_low")


def distances(bars: DataFrame, n: int = 250) -> DataFrame:
    """Adds, for every bar, the fall from the high and the rise from the low of closes in n bars, and bars since that low,
    the latest one of equal ones. Needs i."""
    out = extremes(bars, n, {"low": F.struct(F.col("c").alias("c"), (-F.col("i")).alias("back"))}, {"high": F.col("c")})
    rise = lambda x: (F.col("c") / x - 1) * 100
    return out.withColumns({"from_high": rise(F.col("high")), "from_low": rise(F.col("low.c")), "bars_since_low": F.col("i") + F.col("low.back")}).drop("low", "high")


def observable(shaped: DataFrame, week: DataFrame) -> DataFrame:
    """Each code's latest bar with the columns of the shipped reports whose meaning is plain: changes over 20 and 60 bars,
    distances from the mesh and from means of 30 and 200 bars, the rise line's change over 3 and 5 bars, the calm run's
    length, mean, spread and largest value, and the last whole week's lines and calm weeks. Scores, grades and stages of
    those reports have no known formula. shaped: series with shapes; week: indexed weekly bars with gb and gs, d a Monday."""
    w = W.partitionBy("code").orderBy("d")
    away = lambda x: over(F.col("c"), F.col(x)) * 100 - 100
    ma200 = F.when(F.col("i") >= 199, F.avg("c").over(w.rowsBetween(-199, 0)))
    run = F.collect_list("gs").over(w.rowsBetween(-14, 0))
    out = shaped.withColumns({"chg60": over(F.col("c"), F.lag("c", 60).over(w)) * 100 - 100, "ma200": ma200, "slope3": F.col("gb") - F.lag("gb", 3).over(w), "calm": run, "last": F.row_number().over(W.partitionBy("code").orderBy(F.desc("d"))) == 1}).where("last")
    held = F.greatest("gs_hold", F.lit(1))
    week = week.withColumn("week_hold", streak(F.col("gs") <= LEGACY.gs_max, 15)).select("code", F.date_add("d", 7).alias("wk"), F.col("gb").alias("week_gb"), F.col("gs").alias("week_gs"), "week_hold")
    out = out.withColumn("wk", F.to_date(F.date_trunc("week", "d"))).join(week, ["code", "wk"], "left")
    return out.select(
        "code", "d", "c", "chg1", "chg20", "chg60", "gb", "gs", "slope3", "slope5", "t", "b", "u", "u_sig", "red",
        away("top").alias("from_mesh"), (over(F.col("top"), F.col("bottom")) * 100 - 100).alias("mesh_width"), away("ma30").alias("from_ma30"), away("ma200").alias("from_ma200"),
        (F.col("c") > F.col("ma200")).alias("above_ma200"), "gs_hold", "gs_mean", "gs_std", F.array_max(F.slice("calm", -held, held)).alias("gs_max"), "week_gb", "week_gs", "week_hold",
    )
