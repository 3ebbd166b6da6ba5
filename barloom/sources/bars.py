"""Bars out of ticks, events and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_A_TASK = 250_000  # short rows of whole keys that a task sorts; windows and averages go on from there


def dealt(df: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """df by key in about so many rows a partition, where it has more than some tasks' rows: Spark's own number of partitions
    stays as the table grows, so that a task's memory grows with it. df: a table, which is counted."""
    n = df.count() // rows
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), key) if n >= 4 else df


def walk_ticks(lineitem: DataFrame) -> DataFrame:
    """(code, d, q, tick, px): the fixture's ticks, a walk of whole prices a code that no order of evaluation changes."""
    step = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 1299709) % 401 - 200
    w = W.partitionBy("code").orderBy("d", "k1", "k2", "k3")
    t = lineitem.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_quantity").alias("q"), step.alias("step"))
    px = F.greatest(F.lit(1000), F.lit(20000) + F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0))).cast("double")
    return t.select("code", "d", "q", "k2", F.row_number().over(w).alias("tick"), px.alias("px"))


def to_bars(ticks: DataFrame, keys: list[str], order: str, price: str, volume: str) -> DataFrame:
    """One bar for each group: first, largest, smallest and last price, and the volume."""
    return ticks.groupBy(*keys).agg(F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"), F.sum(volume).alias("v"))


def daily_bars(lineitem: DataFrame) -> DataFrame:
    return to_bars(walk_ticks(lineitem), ["code", "d"], "tick", "px", "q")


def hourly_bars(events: DataFrame) -> DataFrame:
    """60-minute bars of values by event type; events at the same time count by event_id."""
    e = events.select(F.col("event_type").alias("code"), F.date_trunc("hour", "ts").alias("hour"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("px"), F.lit(1).alias("q"))
    return to_bars(e, ["code", "hour"], "at", "px", "q")


def volume_steps(df: DataFrame, total: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds step: what a day's running total grew by since the row before; the first row's total, and never under 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("step", F.greatest(F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0)), F.lit(0)))


def run_bars(ticks: DataFrame, code: str = "code", period: str = "hour", order: str = "at", price: str = "price", volume: str = "size", chunk: str = "chunk") -> DataFrame:
    """Bars of runs: rows of a code that come one after the other in the same period are a run, and of a period's runs the
    last one counts, as if each run's bar were put in place of the one before it.

    order: the order of arrival, without ties in a code; chunk: a column that never falls in that order, such as the day
    of arrival, whose rows suit a task. No window holds a code's whole history: a run begins where the row before, be it
    in the chunk before, has another period; a period's last run begins at the last such row of the period, and what runs
    have in a chunk is put together from there on. Rows with a null code or period make no bar, but end runs."""
    from barloom.operators.scans import before

    df, prev = before(ticks, code, order, chunk, period)
    df = df.withColumn("new_", (~F.col(period).eqNullSafe(prev)).cast("int"))
    df = df.withColumn("run_", F.sum("new_").over(W.partitionBy("kc_").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    # what a run has in a chunk, without a shuffle
    parts = df.groupBy("kc_", "run_", code, period).agg(
        F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"), F.sum(volume).alias("v"),
        F.min(order).alias("first_"), F.max(order).alias("last_"), F.max("new_").alias("new_"),
    )
    start = F.max(F.when(F.col("new_") == 1, F.col("first_"))).over(W.partitionBy(code, period))
    parts = parts.withColumn("from_", start).where("first_ >= from_")
    return parts.groupBy(code, period).agg(F.min_by("o", "first_").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "last_").alias("c"), F.sum("v").alias("v")).where(F.col(period).isNotNull() & F.col(code).isNotNull())


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Bars of weeks that begin on Monday."""
    week = F.to_date(F.date_trunc("week", "d"))
    return bars.groupBy("code", week.alias("w")).agg(F.min_by("o", "d").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "d").alias("c"), F.sum("v").alias("v"))


def enough(bars: DataFrame, least: int) -> DataFrame:
    """Bars of codes with at least that many."""
    return bars.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("code"))).where(F.col("n") >= least)


def minute_ticks(pages: DataFrame, text: str = "text", least: int = 20) -> DataFrame:
    """(code, ts, price, total) of pipe-separated data="..." attributes: field 0 a time, 4 the price, 5 the day's volume so
    far (0 if missing). Fields that can't be read drop the tick; a code with fewer than `least` ticks has none."""
    f = F.split("tick", r"\|")
    rows = pages.select("code", F.explode(F.regexp_extract_all(text, F.lit('data="([^"]+)"'), 1)).alias("tick")).where(F.size(F.split("tick", r"\|")) >= 6)
    rows = rows.select("code", F.try_to_timestamp(F.substring(f[0], 1, 12), F.lit("yyyyMMddHHmm")).alias("ts"), f[4].try_cast("double").alias("price"), F.coalesce(f[5].try_cast("double"), F.lit(0.0)).alias("total"))
    rows = rows.where("ts is not null and price is not null")
    return rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("code"))).where(F.col("n") >= least).drop("n")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listed companies out of a CSV: code, name, market, marcap, close; codes stay texts, numbers that can't be read and
    blanks are null."""
    raw = spark.read.csv(path, header=True, nullValue="", encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("\ufeff").strip().lower() for c in raw.columns])
    return raw.select("code", "name", "market", F.col("marcap").try_cast("double").alias("marcap"), F.col("close").try_cast("double").alias("close"))


def read_vendor_bars(spark: SparkSession, path: str) -> DataFrame:
    """Vendor CSV: code, date (yyyyMMdd), open, high, low, close, volume; leading As of codes go. The rows' order in the
    file, newest first as a rule, doesn't matter: bars are ordered by date wherever order counts."""
    raw = spark.read.csv(path, header=True, nullValue="")
    return raw.select(F.regexp_replace("code", "^A+", "").alias("code"), F.to_date("date", "yyyyMMdd").alias("d"), *[F.col(a).cast("double").alias(b) for a, b in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))])


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """External indicators: code, seq, B, T, T_sig, U, U_sig; blanks and the sentinel are null."""
    from barloom.functions.numeric import clean

    raw = spark.read.csv(path, header=True, nullValue="")
    return raw.select(F.regexp_replace("code", "^A+", "").alias("code"), F.col("seq").cast("int").alias("seq"), *[clean(F.col(x)).alias(x) for x in ("B", "T", "T_sig", "U", "U_sig")])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of fills or signals, with or without a byte order mark; doubled quotes; missing fields are empty texts."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def read_json_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of a schema; an empty table where there is nothing to read, or a row that is no JSON."""
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException:
        return empty
    return rows.drop("_bad") if rows.where("_bad is not null").select("*").limit(1).collect() == [] else empty


def fills(lineitem: DataFrame) -> DataFrame:
    """(code, d, k, side, qty, price): the fixture's line items as fills; odd line numbers buy, others sell."""
    side: Column = F.when(F.col("k2") % 2 == 1, "buy").otherwise("sell")
    return walk_ticks(lineitem).select("code", "d", F.col("tick").alias("k"), side.alias("side"), F.col("q").alias("qty"), F.col("px").alias("price"))
