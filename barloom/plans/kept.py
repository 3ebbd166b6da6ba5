"""Queries whose results are kept up: streams, versioned tables written in several goes, a vendor's pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import ledger
from barloom.sources import shared, vendor, versions
from barloom.sources import bars as src
from barloom.streaming import jobs


def vendor_scan(spark: SparkSession, bars: DataFrame, since: str) -> DataFrame:
    """bars as a vendor's stored pages, scanned from a day on. Stored pages have no limit of requests."""
    pages = shared.place(spark, "pages")
    vendor.write_pages(bars, pages, 150, 8)
    spark.dataSource.register(vendor.VendorBars)
    scan = spark.read.format("vendor_bars").options(path=pages, buckets=8, since=since, requests=0).load()
    return scan.withColumn("code", F.col("code").cast("long"))


ARRIVALS = 6


def arrived(ticks: DataFrame, path: str) -> None:
    """Stores ticks as a stream's input: arrivals by time, of which every thirteenth row comes with the next arrival only and
    every fifth row twice; then a last row that moves the watermark past all of them."""
    first, last = ticks.agg(F.min("ts"), F.max("ts")).first()
    k = F.least(F.lit(ARRIVALS - 1), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * ARRIVALS / F.greatest(F.lit(1), F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)))))
    rows = ticks.withColumn("k", F.when(F.col("id") % 13 == 0, k + 1).otherwise(k))
    rows = rows.unionByName(rows.where("id % 5 = 0").withColumn("k", F.col("k") + F.col("id") % 2))
    for i in range(ARRIVALS + 2):
        rows.where(F.col("k") == i).drop("k").repartition(FILES).write.parquet(f"{path}/arrival-{i:02d}")
    end = ticks.sparkSession.range(1).select(F.lit("").alias("code"), F.lit(last).cast("timestamp") + F.expr("interval 90 days"), F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)).toDF("code", "ts", "id", "price", "total")
    end.write.parquet(f"{path}/arrival-99")


FILES = 4


def streamed_steps(ticks: DataFrame, late: str) -> tuple[str, str]:
    """Runs ticks (code, ts, id, price, total) as a stream; the tables of its steps and of its bars."""
    spark = ticks.sparkSession
    path = shared.place(spark, "stream")
    ticks = ticks.select("code", F.col("ts").cast("timestamp").alias("ts"), "id", "price", "total")
    arrived(ticks, f"{path}/in")
    old = {k: spark.conf.get(k, None) for k in jobs.STORE}
    for k, v in jobs.STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in/*")
        both = jobs.append_batches(f"{path}/steps", "d"), jobs.bar_batches(f"{path}/bars")

        def run(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            try:
                for f in both:
                    f(batch, batch_id)
            finally:
                batch.unpersist()

        jobs.volume_steps(stream, late).writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return f"{path}/steps", f"{path}/bars"


def grown(trades: DataFrame, of: Callable[[DataFrame], DataFrame], day: str, name: str) -> DataFrame:
    """The table of a function of trades that is kept up: one write for the days up to the middle, one for the others, and
    one that brings the second half of them again. trades are read four times: a stored table."""
    spark = trades.sparkSession
    path = shared.place(spark, name)
    first, last = trades.agg(F.min("exit_date"), F.max("exit_date")).first()
    middle = F.date_add(F.lit(first).cast("date"), F.floor(F.date_diff(F.lit(last).cast("date"), F.lit(first).cast("date")) / 2).cast("int"))
    for k, part in enumerate((F.col("exit_date") <= middle, F.col("exit_date") > middle)):
        versions.write(of(trades.where(part)), path, day, "days", ("day", k))
    versions.write(of(trades.where(part)), path, day, "days", ("day", k + 1))
    return versions.read(spark, path)


def stats(trades: DataFrame) -> DataFrame:
    trades = shared.kept(trades, "trades")
    return ledger.stats_of(grown(trades, ledger.day_states, "day", "states"))


def reasons(trades: DataFrame) -> DataFrame:
    trades = shared.kept(trades, "trades")
    return ledger.reasons_of(grown(trades, ledger.reason_states, "day", "reasons"))


def equity(trades: DataFrame) -> DataFrame:
    trades = shared.kept(trades, "trades")
    return ledger.equity_of(grown(trades, ledger.day_growth, "exit_date", "growth"), grown(trades, ledger.day_states, "day", "states"))


def click_ticks(clicks: DataFrame) -> DataFrame:
    """Clicks as ticks in their order of arrival: code (the client), hour, at, chunk (the day of arrival), price, size."""
    rows = clicks.distinct().where("client_id is not null and ts is not null and arrived_at is not null and click_id is not null and value is not null")
    return rows.select(F.col("client_id").alias("code"), F.date_trunc("hour", "ts").alias("hour"), F.struct("arrived_at", "click_id").alias("at"), F.to_date("arrived_at").alias("chunk"), F.col("value").alias("price"), F.lit(1).alias("size"))


def hourly_runs(clicks: DataFrame) -> DataFrame:
    return src.run_bars(click_ticks(clicks))
