"""The daily run: bars to signals, orders, log, report and performance, as tables under one folder."""

from __future__ import annotations

import argparse
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.config import LIMITS
from barloom.operators import indicators, ledger, replay, report, sets, shape, signals
from barloom.sources import vendor, versions
from barloom.sources.bars import enough, minute_ticks, read_external, run_bars, volume_steps

STATE = "strategy string, state string, version string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def sold(log: DataFrame) -> DataFrame:
    """The closed trades of a log's rows."""
    return log.where("action = 'SELL'").select("strategy", "grade", "code", "entry_date", F.col("d").alias("exit_date"), F.col("entry_price").alias("entry"), F.col("price").alias("exit"), F.col("pnl_pct").alias("pnl"), F.col("days_held").alias("days"), F.split_part("reason", F.lit(" → "), F.lit(1)).alias("reason"), "severity", "seq")


def publish(spark: SparkSession, out: str) -> None:
    """Puts in place what the run that the state names has played: log, CSV log, report and the states of performance, of
    its days only. Doing it again changes nothing, so a run that failed after its state was written is finished by the
    next one."""
    found = _read(spark, f"{out}/state", STATE).select("version").distinct().collect()  # a row a strategy
    for (work,) in found:
        if not work or not versions.exists(spark, work):
            continue
        log = spark.read.parquet(work).where("action is not null").drop("state")
        done = log.where(~F.col("action").startswith("ORDER"))
        report.write_days(done.withColumn("day", F.col("d").cast("string")), f"{out}/log", "day")
        days = [r[0] for r in log.select(F.col("d").cast("string")).distinct().collect()]  # the days played
        trades = sold(log)
        for name, df, day in ((TRADES, ledger.day_growth(trades), "exit_date"), (STATES, ledger.day_states(trades), "day"), (WHY, ledger.reason_states(trades), "day")):
            versions.write(df, f"{out}/{name}", day, "days", clear=days)
            versions.prune(spark, f"{out}/{name}")
        report.write_json(report.day_report(log), f"{out}/report")
        versions.deleted(spark, work)


TRADES, STATES, WHY = "trades", "day-states", "day-reasons"


def performance(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades with the running return, statistics by strategy, reasons) of all days played so far, out of the states that
    each day has left: a day's work doesn't grow with the days before it."""
    trades, states, why = (versions.read(spark, f"{out}/{name}") for name in (TRADES, STATES, WHY))
    return ledger.equity_of(trades, states), ledger.stats_of(states), ledger.reasons_of(why)


def run(spark: SparkSession, bars: DataFrame, out: str, until: str | None = None, backfill: int = 1, force: bool = False, reset: bool = False, min_amount: float = LIMITS.min_amount, external: DataFrame | None = None) -> int:
    """Plays the latest `backfill` days up to `until` that haven't been played; how many those are. force and reset begin
    with empty books (reset also drops the log). Writes state (the books, and where the run's rows are), then from those
    log (a folder a day; a day played again replaces itself), report (JSON) and each day's states of performance, which
    performance() reads. external: indicators in place of our own (indicators.override)."""
    logs = f"{out}/log"
    publish(spark, out)
    if reset:
        report.reset(spark, f"{replay.LOG}, day string", logs)
        for name in (TRADES, STATES, WHY):
            versions.deleted(spark, f"{out}/{name}")
    whole = enough(bars, LIMITS.min_bars).drop("n")
    shaped = shape.shaped(whole) if external is None else shape.with_shape(indicators.override(indicators.recursive(indicators.counted(indicators.rolling(whole))), external))
    days = replay.ever(signals.both(shaped, min_amount))
    targets = sets.latest_days(bars, backfill, F.lit(until).cast("date") if until else None)
    done = _read(spark, logs, f"{replay.LOG}, day string").select(F.col("day").cast("date").alias("d")).distinct()
    if not (force or reset):
        targets = sets.minus(targets, done, ["d"])
    n = targets.count()
    if n:
        states = _read(spark, f"{out}/state", STATE).select("strategy", "state") if not (force or reset) else spark.createDataFrame([], "strategy string, state string")
        today = days.join(F.broadcast(targets), "d", "left_semi")  # a row a day
        work = f"{out}/work-{uuid.uuid4().hex}"
        replay.resume(today, states).write.parquet(work)
        kept = spark.read.parquet(work).where("state is not null").select("strategy", "state", F.lit(work).alias("version"))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{out}/state")  # a row a strategy
        publish(spark, out)
    return n


HOURS = "code string, hour timestamp, o double, h double, l double, c double, v double, since long"


def keep_hours(spark: SparkSession, bars: DataFrame, out: str, codes: int = LIMITS.hourly_codes, most: int = LIMITS.hourly_bars) -> int:
    """Puts a run's 60-minute bars (code, hour, o, h, l, c, v) into the store of such bars, which is one versioned table: an
    hour that is there already is replaced, each code keeps its last `most` bars, and of the codes those of this run stay
    and the ones that came last before, `codes` in all. since tells the version in which a code came. The store's size is
    bounded by those two limits. Returns the version."""
    path = f"{out}/hours"
    new = bars.withColumn("since", F.lit(versions.manifest(spark, path)["version"] + 1).cast("long")).select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in HOURS.split(", ")])
    whole = sets.upsert(versions.read(spark, path, HOURS), new, "code", "hour", most)
    whole = whole.withColumn("since", F.min("since").over(W.partitionBy("code")))
    version = versions.write(sets.capped(whole, new, "since", codes), path, mode="replace")
    versions.prune(spark, path)
    return version


def hours_of(pages: DataFrame) -> DataFrame:
    """60-minute bars out of pages of minute ticks (code, text)."""
    ticks = minute_ticks(pages).withColumn("d", F.to_date("ts"))
    ticks = volume_steps(ticks, "total", ["code", "d"], ["ts"]).withColumns({"hour": F.date_trunc("hour", "ts"), "at": F.struct("ts"), "chunk": F.col("d")})
    return run_bars(ticks, volume="step")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("bars", help="Parquet of bars: code, d, o, h, l, c, v; with --cyprice a vendor's pages")
    p.add_argument("out", help="folder of the run's tables")
    p.add_argument("--date")
    p.add_argument("--backfill", type=int, default=1)
    p.add_argument("--force", action="store_true")
    p.add_argument("--reset", action="store_true")
    p.add_argument("--min-amount", type=float, default=LIMITS.min_amount)
    p.add_argument("--cyprice", action="store_true", help="bars come from a vendor's pages")
    p.add_argument("--cyindi", metavar="CSV", help="external indicators in place of our own")
    p.add_argument("--minutes", metavar="PARQUET", help="pages of minute ticks (code, text) for the 60-minute bars")
    p.add_argument("--no-m60", action="store_true", help="leaves out the 60-minute bars")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.cyprice:
        spark.dataSource.register(vendor.VendorBars)
        bars = spark.read.format("vendor_bars").option("path", a.bars).load().withColumn("code", F.col("code").cast("long"))
    else:
        bars = spark.read.parquet(a.bars)
    external = read_external(spark, a.cyindi).withColumn("code", F.col("code").cast("long")) if a.cyindi else None
    n = run(spark, bars, a.out, a.date, a.backfill, a.force, a.reset, a.min_amount, external)
    if a.minutes and not a.no_m60:
        keep_hours(spark, hours_of(spark.read.parquet(a.minutes)), a.out)
    return n


if __name__ == "__main__":
    print(main())
