"""How often queries go over their rows, and how those are dealt to tasks."""

from pyspark.sql import functions as F

from barloom.plans import kept, queries
from barloom.sources import bars as src


def counted(df):
    """df, and how many of its rows have been made."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    @F.udf("boolean")
    def told(x):
        seen.add(1)
        return True

    return df.repartition(2).where(told.asNondeterministic()(F.lit(1))), seen


def test_candidates_are_made_once(spark, sf, monkeypatch):
    rows = [(s, i % 7, f"2024-01-{1 + i % 9:02d}", "일반", i) for i in range(40) for s in ("TB", "LEGACY")]
    from barloom.config import LEGACY_TAG, TB_TAG

    df = spark.createDataFrame(rows, "strategy string, code long, d string, grade string, rank int").withColumn("d", F.to_date("d"))
    df = df.withColumn("strategy", F.when(F.col("strategy") == "TB", TB_TAG).otherwise(LEGACY_TAG))
    for query in (queries.ordered, queries.not_held, queries.candidate_lists):
        found, seen = counted(df)
        monkeypatch.setattr(queries, "ranked", lambda s, d, found=found: found)
        assert query(spark, sf).count() > 0
        assert seen.value == 80


def test_trades_are_made_once(spark):
    rows = [("x", "일반", i, "2024-01-01", f"2024-01-{2 + i % 9:02d}", i / 10, 3, "익절", i) for i in range(30)]
    df = spark.createDataFrame(rows, "strategy string, grade string, code long, entry_date string, exit_date string, pnl double, days int, reason string, seq long").withColumn("exit_date", F.to_date("exit_date"))
    for query in (kept.stats, kept.reasons, kept.equity):
        found, seen = counted(df)
        assert query(found).count() > 0
        assert seen.value == 30


def test_tasks_keep_their_size(spark):
    df = spark.range(4000).withColumn("k", F.col("id") % 400)
    for n in (1000, 2000, 4000):
        got = src.dealt(df.where(F.col("id") < n), "k", 50)
        assert got.rdd.getNumPartitions() == n // 50
        assert got.count() == n and got.select("k", F.spark_partition_id()).distinct().count() == 400
    assert src.dealt(df, "k", 2000) is df
