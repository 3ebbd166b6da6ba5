"""Set operations, keyed merges and look-up joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.config import LIMITS

BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it is counted to have few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_meta(bars: DataFrame, meta: DataFrame, key: str = "code") -> DataFrame:
    """bars with name and market; a code that is unknown is its own name, in no market."""
    out = bars.join(small(meta.select(key, "name", "market")), key, "left")
    return out.withColumns({"name": F.coalesce("name", F.col(key).cast("string")), "market": F.coalesce("market", F.lit(""))})


def latest_days(bars: DataFrame, n: int = 1, until: Column | None = None) -> DataFrame:
    """The last n days of the calendar, which is that of the code with the most bars (ties: the smallest code)."""
    longest = bars.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))
    days = bars.join(F.broadcast(longest), "code", "left_semi").select("d").distinct()  # one row
    days = days if until is None else days.where(F.col("d") <= until)
    return days.orderBy(F.desc("d")).limit(n)


def minus(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Distinct keys of several lists, in the order in which they first come: list by list, each by its own order, ties by
    key. Places are counted within a list's position; only the sizes of those, a row each, are summed in one place."""
    tagged = [p.select(F.col(key), F.lit(k).alias("part"), F.col(order).cast("long").alias("at")) for k, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged)
    first = rows.groupBy(key).agg(F.min(F.struct("part", "at")).alias("first"))
    sizes = first.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("first", (F.sum("n").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("first").orderBy(key))
    return first.withColumn("own", own).join(small(before), "first").select(key, (F.col("before") + F.col("own")).cast("int").alias("place"))


def first_codes(parts: list[DataFrame], key: str, order: str, most: int = LIMITS.chart_codes) -> DataFrame:
    """The first `most` of ordered_union."""
    return ordered_union(parts, key, order).where(F.col("place") <= most)


def date_tail(parts: list[DataFrame], n: int = LIMITS.history_days, day: str = "d") -> DataFrame:
    """The last n of the days that any of the tables has."""
    return reduce(DataFrame.unionByName, [p.select(day) for p in parts]).distinct().orderBy(F.desc(day)).limit(n)


def upsert(old: DataFrame, new: DataFrame, group: str, key: str, keep: int | None = None) -> DataFrame:
    """Rows by (group, key), those of new before those of old; of a group the last `keep` keys."""
    rows = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy(group, key).orderBy(F.desc("version")))).where("r = 1").drop("r", "version")
    if keep is None:
        return rows
    return rows.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(key)))).where(F.col("r") <= keep).drop("r")


def capped(store: DataFrame, current: DataFrame, since: str, most: int = LIMITS.hourly_codes, code: str = "code") -> DataFrame:
    """The store's rows of the codes that stay: all current ones, and as many of those that came into the store last as
    leave `most`; where the current ones are that many, they alone. since: when a row's code first came, larger being
    later; ties by code, larger first. current: code, few enough to count; rows with a null code go."""
    now = current.select(code).where(F.col(code).isNotNull()).distinct()
    left = max(0, most - now.count())
    first = store.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(since).alias("since_"))
    last = first.orderBy(F.desc("since_"), F.desc(code)).limit(left).select(code)  # each task brings its own last ones
    keep = now.unionByName(last).distinct()
    return store.join(small(keep), code, "left_semi")


def thinned(points: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Of each key's places, those that a walk from the smallest on keeps: each place that is at least `gap` beyond the one
    kept before. at: numbers, without nulls; equal ones are one.

    What follows a place, were it kept, doesn't depend on what was kept before, so each place points to the next one, and
    the walk is found by doubling: pointers of twice the length each round, and what is reached by them. Rounds are the
    logarithm of the longest walk; each is stored, and none holds a key's places in one task but the window that finds the
    pointers."""
    from barloom.sources.shared import kept

    follows = F.min("a").over(W.partitionBy("k").orderBy("a").rangeBetween(gap, W.unboundedFollowing))
    places = points.select(F.col(key).alias("k"), F.col(at).alias("a")).distinct()
    jump = kept(places.withColumn("b", follows).where("b is not null"), "jumps")
    reached = places.groupBy("k").agg(F.min("a").alias("a"))
    n = -1
    while True:
        j = jump.alias("j")
        more = reached.alias("r").join(j, F.col("r.k").eqNullSafe(F.col("j.k")) & (F.col("r.a") == F.col("j.a"))).select("r.k", F.col("j.b").alias("a"))
        reached = kept(reached.unionByName(more).distinct(), "reached")
        now = reached.count()
        if now == n:
            break
        n = now
        one, two = jump.alias("x"), jump.alias("y")
        jump = kept(one.join(two, F.col("x.k").eqNullSafe(F.col("y.k")) & (F.col("x.b") == F.col("y.a"))).select("x.k", "x.a", "y.b"), "jumps")
    r = reached.select(F.col("k").alias("k_"), F.col("a").alias("a_"))
    return points.join(r, F.col(key).eqNullSafe(F.col("k_")) & (F.col(at) == F.col("a_")), "left_semi")


def not_held(candidates: DataFrame, positions: DataFrame, keys: list[str], rank: str, room: int) -> DataFrame:
    """Candidates that aren't held, the best `room` of each day and strategy in keys[1:]."""
    free = candidates.join(positions.select(*keys).distinct(), keys, "left_anti")
    return free.withColumn("order", F.row_number().over(W.partitionBy(*keys[1:]).orderBy(rank))).where(F.col("order") <= room)


def flagged(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """left with whether right has its keys."""
    mark = right.select(*keys).distinct().withColumn(name, F.lit(True))
    return left.join(mark, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
