"""Structured Streaming forms of hourly bars, keyed upserts and order replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.replay import LOG, columns_of, play
from barloom.sources import versions


def hourly(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """60-minute bars of a stream of (code, ts, price, size); a window is out once the watermark passes it."""
    at = F.struct("ts", "price")
    bars = ticks.withWatermark("ts", late).groupBy("code", F.window("ts", "1 hour").alias("w"))
    return bars.agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum("size").alias("v")).select("code", F.col("w.start").alias("hour"), "o", "h", "l", "c", "v")


STEPS = "code string, d date, ts timestamp, id long, price double, total double, step double"
DAY_MS = 86_400_000


class _Steps(StatefulProcessor):
    """Of one code's day: rows that the watermark hasn't passed, and the total and place of the last one that it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rows", "held binary, total double, ts long, id long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = np.rec.fromarrays([new["ts"].to_numpy().astype("datetime64[us]").astype("i8"), new["id"].to_numpy("i8"), new["price"].to_numpy("f8"), new["total"].to_numpy("f8")], dtype=HELD)
        yield from self.passed(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.passed(key, np.zeros(0, HELD), timerValues)

    def passed(self, key, new: np.ndarray, timers) -> Iterator[pd.DataFrame]:
        """Rows up to the watermark in order, each but once, with what the total grew by; the others stay."""
        mark = timers.getCurrentWatermarkInMs()
        held, total, ts, id_, timer = self.state.get() if self.state.exists() else (b"", 0.0, -(1 << 62), -(1 << 62), -1)
        rows = np.concatenate([np.frombuffer(bytes(held), HELD), new])
        rows = rows[np.lexsort((rows["id"], rows["ts"]))]
        once = np.ones(len(rows), bool)
        once[1:] = (rows["ts"][1:] != rows["ts"][:-1]) | (rows["id"][1:] != rows["id"][:-1])
        rows = rows[once & ((rows["ts"] > ts) | ((rows["ts"] == ts) & (rows["id"] > id_)))]
        n = int(np.searchsorted(rows["ts"], mark * 1000 + 999, "right"))
        out, rows = rows[:n], rows[n:]
        if n:
            step = np.maximum(np.diff(out["total"], prepend=total), 0.0)
            total, ts, id_ = float(out["total"][-1]), int(out["ts"][-1]), int(out["id"][-1])
            yield pd.DataFrame({"code": key[0], "d": key[1], "ts": pd.to_datetime(out["ts"], unit="us"), "id": out["id"], "price": out["price"], "total": out["total"], "step": step})
        over = (pd.Timestamp(key[1]).value // 1_000_000) + DAY_MS
        if not len(rows) and mark >= over:
            self.state.clear()  # later rows of the day come too late to get here
            return
        due = int(rows["ts"][-1]) // 1000 + 1 if len(rows) else over
        if due != timer:
            self.handle.registerTimer(due)
        self.state.update((rows.tobytes(), total, ts, id_, due))


HELD = np.dtype([("ts", "<i8"), ("id", "<i8"), ("price", "<f8"), ("total", "<f8")])


def volume_steps(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """sources.bars.volume_steps over a stream of (code, ts, id, price, total): what a day's running total grew by since the row
    before, by ts and id; a day's first row has its total, and no step is under 0.

    Rows may come out of order by as much as `late`, and any number of times: they wait until the watermark has passed
    them, and what has come before, or comes later than that, is passed over. State is kept a code and day, so it goes
    with the day, and an event-time timer lets the last rows out. Rows come out in order, and once they do they are
    final, which bar_batches relies on. Rows with a null code, ts, id or total are dropped."""
    rows = ticks.select(F.col("code").cast("string").alias("code"), F.to_date("ts").alias("d"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), F.col("price").cast("double").alias("price"), F.col("total").cast("double").alias("total"))
    rows = rows.where("code is not null and ts is not null and id is not null and total is not null").withWatermark("ts", late)
    return rows.groupBy("code", "d").transformWithStateInPandas(_Steps(), STEPS, "append", "EventTime")


#: transformWithState keeps its state in this store only.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def upsert_batches(path: str, key: list[str], day: str, name: str = "stream", latest: str | None = None):
    """A foreachBatch function that keeps a versioned table with one row a key: a batch's days are read, merged (the batch
    wins; of its own rows that with the largest `latest`) and written as a new version. A batch that is delivered twice
    changes nothing, and one that is killed leaves the version before."""

    def run(batch: DataFrame, batch_id: int) -> None:
        versions.upsert(batch, path, key, day, (name, batch_id), latest)

    return run


BAR = ["code", "hour", "d", "o", "h", "l", "c", "v", "first", "last"]


def merged_bars(parts: DataFrame) -> DataFrame:
    """One bar a code and hour out of parts of bars, which tell the place of their first and last row."""
    bar = parts.groupBy("code", "hour", "d").agg(F.min_by("o", "first").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "last").alias("c"), F.sum("v").alias("v"), F.min("first").alias("first"), F.max("last").alias("last"))
    return bar.select(*BAR)


def bar_parts(steps: DataFrame) -> DataFrame:
    """Parts of 60-minute bars out of rows of volume_steps."""
    at = F.struct("ts", "id").alias("at")
    rows = steps.select("code", F.date_trunc("hour", "ts").alias("hour"), "d", "price", "step", at)
    return rows.groupBy("code", "hour", "d").agg(F.min_by("price", "at").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "at").alias("c"), F.sum("step").alias("v"), F.min("at").alias("first"), F.max("at").alias("last"))


def bar_batches(path: str, name: str = "stream"):
    """A foreachBatch function that keeps a versioned table of 60-minute bars out of a stream of volume_steps: a batch's rows
    are merged into the bars that are there, each batch once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        versions.upsert(bar_parts(batch).select(*BAR), path, ["code", "hour"], "d", (name, batch_id), merge=merged_bars)

    return run


def append_batches(path: str, day: str | None = None, name: str = "stream"):
    """A foreachBatch function that appends to a versioned table, each batch once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        versions.write(batch, path, day, "append", (name, batch_id))

    return run


def replay_stream(days: DataFrame) -> DataFrame:
    """replay() over a stream whose batches hold whole days in order: the book of a strategy is its state, kept as JSON.
    A day that is not after the last one played is passed over, so a day delivered twice is played once."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, text = play(key[0], state.get[0] if state.exists else None, columns_of(pd.concat(list(frames), ignore_index=True)))
        state.update((text,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    return days.groupBy("strategy").applyInPandasWithState(run, LOG, "state string", "append", GroupStateTimeout.NoTimeout)
