"""Indicators over bars: code, d, o, h, l, c, v. All windows share one partitioning and order, so one shuffle serves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import recurrences
from barloom.functions.numeric import change, col, over


def in_order() -> W:
    """A code's bars by date."""
    return W.partitionBy("code").orderBy("d")


def rows(back: int, to: int = 0) -> W:
    return in_order().rowsBetween(-back, to)


def indexed(bars: DataFrame) -> DataFrame:
    """Adds i, the bar's place in its code from 0 on."""
    return bars.withColumn("i", F.row_number().over(in_order()) - 1)


def sma(x: Column | str, n: int) -> Column:
    """Mean of the last n bars, null before there are n. Needs i."""
    return F.when(F.col("i") >= n - 1, F.avg(col(x)).over(rows(n - 1)))


def mesh(bars: DataFrame, start: int = 10, step: int = 5, count: int = 6) -> DataFrame:
    """Adds ma<n> for each length, top and bottom of them all, and red: the shortest above the longest (false before)."""
    lengths = [start + step * k for k in range(count)]
    out = bars.withColumns({f"ma{n}": sma("c", n) for n in lengths})
    cols = [F.col(f"ma{n}") for n in lengths]
    last = F.col(f"ma{lengths[-1]}")
    return out.withColumns({
        "top": F.when(last.isNotNull(), F.greatest(*cols)),
        "bottom": F.when(last.isNotNull(), F.least(*cols)),
        "red": F.coalesce(cols[0] > last, F.lit(False)),
    })


def golden(n: int = 32, variant: str = "ratio") -> tuple[Column, Column]:
    """(rise from the lowest close, fall from the highest close) of the last n bars, in percent, from the first bar on.

    ratio: close / low - 1 and high / close - 1. symmetric: close / low - low / close and high / close - close / high.
    0 where a price is 0."""
    low, high, c = F.min("c").over(rows(n - 1)), F.max("c").over(rows(n - 1)), F.col("c")
    if variant == "ratio":
        up, down = change(c, low), change(high, c)
    elif variant == "symmetric":
        up, down = (over(c, low) - over(low, c)) * 100, (over(high, c) - over(c, high)) * 100
    else:
        raise ValueError("variant is ratio or symmetric")
    return F.coalesce(up, F.lit(0.0)), F.coalesce(down, F.lit(0.0))


def with_golden(bars: DataFrame, n: int = 32, variant: str = "ratio") -> DataFrame:
    up, down = golden(n, variant)
    return bars.withColumns({"gb": up, "gs": down})


def pressed(bars: DataFrame) -> DataFrame:
    """Adds bp and tr, buying pressure and true range; the first bar's previous close is its own."""
    before = F.lag("c").over(in_order())
    prev = F.coalesce(before, F.col("c"))
    low, high = F.least("l", prev), F.greatest("h", prev)
    return bars.withColumn("bp", F.col("c") - low).withColumn("tr", high - low)


def ultimate(bars: DataFrame, lengths: tuple[int, int, int] = (7, 14, 28), signal: int = 8) -> DataFrame:
    """Adds u and u_sig. Buying pressure over true range, summed over three lengths and weighted 4, 2, 1; the first bar's
    previous close is its own. Null until the longest sum is full or if a sum of ranges is 0. u_sig is the mean of the
    last `signal` values of u."""
    out = pressed(bars)
    legs = [F.when(F.col("i") >= n - 1, over(F.sum("bp").over(rows(n - 1)), F.sum("tr").over(rows(n - 1)))) for n in lengths]
    out = out.withColumn("u", (legs[0] * 4 + legs[1] * 2 + legs[2]) * 100 / 7)
    seen = F.count("u").over(rows(signal - 1))
    return out.withColumn("u_sig", F.when(seen == signal, F.avg("u").over(rows(signal - 1)))).drop("bp", "tr")


def back(x: Column | str, k: int) -> Column:
    return F.lag(col(x), k).over(in_order())


def returns(bars: DataFrame) -> DataFrame:
    """Adds chg1, chg5 and chg20, percent changes of the close over so many bars, unrounded."""
    return bars.withColumns({f"chg{k}": change(F.col("c"), back("c", k)) for k in (1, 5, 20)})


# --- recursive averages: one pass over a code's bars


MESH = [10 + 5 * k for k in range(6)]
BLOCK = 1 << 17  # rows that a task walks over together, if they are whole codes


def recursive(bars: DataFrame, fast: int = 10, slow: int = 30, signal: int = 8, rsi: int = 35, ema: int = 10, hold: tuple[float, float, int] | None = None, sliding: bool = False) -> DataFrame:
    """Adds ema (of closes), t, t_sig and b; with hold = (least t, least b, cap) also tb_ok, whether both are reached, and
    tb_hold, for how many bars in a row, capped. With sliding also what mesh and ultimate add, from columns bp and tr
    (pressed), which go: a sliding frame costs Spark a step a value of the frame and bar, here all bars take a step at once.

    A value depends on the one before it, which no window gives: a window's place in its code has bars come by code and in
    order, without a shuffle where they lie so already, and a task walks over blocks of whole codes, all codes of a block a
    step at a time. Only closes are unpacked; the other columns go through as they came, as Arrow's. What windows add
    is best added before: after this pass Spark knows nothing of the rows' order and would shuffle again. A code whose
    bars don't suit one task goes through scans.spread_averages."""
    kinds = {"ema": "double", "t": "double", "t_sig": "double", "b": "double"} | ({"tb_ok": "boolean", "tb_hold": "int"} if hold else {})
    if sliding:
        kinds = {f"ma{n}": "double" for n in MESH} | {"top": "double", "bottom": "double", "red": "boolean", "u": "double", "u_sig": "double"} | kinds
        bars = bars.select(*[c for c in bars.columns if c not in ("bp", "tr")], "bp", "tr")
    code, close, own = bars.columns.index("code"), bars.columns.index("c"), len(bars.columns) - 2 * sliding

    def done(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        """Whole codes' bars, with the averages."""
        rows = pa.Table.from_batches(parts)
        cuts = np.array([0, *_changes(rows.column(code).combine_chunks()), rows.num_rows])
        c = rows.column(close).to_numpy()
        t, t_sig = recurrences.tsi(c, cuts, fast, slow, signal)
        new = [recurrences.ema(c, cuts, ema), t, t_sig, recurrences.rsi(c, cuts, rsi)]
        if sliding:
            place = np.arange(rows.num_rows) - np.repeat(cuts[:-1], np.diff(cuts))
            x = [rows.column(k).cast(pa.float64()) for k in (close, own, own + 1)]
            full = [v.is_valid().to_numpy() for v in x]
            x = [v.fill_null(0.0).to_numpy() for v in x]
            new = [*recurrences.mesh(x[0], full[0], place, MESH), *recurrences.ultimate(x[1], x[2], full[1:], place), *new]
        if hold:
            b = new[-1]
            ok = (t >= hold[0]) & (b >= hold[1])
            new += [ok, recurrences.streak(ok, cuts, hold[2]).astype(np.int32)]
        rows = rows.select(range(own))
        for name, v in zip(kinds, new, strict=True):
            rows = rows.append_column(name, pa.array(v, from_pandas=True))
        return rows.to_batches(max_chunksize=1 << 14)

    def run(batches):
        held: list[pa.RecordBatch] = []  # whole codes' bars, and the latest code's so far
        n, start = 0, 0  # rows held; those before the latest code's first
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = _changes(batch.column(code))
            if held and _differ(held[-1].column(code)[-1], batch.column(code)[0]):
                cuts = [0, *cuts]
            start = n + cuts[-1] if cuts else start
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK and start:
                rest = n - start
                last = [batch.slice(cuts[-1])] if cuts else []
                if not last:  # the latest code began in an earlier batch
                    whole = pa.Table.from_batches(held)
                    last, held = whole.slice(start).to_batches(), whole.slice(0, start).to_batches()
                else:
                    held[-1] = batch.slice(0, cuts[-1])
                yield from done(held)
                held, n, start = last, rest, 0
        if held:
            yield from done(held)

    place = next(n for n in ("i", "place", "place_in_code") if n not in bars.columns)
    rows = bars.withColumn(place, F.row_number().over(in_order()))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields[:own]]
    return rows.mapInArrow(run, ", ".join([*fields, *(f"{n} {k}" for n, k in kinds.items())]))


def _differ(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.is_valid != b.is_valid or (a.is_valid and a.as_py() != b.as_py())


def _changes(codes: pa.Array) -> list[int]:
    """Where a value differs from the one before; nulls are equal."""
    if len(codes) < 2:
        return []
    a, b = codes.slice(1), codes.slice(0, len(codes) - 1)
    differ = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b).fill_null(True), pc.xor(pc.is_valid(a), pc.is_valid(b)))
    return (np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1).tolist()


def counted(bars: DataFrame) -> DataFrame:
    """Adds n_own, how many bars the code has; best before the recursive pass, where bars lie by code."""
    return bars.withColumn("n_own", F.count(F.lit(1)).over(W.partitionBy("code")))


def override(series: DataFrame, external: DataFrame) -> DataFrame:
    """series with external t and b in place of its own, for codes of which there are as many external rows as bars. An
    external null replaces a value too; a code with another count keeps its own. external: code, seq, T, B. series may
    have n_own (counted), which spares a shuffle, and loses it here."""
    own = series if "n_own" in series.columns else counted(series)
    rows = F.count(F.lit(1)).over(W.partitionBy("code"))
    ext = external.select("code", F.col("seq").alias("i"), rows.alias("n_own"), F.col("T").alias("xt"), F.col("B").alias("xb"), F.lit(True).alias("use"))
    out = own.join(ext, ["code", "i", "n_own"], "left")
    out = out.withColumns({"t": F.when(F.col("use"), F.col("xt")).otherwise(F.col("t")), "b": F.when(F.col("use"), F.col("xb")).otherwise(F.col("b"))})
    return out.select(*[c for c in series.columns if c != "n_own"])


def rolling(bars: DataFrame) -> DataFrame:
    """The indicators that windows give, unrounded: i, meshes (ma30 is one of their lengths), top, bottom, red, u, u_sig,
    gb, gs."""
    return with_golden(ultimate(mesh(indexed(bars))))


def series(bars: DataFrame) -> DataFrame:
    """All indicators of a code's bars, unrounded: those of rolling, then ema, t, t_sig, b."""
    return recursive(rolling(bars))


def signs(df: DataFrame, x: Column | str, base: float = 0.0) -> DataFrame:
    """Adds run: the number, from 1, of the run of bars on one side of the base."""
    side = F.signum(col(x) - base)
    new = (F.coalesce(F.lag(side).over(in_order()), F.lit(9.0)) != side).cast("int")
    return df.withColumn("side", side).withColumn("new", new).withColumn("run", F.sum("new").over(in_order().rowsBetween(W.unboundedPreceding, 0))).drop("new")


def month_marks(df: DataFrame) -> DataFrame:
    """Adds new_month: the first bar of a month within its code, but not a code's first bar."""
    return df.withColumn("new_month", F.coalesce(F.trunc("d", "month") != F.lag(F.trunc("d", "month")).over(in_order()), F.lit(False)))


#: A chart's width and left edge, the least space between two labels, and what stays free at the right, in pixels.
CHART = {"width": 900, "left": 56, "gap": 44, "right": 18}


def month_labels(df: DataFrame, width: int = CHART["width"], left: int = CHART["left"], gap: int = CHART["gap"], right: int = CHART["right"]) -> DataFrame:
    """(code, d, x): where a chart's months are labelled: the marks of month_marks, at the middle of their bar, from the
    first on, each at least `gap` beyond the last one labelled, and none at the right edge. A code's bars share the width."""
    from .sets import thinned

    n = F.count(F.lit(1)).over(W.partitionBy("code"))
    x = F.lit(float(left)) + (F.row_number().over(in_order()) - 0.5) * F.lit(float(width)) / n
    marks = month_marks(df).withColumn("x", x).where(F.col("new_month") & (F.col("x") < left + width - right))
    return thinned(marks.select("code", "d", "x"), "code", "x", gap)


def extremes(df: DataFrame, n: int, lows: dict[str, Column], highs: dict[str, Column]) -> DataFrame:
    """Adds the least and the largest of the last n bars' values, at a cost that doesn't grow with n.

    A code's bars are cut into blocks of n. The last n bars are the end of one block and the start of the next, so their
    extreme is that of two running ones: from a block's start on, and from its end back. Spark looks through all of a sliding
    frame for each row; running frames take one step. Values may be of any ordered type, structs too. Needs i."""
    block = F.floor(F.col("i") / n)
    own = {k: c for k, c in (lows | highs).items()}
    best = {k: F.min if k in lows else F.max for k in own}
    pick = {k: F.least if k in lows else F.greatest for k in own}
    out = df.withColumn("block_", block).withColumns({f"v_{k}": c for k, c in own.items()})
    ahead = W.partitionBy("code", "block_").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy("code", "block_").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({f"s_{k}": best[k](f"v_{k}").over(behind) for k in own})
    out = out.withColumns({f"p_{k}": best[k](f"v_{k}").over(ahead) for k in own})
    out = out.withColumns({f"s_{k}": back(f"s_{k}", n - 1) for k in own})  # the running extreme back from the block's end, at the oldest of the n bars
    # fewer than n bars so far lie in the first block
    out = out.withColumns({k: F.when(F.col("i") < n - 1, F.col(f"p_{k}")).otherwise(pick[k](f"p_{k}", f"s_{k}")) for k in own})
    return out.drop("block_", *[f"{a}_{k}" for a in "vsp" for k in own])


def extent(df: DataFrame, x: str) -> DataFrame:
    """(code, low, high) of a column without nulls and NaNs; one value alone is spread by 1 either way."""
    v = F.when(~F.isnan(x), F.col(x))
    out = df.groupBy("code").agg(F.min(v).alias("a"), F.max(v).alias("b"))
    return out.select("code", F.when(F.col("a") == F.col("b"), F.col("a") - 1).otherwise(F.col("a")).alias("low"), F.when(F.col("a") == F.col("b"), F.col("b") + 1).otherwise(F.col("b")).alias("high"))
