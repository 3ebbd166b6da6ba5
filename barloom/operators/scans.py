"""Recursive averages of keys whose rows spread over tasks: scans of affine maps by chunk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from barloom.functions.numeric import over
from barloom.functions.recurrences import composed, onward, weight


def ema_over(df: DataFrame, key: str, order: str, chunk: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds exponential means: columns names each new one's values and length. In the order of a key, nulls passed over
    (and null in the result), it is null before the n-th value, there the mean of the first n, then v * k + p * (1 - k).

    chunk is a column that never falls in the order of a key; the rows of a key's chunk suit a task, and no task has a
    key's rows. For each chunk one task composes the maps p -> (1 - k) p + k v of its values; the few chunks of a key
    are gone through in order, each map applied to where the last one led; and each chunk is walked from its own start.
    A task walks over blocks of whole chunks, all chunks of a block a step at a time, so chunks may be few or very many.
    A null key is a key; order has no two equal values in a key."""
    names, ns = list(columns), [n for _, n in columns.values()]
    values = [v for v, _ in columns.values()]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    own, each, where = len(df.columns), range(len(ns)), [df.columns.index(v) for v in values]
    taken = {c.lower() for c in [*df.columns, *names]}
    kc, place, state = (next(x for x in (f"{n}{i}" for i in count()) if x not in taken) for n in ("kc_", "place_", "state_"))
    both = F.struct(F.col(key).alias("k"), F.col(chunk).alias("c"))  # nulls within are equal
    in_chunk = F.row_number().over(W.partitionBy(kc).orderBy(order))

    def summary(batches):
        for table in whole(batches, 1):
            cuts = starts_of(table.column(1))
            cols = [table.column(0).take(pa.array(cuts[:-1]))]
            for j, n in enumerate(ns):
                x, dense = real(table.column(2 + j), cuts)
                lens = np.diff(dense)
                b = np.append(onward(x, dense[:-1], lens, np.zeros(len(lens)), weight(n)), 0.0)[dense[1:] - 1]
                size = np.minimum(lens, n)
                head = np.append(0, np.cumsum(size))
                at = np.repeat(dense[:-1] - head[:-1], size) + np.arange(head[-1])
                cols += [pa.array(lens), pa.array(np.where(lens > 0, b, 0.0)), pa.ListArray.from_arrays(pa.array(head, pa.int32()), pa.array(x[at]))]
            yield from pa.table(cols, names=[kc, *(f"{c}{j}" for j in each for c in ("m", "b", "head"))]).to_batches(max_chunksize=1 << 14)

    def starts(batches):
        """(values before it, the sum of those that make the first mean, the mean) of each chunk: a row a chunk."""
        now: list[tuple] = []
        for batch in batches:
            rows = []
            for first, *x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if first == 1:
                    now = [(0, 0.0, 0.0)] * len(ns)
                rows.append([v for s in now for v in map(float, s)])
                now = [after(*now[j], x[3 * j], x[3 * j + 2], x[3 * j + 1], n) for j, n in enumerate(ns)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [kc, state])

    def final(batches):
        for table in whole(batches, own):
            cuts = starts_of(table.column(own))
            first = table.column(own + 1).take(pa.array(cuts[:-1])).to_pylist()
            at = np.array(first, float).reshape(len(first), len(ns), 3)
            out = table.select(range(own))
            for j, (name, v, n) in enumerate(zip(names, where, ns, strict=True)):
                x, dense = real(table.column(v), cuts)
                new = np.full(table.num_rows, np.nan)
                new[~np.isnan(real(table.column(v)))] = means(x, dense, at[:, j, 0].astype(np.int64), at[:, j, 1], at[:, j, 2], n)
                out = out.append_column(name, pa.array(new, from_pandas=True))
            yield from out.to_batches(max_chunksize=1 << 14)

    rows = df.select(both.alias(kc), F.col(order), *values).withColumn(place, in_chunk)
    found = f"`{kc}` struct<k:{kinds[key]},c:{kinds[chunk]}>"
    per = ", ".join(f"m{j} bigint, b{j} double, head{j} array<double>" for j in each)
    sums = rows.select(kc, place, *[F.col(v).cast("double") for v in values]).mapInArrow(summary, f"{found}, {per}")
    sums = sums.withColumn(place, F.row_number().over(W.partitionBy(f"{kc}.k").orderBy(f"{kc}.c")))
    at = sums.select(kc, place, *[f"{c}{j}" for j in each for c in ("m", "b", "head")]).mapInArrow(starts, f"{found}, `{state}` array<double>")
    rows = df.withColumn(kc, both).join(at, kc).withColumn(place, in_chunk)
    rows = rows.select(*[F.col(f"`{c}`") for c in df.columns], place, F.when(F.col(place) == 1, F.col(state)).alias(state))
    schema = StructType(list(df.schema.fields))
    for name in names:
        schema = schema.add(name, DoubleType())
    return rows.mapInArrow(final, schema)


BLOCK = 1 << 17  # rows that a task walks over together, if they are whole chunks


def whole(batches: Iterable[pa.RecordBatch], place: int) -> Iterator[pa.Table]:
    """The rows as tables of whole chunks, of BLOCK rows or little more; a chunk begins where the column `place` is 1."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = np.flatnonzero(batch.column(place).to_numpy(zero_copy_only=False) == 1) if n >= BLOCK else ()
        if len(at):
            yield pa.Table.from_batches([*held, batch.slice(0, at[-1])])
            held, n, batch = [], 0, batch.slice(at[-1])
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def starts_of(place: pa.ChunkedArray) -> np.ndarray:
    """Where chunks begin, and the end."""
    return np.append(np.flatnonzero(place.to_numpy() == 1), len(place))


def real(column: pa.ChunkedArray, cuts: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """A column's values, null as NaN; with cuts only those that aren't NaN, and where chunks begin among them."""
    x = column.cast(pa.float64()).fill_null(np.nan).to_numpy()
    if cuts is None:
        return x
    full = ~np.isnan(x)
    return x[full], np.append(0, np.cumsum(full))[cuts]


def after(count: int, total: float, p: float, m: int, head: list[float], b: float, n: int) -> tuple[int, float, float]:
    """The state after a chunk of m values whose map has b and whose first values are head."""
    k, need = weight(n), max(0, n - count)
    if need == 0:
        return count + m, total, (1 - k) ** m * p + b
    if m < need:
        return count + m, total + sum(head[:m]), p
    seed, rest = (total + sum(head[:need])) / n, (1 - k) ** (m - need)
    before = float(composed(np.array(head[:need]), k, np.array([0, need]))[0])  # what the values in the first mean gave to b
    return count + m, total, rest * seed + b - rest * before


def means(x: np.ndarray, cuts: np.ndarray, count: np.ndarray, total: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """The means of chunks x[cuts[j]:cuts[j + 1]], each from the state before it."""
    out, lens, need = np.full(len(x), np.nan), np.diff(cuts), np.maximum(0, n - count)
    p = p.copy()
    for j in np.flatnonzero((need > 0) & (lens >= need)):  # chunks in which a first mean lies
        a, b = cuts[j], cuts[j] + need[j]
        out[b - 1] = p[j] = (total[j] + x[a:b].sum()) / n
    size = np.maximum(0, lens - need)
    new = onward(x, cuts[:-1] + need, size, p, weight(n))
    return np.where(np.isnan(new), out, new)


def before(df: DataFrame, key: str, order: str, chunk: str, value: str) -> tuple[DataFrame, Column]:
    """df with last_, the last value of the key's chunk before, and kc_, key and chunk; and a column of the value of the row
    before. No window holds more than a chunk's rows, or a row a chunk; rows are shuffled once, by kc_."""
    kc = F.struct(F.col(key).alias("k"), F.col(chunk).alias("c"))  # nulls within are equal
    last = df.groupBy(kc.alias("kc_")).agg(F.max_by(value, order).alias("end_"))
    last = last.withColumn("last_", F.lag("end_").over(W.partitionBy("kc_.k").orderBy("kc_.c"))).drop("end_")
    out = df.withColumn("kc_", kc).join(last, "kc_").select(*df.columns, "kc_", "last_")
    return out, F.coalesce(F.lag(value).over(W.partitionBy("kc_").orderBy(order)), "last_")


def spread_averages(bars: DataFrame, chunk: Column, key: str = "code", order: str = "d", close: str = "c", fast: int = 10, slow: int = 30, signal: int = 8, rsi: int = 35, ema: int = 10) -> DataFrame:
    """indicators.recursive for codes whose bars don't suit one task: adds ema, t, t_sig and b. chunk never falls in a
    code's order, as a year or a count's quotient does. Equal to recursive but for rounding in the last places; where
    t has a null after its first value (no move in thousands of bars), that null stays where it is here. What a pass has
    found is stored before the next pass reads it twice."""
    from barloom.sources.shared import kept

    clash = {c.lower() for c in bars.columns} & {"chunk_", "last_", "kc_", "s_", "a_", "u_", "n_", "ms_", "ma_", "up_", "dn_", "top_", "low_", "ema", "t", "t_sig", "b"}
    names = {c: f"in_{i}" for i, c in enumerate(bars.columns) if c.lower() in clash}
    bars = bars.withColumnsRenamed(names)
    df, prev = before(bars.withColumn("chunk_", chunk), key, order, "chunk_", close)
    step = F.coalesce(F.col(close) - prev, F.lit(0.0))
    df = df.withColumn("s_", step).drop("last_", "kc_")
    df = kept(df.withColumns({"a_": F.abs("s_"), "u_": F.greatest("s_", F.lit(0.0)), "n_": F.greatest(-F.col("s_"), F.lit(0.0))}), "steps")
    df = ema_over(df, key, order, "chunk_", {"ema": (close, ema), "ms_": ("s_", fast), "ma_": ("a_", fast), "up_": ("u_", rsi), "dn_": ("n_", rsi)})
    df = kept(df.drop("s_", "a_", "u_", "n_"), "means")
    df = ema_over(df, key, order, "chunk_", {"top_": ("ms_", slow), "low_": ("ma_", slow)})
    df = df.withColumns({"t": over(F.col("top_") * 100, F.col("low_")), "b": over(F.col("up_") * 100, F.col("up_") + F.col("dn_"))})
    df = kept(df.drop("ms_", "ma_", "top_", "low_", "up_", "dn_"), "means")
    df = ema_over(df, key, order, "chunk_", {"t_sig": ("t", signal)})
    new = ["ema", "t", "t_sig", "b"]  # in place of columns of these names
    back = {v: k for k, v in names.items()}
    return df.select(*[F.col(c).alias(back.get(c, c)) for c in bars.columns if back.get(c, c) not in new], *new)
