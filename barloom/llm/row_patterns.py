"""Row pattern matching: A (D|U)* P D* over each key's rows in order, by regular expressions over symbols."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, stored, tidy

ROWS_A_TASK = 1_000_000  # of sorted rows, at most about
ROWS_AT_ONCE = 1 << 15  # of a task's rows that are turned into symbols together, if they hold a break
LONG = 2048  # rows of a segment from which starts that can't match aren't tried
VIEW, GOOD, REAL = 1, 2, 4  # a row's flags: the goal's kind; a kind that D and U take; a value

#: Symbols: a the row that begins a segment; d, u a row below, above the one before; D, U the same where it may be P; P one
#: that may be P only. Goals that are too low for a start are switched off: D to d, U to u, P to x.
OFF = {ord("D"): ord("d"), ord("U"): ord("u"), ord("P"): ord("x")}
PATTERN = regex.compile(rb"(?s:.)([dDuU]*)[DUP]([dD]*)")

Cols = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # key, ts in microseconds, id, cents, flags


def symbols(cols: Cols, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(a symbol a row, the places of the rows that begin a segment). A row begins one if it can be neither D, U nor P, so
    no match goes over that border; cols are whole segments, or begin with one."""
    key, ts, _, cents, flags = cols
    out = np.full(len(key), ord("a"), np.uint8)
    if len(key) > 1:
        real = (flags & REAL) > 0
        near = (key[1:] == key[:-1]) & (ts[1:] - ts[:-1] <= gap) & real[1:] & real[:-1]
        below, above = cents[1:] < cents[:-1], cents[1:] > cents[:-1]
        view, good = (flags[1:] & VIEW) > 0, (flags[1:] & GOOD) > 0
        for name, where in (("P", view), ("d", good & below), ("u", good & above), ("D", view & good & below), ("U", view & good & above)):
            out[1:][near & where] = ord(name)
    return out, np.flatnonzero(out == ord("a"))


def reached(sym: bytearray, cents: list, order: list) -> list:
    """For each row of a segment, the last row of its match or None, without the expression: the last goal high enough in
    the stretch of D and U that the row begins, then all D after it. Linear once rows are ordered by cents."""
    n = len(sym)
    stretch, k = [0] * n, 0  # of a row as a start; a row that may be P only ends one, as a goal, and begins the next
    goals: list[list[int]] = [[]]
    for i, s in enumerate(sym):
        if s in b"DUP":
            goals[k].append(i)
        if s == 80:  # P
            k += 1
            goals.append([])
        stretch[i] = k
    falls = [0] * (n + 1)  # how many D follow each other from here on
    for i in range(n - 1, -1, -1):
        falls[i] = falls[i + 1] + 1 if sym[i] in b"dD" else 0
    out = [None] * n
    for i in order:
        live = goals[stretch[i]]
        while live and cents[live[-1]] < cents[i]:
            live.pop()
        if live and live[-1] > i:
            out[i] = live[-1] + falls[live[-1] + 1]
    return out


def chain(ends: list) -> list[int]:
    """The starts that the search comes to and that match: from a match it goes on at its last row."""
    out, i = [], 0
    while i < len(ends):
        if ends[i] is None:
            i += 1
        else:
            out.append(i)
            i = ends[i]
    return out


def segment_matches(sym: bytearray, cents: list, order: list) -> list[tuple[int, int, bytes]]:
    """(first row, last row, letters) of a segment's matches. order: its rows by rising cents, so that goals that are too
    low for a start are too low for all later ones and are switched off once and for all. The expression is run at every
    start; in a segment of over LONG rows only at those that the search comes to, which `reached` tells, up to their
    last row, so that its cost stays linear."""
    known = None
    if len(sym) > LONG:
        known = reached(sym, cents, order)
        visited = set(chain(known))
        order = [i for i in order if i in visited or sym[i] in b"DUP"]
    ends, groups = [None] * len(sym), {}
    live, pending, at, match = sum(s in b"DUP" for s in sym), [], None, PATTERN.match
    for i in order:
        if cents[i] != at:
            for g in pending:
                sym[g] = OFF[sym[g]]
            live -= len(pending)
            if not live:
                break
            pending, at = [], cents[i]
        if known is None or i in visited:
            m = match(sym, i) if known is None else match(sym, i, known[i] + 1)
            if m:
                ends[i] = m.end() - 1
                groups[i] = m.end(1)
        if sym[i] in OFF:
            pending.append(i)
    return [(i, ends[i], b"A" + bytes(sym[i + 1 : groups[i]]).upper() + b"P" + b"D" * (ends[i] - groups[i])) for i in chain(ends)]


def matches(cols: Cols, gap: int) -> list[tuple]:
    """(key, place of the first row, first id, last id, rows, sum of cents, letters) of rows that are whole segments."""
    key, _, ids, cents, _ = cols
    sym, starts = symbols(cols, gap)
    if not len(starts):
        return []
    if starts[0] != 0:
        raise ValueError("the first row begins a segment")
    ends = np.r_[starts[1:], len(sym)]
    goal = np.r_[0, np.cumsum(np.isin(sym, np.frombuffer(b"DUP", np.uint8)))]
    some = np.flatnonzero(goal[ends] > goal[starts])  # a segment without a goal has no match
    if not len(some):
        return []
    which = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((cents, which))
    sums = np.r_[0, np.cumsum(cents)]
    out = []
    for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
        for i, j, letters in segment_matches(bytearray(sym[a:b]), cents[a:b].tolist(), (order[a:b] - a).tolist()):
            i, j = a + i, a + j
            out.append((int(key[i]), i, int(ids[i]), int(ids[j]), j - i + 1, int(sums[j + 1] - sums[i]), letters.decode()))
    return out


def packed(cols: Cols) -> bytes:
    return b"".join(c.astype("<i8").tobytes() for c in cols[:4]) + cols[4].astype("u1").tobytes()


def unpacked(data: bytes) -> Cols:
    n = len(data) // 33
    long = np.frombuffer(data, "<i8", 4 * n).reshape(4, n)
    return (*long, np.frombuffer(data, "u1", n, 32 * n))


def joined(parts: list[Cols]) -> Cols:
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def cut(cols: Cols, a: int, b: int) -> Cols:
    return tuple(c[a:b] for c in cols)


FOUND = "pid int, row long, client_id long, first_id long, last_id long, n_rows long, sum_cents long, labels string"
FRAGMENT = "frag binary, bridge boolean, spot long"


def find(rows: DataFrame, key: str = "client_id", ts: str = "ts", row_id: str = "click_id", kind: str = "kind", value: str = "value", minutes: int = 15, goal: str = "view", bad: str = "error", rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """The matches of A (D|U)* P D* in each key's distinct rows, by ts and row_id: key, match_no, first_id, last_id, n_rows,
    sum_cents and labels (a letter a row).

    A is any row with a value; D and U lie below and above the row before, and have a kind other than `bad`; P has kind
    `goal` and at least A's cents; D, U and P come at most `minutes` after the row before. The search begins at the
    first row, goes one row on where nothing matches, and from a match's last row on after it.

    Rows are dealt by range over (key, ts, id), so a key with very many rows lies in many tasks, each in order. What can be
    neither D, U nor P begins a segment, and no match leaves its segment: a task matches its own segments, and hands on
    the rows before its first border and from its last one on; those of neighbouring tasks meet by a shuffle, a task a
    border. Where a task has no border at all, as many tasks' rows meet as one segment covers: its rows are held packed
    (33 bytes each), and work stays linear in them. Numbers come from counts a key and task.

    Rows with a null key or ts are dropped. A null value, NaN or one beyond 9e13 fits no letter; a null kind is neither
    D, U nor P. Equal rows count once, whatever their further columns; distinct rows with equal ts and id go by cents,
    nulls first, then by kind (others, null and bad first, then good ones, then the goal), and those equal in all these
    are alike. A null id comes first and is written as null. No rows, no matches. key and id are whole numbers."""
    gap = minutes * 60_000_000
    spark = rows.sparkSession
    scaled = F.col(value).cast("double") * 100 + 0.5
    cents = F.when(~F.isnan(scaled) & (F.abs(scaled) < 9e15), F.floor(scaled))
    is_goal, is_good = F.coalesce(F.col(kind) == goal, F.lit(False)), F.coalesce(F.col(kind) != bad, F.lit(False))
    real = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).distinct()
    slim = real.select(F.col(key).cast("long").alias("k"), F.col(ts).alias("t"), F.col(row_id).cast("long").alias("i"), cents.alias("c"), (is_goal.cast("int") * VIEW + is_good.cast("int") * GOOD).alias("f"))
    slim = stored(slim, "rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // rows_a_task))
    by = ["k", "t", "i", "c", "f"]  # nulls first
    none = -(1 << 63)  # stands for a null id

    def read(batch: pa.RecordBatch) -> Cols:
        c = batch.column(3)
        real = c.is_valid().to_numpy(zero_copy_only=False)
        when = batch.column(1).cast(pa.timestamp("us", getattr(batch.column(1).type, "tz", None))).cast(pa.int64())
        flags = batch.column(4).to_numpy().astype(np.uint8) | np.where(real, REAL, 0).astype(np.uint8)
        return batch.column(0).to_numpy(), when.to_numpy(), batch.column(2).fill_null(none).to_numpy(), c.fill_null(0).to_numpy(), flags

    names = [x.split()[0] for x in f"{FOUND}, {FRAGMENT}".split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.bool_(), pa.int64()]
    ident = lambda x: None if x == none else x

    def told(found: list[tuple]) -> pa.RecordBatch:
        data = list(zip(*found, strict=True)) or [()] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(data, kinds, strict=True)], names)

    def lines(pid: int, base: int, cols: Cols) -> list[tuple]:
        return [(pid, base + at, k, ident(a), ident(b), n, s, letters, None, None, None) for k, at, a, b, n, s, letters in matches(cols, gap)]

    def fragment(pid: int, base: int, cols: Cols, bridge: bool, spot: int) -> pa.RecordBatch:
        return told([(pid, base, *[None] * 6, packed(cols), bridge, spot)])

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list[Cols] = []  # rows since the last border, and new ones
        base, n, headless = 0, 0, True  # the place of held's first row; how many there are; whether no border has come yet
        empty = tuple(np.zeros(0, np.int64) for _ in range(5))

        def flushed():
            """Matches of the whole segments in hand; only the last segment stays."""
            nonlocal held, base, n, headless
            cols = joined(held)
            _, starts = symbols(cols, gap)
            inner = starts[starts > 0]
            held = [cols]
            if not len(inner):
                return
            first, last = int(inner[0]) if headless else 0, int(inner[-1])
            if headless:
                yield fragment(pid, base, cut(cols, 0, first), False, pid)
                headless = False
            if last > first:
                yield told(lines(pid, base + first, cut(cols, first, last)))
            held, base, n = [cut(cols, last, len(cols[0]))], base + last, len(cols[0]) - last

        due = ROWS_AT_ONCE
        for batch in batches:
            if batch.num_rows:
                held.append(read(batch))
                n += batch.num_rows
                if n >= due:
                    yield from flushed()
                    due = max(ROWS_AT_ONCE, 2 * n)  # rows without a border aren't looked through again and again
        if held:
            yield from flushed()
        yield fragment(pid, base, joined(held) if held else empty, headless, pid if headless else pid + 1)
        tidy()

    dealt = slim.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    one = stored(dealt.mapInArrow(run, f"{FOUND}, {FRAGMENT}"), "matches")
    frags = one.where("frag is not null").select("pid", "row", "frag", "spot")
    bridges = one.where("bridge").select(F.col("pid").cast("long").alias("a"), (F.col("pid") + 1).cast("long").alias("b"))
    if bridges.limit(1).count():  # spots that rows without a border connect are one
        comp = components(bridges).withColumnRenamed("node", "spot")
        frags = frags.join(comp, "spot", "left").withColumn("spot", F.coalesce("comp", "spot")).drop("comp")

    def stitch(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pid", "ascending"), ("row", "ascending")])
        parts = [unpacked(x.as_py()) for x in table["frag"]]
        cols = joined(parts)
        at = np.r_[0, np.cumsum([len(p[0]) for p in parts])]
        pids, bases = table["pid"].to_pylist(), table["row"].to_pylist()
        out = []
        for line in lines(0, 0, cols):
            k = int(np.searchsorted(at, line[1], "right")) - 1  # the fragment that holds the first row
            out.append((pids[k], bases[k] + line[1] - int(at[k]), *line[2:]))
        tidy()
        return pa.Table.from_batches([told(out)]).select(names[:8])

    two = stored(frags.groupBy("spot").applyInArrow(stitch, FOUND), "stitched", parts)
    found = one.where("labels is not null").select(two.columns).unionByName(two)
    counts = found.groupBy("client_id", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("client_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(W.partitionBy("client_id", "pid").orderBy("row")) + F.col("before")
    found = found.join(counts.select("client_id", "pid", before.alias("before")), ["client_id", "pid"])
    return found.select(F.col("client_id").alias(key), number.cast("long").alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels")
