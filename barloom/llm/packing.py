"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_rows, stored, tidy
from .tokens import default_vocabulary, ids_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, room: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. A document is its ids and then id 0; one of over `room`
    tokens is cut into pieces of `room`, of which the first takes the remainder. A null text is an empty one."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        ids = ids_of(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids.encode(text.as_py()) + b"\0\0\0\0"
                n = len(data) // 4
                k, at = -(-n // room), 0
                for piece in range(k):
                    to = n - (k - 1 - piece) * room
                    rows.append((doc, piece, at, to - at, zlib.crc32(data[4 * at : 4 * to])))
                    at = to
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy()

    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


# --- the genetic algorithm; a solution is an array with a bin number for each item


def best_fit(order, lengths, room: int, of: np.ndarray | None = None, left: list[int] | None = None) -> np.ndarray:
    """Each item of `order` goes to the fullest bin that has room for it. of, left: bins that are there already."""
    of = np.full(len(lengths), -1, np.int32) if of is None else of
    left = [] if left is None else left
    free = sorted((r, b) for b, r in enumerate(left) if r > 0)
    for i in order:
        n = int(lengths[i])
        k = bisect_left(free, (n, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = room, len(left)
            left.append(room)
        of[i], left[b] = b, r - n
        if r > n:
            insort(free, (r - n, b))
    return of


def exchange(of: np.ndarray, lengths: np.ndarray, room: int, out: np.ndarray, left: list[int], rng, tries: int = 64) -> np.ndarray:
    """Swaps items of some bins for displaced ones that fill those better: one or two of the bin's for one or two of the
    displaced ones that are longer, but still fit. What is displaced instead is shorter, so best fit places it with less
    waste. Changes of and left; returns what is displaced now."""
    free = sorted((int(lengths[i]), int(i)) for i in out)
    inside: dict[int, list[int]] = {}
    some = [int(b) for b in rng.permutation(len(left)) if left[b] > 0][:tries]
    for b in some:
        inside[b] = []
    for i in np.flatnonzero(np.isin(of, some)):
        inside[int(of[i])].append(int(i))
    for b in some:
        gap, own = left[b], inside[b]
        best, pick = 0, None
        for take in [*((x,) for x in own), *combinations(own, 2)]:
            held = sum(int(lengths[x]) for x in take)
            k = bisect_right(free, (held + gap, len(lengths))) - 1
            if k >= 0 and free[k][0] - held > best:
                best, pick = free[k][0] - held, (take, (k,))
            lo, hi = 0, len(free) - 1
            while lo < hi:  # the best sum of two
                both = free[lo][0] + free[hi][0]
                if both > held + gap:
                    hi -= 1
                else:
                    if both - held > best:
                        best, pick = both - held, (take, (lo, hi))
                    lo += 1
            if best == gap:
                break
        if pick:
            take, put = pick
            for k in sorted(put, reverse=True):
                of[free.pop(k)[1]] = b
            for x in take:
                of[x] = -1
                insort(free, (int(lengths[x]), x))
            left[b] -= best
    return np.array([i for _, i in free], np.int64)


def placed(child: np.ndarray, lengths: np.ndarray, room: int, rng) -> np.ndarray:
    """A solution from one some of whose items have no bin: exchanges, then best fit by falling length."""
    held = child >= 0
    child[held] = np.unique(child[held], return_inverse=True)[1]
    left = (room - np.bincount(child[held], weights=lengths[held])).astype(np.int64).tolist() if held.any() else []
    out = exchange(child, lengths, room, np.flatnonzero(~held), left, rng)
    return best_fit(out[np.argsort(-lengths[out], kind="stable")], lengths, room, child, left)


def fills(of: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(of, weights=lengths, minlength=int(of.max()) + 1 if len(of) else 0)


def fitness(of: np.ndarray, lengths: np.ndarray, room: int) -> float:
    """Fewer bins first, then bins that are either full or empty."""
    f = fills(of, lengths) / room
    return -float((f > 0).sum()) + float((f**2).mean() if len(f) else 0)


def crossover(mother: np.ndarray, father: np.ndarray, lengths: np.ndarray, room: int, rng) -> np.ndarray:
    """The mother's bins, after some well-filled bins of the father are put in whole: bins of hers that share an item
    with those are dissolved, and the items so displaced are placed by best fit."""
    f = fills(father, lengths)
    full = np.flatnonzero(f >= 0.98 * f.max())
    take = rng.choice(full, max(1, len(full) // 3), replace=False)
    new = np.isin(father, take)
    broken = np.zeros(int(mother.max()) + 1, bool)
    broken[mother[new]] = True
    lost = broken[mother] & ~new
    child = np.where(new, father + int(mother.max()) + 1, mother).astype(np.int32)
    child[lost] = -1
    return placed(child, lengths, room, rng)


def mutate(of: np.ndarray, lengths: np.ndarray, room: int, rng) -> np.ndarray:
    """Dissolves the emptiest bins and a few others and places their items anew."""
    f = fills(of, lengths)
    gone = np.union1d(np.argsort(f)[: max(1, len(f) // 50)], rng.integers(0, len(f), max(1, len(f) // 50)))
    child = of.copy()
    child[np.isin(of, gone)] = -1
    return placed(child, lengths, room, rng)


def evolve(people: list[np.ndarray], lengths: np.ndarray, room: int, rng, rounds: int, size: int) -> list[np.ndarray]:
    """Best first. Ends early when the best has as few bins as the sum of the lengths allows."""
    least = -(-int(lengths.sum()) // room)
    score = lambda of: fitness(of, lengths, room)
    people = sorted(people, key=score, reverse=True)
    for _ in range(rounds):
        if len(people) < 2 or int(people[0].max()) + 1 <= least:
            break
        a, b = sorted(rng.choice(len(people), 2, replace=False))
        child = crossover(people[a], people[b], lengths, room, rng)
        people = sorted([*people, child, mutate(child, lengths, room, rng)], key=score, reverse=True)[:size]
    return people


def settle(lengths: np.ndarray, room: int, rng, size: int) -> list[np.ndarray]:
    """A first population: best fit by falling length, then best fit of lengths that are shaken a little."""
    people = [best_fit(np.argsort(-lengths, kind="stable"), lengths, room)]
    if int(people[0].max()) + 1 > -(-int(lengths.sum()) // room):
        people += [best_fit(np.argsort(-lengths * rng.uniform(0.8, 1.2, len(lengths))), lengths, room) for _ in range(size - 1)]
    return people


WORK = 1 << 15  # items times rounds of an island, before and after its neighbour's elite comes


def rounds_for(items: int) -> int:
    """Rounds of an island: the same work a block, whatever its size; 8 for 4096 items, 400 at most."""
    return min(400, max(8, WORK // max(1, items)))


def pack(pieces: DataFrame, docs_hint: int, room: int = 2048, islands: int = 3, size: int = 4, rounds: int | None = None, block: int = 4096, seed: int = 7) -> DataFrame:
    """pieces with sequence_id and offset.

    A hash of (doc_id, piece) deals the pieces into blocks of about `block` documents' pieces, whatever their source;
    each block is a bin-packing problem of bounded size. Every block is solved on `islands` islands, each its own task
    and population; then each island's best solution moves to the next island of the ring, all evolve once more, and
    the best solution of a block counts. Blocks that best fit leaves one sequence above the least possible, as where all but
    0.03 % of the room is needed, may stay there: rounds are bounded by the work a block, not by the gap.
    Pieces of exactly `room` tokens are a sequence of their own. Repeated rows are packed as rows of their own, rows
    with null ids too; an empty table gives an empty result."""
    blocks = max(1, -(-docs_hint // block))
    items = pieces.withColumn("blk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    items = stored(items, "pieces")
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def start(key, frame: pd.DataFrame) -> pd.DataFrame:
        blk, isle = (int(x) for x in key)
        lengths = np.sort(frame["length"].to_numpy(np.int64))[::-1]
        rng = np.random.default_rng([seed, blk, isle])
        people = evolve(settle(lengths, room, rng, size), lengths, room, rng, rounds or rounds_for(len(lengths)), size)
        return pd.DataFrame({"blk": [blk], "isle": [isle], "lengths": [lengths.astype("<i4").tobytes()], "people": [[p.astype("<i4").tobytes() for p in people]]})

    def again(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, "<i4").astype(np.int64)
                people = [np.frombuffer(p, "<i4").astype(np.int32) for p in [*r.people, *([r.guest] if r.guest is not None else [])]]
                best = evolve(people, lengths, room, np.random.default_rng([seed, r.blk, r.isle, 1]), rounds or rounds_for(len(lengths)), size)[0]
                out.append((r.blk, r.isle, fitness(best, lengths, room), best.astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["blk", "isle", "fit", "best"])

    def place(key, table: pa.Table, best: pa.Table) -> pa.Table:
        # Arrow and not pandas, which would turn doc_ids beside a null into floats
        table = table.select(order).sort_by([(c, "ascending") for c in order])
        every = table["length"].to_numpy().astype(np.int64)
        whole = every >= room
        seq, offset = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        part = np.flatnonzero(~whole)
        bins = 0
        if len(part):
            lengths = every[part]
            by = np.argsort(-lengths, kind="stable")  # solutions list items by falling length
            of = np.frombuffer(best["best"][0].as_py(), "<i4")
            bins = int(of.max()) + 1
            rank = np.argsort(of, kind="stable")
            run = np.cumsum(lengths[by][rank]) - lengths[by][rank]
            first = np.r_[True, of[rank][1:] != of[rank][:-1]]
            run -= np.repeat(run[first], np.diff(np.r_[np.flatnonzero(first), len(rank)]))
            seq[part[by][rank]], offset[part[by][rank]] = of[rank], run
        seq[whole] = bins + np.arange(whole.sum())
        blk = key[0].as_py()
        return table.append_column("sequence_id", pa.array((blk << 32) + seq)).append_column("offset", pa.array(offset))

    isles = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    short = items.where(F.col("length") < room).select("blk", "length", isles.alias("isle"))
    first = stored(short.groupBy("blk", "isle").applyInPandas(start, "blk int, isle int, lengths binary, people array<binary>"), "islands")
    guests = first.select("blk", F.pmod(F.col("isle") + 1, F.lit(islands)).alias("isle"), F.col("people")[0].alias("guest"))
    second = first.join(guests, ["blk", "isle"], "left").mapInPandas(again, "blk int, isle int, fit double, best binary")
    best = second.groupBy("blk").agg(F.max_by("best", F.struct("fit", -F.col("isle"))).alias("best"))
    return items.groupBy("blk").cogroup(best.groupBy("blk")).applyInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, room: int = 2048, vocabulary: str | None = None, **more) -> DataFrame:
    """token_pieces, packed. docs needs doc_id and text; other columns are ignored. doc_ids are whole numbers; a text that is
    none is refused by the cast to long."""
    return pack(token_pieces(docs, room, vocabulary), docs.count(), room, **more)
