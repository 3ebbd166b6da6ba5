"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, fresh, hot_join, long_rows, pair_blocks, stored, tidy

MULT = np.uint64(0x9E3779B97F4A7C15)
FEW = 1_000_000  # keys of candidate texts, of two numbers each, that are broadcast


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """How many bands of `rows` hashes find a pair at the threshold but for a chance of `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


class Hashes(dict):
    """64-bit hashes of words; grows up to a bound, then starts anew."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) >= 150_000:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h


_hashes = Hashes()


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's n-word grams: lower case, split at white space; a text of fewer words, but
    one at least, has one gram of all its words."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * MULT
        h ^= h >> np.uint64(29)
    return np.unique(h)


def digest_of(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(grams.tobytes())


def min_hashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """A row of `count` 32-bit minima for each set (none empty)."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count).astype(np.uint32)
    out = np.empty((len(sets), count), np.uint32)
    at = 0
    while at < len(sets):  # slices that stay in the processor's cache
        to, n = at, 0
        while to < len(sets) and (n == 0 or n + len(sets[to]) <= 1 << 15):
            n += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        v = np.empty_like(x)
        for k in range(count):
            np.multiply(x, a[k], out=v)
            np.add(v, b[k], out=v)
            out[at:to, k] = np.minimum.reduceat(v, starts)
        at = to
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band, different bands having different keys."""
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * MULT + np.zeros((len(minima), 1), np.uint64)
    for r in range(rows):
        h = (h ^ minima[:, r::rows][:, :bands]) * MULT
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def plausible(threshold: float, hashes: int, sure: float = 5.0) -> float:
    """The share of equal 8-bit minima below which a pair isn't at the threshold, but for a chance as of `sure` standard
    deviations (3e-7 for 5)."""
    return threshold - sure * math.sqrt(threshold * (1 - threshold) / hashes)


def sketch_links(sets: list, sketches: np.ndarray, least: float) -> list[tuple]:
    """Links that join what pairs with a share of equal minima of `least` join: each text is compared with those that
    none has reached yet."""
    out, left = [], np.arange(len(sets))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = (sketches[left] == sketches[i]).mean(1) >= least
            out += [(sets[i], sets[j]) for j in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return out


def shared_bands(bands: np.ndarray) -> np.ndarray:
    """A matrix that tells which two texts share a band key. bands: a row a text."""
    out = np.zeros((len(bands), len(bands)), bool)
    for k in range(bands.shape[1]):
        out |= bands[:, None, k] == bands[None, :, k]
    return out


def starred(links: DataFrame, node: str, other: str) -> DataFrame:
    """(a, b): links with the same components, none between nodes that a smaller one joins already: what a node is linked
    with is linked with the smallest of it instead. Near copies share most of their bands' roots, so where each has a link a
    band before, about one a text stays."""
    met = links.groupBy(F.col(node).alias("of")).agg(F.min(other).alias("least"), F.collect_set(other).alias("all"))
    ends = F.explode(F.array_union(F.array("of"), "all"))
    return met.select(ends.alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, rows: int = 6, miss: float = 1e-5, block: int = 1024) -> DataFrame:
    """key, class_id, n_links, kept: one row a row of docs.

    Two texts are linked when the Jaccard similarity of their n-gram sets is `threshold` or more. n_links counts the
    other rows linked directly, class_id is the smallest key that links reach (itself included) and kept marks the rows
    whose key is that one. Rows with equal sets are one class from the start and never expanded to pairs. Candidates
    share one of so many bands that a pair at the threshold is missed with a chance of `miss`; every candidate pair is
    compared on the full sets, and no other pair is.

    Candidates that chain meet in one group. A group of over `block` texts is first parted: its texts meet again by
    band, with their minima in 8 bits, and only pairs whose minima make the threshold plausible chain any longer. What
    still is larger meets in blocks (common.pair_blocks), so a large group of near copies is spread over many tasks that
    return counts and spanning links only. A band, or a group, that very many texts share costs no task all of its rows
    (common.hot_join). Texts are read once more for the candidates only.

    A null text, an empty one or one of white space has no n-grams and links with nothing. Rows with equal keys stay
    rows of their own. A null key counts as none when the smallest is chosen; a class of only such has a null class_id.
    Other columns of docs are ignored, whatever their names."""
    done = classified(docs, key, text, n, threshold, rows, miss, block)
    return done.select(F.col("id").alias(key), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def classified(docs: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, rows: int = 6, miss: float = 1e-5, block: int = 1024) -> DataFrame:
    """near_duplicates as id, tk (a hash of the text), class_id and n_links."""
    bands = bands_for(threshold, rows, miss)
    rest = long_rows(docs).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("tk", F.xxhash64("text"))
    id_type = rest.schema["id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sets = [ngram_set(t.as_py(), n) for t in part.column(1)]
                real = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                small: list = [None] * len(sets)
                if real:
                    minima = min_hashes([sets[i] for i in real], bands * rows)
                    for i, row, low in zip(real, band_keys(minima, bands, rows), (minima & np.uint32(255)).astype(np.uint8), strict=True):
                        keys[i], small[i] = row, low.tobytes()
                yield pa.record_batch([part.column(0), part.column(2), pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary())], ["id", "tk", "set", "bands", "sketch"])
        tidy()

    signed = stored(rest.mapInArrow(sign, f"id {id_type}, tk long, set binary, bands array<bigint>, sketch binary"), "signatures")
    # one row a class of equal sets; any of its texts stands for it
    classes = signed.where("set is not null").groupBy("set").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.min(F.struct("id", "tk")).alias("of"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    total = signed.count()
    classes = stored(classes, "classes", total)
    keyed = classes.select("set", F.explode("bands").alias("band"))
    shared = stored(keyed.groupBy("band").agg(F.min("set").alias("root"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "shared", total * bands // 2)
    linked = stored(hot_join(keyed, shared.select("band", "root"), "band", shared), "linked", total * bands // 2)
    near = components(starred(linked, "set", "root"))

    groups = stored(near.groupBy("comp").agg(F.count(F.lit(1)).alias("rows")), "groups", total)
    large = groups.where(F.col("rows") > block)
    if large.limit(1).count():
        inside = stored(hot_join(near, large.select("comp", F.lit(True).alias("large")), "comp", groups, "left"), "inside", total)
        again = linked.select("set", "band").join(inside.where("large").select(F.col("node").alias("set")), "set", "left_semi").join(classes.select("set", "sketch"), "set")

        def part(frame: pd.DataFrame) -> pd.DataFrame:
            out, least = [], plausible(threshold, bands * rows)
            for _, g in frame.groupby("gr", sort=False):
                out += sketch_links(g["set"].tolist(), np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1), least)
            tidy()
            return pd.DataFrame(out, columns=["a", "b"])

        close = stored(pair_blocks(stored(again, "again", total * bands // 2), "band", "set", max(1, block // 2), part, "a binary, b binary").distinct(), "close")
        near = inside.where("large is null").select("node", "comp").unionByName(components(starred(close, "b", "a")))

    nodes = classes.join(near, F.col("set") == F.col("node")).select("set", "size", "comp", "bands", F.col("of.id").alias("id"), F.col("of.tk").alias("tk"))
    nodes = stored(nodes, "nodes", total)
    whole = rest.select(F.col("id").alias("rid"), F.col("tk").alias("rtk"), "text")
    few = nodes.select(F.col("id").alias("wid"), F.col("tk").alias("wtk"))
    if few.count() <= FEW:
        whole = whole.join(F.broadcast(few), F.col("rid").eqNullSafe(F.col("wid")) & (F.col("rtk") == F.col("wtk")), "left_semi")
    whole = whole.dropDuplicates(["rid", "rtk"])
    texts = stored(nodes.join(whole, F.col("id").eqNullSafe(F.col("rid")) & (F.col("tk") == F.col("rtk"))).select("set", "size", "comp", "bands", "text"), "texts")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, g in frame.groupby("gr", sort=False):
            sets = [ngram_set(t, n) for t in g["text"]]
            by = np.argsort([len(s) for s in sets], kind="stable")
            sets = [sets[i] for i in by]
            names, size, side = g["set"].to_numpy()[by], g["size"].to_numpy()[by], g["side"].to_numpy()[by]
            may = shared_bands(np.stack(g["bands"].to_numpy()[by]))
            if side[0] != 2:
                may &= side[:, None] != side[None, :]
            count = np.array([len(s) for s in sets])
            flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
            ends = np.cumsum(count)
            starts = ends - count
            mark = np.zeros(int(flat.max()) + 1, bool)
            links, forest = np.zeros(len(sets), np.int64), Forest(len(sets))
            for i in range(len(sets) - 1):
                to = int(np.searchsorted(count, count[i] / threshold * (1 + 1e-9), "right"))
                other = np.flatnonzero(may[i, i + 1 : to]) + i + 1
                if not len(other):
                    continue
                mine = flat[starts[i] : ends[i]]
                mark[mine] = True
                if 4 * len(other) >= other[-1] - other[0]:  # so many that they are read as they lie
                    lo, hi = int(other[0]), int(other[-1]) + 1
                    both = np.add.reduceat(mark[flat[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)[other - lo]
                else:
                    both = np.array([np.count_nonzero(mark[flat[starts[j] : ends[j]]]) for j in other])
                mark[mine] = False
                for j in other[both >= threshold * (count[i] + count[other] - both) - 1e-9].tolist():
                    links[i] += size[j]
                    links[j] += size[i]
                    if forest.join(i, j):
                        out.append((names[i], names[j], 0))
            out += [(names[i], None, int(links[i])) for i in np.flatnonzero(links)]
        tidy()
        return pd.DataFrame(out, columns=["a", "b", "links"])

    found = stored(pair_blocks(texts, "comp", "set", block, compare, "a binary, b binary, links long"), "links")
    joined = components(found.where("b is not null"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of = classes.select("set", "size", "low").join(links, F.col("set") == F.col("a"), "left").join(joined, F.col("set") == F.col("node"), "left")
    of = stored(of.select("set", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "set").alias("comp"), "low"), "answers", total)
    least = of.groupBy("comp").agg(F.min("low").alias("class"), F.count(F.lit(1)).alias("rows"))
    of = hot_join(of.drop("low"), least.drop("rows"), "comp", least).select("set", "n_links", "class")
    done = hot_join(signed.select("id", "tk", "set"), of, "set", classes, "left", "size")
    return done.select("id", "tk", F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("class")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs with one row of each class of near_duplicates, the one with the smallest key. Rows that are equal in key and
    text become one. Texts without n-grams stay, and so do rows with a null key, which no class can be named after. Rows
    are shuffled once; only those whose key and text come more than once are compared in full."""
    k, h, times, own = fresh(docs, "kept_key", "kept_text", "kept_times", "own_text")
    kept = classified(docs, key, text, **more).where("id = class_id")
    kept = stored(kept.groupBy(F.col("id").alias(k), F.col("tk").alias(h)).agg(F.count(F.lit(1)).alias(times)), "kept")
    rows = docs.where(F.col(key).isNotNull()).withColumn(own, F.xxhash64(F.col(text).cast("string")))
    one = rows.join(kept, (F.col(key) == F.col(k)) & (F.col(own) == F.col(h)))
    if kept.where(F.col(times) > 1).limit(1).count():
        one = one.where(F.col(times) == 1).unionByName(one.where(F.col(times) > 1).dropDuplicates([key, text]))
    return one.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
