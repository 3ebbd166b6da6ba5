"""Near-duplicate vectors by randomised-rotation binary codes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, hot_join, pair_blocks, stored, tidy

CODE = 192  # bits of a code at least


def unit_of(v: np.ndarray) -> np.ndarray:
    x = v / np.abs(v).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@lru_cache(32)
def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def turns(dim: int) -> int:
    """How many rotations a vector is coded by: codes of short vectors are made of several, up to CODE bits in all."""
    return max(1, -(-CODE // dim))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors (rows): the signs of the rotated vectors, packed to bits, and the correction factor, which is the
    inner product of the rotated vector with its own code, taken as a unit vector."""
    y = unit @ turn.T
    return np.packbits(y > 0, axis=1), np.abs(y).sum(1) / np.sqrt(unit.shape[1])


def estimates(bits: np.ndarray, factor: np.ndarray, rotated: np.ndarray, dim: int) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) with rotated unit vectors (columns)."""
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    return (signs @ rotated.T.astype(np.float32)) / (np.sqrt(dim) * factor[:, None]).astype(np.float32)


def bound(factor: np.ndarray, dim: int, sure: float) -> np.ndarray:
    """What an estimate is off by at most, but for a chance that falls as exp(-sure^2 / 2)."""
    return sure * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / np.sqrt(max(1, dim - 1))


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (rows) in whole numbers of a byte, and the length of each vector's step."""
    step = np.maximum(np.abs(unit).max(1) / 127, 1e-300)
    return np.rint(unit / step[:, None]).astype(np.int8), step


class Codes:
    """What stands for vectors until a pair needs exact work: for each rotation bits and correction factors, and the
    vector itself rounded to bytes, as the other side of estimates.

    The mean of the rotations' unbiased estimates, plus what rounding takes at most, is one inner product of a row for the
    coded side (signs over factors, rotation after rotation, and a last entry for rounding) and one for the other side
    (the rotated vector, as often, and its step); the rows are made once, and so is the least product, `need`, that a
    coded vector's confidence bound asks for."""

    def __init__(self, bits: np.ndarray, factor: np.ndarray, small: np.ndarray, step: np.ndarray, threshold: float, sure: float):
        dim, n = small.shape[1], factor.shape[1]
        wide, unit = -(-dim // 8), small.astype(np.float32) * step[:, None].astype(np.float32)
        self.coded, self.other = (np.empty((len(step), n * dim + 1), np.float32) for _ in range(2))
        off = 0.0
        for k in range(n):
            at = slice(k * dim, (k + 1) * dim)
            signs = np.unpackbits(bits[:, k * wide : (k + 1) * wide], axis=1, count=dim).astype(np.float32) * 2 - 1
            self.coded[:, at] = signs / (n * np.sqrt(dim) * factor[:, k, None]).astype(np.float32)
            self.other[:, at] = unit @ rotation(dim, 3 + k).T.astype(np.float32)
            off = off + bound(factor[:, k], dim, sure) ** 2
        # a rounded vector lies within half a step of each coordinate, and a code estimates by a vector of length 1 / factor
        self.coded[:, -1], self.other[:, -1] = np.sqrt(dim) / 2 / factor.min(1), step
        self.need = (threshold - np.sqrt(off) / n - 1e-5).astype(np.float32)[:, None]

    def may(self, rows: slice, cols: slice) -> np.ndarray:
        """Which pairs of rows and columns reach the threshold, as far as estimates and their bounds, which fall with the
        root of the rotations' number, can tell."""
        return self.coded[rows] @ self.other[cols].T >= self.need[rows]


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, sure: float = 6.0, block: int = 1024) -> DataFrame:
    """key, n_links, component_id, kept: one row a row of vectors.

    Two vectors are linked when their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is `threshold` or more. Equal vectors of a label are one class and are never expanded to pairs. Each class
    is coded once: bits of its rotated vector and a correction factor, for so many rotations as make CODE bits, and the
    vector rounded to bytes. Within a label, blocks of at most `block` classes meet in tasks of their own
    (common.pair_blocks), which get codes only and tell which vectors have a partner whose estimated cosine plus
    confidence bound reaches the threshold. Only those vectors then go whole to the task of their two blocks, where the
    pairs that the bound leaves open are computed exactly. Tasks return counts and spanning links only. The work within
    one label grows with the square of its distinct vectors, as all of them are compared; at `sure` = 6 the chance to
    miss a link is about 1e-8.

    Vectors that are null, empty, all zero or hold a null, NaN or infinite component link with nothing, nor does a null
    label. Rows with equal keys stay rows of their own; null keys are passed over when the smallest is chosen. Other
    columns are ignored, whatever their names."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    # a text of the vector would be long: a hash stands for it, and equal vectors are told by the whole of both
    rows = vectors.select(F.col(key).alias("id"), F.when(F.coalesce(fine, F.lit(False)), F.xxhash64(F.col(label).cast("string"), v)).alias("h"), F.col(label).cast("string").alias("label"), v.alias("v"))
    # h is all but sure to be unique; a second hash makes it so for any number of rows that can be
    node = F.concat_ws(":", F.col("h").cast("string"), F.hash("label", "v").cast("string"))
    rows = stored(rows.withColumn("node", F.when(F.col("h").isNotNull(), node)), "vectors")
    classes = rows.where("h is not null").groupBy("node", "label", "v").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"))

    def code(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy()
            for dim in np.unique(lengths):
                # the columns stay Arrow's, as pandas would turn whole numbers with nulls into floats
                g = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                v = g.column("v").flatten().to_numpy().reshape(-1, dim)
                unit = unit_of(v)
                coded = [codes(unit, rotation(dim, 3 + k)) for k in range(turns(dim))]
                small, step = rounded(unit)
                group = pa.array([f"{dim}:{a}" for a in g.column("label").to_pylist()], pa.string())
                many = lambda x: pa.array([a.tobytes() for a in x], pa.binary())
                yield pa.record_batch([group, g.column("node"), g.column("size"), g.column("low"), many(np.hstack([b for b, _ in coded])), many(np.stack([f for _, f in coded], 1)), many(small), pa.array(step), many(v)], ["group", "node", "size", "low", "bits", "factor", "small", "step", "data"])
        tidy()

    low_type = rows.schema["id"].dataType.simpleString()
    coded = classes.select("node", "label", "v", "size", "low").mapInArrow(code, f"group string, node string, size long, low {low_type}, bits binary, factor binary, small binary, step double, data binary")
    coded = stored(coded, "codes")

    def codes_of(g: pd.DataFrame) -> Codes:
        whole = lambda c, kind: np.frombuffer(b"".join(g[c]), kind).reshape(len(g), -1)
        return Codes(whole("bits", np.uint8), whole("factor", np.float64), whole("small", np.int8), g["step"].to_numpy(), threshold, sure)

    def blocks(g: pd.DataFrame):
        """(first row, first column, which pairs may reach the threshold), some rows at a time. g: by side."""
        c, inside = codes_of(g), g["side"].iloc[0] == 2
        cut = len(g) if inside else int((g["side"] == 0).sum())
        for at in range(0, cut, 512):
            to = min(cut, at + 512)
            first = at if inside else cut
            if first < len(g):
                may = c.may(slice(at, to), slice(first, len(g)))
                yield at, first, np.triu(may, 1) if inside else may

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for gr, g in frame.groupby("gr", sort=False):
            g = g.sort_values("side", kind="stable")
            found = np.zeros(len(g), bool)
            for at, first, may in blocks(g):
                found[at : at + len(may)] |= may.any(1)
                found[first:] |= may.any(0)
            g = g[found]
            out.append(pd.DataFrame({"many": g["many"], "job": g["job"], "gr": gr, "side": g["side"], "me": g["node"]}))
        tidy()
        return pd.concat(out, ignore_index=True)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, g in frame.groupby("gr", sort=False):
            g = g.sort_values("side", kind="stable")
            unit = unit_of(np.frombuffer(b"".join(g["data"]), np.float64).reshape(len(g), -1))
            names, size = g["me"].to_numpy(), g["size"].to_numpy()
            links, forest = np.zeros(len(g), np.int64), Forest(len(g))
            for at, first, may in blocks(g):
                i, j = np.nonzero(may)
                for k in range(0, len(i), 1 << 16):
                    a, b = i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)] + first
                    hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                    a, b = a[hit], b[hit]
                    np.add.at(links, a, size[b])
                    np.add.at(links, b, size[a])
                    out += [(names[p], names[q], 0) for p, q in zip(a.tolist(), b.tolist(), strict=True) if forest.join(p, q)]
            out += [(names[p], None, int(links[p])) for p in np.flatnonzero(links)]
        tidy()
        return pd.DataFrame(out, columns=["a", "b", "links"])

    lean = coded.select("group", "node", "bits", "factor", "small", "step")
    open_ = stored(pair_blocks(lean, "group", "node", block, look, "many boolean, job long, gr string, side int, me string"), "open")
    whole = open_.join(coded.drop("low", "group"), F.col("me") == F.col("node")).drop("node")
    found = stored(whole.groupBy("many", "job").applyInPandas(compare, "a string, b string, links long"), "links")
    joined = components(found.where("b is not null"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of = coded.select(F.col("node").alias("me"), "size", "low").join(links, F.col("me") == F.col("a"), "left").join(joined, F.col("me") == F.col("node"), "left")
    of = stored(of.select("me", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "me").alias("comp"), "low"), "answers", coded.count())
    least = of.groupBy("comp").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    of = hot_join(of.select("me", "n_links", "comp"), least.drop("rows"), "comp", least).select(F.col("me").alias("node"), "n_links", "component_id")
    done = hot_join(rows.select("id", "node"), of, "node", coded.select("node", "size"), "left", "size")
    done = done.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return done.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
