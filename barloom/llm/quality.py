"""Quality by compression: dictionaries of good and of bad text."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucket, fresh, hash_share, long_rows, tidy

PART = 128  # bytes that are compressed at a time, so that a text's own history doesn't drown the dictionary
LEARNT = 256  # bytes of the parts of text that dictionaries are built from
LEVEL = 3


class Model:
    """Two dictionaries, the calibration's weights (of 1 and the difference) and the share of good labels."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, prior: float):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def score(self, text: str | None) -> float:
        if not self.good or not (text or "").strip():
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * difference(text, self.good, self.bad), -30, 30))))


_compressors: dict[tuple[bytes, bytes], tuple] = {}


def _pair(good: bytes, bad: bytes) -> tuple:
    import zstandard as z

    if (good, bad) not in _compressors:
        _compressors.clear()
        _compressors[good, bad] = tuple(z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_AUTO), write_content_size=False, write_dict_id=False).compress for d in (good, bad))
    return _compressors[good, bad]


def difference(text: str, good: bytes, bad: bytes) -> float:
    """Bytes that the parts of the whole text take with the dictionary of bad text, less those with that of good text, a
    byte of the text. Positive: nearer to good text."""
    data = text.encode("utf-8", "replace")
    g, b = _pair(good, bad)
    parts = [data[at : at + PART] for at in range(0, len(data), PART)]
    return (sum(map(len, map(b, parts))) - sum(map(len, map(g, parts)))) / len(data)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 80) -> np.ndarray:
    """Weights of 1 and x by Newton's method. The ridge on the slope of the standardised x keeps it bounded where few
    texts of a class can be parted without error."""
    m, s = x.mean(), max(float(x.std()), 1e-9)
    z = np.c_[np.ones(len(x)), (x - m) / s]
    w, r = np.zeros(2), ridge * np.diag([1e-3, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + r + 1e-6 * np.eye(2), z.T @ (y - p) - r @ w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return np.array([w[0] - w[1] * m / s, w[1] / s])


def dictionary(texts: list[str], size: int) -> bytes:
    """A zstandard dictionary of about `size` bytes; what is too little to train on serves as a raw one."""
    import zstandard as z

    parts = [d[a : a + LEARNT] for d in (t.encode("utf-8", "replace") for t in texts) for a in range(0, len(d), LEARNT)]
    try:
        return z.train_dictionary(size, parts).as_bytes()
    except (z.ZstdError, ValueError):
        return b"".join(parts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, size: int = 262_144, most_bytes: int = 32 << 20, key: str = "doc_id") -> Model:
    """per_class and most_bytes bound the sample that comes to the driver: about that many labelled documents of each
    class, chosen by a hash of the key, or all if there are fewer, and of these, in an order by hash, as many as have
    that many bytes in all. Half of them make the dictionaries, the other half calibrates; priors are those of all
    labelled rows. A document labelled twice counts once, as the worse of its labels; null labels don't count."""
    spark = docs.sparkSession
    marks = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"))
    counted = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    n = {q: counted.get(q, 0) for q in (0, 1)}
    if not n[0] or not n[1]:
        return Model(b"", b"", np.zeros(2), 1.0 if n[1] else 0.0 if n[0] else 0.5)
    keep = F.lit(False)
    for q in (0, 1):
        keep = keep | ((F.col("quality") == q) & hash_share(F.col(key).cast("string"), per_class / n[q]))
    chosen = marks.where(keep).limit(4 * per_class).collect()  # the bound holds by the hash; this makes it sure
    schema = f"{key} {dict(marks.dtypes)[key]}, quality int"
    rows = docs.select(key, "text").where("text is not null")

    def of(keys: list) -> DataFrame:
        return rows.join(F.broadcast(spark.createDataFrame(keys, schema)), key)

    sizes = of([(r[0], int(r[1])) for r in chosen]).groupBy(key, "quality").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    taken, left = [], {0: most_bytes, 1: most_bytes}
    for r in sorted(sizes, key=lambda r: (zlib.crc32(f"{r[0]}".encode()), str(r[0]))):
        if r["n"] <= left[r["quality"]]:
            left[r["quality"]] -= r["n"]
            taken.append((r[0], r["quality"]))
    texts: dict[int, list[str]] = {0: [], 1: []}
    for r in of(taken).orderBy(key, "text").collect() if taken else []:
        texts[r["quality"]].append(r["text"])
    if min(map(len, texts.values())) < 2:
        return Model(b"", b"", np.zeros(2), n[1] / (n[0] + n[1]))
    good, bad = dictionary(texts[1][::2], size), dictionary(texts[0][::2], size)
    rest = [(t, q) for q in (0, 1) for t in texts[q][1::2] if t.strip()]
    y = np.array([q for _, q in rest], float)
    weights = _logistic(np.array([difference(t, good, bad) for t, _ in rest]), y) if rest else np.zeros(2)
    # the sample's share of good text isn't that of all labelled rows
    weights[0] += np.log(n[1] / n[0]) - np.log(max(1, y.sum()) / max(1, (1 - y).sum()))
    return Model(good, bad, weights, n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1, how likely label 1 is) and predicted (1 if score >= threshold, else 0), or as `into` names them.

    Null texts and those of white space only get the share of good rows among the labelled. Columns of docs with these
    names are replaced. Equal texts get equal scores; no row is dropped or merged."""
    docs = long_rows(docs).drop(*[c for c in docs.columns if c.lower() in into])
    at = docs.columns.index(text)
    schema = StructType(list(docs.schema.fields)).add(into[0], "double").add(into[1], "integer")
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            p = np.array([model.score(t.as_py()) for t in batch.column(at)], float)
            yield pa.record_batch([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names)
        tidy()

    return docs.mapInArrow(run, schema)


def held_out(key: Column | str = "doc_id") -> Column:
    return bucket(key, 4) == 2


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on labels that aren't held out and scores all: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that a model of the labels doesn't reject, with their columns; those without a text stay."""
    names = tuple(fresh(docs, "q_score", "q_predicted"))
    found = score(docs, fit(docs, labels), text, threshold, names)
    return found.where((F.col(names[1]) == 1) | F.col(text).isNull() | (F.trim(text) == "")).select(*docs.columns)
