"""Language identification by error-correcting output codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucket, hash_share, long_rows, tidy

LETTER = regex.compile(r"\p{L}")  # by category: fractions, superscripts and marks are no letters
BITS = 15  # of a hashed n-gram
ORDERS = (2, 3, 4)


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of +1 and -1: all ways to part the languages in two for n up to 5, else about 10 log2 n random
    columns, the draw with the largest least distance between words of 40."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(40):
        words = rng.choice(np.array([-1, 1], np.int8), (n, width))
        far = (words[:, None, :] != words[None, :, :]).sum(2)[~np.eye(n, dtype=bool)].min()
        if far > most and (abs(words.sum(0)) < n).all():
            best, most = words, far
    return best if best is not None else words


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """A hashed n-gram for each place of data but the last order - 1."""
    x = data[: len(data) - order + 1].astype(np.uint32)
    for k in range(1, order):
        x = x * np.uint32(0x01000193) ^ data[k : len(data) - order + 1 + k]
    x = (x + np.uint32(order)) * np.uint32(0x9E3779B1)
    return x >> np.uint32(32 - BITS)


#: bytes of lower-case text; ASCII that is no letter becomes a space
PLAIN = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def folded(text: str) -> np.ndarray:
    return PLAIN[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b"   ", np.uint8)]


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): how often each hashed n-gram stands in the texts of a language; each task sums up first."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, l in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = folded(t.as_py())
                at = sums.setdefault(l, np.zeros(1 << BITS, np.int64))
                for o in ORDERS:
                    at += np.bincount(grams(data, o), minlength=1 << BITS)
        for l, at in sums.items():
            k = np.flatnonzero(at)
            yield pa.record_batch([pa.array([l] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(at[k])], ["lang", "gram", "n"])
        tidy()

    return docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """langs, words (a codeword each) and, for each bit, a binary classifier over hashed n-grams."""

    def __init__(self, langs: list[str], words: np.ndarray, weights: np.ndarray, scale: np.ndarray):
        self.langs, self.words, self.weights, self.scale = langs, words, weights, scale


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 4000, most_langs: int = 400) -> Model:
    """Learns from whole texts whose lang isn't null. per_lang bounds the sample: about that many rows of each language,
    chosen by a hash of the key, or all if there are fewer; and most_langs the languages learnt, the commonest ones.
    Counts of 2^15 n-grams a language come to the driver."""
    docs = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(most_langs).collect()}
    langs = sorted(sizes)
    keep = F.lit(False)
    for l in langs:
        keep = keep | ((F.col(lang) == l) & hash_share(F.coalesce(F.col(key).cast("string"), F.lit("")), per_lang / sizes[l]))
    words = codebook(len(langs))
    counts = np.zeros((len(langs), 1 << BITS))
    if langs:
        found = gram_counts(docs.where(keep), text, lang).toPandas()
        counts[found["lang"].map({l: i for i, l in enumerate(langs)}).to_numpy(), found["gram"].to_numpy()] = found["n"].to_numpy()
    rates = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    weights, scale = [], []
    for k in range(words.shape[1]):
        yes, no = rates[words[:, k] > 0], rates[words[:, k] < 0]
        w = np.clip(np.log(yes.mean(0) / no.mean(0)), -4, 4) if len(yes) and len(no) else np.zeros(1 << BITS)
        margins = rates @ w  # mean margin of each language's text
        middle = (margins[words[:, k] > 0].min() + margins[words[:, k] < 0].max()) / 2 if len(yes) and len(no) else 0.0
        w = w - middle
        weights.append(w)
        scale.append(max(1e-6, np.abs(margins - middle).mean()) if len(margins) else 1.0)
    return Model(langs, words, np.array(weights, np.float32).T.copy(), np.array(scale))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding. margins: a row a text, a column a bit, 1 being a typical margin. The loss of a language
    is the sum over bits of log(1 + exp(-3 margin * bit)), a bit counting as much as its classifier is sure. Returns the
    nearest codeword's place, its share of the summed exp(-loss), and the lead over the next nearest."""
    loss = np.logaddexp(0, -3 * margins[:, None, :] * model.words[None, :, :]).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    ranked = np.sort(p, 1)[:, ::-1]
    lead = ranked[:, 0] - ranked[:, 1] if p.shape[1] > 1 else ranked[:, 0]
    return loss.argmin(1), ranked[:, 0], lead


def margins_of(model: Model, texts: list[str]) -> np.ndarray:
    """The mean weight of each text's n-grams, over the classifier's typical margin; long texts in slices."""
    out = np.zeros((len(texts), model.weights.shape[1]))
    for i, t in enumerate(texts):
        data, total, n = folded(t), 0, 0
        for at in range(0, len(data) - 3, 1 << 16):
            part = data[at : at + (1 << 16) + 3]
            for o in ORDERS:
                g = grams(part, o)
                total = total + np.bincount(g, minlength=1 << BITS) @ model.weights if len(g) > 1 << 14 else total + model.weights[g].sum(0)
                n += len(g)
        out[i] = total / max(1, n) / model.scale
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", doubt: float = 0.2) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous (the lead over the next language is under `doubt`).

    A null text, or one without a letter, is `und` with score 0. With no learned language every text is `und`. Columns
    of docs with these names are replaced; others stay as they are. Equal texts get equal values; rows are neither
    dropped nor merged."""
    drop = [c for c in docs.columns if c.lower() in ("lang_pred", "score", "ambiguous")]
    docs = long_rows(docs).drop(*drop)
    at = docs.columns.index(text)
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            real = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if model.langs else []
            lang, score, doubtful = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if real:
                which, p, lead = decode(model, margins_of(model, [texts[i] for i in real]))
                for i, k in zip(real, which, strict=True):
                    lang[i] = model.langs[k]
                score[real], doubtful[real] = p, lead < doubt
            yield pa.record_batch([*batch.columns, pa.array(lang), pa.array(score), pa.array(doubtful)], names)
        tidy()

    return docs.mapInArrow(run, schema)


def held_out(key: Column | str = "doc_id") -> Column:
    return bucket(key, 5) == 0


def identify(docs: DataFrame) -> DataFrame:
    """Fits on rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score, ambiguous."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
