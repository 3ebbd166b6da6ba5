"""Media columns: payloads stored as lossless WebP images in a binary column, and features of their pixels."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import long_rows, tidy
from .webp import MOST_SIDE, decode, encode_grey

STEP = 192  # a payload's length is a positive multiple of this
PAD = 32


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (payload_length(len(data)) - len(data))


def width_of(n: int) -> int:
    """The width of the image of n samples: STEP, or so many times that as keep the height within the format's limit. Where
    no such width divides n, the least one is taken, and `filled` fills the last row of the image."""
    rows = n // STEP
    least = -(-rows // MOST_SIDE)
    times = next((t for t in range(least, MOST_SIDE // STEP + 1) if rows % t == 0), least)
    width = min(times * STEP, MOST_SIDE)
    if n > width * MOST_SIDE:
        raise ValueError("the payload doesn't fit in an image")
    return width


def filled(data: bytes, width: int) -> bytes:
    return data + bytes([PAD]) * (-len(data) % width)


def payload_length(n_bytes: int) -> int:
    """The length of the payload of a text of n_bytes; what an image holds beyond it fills its last row."""
    return max(1, -(-n_bytes // STEP)) * STEP


def feature(pixels: np.ndarray) -> str:
    """width x height; mean and standard deviation of the grey; entropy in bits; mean step between neighbours in a row,
    each with four places after the point."""
    counts = np.bincount(pixels.reshape(-1), minlength=256)
    p = counts[counts > 0] / pixels.size
    mean = float((counts * np.arange(256)).sum()) / pixels.size
    var = float((counts * (np.arange(256) - mean) ** 2).sum()) / pixels.size
    steps = np.abs(np.diff(pixels.astype(np.int16), axis=1)).mean() if pixels.shape[1] > 1 else 0.0
    return f"{pixels.shape[1]}x{pixels.shape[0]};{mean:.4f};{var**0.5:.4f};{abs(float(-(p * np.log2(p)).sum())):.4f};{steps:.4f}"


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media in place of the text: the payload of each whole text as a lossless WebP file, and n_bytes, the
    text's length in UTF-8. A null text is an empty one. Columns of docs with these names are replaced; rows are neither
    dropped nor merged; equal texts give equal files. Every text is stored as one image, whose pixels begin with the
    payload; the payload's length is payload_length(n_bytes). Only a text beyond the format's sides (over 2^28 bytes) is
    refused."""
    docs = long_rows(docs).drop(*[c for c in docs.columns if c.lower() in ("media", "n_bytes") and c != text])
    at = docs.columns.index(text)
    rest = [f for i, f in enumerate(docs.schema.fields) if i != at]
    schema = StructType(rest).add("media", "binary").add("n_bytes", "long")
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            media, size = [], []
            for t in batch.column(at):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                size.append(len(data))
                data = padded(data)
                width = width_of(len(data))
                media.append(encode_grey(np.frombuffer(filled(data, width), np.uint8), width))
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*cols, pa.array(media, pa.binary()), pa.array(size, pa.int64())], names)

    return docs.mapInArrow(run, StructType(list(schema.fields)))


def read_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows with pixels, width and height of each image: green samples, row after row; null for a null image. The first
    n_bytes of the pixels are the text, the first payload_length(n_bytes) its payload."""
    at = rows.columns.index(media)
    schema = StructType(list(rows.schema.fields)).add("pixels", "binary").add("width", "integer").add("height", "integer")
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            images = [None if m is None else decode(m)[..., 2] for m in batch.column(at).to_pylist()]
            cols = [pa.array([None if x is None else x.tobytes() for x in images], pa.binary()), pa.array([None if x is None else x.shape[1] for x in images], pa.int32()), pa.array([None if x is None else x.shape[0] for x in images], pa.int32())]
            yield pa.record_batch([*batch.columns, *cols], names)

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; all but n_bytes and
    the media columns come from the pixels that were read back, the feature from those of the whole image."""
    stored = to_media(docs.select("doc_id", F.col("text").cast("string").alias("text")))

    def run(batches):
        for batch in batches:
            doc, media, size = batch.columns
            rows = []
            for m, n in zip(media, size, strict=True):
                m = m.as_py()
                pixels = decode(m)[..., 2]
                data = pixels.tobytes()[: payload_length(n.as_py())]
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([doc, size, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media", "n_bytes").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
