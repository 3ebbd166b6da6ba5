"""Token ids in training order: a keyed permutation, and shards of fixed stride."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import long_rows, shared_path, stored, tidy
from .files import opened, replaced
from .tokens import default_vocabulary, ids_of

ROUNDS = 6
ROWS = 1000  # sequences that a task hands on at a time


def _stir(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


NARROW = 1 << 62  # ranges below it have places that fit in a long


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size), at the given places: a balanced Feistel network over the least even number of
    bits that holds size, walked again from whatever falls outside until it falls inside. From NARROW on, places are
    Python's integers in arrays of objects."""
    if not 0 < size <= 1 << 128:
        raise ValueError("size must be from 1 to 2^128")
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    if size < NARROW:
        index = np.asarray(index).astype(np.uint64)
        left, right = index >> shift, index & mask
    else:
        left = np.array([int(x) >> half for x in index], np.uint64)
        right = np.array([int(x) & int(mask) for x in index], np.uint64)
    last = np.uint64((size - 1) >> half), np.uint64((size - 1) & int(mask))
    walk = np.arange(len(left))
    while len(walk):
        x, y = left[walk], right[walk]
        for r in range(ROUNDS):
            x, y = y, x ^ (_stir(y, key * 1_000_003 + r) & mask)
        left[walk], right[walk] = x, y
        walk = walk[(x > last[0]) | ((x == last[0]) & (y > last[1]))]
    if size < NARROW:
        return ((left << shift) | right).astype(np.int64)
    out = np.empty(len(left), object)
    out[:] = [x << half | y for x, y in zip(left.tolist(), right.tolist(), strict=True)]
    return out


def write_shards(docs: DataFrame, path: str, stride: int = 512, key: int = 20_240_601, shards: int | None = None, vocabulary: str | None = None, id_bytes: int = 2, pad: int = 0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes `path`/shard-NNNNNN.bin and returns the index, a row a sequence: doc_id, piece, start, length, shard, place.

    A document is its ids and then id 0, cut into sequences of `stride` ids, the last one padded with `pad`; ids are
    little-endian of id_bytes. A sequence's number is (doc_id - the least doc_id) * the most pieces a document can have
    + piece; the keyed permutation maps that range onto itself, and the order of the images is the training order. A
    shard is an equal range of images, so sequences go to their shard without sampling or sorting the corpus as a
    whole; a task sorts a shard's rows and streams them out. A shard's file is written aside and put in place whole, so
    a task that is run again after a loss leaves the same file. Documents are tokenised once and shuffled once.

    A null text is an empty one (a sequence of the one id 0); a null doc_id is numbered before all others. Rows with
    equal doc_ids have equal numbers: all are kept, next to each other. An empty table writes no shard. Any whole numbers
    do as doc_ids (texts that aren't numbers are refused by the cast): a range of 2^62 numbers or more, as of hashes, has
    its places in 16 bytes instead of a long. An id that doesn't fit in id_bytes is refused."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    rest = long_rows(docs).select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    seen = rest.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.sum(F.octet_length("text"))).first()
    least, most = (seen[0] if seen[0] is not None else 0) - 1, seen[1] if seen[1] is not None else 0
    pieces = ((seen[2] or 0) + 1 + stride - 1) // stride  # an id stands for a byte at least
    size = (most - least + 1) * max(1, pieces)
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (seen[3] or 0) // (256 << 20) + 1)
    wide = -(-size // shards)
    kind, top = {2: ("<u2", 1 << 16), 4: ("<u4", 1 << 32)}[id_bytes]
    narrow = size < NARROW
    kept = np.int64 if narrow else object

    def cut(batches):
        import zstandard

        ids, squeeze = ids_of(vocabulary), zstandard.ZstdCompressor(level=1)

        def told(d, k, at, n, tie, data):
            number = np.array([(least if x is None else x) - least for x in d], kept) * pieces + np.array(k, kept)
            slot = permuted(number, size, key)
            place = pa.array(slot) if narrow else pa.array([x.to_bytes(16, "big") for x in slot], pa.binary())
            return pa.record_batch([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), place, pa.array((slot // wide).astype(np.int32)), pa.array(tie, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "piece", "start", "length", "slot", "shard", "tie", "data"])

        rows: list[tuple] = []
        for batch in batches:
            for d, t, tie in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(ids.encode(t.as_py()) + b"\0\0\0\0", "<u4")
                if id_bytes < 4 and int(data.max()) >= top:
                    raise ValueError(f"an id of {int(data.max())} doesn't fit in {id_bytes} bytes")
                data = data.astype(kind)
                for k, at in enumerate(range(0, len(data), stride)):
                    part = data[at : at + stride]
                    rows.append((d, k, at, len(part), tie, squeeze.compress(part)))
                    if len(rows) == ROWS:
                        yield told(*zip(*rows, strict=True))
                        rows = []
        if rows:
            yield told(*zip(*rows, strict=True))
        tidy()

    def write(batches):
        import zstandard

        plain, padding = zstandard.ZstdDecompressor(), np.full(stride, pad, kind).tobytes()
        shard, out, place = None, None, 0
        try:
            for batch in batches:
                places = []
                for s, data in zip(batch.column(5).to_pylist(), batch.column(7), strict=True):
                    if s != shard:
                        if out is not None:
                            out.done()
                        shard, out, place = s, replaced(f"{path}/shard-{s:06d}.bin"), 0
                    raw = plain.decompress(data.as_buffer(), max_output_size=stride * id_bytes)
                    out.write(raw + padding[len(raw) :])
                    places.append(place)
                    place += 1
                yield pa.record_batch([*batch.columns[:4], batch.column(5), pa.array(places, pa.int64())], ["doc_id", "piece", "start", "length", "shard", "place"])
            if out is not None:
                out.done()
                out = None
        finally:
            if out is not None:
                out.dropped()
        tidy()

    rows = rest.withColumn("tie", F.xxhash64("text")).mapInArrow(cut, "doc_id long, piece int, start long, length int, slot " + ("long" if narrow else "binary") + ", shard int, tie long, data binary")
    # a slot is one document's piece; the tie orders the texts of rows with equal doc_ids, so that a task that is run again leaves the same file
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot", "tie")
    return stored(dealt.mapInArrow(write, "doc_id long, piece int, start long, length int, shard int, place long"), "index")


def read_shard(path: str, shard: int, first: int, count: int, stride: int, id_bytes: int = 2) -> np.ndarray:
    """`count` sequences of a shard from place `first` on, one a row; a reader that was stopped goes on from any place."""
    with opened(f"{path}/shard-{shard:06d}.bin") as f:
        f.seek(first * stride * id_bytes)
        data = f.read(count * stride * id_bytes)
    return np.frombuffer(data, {2: "<u2", 4: "<u4"}[id_bytes]).reshape(-1, stride)


def slots(index: DataFrame) -> DataFrame:
    """The index with slot: the sequence's place in the whole training order, from 0 on without gaps."""
    sizes = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    # a row a shard
    base = sizes.select(F.col("shard").alias("s"), (F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return index.join(F.broadcast(base) if sizes.count() <= 100_000 else base, F.col("shard") == F.col("s")).withColumn("slot", F.col("base") + F.col("place")).drop("s", "base")


def read_back(index: DataFrame, path: str, stride: int = 512, id_bytes: int = 2) -> DataFrame:
    """The index with ids_crc32 of what the shards hold, read one after the other, by a task a shard."""
    fields = ["doc_id", "piece", "start", "length", "shard", "place", "slot"]

    def read(table: pa.Table) -> pa.Table:
        # Arrow and not pandas, which would turn doc_ids beside a null into floats
        table = table.select(fields).sort_by("place")
        shard, crc = table["shard"][0].as_py(), []
        for at in range(0, len(table), 4096):
            part = table.slice(at, 4096)
            data = read_shard(path, shard, part["place"][0].as_py(), len(part), stride, id_bytes).astype("<u4")
            crc += [zlib.crc32(row[:k].tobytes()) for row, k in zip(data, part["length"].to_pylist(), strict=True)]
        tidy()
        return table.append_column("ids_crc32", pa.array(crc, pa.int64()))

    return index.select(*fields).groupBy("shard").applyInArrow(read, "doc_id long, piece int, start long, length int, shard int, place long, slot long, ids_crc32 long")


def training_order(docs: DataFrame, stride: int = 512, **more) -> DataFrame:
    """Writes docs to shards in the shared folder, reads them back, and returns a row a sequence: doc_id, piece, start,
    length, slot, shard, offset (the byte at which it begins in its shard) and ids_crc32 as read."""
    path = shared_path(docs.sparkSession, "shards")
    back = read_back(slots(write_shards(docs, path, stride, **more)), path, stride, more.get("id_bytes", 2))
    return back.select("doc_id", "piece", "start", "length", "slot", "shard", (F.col("place") * stride * more.get("id_bytes", 2)).alias("offset"), "ids_crc32")
