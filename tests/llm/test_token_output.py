import zlib

import numpy as np
import pytest

from barloom.llm import token_output as out
from barloom.llm import tokens
from barloom.llm.common import shared_path


def test_permutation_is_one_to_one():
    for size in (1, 2, 3, 10, 257, 5000):
        seen = out.permuted(np.arange(size), size, 42)
        assert sorted(seen.tolist()) == list(range(size))
    assert (out.permuted(np.arange(999), 999, 1) != out.permuted(np.arange(999), 999, 2)).any()
    assert abs(np.corrcoef(np.arange(5000), out.permuted(np.arange(5000), 5000, 9))[0, 1]) < 0.06
    with pytest.raises(ValueError):
        out.permuted(np.arange(1), 0, 1)


def test_shards_hold_every_sequence_once(spark):
    rows = [(i, f"document {i} " * (i % 40)) for i in range(120)] + [(500, None), (None, "no key"), (-7, "below zero"), (3, "twice"), (900, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard")
    path = shared_path(spark, "t")
    index = out.write_shards(df, path, stride=64, shards=5)
    got = out.slots(index).collect()
    ids = tokens.Ids(tokens.default_vocabulary())
    want = {}
    for k, t in rows:
        data = np.frombuffer(ids.encode(t) + b"\0\0\0\0", "<u4")
        for p in range(-(-len(data) // 64)):
            want.setdefault((k, p), []).append(data[p * 64 : p * 64 + 64].tolist())
    assert sorted(r.slot for r in got) == list(range(sum(map(len, want.values()))))
    for r in got:
        row = out.read_shard(path, r.shard, r.place, 1, 64)[0].tolist()
        assert row[: r.length] in want[r.doc_id, r.piece] and row[r.length :] == [0] * (64 - r.length)
    # a reader that goes on from any place reads the same
    n = sum(r.shard == 2 for r in got)
    whole = out.read_shard(path, 2, 0, n, 64)
    assert (out.read_shard(path, 2, n // 2, n - n // 2, 64) == whole[n // 2 :]).all()
    # the order depends on the key and the rows only
    again = out.slots(out.write_shards(df.repartition(7), shared_path(spark, "t"), stride=64, shards=5)).collect()
    order = lambda rs: [(r.doc_id, r.piece) for r in sorted(rs, key=lambda r: r.slot)]
    assert order(got) == order(again)
    crc = {(r.doc_id, r.piece, r.slot): r.ids_crc32 for r in out.read_back(out.slots(index), path, 64).collect()}
    for r in got:
        assert crc[r.doc_id, r.piece, r.slot] in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want[r.doc_id, r.piece]]


def test_empty_table(spark):
    assert out.training_order(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_permutation():
    # the same network whatever the places are kept in
    for size in (1000, 4097):
        narrow = out.permuted(np.arange(size), size, 5).tolist()
        limit, out.NARROW = out.NARROW, 1
        try:
            assert out.permuted(np.arange(size), size, 5).tolist() == narrow
        finally:
            out.NARROW = limit
    for size in (1 << 62, (1 << 63) + 12345, 3 << 90, 1 << 128):
        places = [*range(500), *range(size - 500, size), size // 2]
        got = out.permuted(np.array(places, object), size, 5).tolist()
        assert len(set(got)) == len(places) and all(0 <= x < size for x in got)


def test_sparse_keys(spark):
    keys = [-(1 << 63), (1 << 63) - 1, 0, None, 10**15, *(k * 0x9E3779B97F4A7C15 % (1 << 63) for k in range(1, 40))]
    df = spark.createDataFrame([(k, f"text {i} " * (1 + i * 7)) for i, k in enumerate(keys)], "doc_id long, text string")
    path = shared_path(spark, "t")
    index = out.write_shards(df, path, stride=64, shards=3)
    got = out.read_back(out.slots(index), path, 64).collect()
    ids = tokens.Ids(tokens.default_vocabulary())
    want = {}
    for i, k in enumerate(keys):
        data = np.frombuffer(ids.encode(f"text {i} " * (1 + i * 7)) + b"\0\0\0\0", "<u4")
        want |= {(k, p): zlib.crc32(data[p * 64 : p * 64 + 64].tobytes()) for p in range(-(-len(data) // 64))}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == want and len(got) == len(want)
    assert sorted(r.slot for r in got) == list(range(len(want))) and {r.shard for r in got} == {0, 1, 2}
    again = out.slots(out.write_shards(df.repartition(5), shared_path(spark, "t"), stride=64, shards=3)).collect()
    assert sorted((r.slot, r.doc_id or 0, r.piece) for r in got) == sorted((r.slot, r.doc_id or 0, r.piece) for r in again)
