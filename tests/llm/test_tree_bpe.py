"""Tree concatenation against the library on whole texts."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import tokens, tree_bpe


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.default_vocabulary()


@pytest.fixture(scope="module")
def whole(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def some(rnd, n):
    kinds = [
        lambda: "".join(rnd.choice("abcdeiorstn") for _ in range(n)), lambda: "a" * n, lambda: "=-" * (n // 2), lambda: " " * n,
        lambda: "".join(chr(rnd.randrange(0x4E00, 0x4E40)) for _ in range(n)), lambda: "0123456789" * (n // 10), lambda: "\n" * n,
        lambda: "".join(rnd.choice(["the", "ing", "of", " a", "<|endoftext|>", "'s", "é", "😀", "　", ".", "7"]) for _ in range(n // 3)),
        lambda: " ".join("".join(rnd.choice("etaoin") for _ in range(rnd.randrange(1, 9))) for _ in range(n // 5)),
        lambda: "<|endoftext|>" * (n // 13), lambda: "x<|endoftext|>" * 2 + "y" * n, lambda: "ab " * (n // 3) + "c" * n + " d" * n,
    ]
    return rnd.choice(kinds)()


@pytest.mark.parametrize("seed", range(40))
def test_windows_agree_with_the_library(vocabulary, whole, seed):
    rnd = random.Random(seed)
    _, of, shown = tree_bpe.model_of(vocabulary)
    text = "".join(some(rnd, rnd.choice([30, 200, 900])) for _ in range(4))
    leaf = rnd.choice([8, 17, 64])
    got, tight, run = [], [], None
    for kind, r, part in [*tree_bpe.leaves(text, vocabulary, leaf), (-1, -1, "")]:
        if tight and (kind != tree_bpe.TIGHT or r != run):
            got += tree_bpe.tree(tight, of, shown)
            tight = []
        if kind == tree_bpe.TIGHT:
            run = r
            tight.append(tree_bpe.leaf_ids(kind, part, vocabulary).tolist())
        elif kind >= 0:
            got += tree_bpe.leaf_ids(kind, part, vocabulary).tolist()
    assert got == whole.encode(text, add_special_tokens=False).ids


def test_windows_stay_short_where_they_can(vocabulary):
    _, of, shown = tree_bpe.model_of(vocabulary)
    rnd, seen = random.Random(1), []
    word = "".join(rnd.choice("etaoinshrdlu") for _ in range(20_000))
    def counted(s):  # noqa: E306
        seen.append(len(s))
        return of(s)
    assert tree_bpe.joined(of(word[:9001]), of(word[9001:]), counted, shown) == of(word) and max(seen) < 200


def test_documents_as_the_library(spark, whole, vocabulary):
    rnd = random.Random(4)
    texts = [None, "", "hello  world\n", "q" * 100_000, "日本" * 60_000, "word " * 30_000, "a<|endoftext|>b" * 9000, *[some(rnd, 70_000) for _ in range(8)]]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] * 2  # repeated rows and null keys
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(2))
    got = sorted(map(repr, (tuple(r) for r in tree_bpe.digest(df, leaf=5000).collect())))
    def want(k, t):  # noqa: E306
        ids = whole.encode(t or "", add_special_tokens=False).ids
        back = whole.decode(ids, skip_special_tokens=False)
        return repr((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want(k, t) for k, t in rows)
    assert tree_bpe.digest(df.limit(0)).count() == 0


def test_decoding_of_any_ids(spark, whole):
    rows = [([15496, 995],), ([162, 220],), ([50256, 447],), ([],), (None,), ([99999, -1, 40],)]
    df = spark.createDataFrame(rows, "ids array<int>").withColumn("decoded", F.lit("mine"))
    got = {None if r.ids is None else tuple(r.ids): r.decoded for r in tree_bpe.decode(df).collect()}
    for ids, in rows[:4]:
        assert got[tuple(ids)] == whole.decode(ids, skip_special_tokens=False)
    assert got[None] is None and got[99999, -1, 40] == "I"
    assert tree_bpe.text_of(pa.array([40, None], pa.int32()), tree_bpe.bytes_table(tokens.default_vocabulary())) == "I"
