"""Alignment against a plain comparison of all token pairs' byte ranges."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import alignment, tokens

TEXTS = [None, "", "hello world", "Hello  world \n\n x", "naïve café 日本語 😀", "a<|endoftext|>b </s> <s> <0x41>", "▁under", "x" * 3000, "the of and " * 400, "1234 5,678.9!!", " lead", "trail ", "\0\t\r\x85\xa0", "hello world", "ingenious internationalization"]


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokens.default_vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    of = tokens.byte_of()
    found = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        ia, ib = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        ba = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(ba) != raw or b"".join(bb) != raw:
            found.append(None)
            continue
        spans = []
        for parts in (ba, bb):
            at, mine = 0, []
            for p in parts:
                mine.append((at, at + len(p)))
                at += len(p)
            spans.append(mine)
        pairs = [(ia[i], ib[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        both = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        text = ";".join(",".join(str(i) for i, x in zip(ia, spans[0], strict=True) if lo < x[1] <= hi) + "|" + ",".join(str(i) for i, y in zip(ib, spans[1], strict=True) if lo < y[1] <= hi) for lo, hi in zip([0, *both], both, strict=False))
        found.append((len(ia), len(ib), len(both), pairs, text))
    count = Counter(p for f in found if f for p in f[3])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], f[2], len(f[3]), sum(count[p] == top[p[1]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()) for f in found], [f and f[4] for f in found]


@pytest.mark.parametrize("chunk,part", [(1 << 21, 1 << 18), (50, 40)])
def test_equals_a_plain_comparison(spark, monkeypatch, chunk, part):
    monkeypatch.setattr(alignment, "PART", part)
    texts = TEXTS + [" ".join(f"word{i} of thing{i * i}" for i in range(150))]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("mine")).withColumn("chunk", F.lit(1)).repartition(3)
    want, text = plain(texts)
    got = sorted((repr(tuple(r)) for r in alignment.linked(df, chunk=chunk).collect()))
    assert got == sorted(repr((k, *w)) for (k, _), w in zip(rows, want, strict=True))
    told = sorted(repr(tuple(r)) for r in alignment.aligned(df).collect())
    assert told == sorted(repr((k, w[0], w[1], t or "")) for (k, _), w, t in zip(rows, want, text, strict=True))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.linked(none).count() == 0 and alignment.aligned(none).count() == 0


def test_labels_cut_groups():
    marks = alignment.labels(6, alignment.np.array([2, 3, 6]), alignment.np.array([3, 4, 5, 6]))
    assert alignment.groups(marks) == [(2, 1), (1, 3)]
    assert [(x >> 32, x & 0xFFFFFFFF) for x in alignment.links(marks, alignment.np.array([7, 8, 9]), alignment.np.array([1, 2, 3, 4])).tolist()] == [(7, 1), (8, 1), (9, 2), (9, 3), (9, 4)]


def test_a_cell_is_tokenised_once(monkeypatch):
    both, given = alignment.Pair(tokens.default_vocabulary(), alignment.default_pieces()), []
    ids = both.ids
    monkeypatch.setattr(both, "ids", lambda spaced: given.append(len(spaced)) or ids(spaced))
    cells, rng = alignment.Cells(both), random.Random(1)
    texts = [" ".join(rng.choices(["alignment", "token,", "été.", "a", "the", "(x)", "end.\nNew"], k=100)) for _ in range(50)]
    found = [cells.of(t) for t in texts]
    assert sum(given) < 200 < sum(map(len, texts))
    assert found[-1][4] == plain(texts[-1:])[1][0]


@pytest.mark.parametrize("kept", [1 << 27, 2000])
def test_cells_in_a_row_equal_the_whole(monkeypatch, kept):
    monkeypatch.setattr(alignment, "KEPT", kept)
    monkeypatch.setattr(alignment, "PART", 30)
    cells, rng = alignment.Cells(alignment.Pair(tokens.default_vocabulary(), alignment.default_pieces())), random.Random(2)
    some = [*" \n\t\x1c\xa0\u3000▁aé²½٣дª.,'_-(0<\0", "  ", "foo", "don't", "'s", "l'été", "12", "日本", "😀", "...", "</s>", "<|endoftext|>", "<0x41>", "tion"]
    texts = TEXTS + ["".join(rng.choices(some, k=rng.randint(1, 20))) for _ in range(1500)]
    want, told = plain(texts)
    for text, row, groups in zip(texts, want, told, strict=True):
        found = cells.of(text)
        assert (found is None) == (groups is None), text
        assert found is None or (found[:5] == (*row[:4], groups) and len(found[5]) == row[3]), text


def test_a_space_after_a_long_text_is_a_token(monkeypatch):
    monkeypatch.setattr(alignment, "PART", 40)
    both = alignment.Pair(tokens.default_vocabulary(), alignment.default_pieces())
    for n in range(36, 46):
        raw, a, b = both.of("x" * n + " ")
        assert raw == b" " + b"x" * n + b" " and both.size_a[a].sum() == both.size_b[b].sum() == n + 2
