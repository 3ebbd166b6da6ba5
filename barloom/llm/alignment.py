"""Alignment of two tokenizers' tokens: groups between shared ends, and how often ids are linked in the corpus."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import long_rows, stored, tidy
from .tokens import default_vocabulary, ids_of
from .tree_bpe import SAFE, bytes_table

PART = 1 << 18  # characters that are tokenised at a time
LINKS = 1 << 21  # of a chunk, or one text's
KEPT = 1 << 27  # bytes of cells that a worker keeps, about
CELL = 200  # of a cell without its characters and links
WORD, MARK = "A-Za-z0-9À-ÖØ-öø-ÿ", r"\n!-/:-@\[-`{-~"
#: A text's cells: it is cut before each space, unless white space or B's sign for a space is before that, and between a
#: space's word and a mark.
CELLS = re.compile(rf" [{WORD}]+(?=[ {MARK}]|\Z)|[ {MARK}][^ ]*(?:(?<=[\s▁]) [^ ]*)*")
#: A text's label string has a character a byte: . none, a and b the end of a token of A, of B, and | of both.
NAMES = np.frombuffer(b".ab|", np.uint8)
SPAN = re.compile(rb"[^|]*\|")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Two tokenizers: of(text) gives both id arrays, or None where either's bytes aren't space+text."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece

        self.a, self.b = ids_of(vocabulary), sentencepiece.SentencePieceProcessor(model_file=pieces)
        known = range(self.b.get_piece_size())
        self.bytes_a = bytes_table(vocabulary)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in known)]
        self.size_a, self.size_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        self.ids_most = max(len(self.bytes_a), len(self.bytes_b))
        whole = [self.b.id_to_piece(i) for i in known if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: No piece has a space after another character; none has a mark after a word's either.
        self.apart = not any("▁" in p.lstrip("▁") for p in whole)
        self.celled = self.apart and not any(re.search(f"[{WORD}][{MARK}]", p) for p in whole)
        self.named = [f"{sign}{i}" for sign in ";,|" for i in range(self.ids_most)]

    def parts(self, spaced: str) -> Iterator[str]:
        """space+text in parts, each with its space: long texts are cut between a letter or digit and a space, where both
        always end a token if `apart`: A splits there."""
        at = 0
        while at < len(spaced):
            found = SAFE.search(spaced, at + PART, len(spaced) - 1) if self.apart and len(spaced) - at > PART else None
            to = found.start() if found else len(spaced)
            yield spaced[at:to]
            at = to

    def ids(self, spaced: str) -> tuple[bytes, np.ndarray, np.ndarray] | None:
        """Both id arrays of space+text, or None; B puts the space there itself."""
        raw = spaced.encode()
        a, b = np.frombuffer(self.a.plain(spaced), "<u4").astype(np.int64), np.array(self.b.encode(spaced[1:], num_threads=1), np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return None
        return raw, a, b

    def of(self, text: str | None) -> tuple[bytes, np.ndarray, np.ndarray] | None:
        """Of a whole text, null or empty: None."""
        if not text:
            return None
        found = []
        for part in self.parts(" " + text):
            found.append(self.ids(part))
            if found[-1] is None:
                return None
        raw, a, b = zip(*found, strict=True)
        return b"".join(raw), np.concatenate(a), np.concatenate(b)


def labels(n: int, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each of n bytes 0, 1, 2 or 3: no token ends with it, one of A, of B, of both."""
    out = np.zeros(n, np.uint8)
    out[ends_a - 1] = 1
    out[ends_b - 1] += 2
    return out


class _Counts(dict):
    """Spans' counts; those of short spans, which come often, are kept."""

    def __missing__(self, span: bytes) -> tuple[int, int]:
        found = span.count(b"a") + 1, span.count(b"b") + 1
        if len(span) <= 32 and len(self) < 1 << 16:
            self[span] = found
        return found


COUNTS = _Counts()


def groups(marks: np.ndarray) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) of each group: spans of the label string up to each shared end, and their labels' counts."""
    return list(map(COUNTS.__getitem__, SPAN.findall(NAMES[marks].tobytes())))


def order(spans: list[tuple[int, int]], a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The ids in the order in which groups are written, A's of a group before B's, as places in Pair.named: `size` names
    with ; for the first of a group, as many with , and with | for the first of B."""
    out = np.empty(len(a) + len(b), np.int64)
    ends_a, ends_b = np.array(spans, np.int64).cumsum(0).T
    first_a, first_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    coded_a, coded_b = a + size, b + size
    coded_a[first_a] -= size
    coded_b[first_b] += size
    out[np.arange(len(a)) + np.repeat(first_b, ends_a - first_a)] = coded_a
    out[np.arange(len(b)) + np.repeat(ends_a, ends_b - first_b)] = coded_b
    return out


def links(marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The id pairs of all overlapping tokens, A's id in the upper half: from each end to the next, one token of A and one
    of B lie over the bytes between."""
    ends = marks[marks > 0]
    in_a, in_b = (ends & 1).astype(np.int64), (ends >> 1).astype(np.int64)
    return a[np.cumsum(in_a) - in_a] << 32 | b[np.cumsum(in_b) - in_b]


class Cells:
    """Texts by their cells, each tokenised and aligned once while it is kept: of(text) gives n_a, n_b, n_groups, n_links, the
    groups as text and the links, or None where either's bytes aren't space+text.

    Cells (about words, and marks) are cut where A's pattern splits and no piece of B goes on, so both always end a token
    there, what a cell has does not depend on its neighbours, and a text has what its cells have in a row. New cells of a
    part are tokenised together; a text with a cell whose bytes differ is tokenised as a whole."""

    def __init__(self, both: Pair):
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bad: set[int] = set()
        self.shown: list[str] = []
        self.counts = array("q")  # n_a, n_b, n_groups, n_links of each
        self.starts = array("q")  # in links
        self.links = array("q")
        self.room = KEPT

    def of(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray] | None:
        if not text:
            return None
        if not self.both.celled or "▁" in text:  # which B shows as a space
            return self._whole(text)
        counts, told, pairs = np.zeros(4, np.int64), [], []
        for part in self.both.parts(" " + text):
            cells = CELLS.findall(part)
            if new := set(cells).difference(self.number):
                if self.room < 0:
                    self.clear()
                    new = set(cells)
                self._add(new, cells[-1])
            at = list(map(self.number.__getitem__, cells))
            if not self.bad.isdisjoint(at):
                return self._whole(text)
            told += map(self.shown.__getitem__, at)
            at = np.array(at, np.int64)
            mine = np.frombuffer(self.counts, np.int64).reshape(-1, 4)[at]
            counts += mine.sum(0)
            ends = mine[:, 3].cumsum()
            from_ = np.frombuffer(self.starts, np.int64)[at] - ends + mine[:, 3]
            pairs.append(np.frombuffer(self.links, np.int64)[np.repeat(from_, mine[:, 3]) + np.arange(ends[-1])])
        return *counts.tolist(), "".join(told)[1:], np.concatenate(pairs)

    def _whole(self, text: str) -> tuple[int, int, int, int, str, np.ndarray] | None:
        found = self.both.of(text)
        if found is None:
            return None
        raw, a, b = found
        marks = labels(len(raw), self.both.size_a[a].cumsum(), self.both.size_b[b].cumsum())
        spans, pairs = groups(marks), links(marks, a, b)
        return len(a), len(b), len(spans), len(pairs), "".join(self._names(spans, a, b))[1:], pairs

    def _names(self, spans: list[tuple[int, int]], a: np.ndarray, b: np.ndarray) -> list[str]:
        return list(map(self.both.named.__getitem__, order(spans, a, b, self.both.ids_most).tolist()))

    def _add(self, new: set[str], last: str) -> None:
        """A part's last cell may end with white space, so it stays last. What B can't be given alone comes after a word:
        a cell without a space, and a space with nothing, which B would take for no text."""
        cells, rest = [], []
        for c in new - {last}:
            if c[0] == " ":
                cells.append(c)
            else:
                rest += [" a", c]
        cells += rest + (self._placed(last) if last in new else [])
        if not self._together(cells):
            for c in new:
                if not self._together(self._placed(c)):
                    self._keep([c], [""], np.zeros((1, 4), np.int64), np.zeros(0, np.int64))
                    self.bad.add(self.number[c])

    def _placed(self, cell: str) -> list[str]:
        return [cell] if cell[0] == " " and cell != " " else [" a", cell]

    def _together(self, cells: list[str]) -> bool:
        spaced = "".join(cells)
        found = self.both.ids(spaced)
        if found is None:
            return False
        raw, a, b = found
        marks = labels(len(raw), self.both.size_a[a].cumsum(), self.both.size_b[b].cumsum())
        last = np.cumsum([len(c) for c in cells] if len(raw) == len(spaced) else [len(c.encode()) for c in cells]) - 1
        if not (marks[last] == 3).all():
            return False
        sums = np.stack([np.cumsum(x, dtype=np.int64)[last] for x in (marks & 1, marks >> 1, marks == 3, marks > 0)], 1)
        names, ends = self._names(groups(marks), a, b), (sums[:, 0] + sums[:, 1]).tolist()
        told = ["".join(names[x:y]) for x, y in zip([0, *ends], ends, strict=False)]
        self._keep(cells, told, np.diff(sums, axis=0, prepend=0), links(marks, a, b))
        return True

    def _keep(self, cells: list[str], told: list[str], counts: np.ndarray, pairs: np.ndarray) -> None:
        self.number.update(zip(cells, range(len(self.shown), len(self.shown) + len(cells)), strict=True))
        self.shown += told
        self.starts.frombytes((len(self.links) + counts[:, 3].cumsum() - counts[:, 3]).tobytes())
        self.counts.frombytes(counts.tobytes())
        self.links.frombytes(pairs.tobytes())
        self.room -= sum(map(len, cells)) + sum(map(len, told)) + 8 * len(pairs) + CELL * len(cells)


_cells: dict[tuple[str, str], Cells] = {}


def cells_of(vocabulary: str, pieces: str) -> Cells:
    """One Cells a Python worker and pair, kept between tasks."""
    if (vocabulary, pieces) not in _cells:
        _cells[vocabulary, pieces] = Cells(Pair(vocabulary, pieces))
    return _cells[vocabulary, pieces]


def aligned(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b and groups (text: a1,a2|b1;a3|b2,b3) of each document; see linked() for what is defined."""
    vocabulary, pieces = vocabulary or default_vocabulary(), pieces or default_pieces()

    def run(batches):
        cells = cells_of(vocabulary, pieces)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = cells.of(text.as_py())
                rows.append((0, 0, "") if found is None else (found[0], found[1], found[4]))
            n, m, g = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(g, pa.string())], ["doc_id", "n_a", "n_b", "groups"])
        tidy()

    return _slim(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, groups string")


def _slim(docs: DataFrame) -> DataFrame:
    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def linked(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, chunk: int = LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    A encodes space+text, B text, which puts a space before it; both take special tokens' strings as plain text. Byte
    offsets where tokens of both end cut them into groups; overlapping tokens are links. An id pair's count is the number
    of links that have it in the whole corpus; n_best counts the links whose count is their B id's highest (ties
    included), count_sum adds up the links' counts.

    A text is tokenised by its cells (about its words), and a cell once while a worker keeps it. A task gathers texts up to `chunk` links, numbers the id pairs of that chunk, and stores
    each text's links as such numbers and the chunk's pairs with their counts, which are thereby added up before they are
    shuffled. A pair comes once a chunk at most, so no pair is hot; its total goes back to its chunks, and a chunk's texts
    and totals meet in one task. Nothing goes to the driver or into a broadcast.

    A text that is null, empty, or whose joined tokens of A or B differ from space+text has no tokens: zeros and ''.
    Repeated rows stay, and count, as rows of their own; rows with null ids too; other columns are ignored."""
    vocabulary, pieces = vocabulary or default_vocabulary(), pieces or default_pieces()
    names = [*(f.split()[0] for f in DOC.split(", ")), "chunk", "codes", "idx", "pair", "n"]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        cells, squeeze, at = cells_of(vocabulary, pieces), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: list[np.ndarray] = []

        def told(cols: dict, n: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in zip(names, kinds, strict=True)], names)

        def flushed():
            nonlocal rows, held, at
            codes, pairs = pd.factorize(np.concatenate(held))
            counts, codes = np.bincount(codes, minlength=len(pairs)), codes.astype("<i4")
            ends = np.cumsum([0, *map(len, held)]).tolist()
            data = [squeeze.compress(codes[x:y].tobytes()) for x, y in zip(ends, ends[1:], strict=False)]
            cols = dict(zip(names[:6], zip(*rows, strict=True), strict=True))
            for x in range(0, len(rows), 500):
                part = {k: v[x : x + 500] for k, v in (cols | {"codes": data}).items()}
                yield told(part | {"chunk": [at] * len(part["codes"])}, len(part["codes"]))
            for x in range(0, len(pairs), 1 << 16):
                y = min(len(pairs), x + (1 << 16))
                yield told({"chunk": np.full(y - x, at), "idx": np.arange(x, y, dtype=np.int32), "pair": pairs[x:y], "n": counts[x:y]}, y - x)
            rows, held, at = [], [], at + 1

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = cells.of(text.as_py())
                if found is None:
                    rows.append((doc, 0, 0, 0, 0, ""))
                    held.append(np.zeros(0, np.int64))
                    continue
                *counts, text, pairs = found
                rows.append((doc, *counts, hashlib.sha256(text.encode()).hexdigest()))
                held.append(pairs)
                size += len(pairs)
                if size >= chunk:
                    yield from flushed()
                    size = 0
        if rows:
            yield from flushed()
        tidy()

    one = stored(_slim(docs).mapInArrow(run, f"{DOC}, chunk long, codes binary, idx int, pair long, n long"), "links")
    texts = one.where("idx is null").select(*names[:8])
    pairs = one.where("idx is not null").select("chunk", "idx", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # a group has a row an id of A at most
    counts = counts.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy(b_id)))
    back = pairs.join(counts, "pair").select(F.col("chunk").alias("ck"), "idx", "total", "best")

    def scored(texts: pa.Table, back: pa.Table) -> pa.Table:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        idx = back["idx"].to_numpy()
        total, best = np.zeros(len(idx), np.int64), np.zeros(len(idx), bool)
        total[idx], best[idx] = back["total"].to_numpy(), back["best"].to_numpy()
        n_best, count_sum = [], []
        for n, data in zip(texts["n_links"].to_pylist(), texts["codes"], strict=True):
            codes = np.frombuffer(plain.decompress(data.as_buffer(), max_output_size=4 * n), "<i4") if n else np.zeros(0, np.int32)
            n_best.append(int(best[codes].sum()))
            count_sum.append(int(total[codes].sum()))
        tidy()
        return texts.select(names[:6]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    out = texts.groupBy("chunk").cogroup(back.groupBy("ck")).applyInArrow(scored, f"{DOC}, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
