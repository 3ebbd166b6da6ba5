"""Byte-pair encoding and decoding of whole texts: long ones in parts, joined by windows that grow until both sides agree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import long_rows, tidy
from .tokens import SPECIAL, byte_of, default_vocabulary, ids_of

LEAF = 1 << 15  # characters of a part that a task encodes at once
#: Between a letter or digit and a space the splitting pattern always splits, and no special token has such a place.
SAFE = regex.compile(r"(?<=[A-Za-z0-9])(?= )")
SAFE_BEFORE = regex.compile(r"(?r)(?<=[A-Za-z0-9])(?= )")
TEXT, SPLIT, TIGHT = 0, 1, 2  # kinds of leaves

_models: dict[str, tuple] = {}


def model_of(vocabulary: str) -> tuple:
    """(tokenizer, its model's ids of a string of shown bytes, the shown bytes of each id), once a worker."""
    if vocabulary not in _models:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        shown = [whole.id_to_token(i) for i in range(whole.get_vocab_size(with_added_tokens=True))]
        _models[vocabulary] = whole, lambda s, f=whole.model.tokenize: [t.id for t in f(s)], shown
    return _models[vocabulary]


def leaves(text: str, vocabulary: str, leaf: int = LEAF) -> Iterator[tuple[int, int, str]]:
    """(kind, run, part) of a text in order. TEXT: text between two safe places, encoded by itself. SPLIT: pieces as the
    library splits them, shown as bytes and separated by spaces, out of a stretch without a safe place. TIGHT: part of one
    piece that nothing splits, of over `leaf` bytes; it is halved until its parts are short enough, and all of one piece
    have the same run."""
    at, run = 0, 0
    while at < len(text):
        if len(text) - at <= leaf:
            yield TEXT, run, text[at:]
            return
        found = SAFE_BEFORE.search(text, at + 1, at + leaf) or SAFE.search(text, at + leaf)
        to = found.start() if found else len(text)
        if to - at <= 2 * leaf:
            yield TEXT, run, text[at:to]
        else:
            for kind, part in _unsafe(text[at:to], vocabulary, leaf):
                if kind == TIGHT:
                    run += 1
                    for x in halves(part, leaf):
                        yield TIGHT, run, x
                else:
                    yield kind, run, part
        at = to


def _unsafe(text: str, vocabulary: str, leaf: int) -> Iterator[tuple[int, str]]:
    """SPLIT leaves, whole TIGHT pieces, and special tokens as TEXT, of a stretch of text without a safe place."""
    split = model_of(vocabulary)[0].pre_tokenizer.pre_tokenize_str
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            yield TEXT, SPECIAL
        held, n = [], 0
        for piece, _ in split(part) if part else ():
            if len(piece) > leaf:
                if held:
                    yield SPLIT, " ".join(held)
                    held, n = [], 0
                yield TIGHT, piece
                continue
            held.append(piece)
            n += len(piece)
            if n >= leaf:
                yield SPLIT, " ".join(held)
                held, n = [], 0
        if held:
            yield SPLIT, " ".join(held)


def halves(piece: str, leaf: int) -> list[str]:
    if len(piece) <= leaf:
        return [piece]
    middle = len(piece) // 2
    return halves(piece[:middle], leaf) + halves(piece[middle:], leaf)


def joined(left: list[int], right: list[int], of: Callable[[str], list[int]], shown: list[str], window: int = 4) -> list[int]:
    """The ids of two parts' bytes in a row, from each part's own ids. The last `window` ids of the left and the first of
    the right are encoded anew together; if the new ids begin with the left's and end with the right's, all neighbours
    are such as the encoder leaves next to each other, which makes the whole the encoder's result, since in this
    vocabulary each token has one merge. If not, the window is doubled; at a part's end there is nothing to agree with."""
    if not left or not right:
        return left + right
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        new = of("".join([shown[t] for t in left[a:]] + [shown[t] for t in right[:b]]))
        if (a == 0 or new[0] == left[a]) and (b == len(right) or new[-1] == right[b - 1]):
            return left[:a] + new + right[b:]
        window *= 2


def tree(parts: list[list[int]], of: Callable[[str], list[int]], shown: list[str]) -> list[int]:
    """Joins neighbours, then neighbours of those, up to one list."""
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2], of, shown) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def leaf_ids(kind: int, part: str, vocabulary: str) -> np.ndarray:
    if kind == TEXT:
        return np.frombuffer(ids_of(vocabulary).encode(part), "<u4").astype(np.int32)
    of = model_of(vocabulary)[1]
    return np.array([i for p in (part.split(" ") if kind == SPLIT else [part]) for i in of(p)], np.int32)


def _list(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """keep's columns and ids (array<int>), equal to those of the `tokenizers` library without added special tokens, special
    tokens in the text counting as such.

    Texts of up to `leaf` characters are encoded where they are. Longer ones are cut into leaves that go to tasks of
    their own, are encoded in parallel, and come together a document: leaves that end where the pattern splits anyway
    follow each other; those of one piece that nothing splits are joined as a tree. A task holds one document's ids.

    A null text counts as empty: no ids. Repeated rows stay rows of their own, rows with null keys too. Columns of keep
    may be of any kind but may not be called ids; columns that aren't kept are ignored, whatever their names."""
    vocabulary = vocabulary or default_vocabulary()
    rest = long_rows(docs).select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    is_long = F.length("__text") > leaf
    kept = rest.select(*[f"`{c}`" for c in keep]).schema
    schema = StructType(list(kept.fields)).add("ids", ArrayType(IntegerType()))
    last = len(kept.fields)

    def whole(batches):
        of = ids_of(vocabulary)
        for batch in batches:
            rows = [np.frombuffer(of.encode(t.as_py()), "<u4").astype(np.int32) for t in batch.column(last)]
            yield pa.record_batch([*batch.columns[:last], _list(rows)], schema.names)
        tidy()

    def cut(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            for r in range(batch.num_rows):
                n += 1
                for k, (kind, run, part) in enumerate(leaves(batch.column(last)[r].as_py(), vocabulary, leaf)):
                    # a leaf but the first has no need of the row's columns; all carry them, so that none is nullable
                    yield pa.record_batch([*batch.slice(r, 1).columns[:last], *(pa.array([v], t) for v, t in ((n, pa.int64()), (k, pa.int32()), (kind, pa.int32()), (run, pa.int32()), (part, pa.string())))], [*kept.names, *own])
        tidy()

    own = ["__row", "__leaf", "__kind", "__run", "__part"]
    parts = StructType(list(kept.fields)).add(own[0], "long").add(own[1], IntegerType()).add(own[2], IntegerType()).add(own[3], IntegerType()).add(own[4], "string")
    coded = StructType([*parts.fields[:-1]]).add("ids", ArrayType(IntegerType()))

    def encoded(batches):
        for batch in batches:
            rows = [leaf_ids(k, p.as_py(), vocabulary) for k, p in zip(batch.column(last + 2).to_pylist(), batch.column(last + 4), strict=True)]
            yield pa.record_batch([*batch.columns[:-1], _list(rows)], coded.names)
        tidy()

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("__leaf")
        _, of, shown = model_of(vocabulary)
        out, tight, run = [], [], None
        for kind, r, ids in zip(table["__kind"].to_pylist(), table["__run"].to_pylist(), table["ids"], strict=True):
            ids = ids.values.to_numpy()
            if tight and (kind != TIGHT or r != run):
                out.append(np.array(tree(tight, of, shown), np.int32))
                tight = []
            if kind == TIGHT:
                tight.append(ids.tolist())
                run = r
            else:
                out.append(ids)
        if tight:
            out.append(np.array(tree(tight, of, shown), np.int32))
        tidy()
        return pa.table([*table.slice(0, 1).columns[:last], _list([np.concatenate(out)])], names=schema.names)

    short = rest.where(~is_long).mapInArrow(whole, schema)
    spread = rest.where(is_long).mapInArrow(cut, parts)
    spread = spread.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__row", "__leaf")
    return short.unionByName(spread.mapInArrow(encoded, coded).groupBy("__row").applyInArrow(together, schema))


def bytes_table(vocabulary: str) -> list[bytes]:
    """The bytes of each id."""
    of = byte_of()
    return [t.encode() if t == SPECIAL else bytes(of[c] for c in t) for t in model_of(vocabulary)[2]]


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """rows and the text of ids, special tokens kept as their strings, as the library decodes. What isn't UTF-8 becomes the
    replacement character; ids outside the vocabulary and nulls are passed over; null ids give null. A column called as
    out is replaced."""
    vocabulary = vocabulary or default_vocabulary()
    rows = rows.drop(*[c for c in rows.columns if c.lower() == out.lower() and c != ids])
    at = rows.columns.index(ids)
    schema = StructType(list(rows.schema.fields)).add(out, "string")

    def run(batches):
        table = bytes_table(vocabulary)
        for batch in batches:
            texts = [None if not x.is_valid else text_of(x.values, table) for x in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], schema.names)
        tidy()

    return rows.mapInArrow(run, schema)


def text_of(ids: pa.Array, table: list[bytes]) -> str:
    ids = ids.drop_null().to_numpy()
    if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
        ids = ids[(ids >= 0) & (ids < len(table))]
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def digest(docs: DataFrame, vocabulary: str | None = None, **more) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 of every document: encoded, and
    decoded again from those ids."""
    vocabulary = vocabulary or default_vocabulary()
    back = encode(docs.withColumn("doc_id", F.col("doc_id").cast("long")), vocabulary=vocabulary, **more)
    back = decode(back, vocabulary=vocabulary)

    def run(batches):
        shown = [str(i) for i in range(len(model_of(vocabulary)[2]))]
        for batch in batches:
            n, one, two = [], [], []
            for ids, text in zip(batch.column(1), batch.column(2), strict=True):
                ids, h = ids.values.to_numpy(), hashlib.sha256()
                for at in range(0, len(ids), LEAF):
                    h.update(("," * (at > 0) + ",".join(map(shown.__getitem__, ids[at : at + LEAF].tolist()))).encode())
                n.append(len(ids))
                one.append(h.hexdigest())
                two.append(hashlib.sha256(text.as_buffer()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    return back.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
