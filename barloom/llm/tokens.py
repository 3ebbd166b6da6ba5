"""Token ids of a byte-level BPE vocabulary file."""

from __future__ import annotations

import json
import re
from array import array

#: The vocabulary's special token, and the pattern by which it splits text before it merges bytes.
SPECIAL = "<|endoftext|>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text in which no two white characters meet: without a look ahead, which takes most of the time.
SPLIT_SINGLE = SPLIT.replace(r"\s+(?!\S)|\s+", r"\s")
RUN = re.compile(r"\s\s")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of() -> dict[str, int]:
    """Vocabulary files show bytes as characters: printable ones as themselves, the rest from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """encode(text): the text's ids as little-endian unsigned 32-bit bytes, equal to those of the `tokenizers` library.

    What isn't Latin-1, or holds the special token's text, goes to `tokenizers`; the rest to `tiktoken`, by the pattern
    that suffices for it."""

    def __init__(self, vocabulary: str):
        import tiktoken

        self.vocabulary, self._whole, self._literal = vocabulary, None, None
        of = byte_of()
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(of[c] for c in word): i for word, i in vocab.items() if word != SPECIAL}
        self.single, self.ordinary = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (SPLIT_SINGLE, SPLIT))

    def whole(self, text: str) -> list[int]:
        """Ids by `tokenizers`, which is loaded when it is first needed."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.vocabulary)
        return self._whole.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> bytes:
        """The same with the special token's string taken as plain text."""
        if text.isascii() or _latin(text):
            return array("I", (self.ordinary if RUN.search(text) else self.single)(text)).tobytes()
        if self._literal is None:
            from tokenizers import Tokenizer

            self._literal = Tokenizer.from_file(self.vocabulary)
            self._literal.encode_special_tokens = True
        return array("I", self._literal.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL not in text and (text.isascii() or _latin(text)):
            return array("I", (self.ordinary if RUN.search(text) else self.single)(text)).tobytes()
        return array("I", self.whole(text)).tobytes()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_loaded: dict[str, Ids] = {}


def ids_of(vocabulary: str) -> Ids:
    """One Ids a Python worker and vocabulary, kept between tasks."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Ids(vocabulary)
    return _loaded[vocabulary]
