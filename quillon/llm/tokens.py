"""Exact token ids by the tokenizers library, with per-worker caches of the pieces that texts have in common.

A tokenizer file splits text into pieces before merging; a piece's ids do not depend on its neighbours.  Texts of
common characters are cut at white space, where every supported tokenizer splits, and a worker remembers the ids of
the pieces it has met.  Any other text goes to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

#: Words and white-space separated pieces remembered per worker; a full cache is emptied, which bounds its memory and
#: changes no result.
CACHE_WORDS, CACHE_PIECES = 800_000, 300_000

#: Printable ASCII, line ends and tab, Latin-1 letters: NFC already, and lower-cased character by character.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¿-ÖØ-öø-ÿ]*")
_WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """A bounded dictionary that computes what it misses and starts afresh when full."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.compute(key)
        return got


class WordEncoder:
    """Ids of a lower-casing BPE tokenizer that drops white space (word_bpe files)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = {b: ord(c) for b, c in byte_alphabet().items()}
        self.words = Remembered(self._word, CACHE_WORDS)
        self.pieces = Remembered(self._piece, CACHE_PIECES)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(".,;:!?|")
        if core.isalpha():  # a word, and perhaps one run of punctuation
            return self.words[core] + self.words[piece[len(core) :]] if len(core) < len(piece) else self.words[core]
        return b"".join([self.words[w] for w in _WORD_PIECES.findall(piece)])

    def encode(self, text: str) -> bytes:
        """The ids of one text, as little-endian unsigned 32-bit integers."""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


class ByteEncoder:
    """Ids of a byte-level BPE tokenizer (byte_bpe files); common text goes through the same merges as ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        back = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = sorted(special)
        self.ranks = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """The library's own, loaded when a text first needs it: most workers meet none and save its memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """The ids of one text, as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special) or not text.isprintable() and not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder | ByteEncoder:
    """The encoder of a tokenizer file, one per Python worker."""
    with open(path, encoding="utf-8") as f:
        head = json.load(f)
    return WordEncoder(path) if head["model"].get("end_of_word_suffix") else ByteEncoder(path)


def public_path(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
