"""Ids of whole texts under a byte-level BPE vocabulary, by way of short pieces.

The vocabulary's pattern starts a new unit at every single space or line break
between two visible characters, whatever stands around it, and merges never cross
units. So a text may be cut there and its pieces encoded apart; a worker remembers
the ids of pieces it has met. Texts with other white space (leading, trailing or
doubled) are cut only where this holds.

Pieces whose characters all lie below U+0250, where the Unicode tables of both
libraries agree, are encoded with the rank file of the same vocabulary, which is
quicker for single words; all others go to the tokenizers library.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import regex

MEMO = 400_000  # pieces remembered by one worker
MEMO_CHARS = 40  # longer pieces are not remembered
_SAFE = regex.compile(r"(?<=\S)(?= \S)")


class Unsafe(Exception):
    """The text has white space at which it can't be cut."""


class Memo(dict):
    """Remembers ``make(key)`` for the latest ``limit`` or more keys."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes whole texts to packed little-endian ids of ``width`` bytes each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = self._ranks(os.path.splitext(path)[0] + ".tiktoken")
        self.first, self.rest = Memo(self._first, 50_000), Memo(self._rest)

    @staticmethod
    def _ranks(path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def pack(self, ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(self.width, "little") for i in ids)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, text: str) -> bytes:
        if self.ranks and (text.isascii() or max(text) < "ɐ") and not any(s in text for s in self.specials):
            return self.pack(self.ranks.encode_ordinary(text))
        return self.pack(self.library([text])[0])

    def _first(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Unsafe
        return self._piece(piece)

    def _rest(self, piece: str) -> bytes:
        inner = piece.removeprefix("\n")
        if not inner or inner[0].isspace() or inner[-1].isspace():
            raise Unsafe
        return self._piece(piece if inner != piece else " " + piece)

    def packed(self, text: str) -> bytes:
        """Ids of the whole text."""
        pieces = text.replace("\n", " \n").split(" ")
        try:
            return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))
        except Unsafe:
            return b"".join(map(self.pack, self.library(list(self._blocks(text)))))

    @staticmethod
    def _blocks(text: str, size: int = 1 << 15):
        """Cuts of the text at safe spaces, of ``size`` characters where possible."""
        start = 0
        while start < len(text):
            found = _SAFE.search(text, start + size)
            end = found.start() if found else len(text)
            yield text[start:end]
            start = end


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def release() -> None:
    """Let go of what this worker remembers; a worker outlives the stage that needed it."""
    encoder.cache_clear()
