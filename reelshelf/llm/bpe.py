"""BPE encoding and decoding by a priority queue of merge ranks.

The symbols of a word form a doubly linked list. Adjacent pairs wait in a heap by
(rank, position); an entry whose symbols have changed since is stale and skipped.
Decoding looks the ids up in the vocabulary and joins the strings.

The vocabulary (``word_bpe_49k.json``) asks for: special strings cut out of the raw
text first, canonical composition, lower case character by character, words by
pattern, bytes as printable characters, and an end-of-word mark. It has no decoder,
so decoded tokens are joined by spaces.

Defined results: a null text is empty, has no tokens, and decodes to the empty
text. Rows that repeat are each returned. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from reelshelf.llm.common import read_table
from reelshelf.llm.encoder import Memo

# Below this character all Unicode tables agree; texts beyond it are normalised and
# cut into words by the library, whose tables may be older or newer than Python's.
LATIN_END = "ɐ"
SPACE = r"\p{White_Space}"
# Not white space to the vocabulary's pattern, but to str.split().
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """Printable character of each byte: itself where printable, else the next beyond U+00FF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.library = Tokenizer.from_file(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.bytes = byte_characters()
        self.word = Memo(self._word)
        self.piece = Memo(self._piece)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge adjacent symbols, lowest rank first, leftmost among equals."""
        size, merges = len(symbols), self.merges
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        queue = []
        for at in range(size - 1):
            if found := merges.get((symbols[at], symbols[at + 1])):
                queue.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, new = heapq.heappop(queue)
            gone = after[at]
            if symbols[at] != left or gone >= size or symbols[gone] != right:
                continue  # stale
            symbols[at], symbols[gone] = new, -1
            after[at] = following = after[gone]
            if following < size:
                before[following] = at
                if found := merges.get((new, symbols[following])):
                    heapq.heappush(queue, (found[0], at, new, symbols[following], found[1]))
            if (ahead := before[at]) >= 0 and (found := merges.get((symbols[ahead], new))):
                heapq.heappush(queue, (found[0], ahead, symbols[ahead], new, found[1]))
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> list[int]:
        letters = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.end
        # A symbol outside the vocabulary has no id and is left out.
        return self.merge([i for i in map(self.ids.get, letters) if i is not None])

    def _piece(self, piece: str) -> tuple[int, str, str]:
        if piece.isascii() or max(piece) < LATIN_END:
            words = self.words.findall(piece)
        else:
            words = [piece[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        ids = [i for word in words for i in self.word[word]]
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def _pieces(self, text: str) -> list[tuple[int, str, str]]:
        if text.isascii():
            text = text.lower()
        elif max(text) < LATIN_END:
            text = unicodedata.normalize("NFC", text).lower()
        else:
            text = self.library.normalizer.normalize_str(text)
        split = regex.split(f"{SPACE}+", text) if _ODD_SPACE.search(text) else text.split()
        return list(map(self.piece.__getitem__, split))

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and the decoded text."""
        if any(s in text for s in self.special):
            found = []
            for part in self.cut.split(text):
                i = self.special.get(part)
                found += [(1, str(i), part)] if i is not None else self._pieces(part)
        else:
            found = self._pieces(text)
        if not all(n for n, _, _ in found):
            found = [f for f in found if f[0]]
        if not found:
            return 0, "", ""
        counts, ids, tokens = zip(*found, strict=True)
        return sum(counts), " ".join(ids), " ".join(tokens)


@cache
def word_bpe(path: str) -> WordBpe:
    """One codec for each Python worker."""
    return WordBpe(path)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_bpe(path)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, ids, decoded = codec.encode(text.as_py() or "")
                rows.append((n, _sha256(ids), _sha256(decoded)))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return docs.select("doc_id", "text").mapInArrow(
        _round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
