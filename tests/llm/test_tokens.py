"""Token counts, the BPE codec and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict, deque

import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelshelf.llm import packing, token_counts
from reelshelf.llm.bpe import WordBpe, round_trip
from reelshelf.llm.encoder import Encoder, Memo

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CODEC, ENCODER = WordBpe(WORDS), Encoder(BYTES)
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
TEXTS = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "it's we'LL 'S", "x y z", "Straße İΣΣ é",
    "日本語 \U0001f642\U0001f642 กำ", "a<|endoftext|>b <|startoftext|> <|endoftext|", "a\x1cb\x85c\x0bd", "1234 56,7",
    "word " * 300, "w" * 3000, "́́ ́", "tab\tbed\r\nline", "½² ǅ", "  lead", "<|endoftext|>",
]
ALPHABET = st.text(st.sampled_from("ab'sS \n\t.,1éßİΣ日́ \x1c<|endoftext|>"), max_size=60)


def ids_of(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(ALPHABET | st.text(max_size=40))
def test_encoders_agree_with_the_library(text):
    packed = ENCODER.packed(text)
    assert list(struct.unpack(f"<{len(packed) // 2}H", packed)) == ids_of(BYTES, text)
    ids = ids_of(WORDS, text)
    decoded = LIBRARY[WORDS].decode(ids, skip_special_tokens=False)
    assert CODEC.encode(text) == (len(ids), " ".join(map(str, ids)), decoded)


def test_memo_forgets_and_long_keys_are_not_kept():
    memo = Memo(str.upper, limit=2)
    assert [memo[k] for k in "abcab"] == list("ABCAB") and len(memo) <= 2
    assert memo["x" * 99] == "X" * 99 and "x" * 99 not in memo


def rows(texts):
    return [*enumerate(texts), (7, None), (7, "twice"), (None, "no id")]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 256), (200, 80)])
def test_counts(documents, chunk, overlap):
    pairs = rows(TEXTS)
    got = token_counts.token_counts(documents(pairs), BYTES, limit=10, chunk=chunk, overlap=overlap).collect()
    want = []
    for i, t in pairs:
        n = len(ids_of(BYTES, t or ""))
        want.append((i, len((t or "").encode()), n, n > 10))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(documents([]), BYTES).count() == 0


def test_overlaps_widen_until_a_boundary_is_found(documents):
    # No unit starts within the first overlaps of the long runs.
    text = ("x" * 900 + " y") * 3 + "z" * 2000
    (row,) = token_counts.token_counts(documents([(1, text)]), BYTES, chunk=300, overlap=70).collect()
    assert row.n_tokens == len(ids_of(BYTES, text))


def test_round_trip_rows(documents):
    pairs = rows(TEXTS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in pairs:
        ids = ids_of(WORDS, t or "")
        decoded = LIBRARY[WORDS].decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    assert sorted(map(tuple, round_trip(documents(pairs), WORDS).collect()), key=str) == sorted(want, key=str)
    assert round_trip(documents([]), WORDS).count() == 0


def test_merges_skip_stale_entries():
    # Equal to merging the lowest rank first by brute force.
    symbols = [CODEC.ids[c] for c in "nananananaaa"] + [CODEC.ids["a</w>"]]
    plain = list(symbols)
    while True:
        found = [(CODEC.merges[p], k) for k, p in enumerate(zip(plain, plain[1:], strict=False)) if p in CODEC.merges]
        if not found:
            break
        (_, new), k = min(found, key=lambda f: (f[0][0], f[1]))
        plain[k : k + 2] = [new]
    assert CODEC.merge(symbols) == plain


def test_packing(spark, documents):
    texts = [f"document {i} " * (1 + i * 37 % 90) for i in range(150)]
    docs = documents(rows(texts)).withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 3 = 1 THEN 'b' END"))
    got = packing.pack(docs, BYTES, sequence=64, window=8).collect()
    ids = defaultdict(list)
    for i, t in rows(texts):
        ids[i].append([*ids_of(BYTES, t or ""), 1])
    places = defaultdict(list)
    for r in got:
        options = [zlib.crc32(struct.pack(f"<{r.length}I", *d[r.start : r.start + r.length])) for d in ids[r.doc_id] if len(d) == r.doc_tokens]
        assert r.ids_crc32 in options
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(d) for group in ids.values() for d in group)
    for number, pieces in places.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 64 or number == max(places)
    assert packing.pack(documents([]), BYTES).count() == 0


def test_windows_hold_the_mixture(spark):
    """Whatever was served to a source by any window is within a document of its share."""
    rows = [(k, k, "abc"[k % 3 % 2], 10 + k % 7) for k in range(3000)]
    docs = spark.createDataFrame(rows, "row long, doc_id long, source string, doc_tokens long")
    placed = packing.assign_windows(docs, window_tokens=500).collect()
    totals, served = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in placed:
        totals[r.source] += r.doc_tokens
        served[r.window][r.source] += r.doc_tokens
    done = defaultdict(int)
    for window in range(max(served)):
        for source, total in totals.items():
            done[source] += served[window][source]
            share = 500 * (window + 1) * total / sum(totals.values())
            assert share - 17 < done[source] <= share + 1e-6
    weighted = packing.assign_windows(docs, {"a": 0.9, "b": 0.1}, window_tokens=500).collect()
    last = {s: max(r.window for r in weighted if r.source == s) for s in "ab"}
    assert last["a"] < last["b"]


@pytest.mark.parametrize("mixture", [{"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 0.125, "b": 0.75, "c": 0.125}])
def test_rounds_are_those_of_a_plain_loop_over_queues(spark, mixture):
    rows = [(k, k, "aabc"[k * 7 % 4], 1 + k * 37 % 190) for k in range(400)]
    docs = spark.createDataFrame(rows, "row long, doc_id long, source string, doc_tokens long").repartition(5)
    placed = packing.assign_windows(docs, mixture, window_tokens=512, turns=4).collect()
    queues = {s: deque((k, n) for k, _, source, n in rows if source == s) for s in mixture}
    deficits, order, turn = dict.fromkeys(mixture, 0.0), [], 0
    while any(queues.values()):
        for source, queue in queues.items():
            deficits[source] += mixture[source] * 128
            while queue and queue[0][1] <= deficits[source]:
                number, size = queue.popleft()
                deficits[source] -= size
                order.append((turn // 4, turn % 4, source, number))
        turn += 1
    got = sorted(placed, key=lambda r: (r.window, r.turn, r.source, r.queue_before))
    assert [(r.window, r.turn, r.source, r.row) for r in got] == order


def test_targets_bind_and_sources_take_turns(spark, documents):
    """A source of a tenth of the tokens gets its tempered share until it runs dry, in every window's sequences."""
    docs = documents([(i, f"word {i} " * 8) for i in range(900)]).withColumn("source", F.expr("IF(doc_id % 10 = 0, 'small', 'large')"))
    got = packing.pack(docs, BYTES, sequence=64, window=32, temper=0.5).collect()
    tokens = defaultdict(lambda: defaultdict(int))
    for r in got:
        tokens[r.sequence_id // 32]["small" if r.doc_id % 10 == 0 else "large"] += r.length
    share = [w["small"] / sum(w.values()) for _, w in sorted(tokens.items())]
    # Tokens 1 to 9 have roots 1 to 3: a quarter of each window, for as long as the tokens last.
    lasts = int(sum(w["small"] for w in tokens.values()) / (0.25 * 32 * 64))
    assert lasts > 2 and all(abs(s - 0.25) < 0.05 for s in share[:lasts]) and share[-1] == 0, share
    both = defaultdict(set)
    for r in got:
        both[r.sequence_id].add(r.doc_id % 10 == 0)
    # A round is two sequences long, and a document of either source fits its credit for a round.
    assert all(len(both[2 * k] | both[2 * k + 1]) == 2 for k in range(16 * lasts))


def test_a_packing_worker_holds_little_beside_its_batch():
    """Documents are handed on a few at a time, with all their ids."""
    texts = [None if i % 7 == 0 else f"text {i} of é{i}" for i in range(1_203)]
    batch = pa.RecordBatch.from_pydict(
        {"row": list(range(1_203)), "doc_id": list(range(1_203)), "source": ["s"] * 1_203, "text": texts}
    )
    got = list(packing._encode(BYTES)(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in got) <= 500
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["row"] for r in rows] == list(range(1_203))
    for r, text in zip(rows, texts, strict=True):
        ids = [*ids_of(BYTES, text or ""), 1]
        assert r["doc_tokens"] == len(ids)
        assert zstandard.ZstdDecompressor().decompress(r["ids"]) == struct.pack(f"<{len(ids)}H", *ids)
