"""Toxicity scores by a weighted lexicon.

Texts are folded before matching: compatibility forms and accents go, lookalikes
from other scripts become the Latin letter, and digits and signs that stand in for
letters inside a word become that letter. The lexicon holds folded words, and
beginnings of words, matched by one Aho-Corasick automaton at word starts. Matches
inside an exception phrase don't count. The weights that are found are summed and
normalised by the length of the text, on a logarithmic scale; a logistic curve
gives the score.

Lexicon, exceptions and curve are learned from at most ``PER_CLASS`` labelled
documents of each class: an entry is in many more toxic documents than clean ones,
and in more than chance explains; it is judged by its own counts, so the words of a
rare language stay however many other toxic documents there are. It weighs the
logarithm of the ratio of its shares; an exception is an entry with its
neighbour, found in clean documents only.

Defined results: null and empty texts score zero, and without labelled rows of both
classes every text does. Rows that repeat are each scored. Only the id and text of
a document are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.common import held_out, read_table
from reelshelf.llm.features import labelled_sample

PER_CLASS = 3000  # labelled documents of each class that the lexicon is learned from
THRESHOLD = 0.3
ENTRIES = 2000  # of the lexicon
LEAST_DOCS = 3  # toxic documents that hold an entry
CHANCE = 0.0003  # that a word without a bias is in so many toxic documents; best of five in cross-validation
LEAST_RATIO = 12.0  # of its shares among toxic and clean documents
STEMS = (4, 5, 6)  # letters of beginnings of words
EXCEPTION_DOCS = 3  # clean documents that hold an exception phrase

# Letters of other scripts that look like a Latin one.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ι": "i", "κ": "k", "ν": "v", "τ": "t",
    "η": "n", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ɪ": "i", "ѵ": "v", "ո": "n", "օ": "o",
}
# Digits and signs that stand in for a letter.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
# "1" and "|" stand for i and for l, so both letters are folded to one.
_LETTERS = str.maketrans(LOOKALIKES | {"l": "i"})
_SIGNS = str.maketrans(STAND_INS)
_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­]")
_STAND_IN = re.compile(r"[\d@$!|]+")
# Letters, digits and signs in a row.
_RUN = re.compile(r"(?:[^\W_]|[@$!|])+")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Text as the lexicon sees it."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _undisguised(text).lower().translate(_LETTERS)


def _undisguised(text: str) -> str:
    """Text with the stand-ins of each run that has a letter; signs behind the last letter or digit stay.

    Runs are found from their stand-ins, each is read once, so the time is linear.
    """
    out, done = [], 0
    for hit in _STAND_IN.finditer(text):
        start = hit.start()
        if start < done:
            continue
        while start > done and text[start - 1].isalnum():
            start -= 1
        run = _RUN.match(text, start)[0]
        word = run.rstrip("@$!|")
        if _LETTER.search(word):
            out += text[done:start], word.translate(_SIGNS), run[len(word) :]
        else:
            out += text[done:start], run
        done = start + len(run)
    return "".join(out) + text[done:]


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


class Lexicon:
    """Entries (word or stem, weight), exception phrases and the curve of the score."""

    def __init__(
        self,
        whole: dict[str, float],
        stems: dict[str, float],
        exceptions: list[str] = (),
        curve: tuple[float, float, float] = (-2.0, 1.0, -0.5),
    ):
        self.whole, self.stems, self.exceptions, self.curve = whole, stems, list(exceptions), curve

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for word, weight in self.whole.items():
            entries.setdefault(word, [0.0, 0.0, False])[0] = weight
        for stem, weight in self.stems.items():
            entries.setdefault(stem, [0.0, 0.0, False])[1] = weight
        for phrase in self.exceptions:
            entries.setdefault(phrase, [0.0, 0.0, False])[2] = True
        for text, (word, stem, phrase) in entries.items():
            found.add_word(text, (len(text), word, stem, phrase))
        if entries:
            found.make_automaton()
        return found

    def weight(self, text: str) -> tuple[float, int]:
        """Sum of the weights found, one for each word, and the length in words."""
        folded = fold(text)
        length = folded.count(" ") + folded.count("\n") + 1
        machine = self.automaton
        if not len(machine):
            return 0.0, length
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        size = len(folded)
        for last, (count, word, stem, phrase) in machine.iter(folded):
            first = last - count + 1
            if first and folded[first - 1].isalnum():
                continue
            ends = last + 1 == size or not folded[last + 1].isalnum()
            if phrase and ends:
                spared.append((first, last))
            value = max(word if ends else 0.0, stem)
            if value > best.get(first, 0.0):
                best[first] = value
        spared.sort()
        total, reach, phrases = 0.0, -1, iter([*spared, (size, size)])
        first, last = next(phrases)
        for at in sorted(best):
            while first <= at:
                reach = max(reach, last)
                first, last = next(phrases)
            if at > reach:
                total += best[at]
        return total, length

    def score(self, text: str) -> float:
        found, length = self.weight(text)
        if not found:
            return 0.0
        start, by_weight, by_length = self.curve
        z = start + by_weight * np.log1p(found) + by_length * np.log1p(length)
        return float(1 / (1 + np.exp(-z)))


def _candidates(tokens: list[str]) -> set[tuple[int, str]]:
    """(stem length or 0, text) of every word, and the beginnings of the longer ones."""
    own = set(tokens)
    return {(0, w) for w in own} | {(n, w[:n]) for w in own for n in STEMS if len(w) > n}


def _curve(found: np.ndarray, length: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on weight and length of documents with a match, by Newton steps."""
    x = np.stack([np.ones(len(found)), np.log1p(found), np.log1p(length)], axis=1)
    beta = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (labels - p) - 0.1 * beta
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), slope)
    return tuple(map(float, beta))


def _chance(toxic: int, clean: int, share: float) -> float:
    """Probability that of all documents with a word ``toxic`` or more are toxic, at the toxic ``share`` of documents."""
    n = toxic + clean
    term = exp(
        lgamma(n + 1) - lgamma(toxic + 1) - lgamma(clean + 1) + toxic * log(share) + clean * log1p(-share)
    )
    total = 0.0
    for k in range(toxic, n + 1):
        total += term
        term *= (n - k) / (k + 1) * share / (1 - share)
    return total


def learn(texts: list[str], labels: list[int], chance: float = CHANCE) -> Lexicon:
    """Lexicon of the folded words and stems that mark toxic documents."""
    counts, totals = {0: Counter(), 1: Counter()}, Counter(labels)
    if len(totals) < 2:
        return Lexicon({}, {})
    for text, label in zip(texts, labels, strict=True):
        counts[label].update(_candidates(words(text)))
    share = totals[1] / (totals[0] + totals[1])
    rated = []
    for entry, n in counts[1].items():
        ratio = (n / totals[1]) / ((counts[0][entry] + 0.5) / totals[0])
        if n >= LEAST_DOCS and ratio >= LEAST_RATIO and _chance(n, counts[0][entry], share) <= chance:
            rated.append((n * np.log(ratio), float(np.log(ratio)), entry))
    chosen = sorted(rated, key=lambda r: (-r[0], r[2]))[:ENTRIES]
    whole = {text: weight for _, weight, (stem, text) in chosen if not stem}
    stems = {text: weight for _, weight, (stem, text) in chosen if stem}
    # Phrases around an entry that clean documents hold, and toxic ones don't.
    phrases = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels, strict=True):
        own, folded = words(text), fold(text)
        held = {
            f"{a} {b}" for a, b in zip(own, own[1:], strict=False) if a in whole or b in whole
        }
        phrases[label].update(p for p in held if p in folded)
    exceptions = sorted(p for p, n in phrases[0].items() if n >= EXCEPTION_DOCS and not phrases[1][p])
    lexicon = Lexicon(whole, stems, exceptions)
    found = np.array([lexicon.weight(t) for t in texts])
    matched = found[:, 0] > 0
    if matched.any():
        lexicon.curve = _curve(found[matched, 0], found[matched, 1], np.array(labels)[matched])
    return lexicon


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts).sort_values("doc_id")
    lexicon = learn([t or "" for t in rows["text"]], rows["label"].tolist())
    yield pd.DataFrame(
        {
            "whole": [list(lexicon.whole.items())],
            "stems": [list(lexicon.stems.items())],
            "exceptions": [lexicon.exceptions],
            "curve": [list(lexicon.curve)],
        }
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Lexicon:
    """Learned lexicon, of at most ``ENTRIES`` entries."""
    pairs = "array<struct<entry: string, weight: double>>"
    learned = labelled_sample(docs, labels, label, per_class).repartition(1).mapInPandas(
        _learn, f"whole {pairs}, stems {pairs}, exceptions array<string>, curve array<double>"
    )
    for row in learned.collect():
        return Lexicon(dict(map(tuple, row.whole)), dict(map(tuple, row.stems)), row.exceptions, tuple(row.curve))
    return Lexicon({}, {})


def _score(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    return run


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every document."""
    return docs.select("doc_id", "text").mapInArrow(_score(lexicon), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
