from __future__ import annotations

import uuid

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with the operators' own."""

    def make(pairs, lang="en", source="s"):
        rows = [(i, t, lang, source, len(t or ""), 1, "x", b"y") for i, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS + ", row int, label string, digest binary")

    return make


@pytest.fixture
def folder(spark):
    from reelshelf.session import scratch_dir

    return f"{scratch_dir(spark)}/llm-test-{uuid.uuid4().hex}"
