"""Small tables for the operators on documents."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, value string, id long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text), with further columns whose names the operators use inside."""
    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x", 5) for i, t in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank and very long texts, repeated rows and a null id."""
    long = " ".join(f"w{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one"), (5, "one"), (None, "no id at all"), (6, "!!! ???"),
            (7, "a b c d e f g h i j"), (8, "a b c d e f g h i j")]
