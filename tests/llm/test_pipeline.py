"""Each stage of the pipeline against a plain version of its rule, row by row; odd rows survive."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from movewell.llm import secrets, toxicity
from movewell.llm.common import stored, table
from tests.llm.test_documents import brute_components, brute_entropy, brute_spans, plain_shingles, word_shingles

TABLES = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
A, B, C = (" ".join(f"{letter}{n}" for n in range(40)) for letter in "abc")


def rows_of(docs):
    return Counter(map(tuple, docs.collect()))


def odd_rows(spark, schema, *more):
    rows = [(None, "no id", None, None, None), (10**9, None, "en", "s", 0), (10**9 + 1, "", "en", "s", 0), (10**9 + 1, "", "en", "s", 0),
            (10**9 + 2, "password=abcdefgh1234", "en", "s", 21), *more]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def passed(spark):
    """Name of the stage: its input and its output, over all documents and odd rows."""
    docs = table(spark, TABLES, "documents")
    item = table(spark, TABLES, "benchmark").first()["text"]
    docs = stored(docs.union(odd_rows(spark, docs.schema, (3 * 10**9, A, "en", "s", 1), (5 * 10**9, A, "en", "s", 1), (5 * 10**9, B, "en", "s", 1),
                                      (11 * 10**9, C, "en", "s", 1), (11 * 10**9, C, "en", "t", 1), (None, A, "en", "s", 1), (None, item, "en", "s", 1))), "pipeline-test")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, TABLES), "pipeline-test")
        kept[name] = docs, out
        if name != "bpe":
            assert out.columns == COLUMNS
        docs = out
    return kept


def test_toxic_rows_go(spark, passed):
    """The model as such is tested elsewhere; here every row is scored anew from its words and weights."""
    before, after = passed["toxicity"]
    model = toxicity.train(before, table(spark, TABLES, "labels"))
    weights = dict(zip(model.features.tolist(), model.weights[:-1].tolist()))

    def score(text):
        words = set(re.findall(r"\w+", (text or "").lower()))
        words |= {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) >= n}
        found = {xxhash.xxh32_intdigest(w) % (1 << 18) for w in words}
        return 1 / (1 + np.exp(-(sum(weights.get(b, 0.0) for b in found) + model.weights[-1])))

    assert rows_of(after) == Counter({row: n for row, n in rows_of(before).items() if score(row[1]) < 0.7})
    assert before.count() > after.count()


def test_one_row_of_each_group_stays(passed):
    before, after = passed["near duplicates"]
    rows, kept = rows_of(before), rows_of(after)
    texts = sorted({row[1] for row in rows if word_shingles(row[1], 5)})
    group = brute_components(list(enumerate(texts)), 5)
    members = {}
    for row in rows:
        if row[1] in set(texts):
            members.setdefault(group[texts.index(row[1])], []).append(row)
    expected = Counter({row: n for row, n in rows.items() if not word_shingles(row[1], 5)})
    for found in members.values():
        least = min(((row[0] is None, row[0] or 0) for row in found))
        stays = [row for row in found if kept[row]]
        assert len(stays) == 1 and kept[stays[0]] == 1
        assert (stays[0][0] is None, stays[0][0] or 0) == least
        expected[stays[0]] += 1
    assert kept == expected
    own = {(row[0], row[1]) for row in kept}
    assert (3 * 10**9, A) in own and (5 * 10**9, B) in own and (5 * 10**9, A) not in own and (None, A) not in own
    assert sum(n for row, n in kept.items() if row[1] == C) == 1


def test_rows_that_hold_an_item_go(spark, passed):
    before, after = passed["decontamination"]
    items = [plain_shingles(r["text"]) for r in table(spark, TABLES, "benchmark").collect()]

    def leaks(text):
        have = plain_shingles(text)
        return any(item and 100 * len(item & have) >= 80 * len(item) for item in items)

    assert rows_of(after) == Counter({row: n for row, n in rows_of(before).items() if not leaks(row[1])})
    assert any(row[0] is None for row in rows_of(before) - rows_of(after))


def test_secrets_are_masked(passed):
    before, after = passed["secrets"]

    def masked(text):
        if text is None:
            return None
        base = brute_spans(text)
        more = [x for x in brute_entropy(text, secrets.Settings()) if not any(b[0] <= x[0] and b[2] >= x[2] for b in base)]
        out, at = "", 0
        for start, _, end in sorted(base + more):
            if start > at or (start == 0 and at == 0):
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        return out + text[at:]

    # a text that changed, changes its n_chars with it
    expected = Counter()
    for row, n in rows_of(before).items():
        text = masked(row[1])
        expected[(row[0], text, row[2], row[3], row[4] if text is None else len(text))] += n
    assert rows_of(after.where("text IS NOT NULL")) == Counter({r: n for r, n in expected.items() if r[1] is not None})
    assert rows_of(after.where("text IS NULL")) == Counter({r: n for r, n in expected.items() if r[1] is None})
    assert before.where(F.col("text").contains("password=abcdefgh1234")).count() == 1


def test_every_row_is_encoded(passed):
    before, after = passed["bpe"]
    texts = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in before.collect())
    rows = after.collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == texts
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_run_gives_the_rows_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, TABLES)
    assert rows.columns[:2] == ["doc_id", "n_tokens"] and 0 < rows.count() < table(spark, TABLES, "documents").count()


def test_no_documents(spark):
    docs = table(spark, TABLES, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, TABLES), "pipeline-test")
        assert docs.count() == 0
