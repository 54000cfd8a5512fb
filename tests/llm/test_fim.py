"""Fill-in-the-middle against splitting the text into its units; chunks and their cache."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from movewell.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if doc_id is None:
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    before, middle, after = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(before), len(middle), f"<S>{after}<P>{before}<M>{middle}"
    return n, "psm", len(before), len(middle), f"<P>{before}<S>{after}<M>{middle}"


def texts():
    rng = random.Random(11)
    passage = " ".join("".join(rng.choice("abcdeé🙂") for _ in range(rng.randint(1, 9))) for _ in range(300))
    made = ["", None, " ", "\n\n", "a", " a", "a ", "a  b\t\n c ", "x<P>y", "a<M", "<S", "ends <", "x" * 5000, " " * 5000, "  a b", passage]
    for _ in range(150):
        cut = rng.randrange(len(passage))
        made.append("".join(rng.choice(["a", "bc", " ", "  ", "\n", "\x0b", "é", "🙂", passage[cut:cut + 700]]) for _ in range(rng.randint(1, 30))))
    return made


def test_forms_equal_splitting_into_units(docs_of, odd_texts):
    rows = [*enumerate(texts()), *[(i and i + 1000, t) for i, t in odd_texts], (3, "one id, two texts")]
    found = fim.transform(docs_of(rows).repartition(2)).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda row: (row[0] is None, row[0] or 0, row[-1])
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=key) == \
        sorted(((i, *brute(i, t)) for i, t in rows), key=key)
    assert sorted((r["doc_id"] or -1, r["again"]) for r in found) == sorted((i or -1, t or "") for i, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_no_texts(docs_of):
    assert fim.transform(docs_of([])).collect() == []


def test_every_place_in_small_chunks():
    settings = fim.Settings(least=2, most=7, spread=1)
    summaries = fim.Summaries(64)
    for text in filter(None, texts()):
        text = text[:400]
        units = fim.Units(fim.codes_of(text), settings, summaries)
        expected = np.cumsum([0, *map(len, UNIT.findall(text))]).tolist()
        assert units.count == len(expected) - 1
        assert [units.place(k) for k in range(units.count + 1)] == expected


def test_a_shared_passage_is_summed_up_once():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    settings, summaries = fim.Settings(), fim.Summaries(1 << 20)
    fim.Units(fim.codes_of("some words first " + passage), settings, summaries)
    before = summaries.hits
    chunks = len(fim.Units(fim.codes_of("quite another beginning, longer than that one: " + passage), settings, summaries).ends)
    assert summaries.hits - before >= chunks - 3


def test_equal_hashes_are_not_equal_chunks(monkeypatch):
    monkeypatch.setattr(fim, "hash", lambda content: 1, raising=False)
    summaries = fim.Summaries(1 << 20)
    one, other = fim.codes_of("a b c"), fim.codes_of(" abc ")
    assert [w.tolist() for _, _, w in map(summaries.of, (one, other, one))] == [[1, 3], [4], [1, 3]]
    assert summaries.hits == 0
