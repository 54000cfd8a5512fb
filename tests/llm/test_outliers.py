"""Quality rules against plain counting and a plain minimum covariance determinant."""

from __future__ import annotations

import random
import re
from collections import Counter
from math import ceil, floor, log, prod, sqrt

import pytest

from movewell.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))


def vector(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words):
    values = (log(1 + n_words), log((1 + word_chars) / (1 + n_words)), log(1 + 100 * n_symbols / (1 + word_chars)),
              log(1 + 100 * n_dup_lines / (1 + n_words)), n_repeat_words / (1 + n_words))
    return [floor(256 * v + .5) for v in values]


def reached(values, share):
    return sorted(values)[ceil(len(values) * share) - 1]


def fitted(rows, floor_, prior):
    n, size = len(rows), len(rows[0])
    mean = [sum(r[i] for r in rows) / n for i in range(size)]
    factor = [[0.0] * size for _ in range(size)]
    for j in range(size):
        for i in range(j, size):
            spread = sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows)
            value = (spread + floor_ * prior) / (n + prior) + floor_ if i == j else spread / (n + prior)
            value -= sum(factor[i][k] * factor[j][k] for k in range(j))
            factor[i][j] = sqrt(max(value, floor_)) if i == j else value / factor[j][j]
    return mean, factor


def distance(row, estimate):
    mean, factor = estimate
    y = []
    for i, z in enumerate(row):
        y.append((z - mean[i] - sum(factor[i][k] * y[k] for k in range(i))) / factor[i][i])
    return sum(v * v for v in y)


def brute(rows, settings):
    """Distances of the vectors of one group."""
    floor_, least = round((256 * settings.spread) ** 2), 256 * settings.spread
    size = range(len(rows[0]))
    middle = [reached([r[i] for r in rows], .5) for i in size]
    wide = [reached([abs(r[i] - middle[i]) for r in rows], .5) for i in size]
    ended = []
    for start in (sum, max):
        far = [start(((r[i] - middle[i]) / (wide[i] + least)) ** 2 for i in size) for r in rows]
        for _ in range(settings.rounds):
            places = [floor(log(max(d, 1e-3)) * 64) for d in far]
            border = reached(places, settings.share)
            estimate = fitted([r for r, p in zip(rows, places) if p <= border], floor_, settings.prior)
            far = [distance(r, estimate) for r in rows]
        ended.append((prod(estimate[1][i][i] for i in size), -len(ended), far))
    factor = outliers.consistency(settings.share, len(rows[0]))
    return [d / factor for d in min(ended, key=lambda e: (e[0], -e[1]))[2]]


def texts(seed=12, size=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    for n in range(size):
        words = [word() for _ in range(rng.choice([10, 60, 120, 300, 900]))]
        if n % 9 == 0:
            words = [w + "###" for w in words]
        lines = [" ".join(words[i:i + 12]) for i in range(0, len(words), 12)]
        if n % 7 == 0:
            lines += [lines[0]] * rng.randint(1, 6)
        if n % 11 == 0:
            lines += ["", " ", " ", "x y"] * 2
        yield "\n".join(lines)


def test_verdicts_equal_a_plain_estimate(spark):
    rows = [(n, t, ["en", "fr", None][n % 3], "hot" if n % 2 else None) for n, t in enumerate(texts())]
    rows += [(500, None, "en", "hot"), (501, "", None, None), (None, rows[1][1], "fr", "hot"), (1, rows[1][1], "fr", "hot"), (502, rows[4][1], "alone", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "1 AS n", "2 AS z0", "'x' AS start", "'y' AS place", "3 AS kept")
    settings = outliers.Settings()
    found = outliers.judged(docs.repartition(3), settings).collect()
    expected, groups = [], {}
    for i, text, lang, source in rows:
        made = counts(text)
        failed = made[0] < 50 or 100 * made[4] > 50 * made[0]
        expected.append([i, lang, source, *made, failed, None])
        if not failed:
            groups.setdefault((lang, source), []).append(len(expected) - 1)
    for members in groups.values():
        for at, far in zip(members, brute([vector(*expected[m][3:8]) for m in members], settings)):
            expected[at][-1] = far
    order = lambda row: repr(row[:9])
    found, expected = sorted(map(list, found), key=order), sorted(expected, key=order)
    assert [f[:9] for f in found] == [e[:9] for e in expected]
    assert [f[9] for f in found] == [e[9] if e[9] is None else pytest.approx(e[9], rel=1e-9, abs=1e-9) for e in expected]
    cut = outliers.chi_square_quantile(1 - settings.tail, 5)
    assert [f[10] for f in found] == [not e[8] and e[9] <= cut for e in expected]
    assert {f[10] for f in found} == {True, False}


def test_a_quarter_of_outliers_does_not_hide_itself(spark):
    rng = random.Random(3)
    rows = [(n, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + ("##" if n % 5 == 0 else "")
                         for _ in range(rng.randint(60, 400))), "en", "one") for n in range(200)]
    found = outliers.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == {n for n in range(200) if n % 5 == 0}


def test_no_texts_and_no_groups(spark):
    assert outliers.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
    bare = outliers.judged(spark.createDataFrame([(1, "a b"), (2, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in bare) == [(1, True, False), (2, False, True)]


def test_long_and_repeating_texts(spark):
    long = " ".join(f"w{i % 9001}" for i in range(40_000))
    rows = [(1, long), (2, "a b c " * 30), (3, "a a a a"), (4, "\n".join(["x"] * 20_000))]
    found = outliers.counted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[3:] for r in found} == {i: counts(t) for i, t in rows}


def test_chi_square():
    assert outliers.chi_square_below(4.0, 2) == pytest.approx(1 - 2.718281828459045 ** -2)
    assert outliers.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4)
