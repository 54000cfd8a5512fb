"""Near-duplicates, leaks, secrets and top-k against brute force; odd and empty inputs."""

from __future__ import annotations

import hashlib
import random
import re
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from movewell.llm import decontamination, neardup, secrets, topk


def word_shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width, percent=80):
    sets = [(i, word_shingles(t, width)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1:]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                label[high] = low
    return {i: find(i) for i in label}


def near_copies(seed=2, groups=6, size=9):
    """Groups of edited copies with common passages in all texts, and texts made of little else."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows, number = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < .5:
                text[3:3] = passage
            number += 1
            rows.append((number, " ".join(text)))
    for _ in range(60):
        number += 1
        rows.append((number, " ".join(passage + [word() for _ in range(rng.choice([0, 2, 6, 12, 40]))])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(words=5, common=4), neardup.Settings(common=2, mostly=0.2)])
def test_components_equal_brute_force(docs_of, odd_texts, settings):
    rows = near_copies() + [(i and i + 5000, t) for i, t in odd_texts]
    found = neardup.near_duplicates(docs_of(rows).repartition(3), settings).collect()
    expected = brute_components(rows, settings.words, settings.percent)
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None} == set(expected.items())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["doc_id"] is not None)
    sizes = {i: len(word_shingles(t, settings.words)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in found)
    assert [r["kept"] for r in found if r["doc_id"] is None] == [True]


def thue_morse(letters, size=1024):
    return "".join(letters[bin(n).count("1") % 2] for n in range(size))


def test_crafted_words_do_not_collide(docs_of):
    """A word and its complement, equal under every polynomial hash of odd base modulo a power of two."""
    rows = [(1, thue_morse("ab")), (2, thue_morse("ba")), (3, thue_morse("ab"))]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_an_id_of_several_texts_is_one_document(docs_of):
    a, b, c = (" ".join(f"{letter}{i}" for i in range(30)) for letter in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, ""), (11, c), (11, c), (7, ""), (None, a), (12, None), (12, c), (4, "x y z"), (4, b + " end")]
    found = neardup.near_duplicates(docs_of(rows)).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {
        (3, 3), (5, 3), (9, 3), (4, 3), (11, 11), (12, 11), (7, 7), (None, None)}


def passage_texts(size, seed=9):
    """Documents of ten out of forty passages: all they are made of is common, and few are linked."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}w{rng.randrange(900)}" for _ in range(40)) for k in range(40)]
    rows = []
    for n in range(size):
        chosen = rng.sample(range(40), 10)
        rows.append((n, " ".join(passages[k] for k in chosen)))
        if n % 50 == 0:
            rows.append((size + n, " ".join(passages[k] for k in chosen[:-1])))
    return rows


def test_labels_are_not_made_anew_without_new_links(docs_of, monkeypatch):
    calls = []
    monkeypatch.setattr(neardup, "components", lambda links, made=neardup.components: calls.append(1) or made(links))
    rows = [(n, " ".join(f"{n // 2}w{k}" for k in range(50 - n % 2))) for n in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(rows)).collect()}
    assert found == {n: n - n % 2 for n in range(20)}
    assert len(calls) == 1


def test_documents_of_common_passages(docs_of):
    rows = passage_texts(400)
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(rows).repartition(4)).collect()}
    assert found == brute_components(rows, 4)
    assert sum(i != c for i, c in found.items()) >= 8


def test_linked_sets_share_a_band():
    """Sets at the bound, of many sizes, always have a key in common; unlike ones of some size hardly ever."""
    rng, met = random.Random(1), 0
    for n in [*range(4, 80), *range(80, 2000, 41)]:
        for _ in range(8):
            shared = rng.sample(range(1 << 62), n)
            differ = n // 4
            one = rng.randint(0, differ)
            sides = [shared + rng.sample(range(1 << 62), extra) for extra in (one, differ - one)]
            assert 100 * n >= 80 * (n + differ)
            keys = [set(neardup.band_keys(np.array(side), len(side), 80).tolist()) for side in sides]
            assert keys[0] & keys[1]
        unlike = [np.array((shared[: n // 3] + rng.sample(range(1 << 62), n))[:n]) for _ in range(2)]
        met += n > 15 and bool(set(neardup.band_keys(unlike[0], n, 80).tolist()) & set(neardup.band_keys(unlike[1], n, 80).tolist()))
    assert met <= 20


def test_a_template_with_own_words_is_linked_whatever_its_probes(docs_of):
    """A fifth of the set is rare, yet two fifths of the probes: whole sets must decide, not rare lists."""
    template = [f"t{i}" for i in range(403)]
    probes = lambda text: set(neardup.shingle_set(text, 4)[:48].tolist())
    known = set(neardup.shingle_set(" ".join(template), 4).tolist())
    copies = (" ".join(template + [f"own{n}x{i}" for i in range(100)]) for n in range(100_000))
    copy = next(text for text in copies if len(probes(text) - known) >= 20)
    others = [(100 + n, " ".join(template + [f"other{n}x{i}" for i in range(102)])) for n in range(200)]
    rows = [(1, " ".join(template)), (2, copy), *others]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(rows)).collect()}
    assert found == brute_components(rows, 4)
    assert found[2] == 1


def test_no_documents(spark, docs_of):
    none = docs_of([])
    assert neardup.near_duplicates(none).collect() == []
    assert secrets.scan(none).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(none, items).collect() == []
    assert decontamination.leaks(docs_of([(1, "a b c d e f")]), items).collect() == []


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_shingles(text, width=5):
    words = plain_words(text)
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("limit", [200_000, 0])
def test_leaks_equal_brute_force(spark, docs_of, odd_texts, limit):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(n, " ".join(word() for _ in range(size))) for n, size in enumerate([1, 3, 5, 9, 20, 33, 70, 150] * 3)]
    items += [(90, None), (91, ""), (None, "no id here to be found"), (92, items[4][1]), (92, items[5][1])]
    rows = []
    for n in range(120):
        body = [word() for _ in range(rng.choice([5, 60, 400]))]
        _, text = rng.choice([i for i in items if i[1]])
        part = text.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            part[rng.randrange(len(part))] = word()
        body[2:2] = part[: rng.choice([len(part), len(part), max(1, len(part) * 9 // 10)])]
        rows.append((n, " ".join(body).upper() if n % 7 == 0 else ", ".join(body)))
    rows += [(i and i + 1000, t) for i, t in odd_texts]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(docs_of(rows), table, decontamination.Settings(broadcast_rows=limit)).collect()
    expected = {}
    for i, text in rows:
        for item, asked in items:
            width = min(5, len(plain_words(asked)))
            wanted = plain_shingles(asked, width) if width else set()
            if i is not None and item is not None and wanted and len(plain_words(text)) >= width:
                shared = len(wanted & plain_shingles(text, width))
                if shared * 100 >= 80 * len(wanted):
                    expected[i, item] = max(expected.get((i, item), 0), shared * 100 // len(wanted))
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in found} == expected


def test_short_items_are_found_inside_documents(spark, docs_of):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "Zeta!"), (3, "beta alpha")], "item_id long, text string")
    rows = [(1, "x y alpha beta gamma delta epsilon zeta q"), (2, "alpha beta gamma"), (3, "zeta"), (4, None), (5, "alpha, BETA; gamma delta"),
            (6, "alpha x beta gamma delta y"), (1, "nothing here")]
    found = decontamination.leaks(docs_of(rows), items).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1, 1, 100), (1, 2, 1, 1, 100), (3, 2, 1, 1, 100), (5, 1, 1, 1, 100)]


KEYS = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
PATTERNS = [("assign", KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16),
            ("hex", r"[0-9a-f]+", 0, 32)]


def brute_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(PATTERNS)
             for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(found)


def brute_entropy(text, settings):
    for m in re.finditer(secrets.CANDIDATE, text or ""):
        value = m.group()
        if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)) or any(re.search(p, value) for p in settings.allowed):
            continue
        bits = (settings.hex_bits if re.fullmatch("[0-9a-fA-F]+", value) else
                settings.alphanumeric_bits if re.fullmatch("[0-9A-Za-z]+", value) else settings.base64_bits)
        best = max(-sum(w.count(c) / 20 * log2(w.count(c) / 20) for c in set(w))
                   for w in (value[i:i + 20] for i in range(len(value) - 19)))
        if best >= bits:
            yield m.start(), 3, m.end()


TEXTS = [
    "password = 'abcdefgh' token:short secret=token=\"abcdefghijk", "PassWord:x passwd=12345678 api_key='A+/=._-9' apikey=12345678",
    "ñ🙂 token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" é", "AKIA0123456789AB AKIASHORT AKIAAKIA0123456789 xAKIA01234567890123",
    "d41d8cd98f00b204e9800998ecf8427e 0123456789abcdef0123456789abcdef0", "paſsword=abcdefghij toKen=abcdefghij",
    "key Zx9Qw3Er5Ty7Ui1Op2As4Df6 and aaaaaaaaaaaaaaaaaaaaaaaa1 and /usr/local/share/applications/thing/12",
    "f47ac10b-58cc-4372-a567-0e02b2c3d479 AB+/cd12EF34gh56IJ78kl90== " + "Zx9" * 40, "", None, "secret=" + "x" * 50_000,
]


def test_spans_equal_brute_force(docs_of):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (0, TEXTS[0])]
    found = secrets.scan(docs_of(rows)).collect()
    settings = secrets.Settings()
    expected = []
    label = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    for i, text in rows:
        base = brute_spans(text)
        more = [x for x in brute_entropy(text, settings) if not any(b[0] <= x[0] and b[2] >= x[2] for b in base)]
        counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        expected.append((i, *counts, hashlib.sha256(label(base).encode()).hexdigest(), label(sorted(base + more))))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert any("entropy" in row[-1] for row in expected)


def test_masking_keeps_rows_and_columns(docs_of):
    rows = list(enumerate(TEXTS))
    docs = docs_of(rows)
    found = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert set(found) == {i for i, _ in rows} and secrets.redact(docs).columns == docs.columns
    for i, text in rows:
        if text is None:
            assert found[i]["text"] is None
            continue
        runs, at = [], 0
        for part in filter(None, spans[i].split(",")):
            _, start, end = part.split(":")
            runs.append((int(start), int(end)))
        out = ""
        for start, end in sorted(runs):
            if start > at or (start == 0 and at == 0):
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert found[i]["text"] == out + text[at:] and found[i]["n_chars"] == len(found[i]["text"])


@pytest.mark.parametrize("settings", [topk.Settings(), topk.Settings(k=3, block=8, chunk=4, first_depth=1)])
def test_top_k_equals_brute_force(spark, settings):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, -.5, 0.0, .25, .5, 1.0]) for _ in range(6)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6),
             (10, rows[10][1]), (250, [0.0] * 6), (50, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    vectors = topk.integer_vectors(table)
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), settings).collect()
    sound = {i: [int(x * 256 // 1) for x in v] for i, v in rows if i is not None and (i < 200 or i == 250)}
    expected = set()
    for q in sound:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q)
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[: settings.k])}
    assert set(map(tuple, found)) == expected and len(found) == len(expected)


def test_top_k_of_few_rows(spark):
    none = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).collect() == []
    two = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, topk.top_k(two, two).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
