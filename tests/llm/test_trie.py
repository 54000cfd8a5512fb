"""The conversation trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from movewell.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            told[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    original = {c: [t for _, t in sorted(turns)] for c, turns in told.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = original.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        own = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += path not in children
    return sorted((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), children[path], leaves[path], saved[path],
                   hashlib.sha256(",".join(str(c) for c in convs if len(rebuilt[c]) == len(path)).encode()).hexdigest())
                  for path, convs in members.items())


def conversations(seed=13):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(200), 130):
        talk = [rng.choice("abc") for _ in range(rng.randint(1, 12))] if conv % 3 else ["hello there", "a", "b"][: rng.randint(1, 3)]
        rows += [(conv, turn, rng.choice(["user", "user", "bot", None]), f"{text} {text}" if turn % 2 else text) for turn, text in enumerate(talk)]
    deep = ["x y", "z", "w w w"] * 40
    for conv, size in ((300, 120), (301, 100), (302, 117), (303, 120), (304, 64)):
        rows += [(conv, turn, "user", deep[turn]) for turn in range(size)]
    rows += [(400, None, "user", "null turn"), (400, 0, "user", "after"), (400, 0, "bot", "tie"), (400, 0, "bot", "tie"), (401, 5, None, None),
             (None, 0, "user", "no conversation"), (-7, 0, "user", "negative")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [trie.Settings(), trie.Settings(height=2, block=7), trie.Settings(height=3, block=1)])
def test_nodes_equal_a_plain_trie(spark, settings):
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS depth", "'k' AS key", "2 AS length", "3 AS part", "4 AS place")
    found = trie.trie(table.repartition(5), settings)
    assert sorted(found.columns) == sorted(COLUMNS)
    assert sorted(map(tuple, found.select(*COLUMNS).collect())) == brute(rows)


def test_a_turnless_rebuilt_conversation_ends_at_the_root(spark):
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, 0, "user", "a"), (conv, 1, "bot", "b")]
    found = trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*COLUMNS).collect()
    assert list(map(tuple, found)) == brute(rows) == [
        (conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_no_conversations(spark):
    assert trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_many_conversations_at_one_node(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 3000) for t in range(4)]
    found = trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == brute(rows)
