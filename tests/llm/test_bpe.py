"""BPE, Re-Pair shards and section counts against the library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from movewell.llm import attribution, bpe, repair

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = [*"ab 's \n\t 1ñ½²\u0085 \x1c\x1f 　é!?'", "<|endoftext|>", "<|startoftext|>", "  ", "'ll", "日本", "🙂", "é", "İ", "Σς", "﻿"]


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def odd_strings(count, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(count)]


def test_ids_and_decoding_equal_the_library():
    known, tokenizer = bpe.Vocabulary(BYTES), library(BYTES)
    encoder = bpe.Encoder(known)
    for text in odd_strings(3000):
        ids = encoder.encode(text).tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert known.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_prepared_texts_equal_the_library():
    """New words of many texts made together, over batches, with caches that fill and are forgotten."""
    known, tokenizer = bpe.Vocabulary(BYTES), library(BYTES)
    encoder = bpe.Encoder(known)
    rng = random.Random(8)
    texts = odd_strings(1500, seed=4) + ["".join(rng.choice("abcdefghi 's1éß日\n") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    for begin in range(0, len(texts), 150):
        encoder.prepare(texts[begin:begin + 150])
        for text in texts[begin:begin + 150]:
            ids = encoder.encode(text).tolist()
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encoder.words) > 1000


def test_words_of_every_length_together():
    known, tokenizer = bpe.Vocabulary(BYTES), library(BYTES)
    rng = random.Random(2)
    words = ["".join(rng.choice("aabcdethéx") for _ in range(rng.randint(1, 70))) for _ in range(5000)] + ["", "a"]
    expected = [one.ids for one in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert [np.frombuffer(one, np.uint32).tolist() for one in known.packed_words([word.encode() for word in words])] == expected


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.Vocabulary(WORDS)


def test_long_words_take_the_heap_to_the_same_ids():
    known, tokenizer = bpe.Vocabulary(BYTES), library(BYTES)
    rng = random.Random(1)
    for size in (95, 96, 97, 400, 6000):
        word = "".join(rng.choice("aabcdeth") for _ in range(size))
        assert known.word_ids(word.encode()) == tokenizer.encode(word, add_special_tokens=False).ids
        assert known._by_heap([known.first_ids[b] for b in word.encode()]) == known.word_ids(word.encode())


def test_documents(docs_of, odd_texts):
    rows = bpe.encode_documents(docs_of(odd_texts), BYTES, with_ids=True).collect()
    tokenizer = library(BYTES)
    expected = []
    for doc_id, text in odd_texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)


def test_no_documents(docs_of):
    assert bpe.encode_documents(docs_of([]), BYTES).collect() == []
    assert attribution.section_tokens(docs_of([]), BYTES).collect() == []


def test_chunks_equal_whole_texts_of_the_library():
    tokenizer, encoder = library(WORDS), repair.ChunkEncoder(WORDS)
    texts = odd_strings(1500) + ["x" * 300 + " y " + "x" * 300]
    texts += ["It'S DON'T we'll ÉCOLE Straße ſo ĸ 2×3÷4 Σίσυφος İstanbul e\u0301 ﬁn 漢字 <|endoftext|>x <| a|b a\x1cb", "'s'T'"]
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_string_that_is_chunk_and_word_is_remembered_once(monkeypatch):
    """And forgetting in the midst of a text changes no ids."""
    texts = ["alpha Alpha, alpha", "don't DON'T it's 42 4242 --' ''s 's", "\u00c9t\u00e9 \u00e9t\u00e9. na\u00efve <|endoftext|> \u4e2d\u6587, x" + "y" * 80]
    encoder = repair.ChunkEncoder(WORDS)
    encoder.encode(texts[:1])
    memories = [memory for memory in vars(encoder).values() if isinstance(memory, dict)]
    assert sorted(key for memory in memories for key in memory if isinstance(key, str)) == [",", "Alpha,", "alpha"]
    monkeypatch.setattr(repair, "CACHED", 2)
    expected = [np.array(e.ids, "<u4").tobytes() for e in library(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == expected == repair.ChunkEncoder(WORDS).encode(texts)


def test_each_distinct_chunk_of_a_batch_is_looked_up_once(monkeypatch):
    """And any character between words, or as the first or last of one, gives the ids of the library."""
    encoder, asked = repair.ChunkEncoder(WORDS), []
    monkeypatch.setattr(encoder.known, "tokenize", lambda word, plain=encoder.known.tokenize: asked.append(word) or plain(word))
    texts = [f"{chr(c)}ab{chr(c)}CD{chr(c)} {chr(c)}" for c in [*range(0x500), *range(0x1E00, 0x2100), 0x3000, 0xFEFF, 0x1F642]]
    texts += ["", " ", "\n", " a  b\t\r\n\x0b\x0cc "]
    expected = [np.array(e.ids, "<u4").tobytes() for e in library(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts * 2) == expected * 2 and encoder.encode(texts[::-1]) == expected[::-1]
    assert len(asked) == len(set(asked)) and encoder.encode([]) == []


def test_pairs_are_counted_alike_at_any_width():
    """Whether pair and place fit in one number or not."""
    rng = np.random.default_rng(2)
    pairs = rng.zipf(1.3, 5000) % 1000 << 10 | rng.zipf(1.3, 5000) % 1000
    values, counts = np.unique(pairs, return_counts=True)
    for width in (10, 31):
        found, places, number = repair.frequent(pairs, width, 8)
        assert found.tolist() == values[counts >= 8].tolist()
        assert sorted(places.tolist()) == np.flatnonzero(np.isin(pairs, found)).tolist() and (pairs[places] == found[number]).all()
        assert [len(part) for part in repair.frequent(pairs[:0], width, 8)] == [0, 0, 0]


@pytest.mark.parametrize("settings", [repair.Settings(least=3), repair.Settings(least=2), repair.Settings()])
def test_shards_round_trip_and_random_access(settings):
    rng = np.random.default_rng(5)
    sizes = [0, 1, 700, 2, 0, 900, 50]
    ids = rng.choice([3, 4, 5, 6, 70_000], size=sum(sizes), p=[.4, .3, .2, .05, .05]).astype("<u4")
    ids[10:200] = 3
    ends = np.cumsum(sizes)
    shard = repair.Shard(payload := repair.compress(ids, ends, settings))
    every, counts = shard.every()
    assert every.tolist() == ids.tolist() and counts.tolist() == sizes
    for number, (end, size) in enumerate(zip(ends, sizes)):
        own = ids[end - size: end]
        assert shard.ids(number).tolist() == own.tolist()
        for start, stop in ((0, 1), (5, 40), (size // 2, size), (3, 3)):
            assert shard.ids(number, start, min(stop, size)).tolist() == own[start: min(stop, size)].tolist()
    if settings.least == 2:
        assert len(payload) < len(ids) * 4
    with pytest.raises(ValueError):
        repair.Shard(b"other" + payload)


def pairs_left(payload):
    """How often each pair of neighbours within a document still occurs."""
    shard = repair.Shard(payload)
    inner = np.ones(max(0, len(shard.symbols) - 1), bool)
    inner[[s - 1 for s in shard.starts.tolist() if 0 < s < len(shard.symbols)]] = False
    left, right = shard.symbols[:-1][inner], shard.symbols[1:][inner]
    return np.unique(left << 32 | right, return_counts=True)[1], shard


def test_no_frequent_pair_is_left():
    """On real ids, on runs of one id and on a text repeated many times: replaced to the end, and long rules found."""
    import duckdb
    texts = [t for t, in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    encoded = [np.frombuffer(raw, "<u4") for raw in repair.ChunkEncoder(WORDS).encode(texts)]
    passage = np.random.default_rng(3).integers(0, 40_000, 300).astype("<u4")
    for parts in (encoded, [np.full(5000, 7, "<u4")], [passage] * 64, [np.zeros(0, "<u4")] * 3):
        ids, ends = np.concatenate(parts), np.cumsum([len(part) for part in parts])
        counts, shard = pairs_left(repair.compress(ids, ends))
        assert not len(counts) or counts.max() < repair.Settings().least
        every, sizes = shard.every()
        assert np.array_equal(every, ids) and sizes.tolist() == [len(part) for part in parts]
    assert pairs_left(repair.compress(np.concatenate([passage] * 64), np.arange(1, 65) * 300))[1].symbols.tolist() == [
        int(repair.Shard(repair.compress(np.concatenate([passage] * 64), np.arange(1, 65) * 300)).base) + 298] * 64


@pytest.mark.parametrize("size", [16, 700, 5001])
def test_runs_of_one_id_are_halved_every_round(size):
    """By one rule each time, so rules grow with the logarithm of a run, whatever stands beside it."""
    runs = [np.full(size, 7, "<u4"), np.full(size + 3, 7, "<u4"), np.concatenate([[9], np.full(size, 7), [9, 8], np.full(size, 8)])]
    ids, ends = np.concatenate(runs * 3).astype("<u4"), np.cumsum([len(run) for run in runs * 3])
    counts, shard = pairs_left(repair.compress(ids, ends))
    assert len(shard.rules) <= 4 * size.bit_length() and len(np.unique(shard.rules, axis=0)) == len(shard.rules)
    assert np.array_equal(shard.every()[0], ids) and (not len(counts) or counts.max() < repair.Settings().least)


def test_copies_of_ascending_ids_are_joined_evenly():
    """Not from one end, which takes as many rounds as a copy has ids."""
    ids = np.tile(np.arange(100, 900), 20).astype("<u4")
    shard = repair.Shard(repair.compress(ids, np.arange(1, 21) * 800))
    depth = [0] * shard.base
    for left, right in shard.rules.tolist():
        depth.append(1 + max(depth[left], depth[right]))
    assert max(depth) <= 60 and shard.symbols.tolist() == [shard.base + 798] * 20
    assert np.array_equal(shard.every()[0], ids)


def test_shards_of_documents(spark, docs_of, odd_texts):
    folder = repair.write_shards(docs_of(odd_texts), WORDS, repair.Settings(shard_ids=40, least=2))
    rows = sorted(map(tuple, repair.read_documents(spark, folder).collect()), key=lambda r: r[1])
    tokenizer = library(WORDS)
    expected, start = [], 0
    for doc_id, text in sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == expected
    empty = repair.write_shards(docs_of([]), WORDS)
    assert repair.read_documents(spark, empty).collect() == []


@pytest.mark.parametrize("rule", attribution.RULES)
def test_sections_against_counting_by_hand(docs_of, odd_texts, rule):
    texts = [(n, text) for n, text in enumerate(odd_strings(60, seed=9) + ["a\n\n\n  b\n", "\n", "日\n本🙂\n\n"])] + odd_texts[:3]
    tokenizer = library(BYTES)
    expected = []
    for doc_id, text in texts:
        text = text or ""
        lines = text.split("\n")
        sections, at = [], 0
        for number, line in enumerate(lines):
            size = len(line) + (number < len(lines) - 1)
            if size or len(lines) == 1:
                sections.append((at, at + size))
            at += size
        counts = [[0, 0] for _ in sections]
        for start, stop in library_spans(tokenizer, text):
            held = [max(0, min(stop, e) - max(start, s)) for s, e in sections]
            touched = [k for k, h in enumerate(held) if h]
            owner = {"first": touched[0], "last": touched[-1], "most": held.index(max(held))}[rule]
            counts[owner][0] += 1
            counts[owner][1] += len(touched) > 1
        expected += [(doc_id, k, s, e, *counts[k]) for k, (s, e) in enumerate(sections)]
    rows = attribution.section_tokens(docs_of(texts), BYTES, rule).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)


def library_spans(tokenizer, text):
    """Character spans of tokens from the bytes they stand for."""
    known = bpe.vocabulary(BYTES)
    owner = [n for n, c in enumerate(text) for _ in c.encode("utf-8")]
    at = 0
    for i in tokenizer.encode(text, add_special_tokens=False).ids:
        size = len(known.bytes_of[i])
        yield owner[at], owner[at + size - 1] + 1
        at += size


def test_an_unknown_rule_is_refused(docs_of):
    with pytest.raises(ValueError):
        attribution.section_tokens(docs_of([]), BYTES, "half")
