"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A word is held as its parts, whose borders are the part boundaries, and the ranks of adjacent parts. The
smallest rank is found by a scan, its boundary deleted by joining the two parts, and only the two
neighbouring ranks are looked up again. The new words of a batch of texts go through this together: words
of similar length are the rows of one matrix of parts and one of ranks, and a step finds the least rank of every row,
deletes that boundary in it and refreshes two ranks. Words beyond ``SHORT`` bytes, where repeated scans would
cost the square of the length, use a heap of the same ranks. The vocabulary file is a parameter and never copied.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from movewell.llm.common import pieces, texts_of

SHORT = 96
CACHED_CHUNKS = 400_000
CACHED_LENGTH = 64
ROWS = 4096  # words in one matrix

#: Fixed value: the pattern by which this vocabulary's words are cut.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A single space between two characters that are no white space: no word reaches across its left side.
CUTS = re.compile(r"(?<=\S) (?=\S)")
NO_RANK = 1 << 60


def printable_bytes() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Vocabulary:
    """Ids, merge ranks and special tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        shown = printable_bytes()
        raw = {c: b for b, c in shown.items()}
        ids = content["model"]["vocab"]
        self.bytes_of = {i: bytes(raw[c] for c in token) for token, i in ids.items()}
        self.first_ids = [ids[shown[b]] for b in range(256)]
        if (content["pre_tokenizer"]["type"], content["normalizer"], content["model"]["type"]) != ("ByteLevel", None, "BPE") or \
                content["pre_tokenizer"]["add_prefix_space"] or not content["pre_tokenizer"].get("use_regex", True) or \
                content["model"].get("byte_fallback") or content["model"].get("ignore_merges"):
            raise ValueError(f"{path} is not a byte-level BPE without normalizer, whose words this module cuts")
        self.rank, self.merged = {}, []
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[left] << 32 | ids[right]] = rank
            self.merged.append(ids[left + right])
        self._make_table()
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self._make_texts()

    def _make_table(self) -> None:
        """Ranks by pair in an open table, so that many pairs are looked up at once; and those of two bytes directly."""
        self.bits = max(10, (2 * len(self.rank)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int64)
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        waiting, slots = np.arange(len(pairs)), self._slots(pairs)
        while len(waiting):
            _, first = np.unique(slots, return_index=True)
            placed = first[self.keys[slots[first]] == -1]
            self.keys[slots[placed]], self.ranks[slots[placed]] = pairs[waiting[placed]], waiting[placed]
            left = np.setdiff1d(np.arange(len(waiting)), placed)
            waiting, slots = waiting[left], (slots[left] + 1) & ((1 << self.bits) - 1)
        self.merged_ids = np.array(self.merged, np.int64)
        self.byte_ids = np.array(self.first_ids, np.int64)
        self.byte_ranks = self.ranks_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NO_RANK where there is none."""
        pairs = left << 32 | right
        slots = self._slots(pairs)
        found, keys = np.full(len(pairs), NO_RANK, np.int64), self.keys[slots]
        hit = keys == pairs
        found[hit] = self.ranks[slots[hit]]
        waiting = np.flatnonzero(~hit & (keys != -1))
        while len(waiting):
            slots[waiting] = (slots[waiting] + 1) & ((1 << self.bits) - 1)
            keys = self.keys[slots[waiting]]
            hit = keys == pairs[waiting]
            found[waiting[hit]] = self.ranks[slots[waiting[hit]]]
            waiting = waiting[~hit & (keys != -1)]
        return found

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of one word."""
        return np.frombuffer(self.packed_words([word])[0], np.uint32).tolist()

    def packed_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as 32-bit integers: short words of similar length together, long ones by the heap."""
        made = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        short = order[sizes[order] <= SHORT]
        begin = 0
        while begin < len(short):
            width = int(sizes[short[begin]])
            stop = min(begin + ROWS, int(np.searchsorted(sizes[short], width + width // 4, "right")))
            rows = short[begin:stop]
            self._together([words[r] for r in rows], sizes[rows], rows, made)
            begin = stop
        for row in order[len(short):]:
            made[row] = array("I", self._by_heap([self.first_ids[b] for b in words[row]])).tobytes()
        return made

    def _together(self, words: list[bytes], sizes: np.ndarray, rows: np.ndarray, made: list[bytes]) -> None:
        width = int(sizes.max())
        raw = np.frombuffer(b"".join([word.ljust(width, b"\0") for word in words]), np.uint8).reshape(len(words), width)
        parts, sizes = self.byte_ids[raw], sizes.copy()
        ranks = np.where(np.arange(width - 1) < (sizes - 1)[:, None], self.byte_ranks[raw[:, :-1], raw[:, 1:]], NO_RANK)
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(at)), at]
                ended = least == NO_RANK
            else:
                ended = np.ones(len(rows), bool)
            if ended.any():
                every, wide = parts[ended].astype(np.uint32).tobytes(), 4 * parts.shape[1]
                for row, begin, size in zip(rows[ended].tolist(), range(0, len(every), wide), sizes[ended].tolist()):
                    made[row] = every[begin: begin + 4 * size]
                going = ~ended
                if not going.any():
                    return
                rows, parts, ranks, sizes, at, least = rows[going], parts[going], ranks[going], sizes[going], at[going], least[going]
            each = np.arange(len(rows))
            parts[each, at] = self.merged_ids[least]
            columns = np.arange(parts.shape[1] - 1)  # delete the boundary: what lies beyond it moves up
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            sizes -= 1
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < sizes - 1)
            places = np.concatenate([at[before] - 1, at[after]])
            beside = np.concatenate([before, after])
            ranks[beside, places] = self.ranks_of(parts[beside, places], parts[beside, places + 1])

    def _by_heap(self, parts: list[int]) -> list[int]:
        rank, size = self.rank.get, len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(size - 1)
                if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= size or parts[j] != right:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else size
                if b < size and (found := rank(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (found, a, parts[a], parts[b]))
        return [part for part in parts if part >= 0]

    def _make_texts(self) -> None:
        """Bytes of all tokens in one piece, and decimal digits of all ids, each with its comma."""
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        shown = [f"{i},".encode() for i in range(len(tokens))]
        wide = max(map(len, shown))
        self.digits = np.frombuffer(b"".join(one.ljust(wide, b"\0") for one in shown), np.uint8).reshape(len(shown), wide)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal text joined by commas."""
        digits = self.digits[ids].ravel()
        return digits[digits != 0][:-1].tobytes()

    def decode(self, ids) -> str:
        """The text of the ids, of which there must be some in the vocabulary alone."""
        ids = np.asarray(ids, np.int64)
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.token_starts[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.token_bytes[places].tobytes().decode("utf-8", "replace")


class _Irregular(Exception):
    """White space stands beside a space, so a chunk cannot be looked up on its own."""


class _Chunks(dict):
    """The packed ids of chunks that follow a single space; forgotten as a whole when full."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Irregular
        made = self.make(" " + chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = made
        return made


class Encoder:
    """Encodes whole texts, with a bounded memory of words and chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self._chunk)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            (ids,) = self.vocabulary.packed_words([word.encode("utf-8")])
            if len(word) <= CACHED_LENGTH:
                if len(self.words) >= CACHED_CHUNKS:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._word, WORDS.findall(chunk)))

    def _plain(self, text: str) -> bytes:
        try:
            first, *rest = text.split(" ")
            if rest and (not first or first[-1].isspace()):
                raise _Irregular
            return self._chunk(first) + b"".join(map(self.chunks.__getitem__, rest))
        except _Irregular:
            first, *rest = CUTS.split(text)
            return self._chunk(first) + b"".join([self._chunk(" " + chunk) for chunk in rest])

    def prepare(self, texts: list[str]) -> None:
        """Make the words that are new in these texts, all together; what is not made here is made when it is met."""
        wanted, needed = set(), set()
        for text in texts:
            if self.special is not None and self.special.search(text):
                continue
            first, *rest = text.split(" ")
            needed.update(WORDS.findall(first))
            wanted.update(rest)
        new = wanted.difference(self.chunks)
        if len(self.chunks) + len(new) > CACHED_CHUNKS:
            self.chunks.clear()
            new = wanted
        chunks = [chunk for chunk in new if chunk and len(chunk) <= CACHED_LENGTH and not (chunk[0].isspace() or chunk[-1].isspace())]
        # no word reaches across the left side of a single space: one call finds the words of all
        found = WORDS.findall(" " + " ".join(chunks)) if chunks else []
        needed.update(found)
        missing = needed.difference(self.words)
        if len(self.words) + len(missing) > CACHED_CHUNKS:
            self.words.clear()
            missing = needed
        words = [word for word in missing if len(word) <= CACHED_LENGTH]
        self.words.update(zip(words, self.vocabulary.packed_words([word.encode("utf-8") for word in words])))
        packed = list(map(self._word, found))
        begins = [place for place, word in enumerate(found) if word[0] == " "]  # each chunk, and nothing else, begins so
        for chunk, begin, end in zip(chunks, begins, [*begins[1:], len(found)]):
            self.chunks[chunk] = packed[begin] if end - begin == 1 else b"".join(packed[begin:end])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text. Special tokens in the text are themselves."""
        if self.special is None or not self.special.search(text):
            return np.frombuffer(self._plain(text), np.uint32)
        own = {token: array("I", [i]).tobytes() for token, i in self.vocabulary.special.items()}
        parts = [own[part] if part in own else self._plain(part) for part in self.special.split(text) if part]
        return np.frombuffer(b"".join(parts), np.uint32)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


COLUMNS = [("doc_id", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"),
           ("decoded_sha256", pa.string(), "string")]
IDS = ("ids", pa.list_(pa.int32()), "array<int>")


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text, and their decoding, one row per input row.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    decoded text in UTF-8); with ``with_ids`` also ids. A null text is an empty one: no tokens.
    Rows with a null doc_id, repeated rows and further columns change nothing for other rows.
    There is no shuffle; a task holds one Arrow batch and a bounded number of known words.
    """
    columns = [*COLUMNS, IDS] if with_ids else COLUMNS
    schema = pa.schema([(name, kind) for name, kind, _ in columns])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        encoder = Encoder(known)
        for batch in pieces(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            encoder.prepare(texts)
            ids = [encoder.encode(text) for text in texts]
            decoded = [known.decode(one).encode("utf-8") for one in ids]
            arrays = [batch.column(0).cast(pa.int64()), pa.array(map(len, ids), pa.int64()),
                      pa.array([hashlib.sha256(known.decimal(one)).hexdigest() for one in ids], pa.string()),
                      pa.array([hashlib.sha256(one).hexdigest() for one in decoded], pa.string())]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))))
            yield pa.record_batch(arrays, schema=schema)

    return texts_of(docs).mapInArrow(encode, ", ".join(f"{name} {kind}" for name, _, kind in columns))
