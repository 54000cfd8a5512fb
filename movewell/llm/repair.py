"""Token ids in grammar-compressed shards: Re-Pair, with rules and expansion lengths.

Documents in ascending id order are cut into shards of bounded size. In a shard the most frequent
pairs of neighbouring symbols are replaced by new symbols, again and again until no pair is left that occurs
``least`` times, never across the end of a document. The places of frequent pairs are kept in lists and the symbols
linked with their neighbours, so a round counts and changes only what the round before has touched; it replaces
the pairs at least a sixteenth as frequent as the most frequent one. In a run of one symbol it replaces every second
occurrence, so a run of any length is halved by each round. A shard holds its rules, the length to which each expands,
where each document begins in the symbols, and the symbols. So any stretch of ids of any document is read without
expanding what lies before it.

A shard, all integers little-endian: the magic, then as unsigned 32-bit the numbers of documents,
rules and symbols and the symbol of the first rule; rules as pairs of symbols, their expansion
lengths, the first symbol of each document and of the end, and the symbols, each unsigned 32-bit.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from movewell.llm.bpe import printable_bytes
from movewell.llm.common import pieces, texts_of
from movewell.session import shared_dir

MAGIC = b"RPR1"
END = 1
MARK = "<|"
NO_RULE = np.iinfo(np.int32).max
BUCKET_BITS = 20
NEAR = 16  # a round replaces pairs up to so many times less frequent than the most frequent one
CACHED = 1_150_000
CACHED_LENGTH = 64
TEXTS = 1024  # of a batch, whose chunks are looked up once
#: Printable ASCII and single Latin letters, each of which is its own normal form and has one lower-case letter; and a
#: break between chunks.
PLAIN = re.compile("[\n!-~\u00c0-\u012f\u0131-\u017f]+")
#: Fixed value: the pattern by which this vocabulary's words are cut, for lower-case plain characters; a break is a word of its own.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|\n|[^\na-z0-9\u00df-\u00f6\u00f8-\u017f]+")
NO_ID = 0xFFFFFFFF  # which no token has
BREAK = struct.pack("=I", NO_ID)


@dataclass(frozen=True)
class Settings:
    """shard_ids: a shard is closed at so many ids (a longer document is a shard of its own). least:
    occurrences of a pair that is replaced."""

    shard_ids: int = 1_000_000
    least: int = 8


def bucket_of(pair: np.ndarray, bits: int) -> np.ndarray:
    return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def frequent(pairs: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur often enough, the places in ``pairs`` where they do, and the number of each place's pair.
    width: bits of a symbol."""
    bits = min(BUCKET_BITS, max(8, len(pairs).bit_length()))
    bucket = bucket_of(pairs, bits)
    # a frequent pair lies in a bucket at least as full, so no other pairs need sorting
    places = np.flatnonzero((np.bincount(bucket, minlength=1 << bits) >= least)[bucket])
    own, bits = pairs[places], len(pairs).bit_length()
    if 2 * width + bits < 64:  # pair and place in one number, which sorts faster
        order = np.sort(own << bits | places)
        own, places = order >> bits, order & ((1 << bits) - 1)
    else:
        order = np.argsort(own, kind="stable")
        own, places = own[order], places[order]
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1])[:len(own)])
    counts = np.diff(begins, append=len(own))
    often = counts >= least
    return own[begins[often]], places[np.repeat(often, counts)], np.repeat(np.arange(often.sum()), counts[often])


def compress(ids: np.ndarray, ends: np.ndarray, settings: Settings = Settings()) -> bytes:
    """A shard of the documents that end before each of ``ends``."""
    size = len(ids)
    symbols = np.append(ids, 0).astype(np.int64)
    last, alive = np.zeros(size + 1, bool), np.ones(size + 1, bool)
    last[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] = True
    after, before = np.arange(1, size + 2), np.arange(-1, size)  # place ``size`` is beyond the end; -1 is the same place
    before[0] = size
    hit, touched = np.full(size + 1, NO_RULE, np.int32), np.zeros(size + 1, bool)
    base = int(ids.max()) + 1 if size else 1
    rules: list[np.ndarray] = []
    next_symbol = base
    width = (base + size).bit_length()  # every rule saves a symbol, so there are fewer rules than ids
    right = (1 << width) - 1
    inner = np.flatnonzero(~last[:-1])
    pairs, found, number = frequent(symbols[inner] << width | symbols[inner + 1], width, settings.least)
    at = inner[found]  # the lists of occurrences: place, and number of its pair
    while True:
        counts = np.bincount(number, minlength=len(pairs))
        often = counts >= settings.least
        if not often.any():
            break
        stays = often[number]
        at, number, pairs, counts = at[stays], (np.cumsum(often) - 1)[number[stays]], pairs[often], counts[often]
        chosen = np.flatnonzero(counts * NEAR >= counts.max())
        rank = np.full(len(pairs), NO_RULE, np.int32)
        # pairs equally frequent in a mixed order: by value, copies of ascending ids would be joined from one end, a pair a round
        mixed = bucket_of(pairs[chosen], BUCKET_BITS)
        rank[chosen[np.lexsort((pairs[chosen], mixed, -counts[chosen]))]] = np.arange(len(chosen))
        own = rank[number]
        places, own = at[own < NO_RULE], own[own < NO_RULE]
        order = np.empty(len(chosen), np.int64)
        order[rank[chosen]] = pairs[chosen]
        twins = np.flatnonzero((order >> width == order & right)[own])
        if len(twins):  # a run of one symbol: every second occurrence, all in this round and by one rule
            twins = twins[np.argsort(places[twins])]
            follows = np.append(False, before[places[twins[1:]]] == places[twins[:-1]])
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(twins))))
            kept = np.ones(len(places), bool)
            kept[twins[(np.arange(len(twins)) - first) % 2 == 1]] = False
            places, own = places[kept], own[kept]
        hit[places] = own
        # of overlapping occurrences the more frequent pair wins, of equal ones the earlier
        wins = (own < hit[before[places]]) & (own <= hit[after[places]])
        hit[places] = NO_RULE
        places, own = places[wins], own[wins]
        applied = np.bincount(own, minlength=len(chosen)) > 0
        used = order[applied]
        rules.append(np.stack([used >> width, used & right], axis=1))
        taken = after[places]  # joined with the symbol before it
        symbols[places] = next_symbol + (np.cumsum(applied) - 1)[own]
        next_symbol += len(used)
        last[places] = last[taken]
        alive[taken] = False
        after[places] = after[taken]
        before[after[places]] = places
        before[size] = size
        beside = before[places]
        for changed in (places, taken, beside):
            touched[changed] = True
        stays = ~touched[at]
        touched[taken] = False
        touched[size] = False
        fresh = np.sort(np.concatenate([places, beside]))
        fresh = fresh[np.append(True, fresh[1:] != fresh[:-1]) & touched[fresh] & ~last[fresh] & alive[fresh]]
        for changed in (places, beside):
            touched[changed] = False
        more, found, named = frequent(symbols[fresh] << width | symbols[after[fresh]], width, settings.least)
        at, number = np.concatenate([at[stays], fresh[found]]), np.concatenate([number[stays], named + len(pairs)])
        pairs = np.concatenate([pairs, more])
    symbols = symbols[:-1][alive[:-1]]
    grammar = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths = np.ones(base + len(grammar), np.int64)
    done = base
    for layer in rules:  # a layer's symbols are of the layers before
        lengths[done: done + len(layer)] = lengths[layer].sum(axis=1)
        done += len(layer)
    sizes = np.diff(np.concatenate([[0], ends]))
    expanded = np.concatenate([[0], np.cumsum(lengths[symbols])])
    starts = np.searchsorted(expanded, np.concatenate([[0], np.cumsum(sizes)]))
    head = MAGIC + struct.pack("<4I", len(ends), len(grammar), len(symbols), base)
    return head + b"".join(part.astype("<u4").tobytes() for part in (grammar, lengths[base:], starts, symbols))


class Shard:
    """Random access to the ids of a shard's documents."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        documents, rules, size, self.base = struct.unpack_from("<4I", payload, 4)
        words = np.frombuffer(payload, "<u4", offset=20).astype(np.int64)
        self.rules = words[: 2 * rules].reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), words[2 * rules: 3 * rules]])
        self.starts = words[3 * rules: 3 * rules + documents + 1]
        # what every rule expands to, one after the other, behind the plain ids, which expand to themselves
        flat = self._expanded(np.arange(self.base, self.base + rules))
        self.table = np.concatenate([np.arange(self.base), flat])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.symbols = words[3 * rules + documents + 1:]
        if len(self.symbols) != size:
            raise ValueError("a shard is cut short")

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.lengths[symbols]
        ends = np.cumsum(sizes)
        return self.table[np.repeat(self.places[symbols] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        while (rule := symbols >= self.base).any():
            widths = 1 + rule
            ends = np.cumsum(widths)
            out = np.empty(int(ends[-1]), np.int64)
            out[ends - widths] = np.where(rule, 0, symbols)
            pairs = self.rules[symbols[rule] - self.base]
            out[ends[rule] - 2], out[ends[rule] - 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols

    def ids(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of one document; only symbols that reach there are expanded."""
        own = self.symbols[self.starts[document]: self.starts[document + 1]]
        ends = np.cumsum(self.lengths[own])
        stop = int(ends[-1]) if len(ends) and stop is None else stop or 0
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[first - 1]) if first else 0
        return self.expand(own[first:last])[start - skipped: stop - skipped]

    def every(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each document."""
        sums = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        return self.expand(self.symbols), np.diff(sums[self.starts])


@lru_cache(maxsize=2)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class Known(dict):
    """The ids of chunks and of words; of a string that is both they are the same. Forgotten as a whole when full."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.tokenize = self.tokenizer.model.tokenize
        shown = printable_bytes()
        self.shown = {ord(c): "".join(shown[b] for b in c.encode("utf-8")) for c in map(chr, range(0xA0, 0x180))}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marked = all(token.content.startswith(MARK) for token in added)  # so that what lacks the mark holds none

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _model(self, words: list[str]) -> list[bytes]:
        tokenize, shown = self.tokenize, self.shown
        return [array("I", [token.id for token in tokenize(word if word.isascii() else word.translate(shown))]).tobytes()
                for word in words]

    def _plain(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks of plain characters and of the words new in them. All are cut in one go, with a break after each."""
        words = WORDS.findall("\n".join(chunks).lower() + "\n")
        distinct = dict.fromkeys(words)
        del distinct["\n"]
        made = dict(zip(distinct, map(self.get, distinct)))
        fresh = [word for word, ids in made.items() if ids is None]
        kept = dict(zip(fresh, self._model(fresh)))
        made.update(kept)
        made["\n"] = BREAK
        raw = b"".join(map(made.__getitem__, words))
        ends = (4 * np.flatnonzero(np.frombuffer(raw, np.uint32) == NO_ID)).tolist()
        kept.update((chunk, raw[begin:end]) for chunk, begin, end in zip(chunks, [0, *(end + 4 for end in ends)], ends))
        return kept

    def of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks. What is new is made for all of them together and kept afterwards."""
        ids = list(map(self.get, chunks))
        new = [at for at, own in enumerate(ids) if own is None]
        if not new:
            return ids
        plain, odd = [chunks[at] for at in new], []
        if not self._are_plain("\n".join(plain)):
            odd = [chunk for chunk in plain if not self._are_plain(chunk)]
            plain = [chunk for chunk in plain if self._are_plain(chunk)]
        kept = self._plain(plain)
        kept.update(zip(odd, self.whole(odd)))
        for at in new:
            ids[at] = kept[chunks[at]]
        if len(self) + len(kept) > CACHED:
            self.clear()
        self.update(islice(((key, own) for key, own in kept.items() if len(key) <= CACHED_LENGTH), CACHED))
        return ids

    def _are_plain(self, chunks: str) -> bool:
        return self.marked and MARK not in chunks and PLAIN.fullmatch(chunks) is not None


class ChunkEncoder:
    """The library's ids of whole texts. Words never reach across white space, so the chunks between ASCII
    white space are told apart by Arrow, and each distinct one of a batch is looked up once. What is new is
    encoded and remembered, up to a bound at which all is forgotten.

    A chunk of plain characters, which the vocabulary's normalizer only lower-cases, is cut into
    words here, and each new word goes straight to the library's model; the words of many chunks are
    the same. Any other chunk goes through the whole library, other white space in it too.
    """

    def __init__(self, path: str):
        self.known = Known(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers of the machine, which are little-endian."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = cut.values.dictionary_encode()
        ids = self.known.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        chunks = coded.indices.to_numpy()
        ends = np.cumsum(own := sizes[chunks])
        places = np.repeat(begins[chunks] - (ends - own), own)
        places += np.arange(len(places))
        raw = np.frombuffer(b"".join(ids), np.uint32)[places].tobytes()
        bounds = (4 * np.append(0, ends)[cut.offsets.to_numpy()]).tolist()
        return [raw[begin:end] for begin, end in pairwise(bounds)]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker, with the words that it knows."""
    return ChunkEncoder(path)


SHARDS = "part int, place int, doc_ids array<bigint>, n_ids long, payload binary"


def write_shards(docs: DataFrame, path: str, settings: Settings = Settings()) -> str:
    """Write shards of every whole text's ids, with id 1 after each, and return their folder.

    Documents are ordered by doc_id (null first), then text. A null text is empty: the end id alone.
    Rows are dealt by ranges of the id, so a task holds one shard and one Arrow batch. A shard's row
    names its task (part), whose number follows the ranges, and its place among that task's shards.
    """
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = np.array([END], "<u4").tobytes()
        task, place = TaskContext.get().partitionId(), count()
        names, parts, size = [], [], 0

        def closed():
            ids = np.frombuffer(b"".join(parts), "<u4")
            ends = np.cumsum([len(part) // 4 for part in parts])
            return pa.record_batch([pa.array([task], pa.int32()), pa.array([next(place)], pa.int32()),
                                    pa.array([names], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                                    pa.array([compress(ids, ends, settings)], pa.binary())],
                                   names=["part", "place", "doc_ids", "n_ids", "payload"])

        for batch in pieces(batches, TEXTS):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                if parts and size + len(ids) // 4 + 1 > settings.shard_ids:
                    yield closed()
                    names, parts, size = [], [], 0
                names.append(name)
                parts.append(ids + end)
                size += len(parts[-1]) // 4
        if parts:
            yield closed()

    spark = docs.sparkSession
    folder = shared_dir(spark, "repair")
    dealt = texts_of(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(shards, SHARDS).write.option("compression", "zstd").parquet(folder)
    return folder


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards.

    start is the number of ids of all documents before it in the order of writing. Running sums are
    taken over the shards of each writing task, over one row for each such task, and within a shard.
    """
    stored = spark.read.schema(SHARDS).parquet(folder)
    place = stored.select("part", "place", "n_ids")
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = place.groupBy("part").agg(F.sum("n_ids").alias("of_part")).select("part", F.sum("of_part").over(across).alias("earlier"))
    starts = (place.withColumn("own", F.sum("n_ids").over(within)).join(parts, "part")
              .select("part", "place", (F.coalesce("earlier", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("before")))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, place, names, payload in zip(*batch.columns):
                ids, sizes = Shard(payload.as_py()).every()
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.record_batch([pa.array([part.as_py()] * len(sizes), pa.int32()), pa.array([place.as_py()] * len(sizes), pa.int32()),
                                       names.values, pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                                      names=["part", "place", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = stored.select("part", "place", "doc_ids", "payload").mapInArrow(
        expand, "part int, place int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "place"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
