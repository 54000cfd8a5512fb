"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document is the set of its word shingles. Equal sets become one class at once, so copies cost one
row. Of every class the smallest hashes are retained; inverted lists of retained values give the
overlaps of classes, the sketch of the union estimates their similarity, and full sets confirm.

Lists of common values (beyond ``common`` classes) are not paired up. A class most of whose retained
values are rare meets its partners in rare lists, for two sets that share four fifths of their
shingles share rare ones too: it would have to be at least 29 of the 48 smallest values of their
union that only one of them has, where a fifth is expected (odds 1.1e-9).

Of the other classes, the core, whole sets are looked at. Pairs that share a shingle rare in the core meet in
its list. All others share common shingles only. The common part of a set gives a signature of least values,
from ranges of the one hash and for small sets from several orders made of it, and five of these together are the value
of a list, which two sets have in common only if they are alike. There are as many lists as it takes to miss a pair at
the bound with odds below 1e-9. Long lists are then of groups that are alike: each class
is compared with one leader first, those that are left apart with others in turn, and what is then still apart is
compared across the components of a list. A class with more own shingles than half of what may differ
is compared with others that have fewer, never with its like. No list is capped and no value dropped without
the other way taking its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewell.llm.common import discard, pieces, stored, texts_of
from movewell.llm.components import components


@dataclass(frozen=True)
class Settings:
    """words: of a shingle. percent: of the union that two linked sets share at least.

    sketch: hashes retained of each set. probes: of these, how many go to inverted lists. common: a
    list longer than this is not paired up. mostly: a class with a larger share of common probes
    than this is of the core; far below percent, as the probes only estimate the share. slack: how far below the bound an estimate may lie; at 64
    retained values five standard errors. led: of the core's long lists, one in so many has a
    leader. turns: with further leaders, as long as they find links.
    """

    words: int = 4
    percent: int = 80
    sketch: int = 64
    probes: int = 48
    common: int = 32
    mostly: float = 0.4
    slack: float = 0.25
    led: int = 4
    turns: int = 6


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


class Words(dict):
    """The first 8 bytes of the BLAKE2b digest of each word, as a number; forgotten as a whole when full."""

    FULL, LONG = 400_000, 64

    def __missing__(self, word: bytes) -> int:
        made = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.LONG:
            if len(self) >= self.FULL:
                self.clear()
            self[word] = made
        return made


KNOWN = Words()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space alone
    return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles; shorter texts are one shingle of all words."""
    hashed = word_hashes(text or "")
    if not len(hashed):
        return np.zeros(0, np.int64)
    width = min(words, len(hashed))
    value = np.full(len(hashed) - width + 1, width, np.uint64)
    for at in range(width):
        value = value * np.uint64(0xFF51AFD7ED558CCD) + hashed[at: len(hashed) - width + 1 + at]
    return np.unique((_mixed(value) >> np.uint64(1)).astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _print(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, by which texts of one id are told apart) and text."""
    return texts_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, mark, n (size of the whole set), print (of the whole set), sketch (its smallest hashes)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(text.as_py(), settings.words) for text in batch.column(2)]
            yield pa.record_batch([*batch.columns[:2], pa.array(map(len, sets), pa.int64()), pa.array(map(_print, sets), pa.binary()),
                                   _lists([one[: settings.sketch] for one in sets])], names=["doc_id", "mark", "n", "print", "sketch"])

    return rows_of(docs).mapInArrow(sketch, "doc_id long, mark long, n long, print binary, sketch array<bigint>")


FILTER_BITS = 1 << 24


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose mark falls on a bit that some wanted mark sets, so that few other texts move to the join.

    The bits are FILTER_BITS at most, as words of 64: that is the bound of what is broadcast.
    """
    bit = F.pmod("mark", F.lit(FILTER_BITS))
    words = wanted.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(mark, {FILTER_BITS}) % 64 AS INT))").alias("bits"))
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return (rows.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(words), "word")
            .where(F.getbit("bits", (bit % 64).cast("int")) == 1).select(*rows.columns))


def whole_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """id and full set of the wanted classes; wanted: id, and the doc_id and mark of a row that has the set."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.record_batch([batch.column(0), _lists([shingle_set(t.as_py(), settings.words) for t in batch.column(1)])],
                                  names=["id", "members"])

    rows = _likely(rows_of(docs), wanted).join(wanted, ["doc_id", "mark"]).select("id", "text")
    return rows.mapInArrow(gather, "id long, members array<bigint>").dropDuplicates(["id"])  # rows may be repeated


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _estimate(one: Column, other: Column, size: int) -> Column:
    """Share of the union's smallest hashes that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(one, other)), 1, size)
    return F.size(F.array_intersect(F.array_intersect(union, one), other)) / F.size(union)


def _plausible(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule the link out, with the estimate."""
    first = classes.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    second = classes.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    near = F.col("near") >= settings.percent / 100 - settings.slack
    return (pairs.join(first, "a").join(second, "b")
            .select("a", "b", _estimate(F.col("sketch_a"), F.col("sketch_b"), settings.sketch).alias("near")).where(near))


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) whose full sets share the asked percentage of their union."""
    first = sets.select(F.col("id").alias("a"), F.col("members").alias("set_a"))
    second = sets.select(F.col("id").alias("b"), F.col("members").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.select("a", "b").join(first, "a").join(second, "b")
            .where(common * 100 >= (F.size("set_a") + F.size("set_b") - common) * settings.percent).select("a", "b"))


def _ordered(one: Column, other: Column) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    first = labels.select(F.col("id").alias("a"), F.col("component").alias("of_a"))
    second = labels.select(F.col("id").alias("b"), F.col("component").alias("of_b"))
    return (pairs.join(first, "a", "left").join(second, "b", "left")
            .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))


def _marked(rows: DataFrame, settings: Settings, purpose: str) -> DataFrame:
    """Rows (value, ...) of values that several rows have, marked where these are many; a stored table.

    The counts are written first: where they are few, rows of lone values go no further than their scan.
    """
    lengths = stored(rows.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") > 1), f"{purpose}-lengths")
    made = stored(rows.join(lengths, "value").withColumn("common", F.col("length") > settings.common).drop("length"), purpose)
    discard(lengths)
    return made


def _met(lists: DataFrame, settings: Settings, allowed: Column | None = None) -> DataFrame:
    """Pairs (a, b) that meet in a list that is not common; ``allowed`` may compare columns x with x_b."""
    rare = lists.where(~F.col("common")).drop("common")
    other = rare.select("value", *[F.col(c).alias(f"{c}_b") for c in rare.columns if c != "value"])
    fits = (F.col("id") < F.col("id_b")) & _sizes_allow(F.col("n"), F.col("n_b"), settings.percent)
    return (rare.join(other, "value").where(fits if allowed is None else fits & allowed)
            .select(F.col("id").alias("a"), F.col("id_b").alias("b")))


def _bound_allows(percent: int) -> Column:
    """Whether sets that share common shingles only, h of n and h_b of n_b, can share enough."""
    shared = F.least("h", "h_b")
    return shared * 100 >= (F.col("n") + F.col("n_b") - shared) * percent


# --- bands of the core's common shingles -------------------------------------------------------

BAND = 5
SMALL = 7  # sets below 2 ** SMALL shingles take a whole order for every value of their signature


@lru_cache(maxsize=8)
def bands(percent: int) -> int:
    """Bands of which two sets at the bound have one in common, but for odds of 1e-9."""
    return ceil(log(1e-9) / log(1 - (percent / 100) ** BAND))


def signature(values: np.ndarray, size_class: int, wanted: int) -> np.ndarray:
    """Least values of the set in several orders, or in ranges of an order; a range without a value has a number of its own."""
    if size_class < SMALL:
        orders = _mixed(np.arange(1, wanted + 1, dtype=np.uint64))
        return _mixed(values[None, :] + orders[:, None]).min(axis=1)
    bits = min(size_class - 2, 9)
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    made = []
    for order in range(-(-wanted >> bits)):
        ordered = np.sort(_mixed(values + _mixed(np.array([order + 1], np.uint64))))
        first = np.append(ordered, np.uint64(0))[np.searchsorted(ordered, edges)]
        made.append(np.where(first >> np.uint64(64 - bits) == edges >> np.uint64(64 - bits), first, edges + np.uint64(1)))
    return np.concatenate(made)[:wanted]


def band_keys(held: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Keys of a set of n shingles, of which ``held`` are common, by its size class and by the next if that is near."""
    own, number = n.bit_length() - 1, bands(percent)
    keys = []
    for size_class in (own, own + 1):
        if size_class == own or n * 100 >= (1 << size_class) * percent:
            parts = signature(held.astype(np.uint64), size_class, number * BAND).reshape(number, BAND)
            key = np.arange(number, dtype=np.uint64) + np.uint64(size_class << 32)
            for at in range(BAND):
                key = key * np.uint64(0xFF51AFD7ED558CCD) + parts[:, at]
            keys.append(_mixed(key))
    return np.unique(np.concatenate(keys).astype(np.int64))


def _bands(commons: DataFrame, settings: Settings) -> DataFrame:
    """id, n, h and keys; commons: id, n and the common shingles held."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held = [np.asarray(one.values) for one in batch.column(2)]
            keys = [band_keys(one, n, settings.percent) for one, n in zip(held, batch.column(1).to_pylist())]
            yield pa.record_batch([*batch.columns[:2], pa.array(map(len, held), pa.int64()), _lists(keys)], names=["id", "n", "h", "keys"])

    return commons.select("id", "n", "held").mapInArrow(deal, "id long, n long, h long, keys array<bigint>")


def _core_candidates(docs: DataFrame, core_sets: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of the core to be compared; the bands of its sets; and the values of lists too long to be paired up."""
    shingles = core_sets.select("id", F.size("members").cast("long").alias("n"), F.explode("members").alias("value"))
    lists = _marked(shingles, settings, "neardup-core-lists")
    commons = lists.where("common").groupBy("id", "n").agg(F.collect_list("value").alias("held"))  # of one set
    dealt = stored(_bands(commons.where(F.size("held") * 100 >= F.col("n") * settings.percent), settings), "neardup-bands")
    banded = _marked(dealt.select("id", "n", "h", F.explode("keys").alias("value")), settings, "neardup-band-lists")
    allowed = _bound_allows(settings.percent)
    rank = F.struct((F.col("h") / F.col("n")).alias("share"), (-F.col("n")).alias("small"), (-F.col("id")).alias("first"), "h")
    some = banded.where(F.col("common") & (F.pmod("value", F.lit(settings.led)) == 0))
    leaders = some.groupBy("value").agg(F.max(rank).alias("lead")).select(
        "value", (-F.col("lead.first")).alias("id_b"), (-F.col("lead.small")).alias("n_b"), F.col("lead.h").alias("h_b"))
    to_leader = (some.join(leaders, "value").where((F.col("id") != F.col("id_b")) & allowed)
                 .select(*_ordered(F.col("id"), F.col("id_b"))))
    pairs = stored(_met(lists, settings).union(_met(banded, settings, allowed)).union(to_leader).distinct(), "neardup-core-pairs")
    long = stored(banded.where("common").select("value").distinct(), "neardup-long")
    discard(lists, banded)
    return pairs, dealt, long


def _split_lists(dealt: DataFrame, long: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Rows (value, id, n, h, keys, light, component, main) of long lists that hold several components; main has most rows. Stored."""
    light = F.col("n") * (100 - settings.percent) >= (F.col("n") - F.col("h")) * (100 + settings.percent)
    named = dealt.join(labels.select("id", "component"), "id", "left").select(
        "id", "n", "h", "keys", light.alias("light"), F.coalesce("component", "id").alias("component"), F.explode("keys").alias("value"))
    sizes = named.groupBy("value", "component").agg(F.count(F.lit(1)).alias("rows")).join(long, "value", "left_semi")
    largest = stored(sizes.groupBy("value").agg(F.max(F.struct("rows", "component")).alias("most"), F.count(F.lit(1)).alias("kinds"))
                     .where("kinds > 1").select("value", F.col("most.component").alias("main")), "neardup-largest")
    split = stored(named.join(largest, "value"), "neardup-split")
    discard(largest)
    return split


def _fits(settings: Settings) -> Column:
    return _bound_allows(settings.percent) & _sizes_allow(F.col("n"), F.col("n_b"), settings.percent)


def _to_other_leaders(split: DataFrame, turn: int, settings: Settings) -> DataFrame:
    """Two pairs (a, b) at most for each class outside its lists' main components, with members that this turn picks."""
    pick = F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("h").alias("h_b"))
    leaders = split.where("component = main").groupBy("value").agg(F.max(pick).alias("lead")).select("value", "lead.*")
    met = split.where("component <> main").join(leaders, "value").where(_fits(settings))
    ends = met.groupBy("id").agg(F.min(F.struct("draw", "id_b")).alias("one"), F.max(F.struct("draw", "id_b")).alias("other"))
    both = ends.select("id", F.explode(F.array("one.id_b", "other.id_b")).alias("id_b"))
    return both.select(*_ordered(F.col("id"), F.col("id_b"))).distinct()


def _apart(split: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) of long lists whose ends are not in one component; one of the two is outside the list's largest.

    Of the lists that both are in, a pair comes up in one; if that is a short list, it has been compared there.
    """
    columns = [F.col(c).alias(f"{c}_b") for c in ("id", "n", "h", "keys", "light", "component")]
    outside = split.where(F.col("component") != F.col("main"))
    once = F.array_min(F.array_intersect("keys", "keys_b")) == F.col("value")
    fits = (F.col("component") != F.col("component_b")) & _fits(settings) & once
    # two sets with more own shingles than half of what may differ are no pair, so one side is light
    either = split.where("light").join(outside.select("value", *columns), "value").where(fits)
    other = split.where("NOT light").join(outside.where("light").select("value", *columns), "value").where(fits)
    return either.union(other).select(*_ordered(F.col("id"), F.col("id_b"))).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels once these stored links are added; a stored table in place of the one given, which is removed.

    Only the components that the links touch are looked at; without links the labels stay as they are.
    """
    if links.isEmpty():
        return labels
    known = labels.select("id", "component")
    of_a = links.join(known.select(F.col("id").alias("a"), F.col("component").alias("of_a")), "a", "left")
    of_both = of_a.join(known.select(F.col("id").alias("b"), F.col("component").alias("of_b")), "b", "left")
    between = of_both.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(between)
    everyone = known.select("id").union(links.select("a")).union(links.select("b")).distinct()
    own = everyone.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    made = stored(own.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
                  .select("id", F.coalesce("to", "component").alias("component")), "neardup-labels")
    discard(moved, labels)
    return made


def _by_probes(lists: DataFrame, counted: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) that share at least a quarter of the rare probes of the one that has fewer.

    Of these four fifths are expected to be shared at the bound; so few are with odds of 1e-9 at most.
    """
    met = _met(lists, settings).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    rare = counted.select("id", (F.least("n", F.lit(settings.probes)) - F.col("commons")).alias("rare"))
    sized = (met.join(rare.select(F.col("id").alias("a"), F.col("rare").alias("rare_a")), "a", "left")
             .join(rare.select(F.col("id").alias("b"), F.col("rare").alias("rare_b")), "b", "left"))
    return sized.where(F.col("shared") * 4 >= F.least("rare_a", "rare_b")).select("a", "b")


def class_links(docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """(id, component) of the classes that are linked; classes: id, doc_id, mark, n, sketch. A stored table.

    A link inside a component that is already known is not confirmed again, so a group of near
    copies costs about one comparison for each of them instead of one for each pair.
    """
    probed = classes.select("id", "n", F.explode(F.slice("sketch", 1, settings.probes)).alias("value"))
    lists = _marked(probed, settings, "neardup-lists")
    counted = stored(lists.groupBy("id", "n").agg(F.count_if("common").alias("commons")), "neardup-counted")
    core = stored(counted.where(F.col("commons") > F.least("n", F.lit(settings.probes)) * settings.mostly).select("id"), "neardup-core")
    places = classes.select("id", "doc_id", "mark")
    core_places = stored(places.join(core, "id", "left_semi"), "neardup-core-places")
    core_sets = stored(whole_sets(docs, core_places, settings), "neardup-core-sets")
    core_pairs, dealt, long = _core_candidates(docs, core_sets, settings)

    candidates = stored(_by_probes(lists, counted, settings).union(core_pairs).distinct(), "neardup-candidates")
    discard(lists, core_pairs, counted)
    pairs = stored(_plausible(candidates, classes, settings), "neardup-pairs")
    discard(candidates)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(core, "id", "left_anti")
    wanted = stored(places.join(ends, "id", "left_semi"), "neardup-places")
    other_sets = stored(whole_sets(docs, wanted, settings), "neardup-sets")
    sets = core_sets.union(other_sets)

    best = pairs.groupBy(F.col("b").alias("id")).agg(F.max(F.struct("near", (-F.col("a")).alias("other"))).alias("best"))
    first = stored(_confirmed(best.select((-F.col("best.other")).alias("a"), F.col("id").alias("b")), sets, settings), "neardup-links")
    labels = components(first)
    again = stored(_confirmed(_across(pairs, labels), sets, settings), "neardup-links")
    discard(pairs)
    labels = _merged(labels, again)
    links = [first, again]
    for turn in range(settings.turns):
        split = _split_lists(dealt, long, labels, settings)
        asked = _to_other_leaders(split, turn, settings)
        found = stored(_confirmed(_plausible(asked, classes, settings), sets, settings), "neardup-links")
        links.append(found)
        if found.isEmpty():
            break
        labels = _merged(labels, found)
        discard(split)
    else:
        split = _split_lists(dealt, long, labels, settings)
    cross = stored(_apart(split, settings), "neardup-apart")
    last = stored(_confirmed(_plausible(cross, classes, settings), sets, settings), "neardup-links")
    made = _merged(labels, last)
    discard(split, cross, long, dealt, other_sets, core_sets, core_places, core, wanted, *links, last)
    return made


def grouped(docs: DataFrame, settings: Settings = Settings(), one_per_id: bool = False) -> DataFrame:
    """doc_id, mark, n, group of every input row; a stored table. Texts are told apart by id and mark.

    group is null for texts without a word, and the same number for all texts that links connect. With
    ``one_per_id`` all texts of one id are connected, too, and rows without an id have no group.
    """
    known = stored(sketches(docs, settings), "neardup-sketches")
    sound = known.where((F.col("n") > 0) & (F.col("doc_id").isNotNull() if one_per_id else F.lit(True)))
    # a null id stands for itself in a row of another column, so that joins need no case for it
    least = sound.groupBy("n", "print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "sketch")).alias("least"))
    named = least.select("n", "print", "least.none", "least.doc_id", "least.mark", "least.sketch")
    whole = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")))
    classes = stored(named.select(F.xxhash64("print", "n").alias("id"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "mark", "n", "print", "sketch"),
                     "neardup-classes")
    labels = class_links(whole, classes.select("id", "doc_id", "mark", "n", "sketch"), settings)
    of_print = classes.select("print", F.col("n").alias("n_class"), "id")
    rows = known.select("doc_id", "mark", "n", "print")
    if one_per_id:
        several = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min("print").alias("low"), F.max("print").alias("high")).where("low < high").select("doc_id")
        several = stored(several, "neardup-several")
        own = rows.where("n > 0").join(several, "doc_id", "left_semi").join(of_print, "print").select("doc_id", "id").distinct()
        first = own.groupBy("doc_id").agg(F.min("id").alias("a"))
        more = stored(own.join(first, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "neardup-links")
        labels = _merged(labels, more)
        discard(several, more)
    numbered = stored(of_print.join(labels.select("id", "component"), "id", "left").select(
        "print", "n_class", F.coalesce("component", "id").alias("group")), "neardup-numbered")
    mine = (F.col("n") == F.col("n_class")) & (rows["print"] == numbered["print"])
    made = stored(rows.join(numbered, mine & (rows["doc_id"].isNotNull() if one_per_id else F.lit(True)), "left")
                  .select("doc_id", "mark", "n", "group"), "neardup-groups")
    discard(known, classes, labels, numbered)
    return made


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every input row.

    component_id is the smallest doc_id reachable by links, kept says whether it is the row's own.
    Null, empty and wordless texts have an empty set and are linked with nothing. A null doc_id has
    no component and is kept. Rows of one doc_id are one document with the links of all its texts.
    """
    rows = grouped(docs, settings, one_per_id=True)
    least = rows.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    joined = rows.join(least, "group", "left")
    # of an id that has texts with and without words, all rows go with those that have words
    mixed = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_if(F.col("n") == 0).alias("bare"), F.max("group").alias("_group"))
    mixed = stored(mixed.where("bare > 0 AND _group IS NOT NULL").join(least.withColumnRenamed("group", "_group"), "_group")
                   .select("doc_id", F.col("least").alias("least_of_id")), "neardup-mixed")
    component = F.coalesce(F.col("least"), F.col("least_of_id"), F.col("doc_id"))
    return joined.join(mixed, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
