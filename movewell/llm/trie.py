"""The trie of conversation prefixes, its subtree totals rolled up by bands of depth.

Only a digest and a word count of every turn move. The key of a prefix is a digest of sums: each turn adds
six numbers drawn from its place and digest, so sums of blocks add up and no conversation, however long, has
to be walked by one task. Nodes are the distinct keys.

Totals of subtrees go up in bands of fixed height. Inside a band a node is copied to its ancestors of the
same band only, at most ``height`` of them. The tops of bands then form a trie that is ``height`` times
flatter and is rolled up in the same way; the whole total of a top goes back to the ancestors, within one
band, of its parent. So rounds grow with the logarithm of the depth, and copies with the height.
"""

from __future__ import annotations

from dataclasses import dataclass

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from movewell.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Numbers that a turn adds to a key, of 40 bits each: sums of 8 million turns stay exact.
LIMBS = 6
SUMS = [f"k{n}" for n in range(LIMBS)]


@dataclass(frozen=True)
class Settings:
    """group, borrow: a conversation c takes crc32(c) modulo ``borrow`` first turns from c - c % group.
    height: of a band. block: places whose sums one task runs through; a longer conversation takes several."""

    group: int = 20
    borrow: int = 4
    height: int = 8
    block: int = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest and words of every turn, in order of turn (null first), then digest.

    The order within a long conversation is cut into ranges, numbered apart and put together by their counts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).where("conv_id IS NOT NULL")
    # the digests are made once: cutting ranges reads its input twice
    cut = stored(stored(named, "trie-turns").repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "trie-parts")
    sizes = cut.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")).where("start > 0")
    within = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest")
    return (cut.withColumn("row", F.row_number().over(within) - 1).join(starts, ["conv_id", "part"], "left")
            .select("conv_id", (F.coalesce("start", F.lit(0)) + F.col("row")).alias("place"), "digest", "words"))


def rebuilt(turns: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of the rebuilt conversations, and (conv_id, depth from 1, digest, words) of their turns."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % settings.group).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % settings.borrow).alias("asked"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = stored(convs.join(lengths, "base", "left").withColumn(
        "head", F.least("asked", F.coalesce("of_base", F.lit(0)))), "trie-conversations")
    heads = turns.where((F.col("conv_id") % settings.group == 0) & (F.col("place") < settings.borrow - 1)).select(
        F.col("conv_id").alias("base"), "place", "digest", "words")
    borrowed = convs.join(heads, "base").where("place < asked").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    kept = turns.join(convs.select("conv_id", "asked", "head"), "conv_id").where("place >= asked").select(
        "conv_id", (F.col("place") - F.col("asked") + F.col("head") + 1).alias("depth"), "digest", "words")
    length = F.col("head") + F.greatest(F.lit(0), F.col("own") - F.col("asked"))
    return convs.select("conv_id", length.alias("length")), kept.unionByName(borrowed)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth, *sums), 256), 1, 32))


def prefixes(lengths: DataFrame, turns: DataFrame, settings: Settings) -> DataFrame:
    """conv_id, depth, key, parent (key of the prefix before), words and last, of every prefix from depth 0."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")), 256)
    drawn = turns.select("conv_id", "depth", "words", F.expr(f"depth div {settings.block}").alias("block"), *[
        F.conv(F.substring(mixed, 10 * n + 1, 10), 16, 10).cast("long").alias(f"d{n}") for n in range(LIMBS)])
    many = lengths.where(F.col("length") >= settings.block).select("conv_id")
    parts = drawn.join(many, "conv_id", "left_semi").groupBy("conv_id", "block").agg(*[F.sum(f"d{n}").alias(f"d{n}") for n in range(LIMBS)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv_id", "block", *[F.sum(f"d{n}").over(before).alias(f"o{n}") for n in range(LIMBS)]).where("block > 0")
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = drawn.select("*", *[F.sum(f"d{n}").over(running).alias(f"r{n}") for n in range(LIMBS)]).join(
        offsets, ["conv_id", "block"], "left").select("conv_id", "depth", "words", *[f"d{n}" for n in range(LIMBS)], *[
            (F.col(f"r{n}") + F.coalesce(f"o{n}", F.lit(0))).alias(k) for n, k in enumerate(SUMS)])
    nothing = [F.lit(0).cast("long")] * LIMBS
    keyed = summed.select("conv_id", "depth", _key(F.col("depth"), [F.col(k) for k in SUMS]).alias("key"),
                          _key(F.col("depth") - 1, [F.col(k) - F.col(f"d{n}") for n, k in enumerate(SUMS)]).alias("parent"), "words")
    roots = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), _key(F.lit(0).cast("long"), nothing).alias("key"),
                           F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    return keyed.unionByName(roots).join(lengths, "conv_id").withColumn("last", F.col("depth") == F.col("length")).drop("length")


def _ends(paths: DataFrame) -> DataFrame:
    """key and the digest of the ids, ascending and joined by commas, of the conversations that end there.

    The ids of a node are cut into ranges and joined within each; the digest then runs over the ranges in
    order, one after the other, holding one of them at a time.
    """
    ids = paths.where("last").select("key", "conv_id").repartitionByRange("key", "conv_id").withColumn("part", F.spark_partition_id())
    pieces = ids.groupBy("key", "part").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for row in batch.to_pylist():
                if row["key"] == key:
                    state.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = row["key"], hashlib.sha256()
                state.update(row["ids"].encode("ascii"))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


TOTALS = ["n_leaves", "saved_tokens"]


def _rolled_up(paths: DataFrame, values: DataFrame, deepest: int, settings: Settings, step: int = 1) -> DataFrame:
    """key and subtree totals of the nodes whose depth is a multiple of ``step``.

    paths: (conv_id, depth, key) of the conversations that nodes are named after; values: (key, conv_id, depth,
    totals) of the nodes, with what each adds itself.
    """
    band = step * settings.height
    upward = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    chains = stored(paths.where(F.col("depth") % step == 0).withColumn("band", F.expr(f"depth div {band}")).select(
        "conv_id", "depth", F.collect_list("key").over(upward).alias("above")), "trie-chains")
    placed = values.join(chains, ["conv_id", "depth"])
    inside = placed.select(F.explode("above").alias("key"), *TOTALS).groupBy("key").agg(*[F.sum(c).alias(c) for c in TOTALS])
    if deepest < band:
        return inside
    inside = stored(inside, "trie-totals")
    tops = values.where(F.col("depth") % band == 0).select("key", "conv_id", "depth")
    whole = stored(_rolled_up(paths, tops.join(inside, "key"), deepest, settings, band), "trie-tops")
    # the chain of a top's parent ends a band: its depth is the top's less one step, in the same conversation
    carried = (tops.where("depth > 0").join(whole, "key").select("conv_id", (F.col("depth") - step).alias("depth"), *TOTALS)
               .join(chains, ["conv_id", "depth"]).select(F.explode("above").alias("key"), *TOTALS))
    return inside.unionByName(carried).groupBy("key").agg(*[F.sum(c).alias(c) for c in TOTALS])


def trie(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation. Turns that are equal in their order go by the SHA-256 of
    the length of the role, a colon, role and text; repeated rows are turns of their own. A conversation whose turns
    all lie in a missing base's place has none and ends at the root. Without conversations there is no node.
    Other columns change nothing.
    """
    turns = stored(turns_of(conversations), "trie-numbered")
    lengths, told = rebuilt(turns, settings)
    lengths = stored(lengths, "trie-lengths")
    paths = stored(prefixes(lengths, told, settings), "trie-paths")
    nodes = stored(paths.groupBy("key", "depth", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words")), "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    grown = stored(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-grown")
    values = grown.select("key", "conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    named = paths.select("conv_id", "depth", "key").join(nodes.select("conv_id").distinct(), "conv_id", "left_semi")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = _rolled_up(named, values, deepest, settings)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (grown.join(totals, "key").join(_ends(paths), "key", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
