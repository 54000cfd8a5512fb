"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed by shingles.

Test items are short and documents long, so it is containment that counts: the share of an item's
word shingles that a document holds. Items are partitioned by the size of their shingle set, in
powers of two. Of each item the smallest hashes are probes: of a small one as many as it may miss and one
more, so one of them is found for certain; of a large one a fixed number, of which a document that holds
four fifths of the item holds most. Each partition has a bound, its largest probe, and a document looks up
its shingles below the largest bound of the partitions that it is large enough for. Candidates
are confirmed by the exact share of whole shingle sets.

An item shorter than a shingle is looked for as it is: as a run of so many words in a document.

Everything is columns of Spark; there is no Python on the data path.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewell.llm.common import stored, texts_of


@dataclass(frozen=True)
class Settings:
    """words: of a shingle. containment: percent of the item's shingles that make a leak. probes:
    smallest hashes of a large item; at four fifths the chance that a document with a leak has fewer
    than a quarter of 16 is below one in a million. least_share: of these, to be a candidate.
    broadcast_rows: more probes than this are joined by shuffle instead of broadcast, to the same result."""

    words: int = 5
    containment: int = 80
    probes: int = 16
    least_share: float = 0.25
    broadcast_rows: int = 200_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters and digits in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, words: int) -> Column:
    """Distinct hashes of ``words`` neighbouring words; a shorter text is one shingle of all its words."""
    starts = F.when(F.size(hashes) >= words, F.sequence(F.lit(0), F.size(hashes) - words))
    long = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + at) for at in range(words)]))
    short = F.when(F.size(hashes) > 0, F.array(F.xxhash64(F.concat_ws(",", hashes.cast("array<string>")))))
    return F.array_distinct(F.coalesce(long, short, F.array().cast("array<bigint>")))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """id and shingles; the word hashes are a column of their own, so that they are made once."""
    hashed = rows.select("id", word_hashes(F.col("text")).alias("hashes"))
    return hashed.select("id", shingle_hashes(F.col("hashes"), words).alias("shingles"))


def _probes(items: DataFrame, settings: Settings) -> DataFrame:
    """One row per probe: value, item_id, n (shingles), needed (probes to be a candidate), part (power of two of n)."""
    missed = F.floor(F.size("shingles") * (100 - settings.containment) / 100).cast("int") + 1
    sure = missed < settings.probes
    chosen = F.slice(F.array_sort("shingles"), F.lit(1), F.when(sure, missed).otherwise(settings.probes))
    return items.select(
        F.col("id").alias("item_id"), F.size("shingles").alias("n"), F.floor(F.log2(F.size("shingles"))).cast("int").alias("part"),
        F.when(sure, 1).otherwise(F.ceil(F.lit(settings.probes * settings.least_share))).cast("long").alias("needed"),
        F.explode(chosen).alias("value"))


def _bound(size: Column, bounds: dict[int, int], settings: Settings) -> Column:
    """The largest bound of the partitions whose items a document of this many shingles can hold enough of."""
    fits, highest = F.lit(None).cast("long"), None
    for part in sorted(bounds):
        highest = bounds[part] if highest is None else max(highest, bounds[part])
        fits = F.when(size * 100 >= (1 << part) * settings.containment, F.lit(highest)).otherwise(fits)
    return fits


def _short_leaks(texts: DataFrame, short: DataFrame) -> DataFrame:
    """id and item_id where a document holds all words of a short item in a row; short: item_id, width, run (a hash)."""
    widths = [row["width"] for row in short.select("width").distinct().collect()]  # fewer than the words of a shingle
    if not widths:
        return short.select(F.col("item_id").alias("id"), "item_id")
    hashed = texts.select("id", word_hashes(F.col("text")).alias("hashes"))

    def runs_of(width: int) -> Column:
        runs = F.when(F.size("hashes") >= width, shingle_hashes(F.col("hashes"), width)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(runs, lambda run: F.struct(F.lit(width).alias("width"), run.alias("run")))

    runs = F.concat(*map(runs_of, sorted(widths)))
    looked = hashed.select("id", F.explode(runs).alias("own")).select("id", "own.width", "own.run")
    return looked.join(short, ["width", "run"]).select("id", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, matched, n_item, containment (percent, rounded down) of every leak.

    One row for each pair of a document and an item of which it holds the asked percentage; of an item shorter
    than a shingle, all its words in a row (one of one). Null,
    empty and wordless texts hold nothing and are no items; rows with a null id take no part. Rows
    of one id are looked at each for itself, and the highest share counts.
    """
    named = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("id").isNotNull())
    worded = named.select("id", "text", F.size(word_hashes(F.col("text"))).alias("width"))
    items = stored(_sets(worded.where(F.col("width") >= settings.words), settings.words).distinct(), "leak-items")
    brief = worded.where((F.col("width") > 0) & (F.col("width") < settings.words)).select(
        F.col("id").alias("item_id"), "width", word_hashes(F.col("text")).alias("hashes"))
    short = stored(reduce(DataFrame.union, [brief.where(F.col("width") == width).select(
        "item_id", "width", F.get(shingle_hashes(F.col("hashes"), width), F.lit(0)).alias("run")) for width in range(1, settings.words)]), "leak-short")
    texts = texts_of(docs).select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull())
    briefly = _short_leaks(texts, short).select("id", "item_id", F.lit(1).cast("long").alias("matched"),
                                                F.lit(1).cast("long").alias("n_item"), F.lit(100).alias("containment"))

    probes = stored(_probes(items, settings), "leak-probes")
    bounds = {row["part"]: row["highest"] for row in probes.groupBy("part").agg(F.max("value").alias("highest")).collect()}
    few = probes.count() <= settings.broadcast_rows
    looked = _sets(texts, settings.words).select("id", F.size("shingles").alias("size"), "shingles").select(
        "id", "size", F.explode(F.filter("shingles", lambda value: value <= _bound(F.col("size"), bounds, settings))).alias("value"))
    fits = F.col("size") * 100 >= F.col("n") * settings.containment
    hits = (looked.join(F.broadcast(probes) if few else probes, "value").where(fits).groupBy("id", "item_id")
            .agg(F.count(F.lit(1)).alias("hit"), F.min("needed").alias("needed")))
    candidates = stored(hits.where(F.col("hit") >= F.col("needed")).select("id", "item_id"), "leak-candidates")
    wanted = candidates.select(F.col("id").alias("wanted")).distinct()
    suspects = stored(_sets(texts.join(wanted, F.col("id") == F.col("wanted"), "left_semi"), settings.words), "leak-suspects")
    both = (candidates.join(suspects, "id")
            .join(items.select(F.col("id").alias("item_id"), F.col("shingles").alias("of_item")), "item_id"))
    shared = F.size(F.array_intersect("shingles", "of_item"))
    percent = F.floor(shared * 100 / F.size("of_item")).cast("int")
    long = (both.select("id", "item_id", shared.cast("long").alias("matched"),
                        F.size("of_item").cast("long").alias("n_item"), percent.alias("containment"))
            .where(F.col("matched") * 100 >= F.col("n_item") * settings.containment))
    return (long.unionByName(briefly).withColumnRenamed("id", "doc_id").groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "matched", "n_item")).alias("best"))
            .select("doc_id", "item_id", "best.matched", "best.n_item", "best.containment"))
