"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, whatever they are, is the
unlabelled text. A linear classifier over the presence of words and word beginnings is trained with
the class-prior-corrected risk

    prior * R+(f) + max(0, Ru(f) - prior * R-(f)),    R+, R- over positives, Ru over unlabelled,

with a logistic loss and the non-negative correction: where the second term falls below zero, its
gradient is stepped against. Which words are looked at is found from document counts over the whole
training sample, by Spark; the fit itself is numpy over a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movewell.llm.common import bounded_batches, fold, pieces, share_kept, stored, table, texts_of

BUCKETS = 1 << 18
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, features and fit.

    positives, unlabelled: expected rows of each kind in the sample; positives by hash of the id, one text for
    each, unlabelled rows by hash of id and text, equal rows once.
    features: words and beginnings looked at, those whose shares differ by most standard errors, and
    by at least ``least_z``. steps, rate, decay: of the fit.
    """

    positives: int = 3_000
    unlabelled: int = 9_000
    features: int = 384
    least_z: float = 4.5
    steps: int = 600
    rate: float = 0.1
    decay: float = 5e-5


def word_buckets(text: str) -> np.ndarray:
    """The distinct hashed words, and beginnings of words, of a whole text, sorted."""
    words = set(WORD.findall(text.lower()))
    words.update(*[{w[:n] + "*" for w in words if len(w) >= n} for n in BEGINNINGS])
    hashed = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % BUCKETS
    return np.unique(hashed)


def choose_features(positive: np.ndarray, unlabelled: np.ndarray, sizes: tuple[int, int], settings: Settings) -> np.ndarray:
    """Buckets whose share among positives exceeds that among unlabelled rows by enough standard errors."""
    n_pos, n_unl = sizes
    p, u = positive / max(n_pos, 1), unlabelled / max(n_unl, 1)
    pooled = (positive + unlabelled + 1) / (n_pos + n_unl + 2)
    z = (p - u) / np.sqrt(pooled * (1 - pooled) * (1 / max(n_pos, 1) + 1 / max(n_unl, 1)))
    order = np.lexsort((np.arange(len(z)), -z))[: settings.features]
    return np.sort(order[z[order] >= settings.least_z])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, settings: Settings) -> np.ndarray:
    """Weights (last: the constant) minimising the non-negative risk by Adam over full batches.

    The rows are zeros and ones. As floats they are held once.
    """
    pos, unl = (np.hstack([x[np.lexsort(x.T)] if x.size else x, np.ones((len(x), 1))]) for x in (positive, unlabelled))
    weights = np.zeros(pos.shape[1])
    weights[-1] = -1.0
    if not len(pos) or not len(unl):
        return weights
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, settings.steps + 1):
        f_pos, f_unl = pos @ weights, unl @ weights
        # logistic loss of calling it positive: log(1 + exp(-f)); of calling it negative: log(1 + exp(f))
        up = -prior * (_sigmoid(-f_pos) @ pos) / len(pos)
        rest = np.logaddexp(0, f_unl).mean() - prior * np.logaddexp(0, f_pos).mean()
        down = (_sigmoid(f_unl) @ unl) / len(unl) - prior * (_sigmoid(f_pos) @ pos) / len(pos)
        gradient = (up + down if rest >= 0 else -down) + settings.decay * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def _sigmoid(value):
    return 1 / (1 + np.exp(-np.clip(value, -40, 40)))


def presence(has: pa.ChunkedArray, chosen: np.ndarray) -> np.ndarray:
    """A row of zeros and ones for each list, one where it names a bucket of ``chosen``; a byte each, as the driver holds them all."""
    x = np.zeros((len(has), len(chosen)), np.uint8)
    rows = np.repeat(np.arange(len(has)), pc.list_value_length(has).to_numpy())
    x[rows, np.searchsorted(chosen, pc.list_flatten(has).to_numpy())] = 1
    return x


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        found = np.isin(self.features, word_buckets(text or ""), assume_unique=True)
        return float(_sigmoid(self.weights[:-1][found].sum() + self.weights[-1]))


def _positives(labels: DataFrame, settings: Settings) -> tuple[DataFrame, float]:
    """Ids of a bounded sample of toxic documents, and their share among the labels learned from."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 3) != 1))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = known.agg(F.count_if("toxic").alias("toxic"), F.count(F.lit(1)).alias("every")).first()
    share = F.lit(min(1.0, settings.positives / max(counts["toxic"], 1)))
    sample = known.where(F.col("toxic") & share_kept(F.col("doc_id"), share)).select("doc_id")
    return stored(sample, "toxic-ids"), counts["toxic"] / max(counts["every"], 1)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from documents and labels outside the held-out fold (crc32 of the id mod 3 is 1).

    To the driver come counts per hashed word (at most ``BUCKETS`` rows) and, of the sample, which
    of the chosen words each document has. Rows with null ids or labels teach nothing; of a label
    given twice the toxic one counts. Without positives every score is below one half.
    """
    positives, prior = _positives(labels, settings)
    known = texts_of(docs).where(fold("doc_id", 3) != 1)
    share = F.lit(min(1.0, settings.unlabelled / max(known.select("doc_id").count(), 1)))
    mark = F.xxhash64("doc_id", "text")
    toxic = known.join(positives, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    others = known.withColumn("mark", mark).where(share_kept(F.col("mark"), share, "unlabelled")).dropDuplicates(["doc_id", "mark"])
    kinds = [toxic.select("doc_id", "text", F.lit(True).alias("positive"), F.lit(False).alias("unlabelled")),
             others.select("doc_id", "text", F.lit(False), F.lit(True))]
    rows = kinds[0].union(kinds[1])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_buckets(text.as_py() or "").tolist() for text in batch.column(1)]
            yield pa.record_batch([batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.int64()))],
                                  names=["positive", "unlabelled", "buckets"])

    found = stored(rows.mapInArrow(buckets, "positive boolean, unlabelled boolean, buckets array<bigint>"), "toxic-sample")
    both = [F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")]
    counted = found.select("positive", "unlabelled", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*both).toArrow()
    sizes = found.agg(*both).first()
    positive, unlabelled = np.zeros(BUCKETS), np.zeros(BUCKETS)
    positive[counted["bucket"].to_numpy()], unlabelled[counted["bucket"].to_numpy()] = counted["p"].to_numpy(), counted["u"].to_numpy()
    chosen = choose_features(positive, unlabelled, (sizes["p"], sizes["u"]), settings)
    wanted = F.array(*[F.lit(int(b)) for b in chosen]).cast("array<bigint>")
    present = found.select("positive", "unlabelled", F.array_intersect("buckets", wanted).alias("has")).toArrow()
    x = presence(present["has"], chosen)
    return Model(chosen, fit(x[present["positive"].to_numpy()], x[present["unlabelled"].to_numpy()], prior, settings))


REJECTED_FROM = 0.7  # Fixed value: the score from which a document is called toxic.


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns as a struct) and score of every whole text. Texts are scored where they are read."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = [model.score(text.as_py()) for text in pc.struct_field(batch.column(0), "text")]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def score_documents(docs: DataFrame, model: Model, threshold: float = REJECTED_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, one row per input row.

    Null and empty texts have no word and get the score of the constant alone. A null doc_id has a
    null held_out. Further columns change nothing.
    """
    # the text goes to the scorer alone: it need not come back
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text.as_py()) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(spark, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Scores of ``docs`` by a model learned from them and the labels of the folder."""
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
