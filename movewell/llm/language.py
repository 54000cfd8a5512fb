"""Language by a blended-spectrum string kernel, Nystroem landmarks and kernel ridge regression.

A text is the set of its character n-grams of lengths 1 to 3, case folded, runs of other characters
than letters being one space. The kernel of two texts is the size of the common set over the root
of the sizes' product, over all n-grams: one that no landmark has adds to a text's size alone.
Landmark texts of every language span the regression; one ridge regressor per language is fitted on
a bounded sample, and whole texts are scored by matrix products, some landmarks at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewell.llm.common import fold, pieces, share_kept, texts_of

NO_WORD = re.compile(r"[\W\d_]+")
NO_LETTER = regex.compile(r"[\p{Nl}\p{No}]+")  # numbers such as the half sign, which are of a word and no digits
GRAMS = (1, 2, 3)
CELLS = 1 << 20
UNKNOWN = "und"
BLOCK = 64  # texts and landmarks that are compared at once


@dataclass(frozen=True)
class Settings:
    """per_language: expected training rows of each language, taken by hash of id and text, equal rows once.
    landmarks: of each language. rows, spanned: of all languages together; with many languages each has fewer.
    languages: more distinct values than this are an error. ridge: penalty. sharpness: by which the
    regressors' values are multiplied before their softmax gives the score."""

    per_language: int = 400
    landmarks: int = 32
    rows: int = 16_000
    spanned: int = 2_000
    languages: int = 500
    ridge: float = 1e-3
    sharpness: float = 6.0


def gram_cells(text: str | None) -> np.ndarray | None:
    """Distinct hash cells of a whole text's n-grams; none where it has no letter."""
    cleaned = NO_WORD.sub(" ", (text or "").lower())
    cleaned = (cleaned if cleaned.isascii() else NO_LETTER.sub(" ", cleaned)).strip()
    if not cleaned:
        return None
    codes = np.frombuffer(f" {cleaned} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    seen = np.zeros(CELLS, bool)
    mixed = np.zeros(len(codes), np.uint64)
    for n in GRAMS:
        mixed = (mixed[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:]) * np.uint64(0xD6E8FEB86659FD93)
        seen[(mixed >> np.uint64(44)).astype(np.int64)] = True
        mixed = mixed ^ np.uint64(n)
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    """cells: sorted hash cells that a landmark has. landmarks: their cells. weights: by language."""

    cells: np.ndarray
    landmarks: list[np.ndarray]
    weights: np.ndarray
    languages: list[str]
    sharpness: float

    def presence(self, found: list[np.ndarray | None], cells: np.ndarray | None = None) -> np.ndarray:
        """Presence of ``cells``, by default those of all landmarks, over the root of each text's whole size."""
        cells = self.cells if cells is None else cells
        column = np.full(CELLS, -1, np.int32)
        column[cells] = np.arange(len(cells))
        out = np.zeros((len(found), len(cells)), np.float32)
        for row, own in enumerate(found):
            if own is not None:
                at = column[own]
                out[row, at[at >= 0]] = 1 / np.sqrt(len(own))
        return out

    def kernel(self, found: list[np.ndarray | None]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        out = np.zeros((len(found), len(self.landmarks)))
        for at in range(0, len(self.landmarks), BLOCK):
            block = self.landmarks[at: at + BLOCK]
            cells = _union(block)
            spanned = self.presence(block, cells).T
            for row in range(0, len(found), BLOCK):
                out[row: row + BLOCK, at: at + BLOCK] = self.presence(found[row: row + BLOCK], cells) @ spanned
        return out

    def predict(self, found: list[np.ndarray | None]) -> tuple[list[str], list[float]]:
        if not self.languages or not found:
            return [UNKNOWN] * len(found), [0.0] * len(found)
        kernel = self.kernel(found)
        values = np.hstack([kernel, np.ones((len(kernel), 1))]) @ self.weights
        likely = np.exp(self.sharpness * (values - values.max(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        names = [UNKNOWN if cells is None else self.languages[b] for cells, b in zip(found, best)]
        return names, [0.0 if cells is None else float(p[b]) for cells, p, b in zip(found, likely, best)]


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from texts with a language, outside the held-out fold (crc32 of the id mod 3 is 1).

    The driver gets the number of rows of each language, then the hashed n-grams of a sample whose
    expected size is ``per_language`` of each, and no more than ``rows``. Rows with null or letterless texts teach nothing.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", 3) != 1))
    counts = known.groupBy("lang").count().limit(settings.languages + 1).collect()
    if len(counts) > settings.languages:
        raise ValueError(f"more than {settings.languages} languages")
    if not counts:
        return Model(np.zeros(0, int), [], np.zeros((1, 0)), [], settings.sharpness)
    wanted = min(settings.per_language, settings.rows // len(counts))
    share = F.create_map(*[part for r in counts for part in (
        F.lit(r["lang"]), F.lit(min(1.0, wanted / r["count"])))])[F.col("lang")]
    mark = F.xxhash64("doc_id", "text")
    sample = known.withColumn("mark", mark).where(share_kept(F.col("mark"), share)).dropDuplicates(["doc_id", "lang", "mark"]).drop("mark")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_cells(text.as_py()) for text in batch.column(1)]
            cells = pa.array([None if f is None else f.astype("<i4").tobytes() for f in found], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(2), cells], names=["doc_id", "lang", "cells"])

    rows = sorted(sample.mapInArrow(measure, "doc_id long, lang string, cells binary").where("cells IS NOT NULL").collect(),
                  key=lambda r: (r["lang"], r["doc_id"], bytes(r["cells"])))
    found = [np.frombuffer(r["cells"], "<i4") for r in rows]
    languages = sorted({r["lang"] for r in rows})
    if not rows:
        return Model(np.zeros(0, int), [], np.zeros((1, 0)), [], settings.sharpness)
    label = np.array([languages.index(r["lang"]) for r in rows])
    each = max(1, min(settings.landmarks, settings.spanned // len(languages)))
    chosen = np.concatenate([_spread(np.flatnonzero(label == k), each) for k in range(len(languages))])
    landmarks = [found[at] for at in chosen]
    model = Model(_union(landmarks), landmarks, np.zeros((1, len(languages))), languages, settings.sharpness)
    alike = model.kernel(found)
    kernel = np.hstack([alike, np.ones((len(alike), 1))])
    targets = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (len(label) / np.maximum(1, np.bincount(label, minlength=len(languages))))[label]
    penalty = np.zeros((kernel.shape[1], kernel.shape[1]))
    penalty[:-1, :-1] = alike[chosen]
    left = kernel.T @ (kernel * weight[:, None]) + settings.ridge * weight.sum() * (penalty + 1e-6 * np.eye(len(penalty)))
    weights = np.linalg.solve(left, kernel.T @ (targets * weight[:, None]))
    return Model(model.cells, landmarks, weights, languages, settings.sharpness)


def _union(found: list[np.ndarray]) -> np.ndarray:
    """Sorted cells that any of the texts has."""
    seen = np.zeros(CELLS, bool)
    for cells in found:
        seen[cells] = True
    return np.flatnonzero(seen)


def _spread(rows: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` of the rows, evenly spaced."""
    return rows[np.unique(np.linspace(0, len(rows) - 1, min(wanted, len(rows))).astype(int))]


def predict_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text, one row per input row.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Ties
    go to the language first in order. A null doc_id has a null held_out.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, scores = model.predict([gram_cells(text.as_py()) for text in batch.column(1)])
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                  names=["doc_id", "lang_pred", "score"])

    return texts_of(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double").select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
