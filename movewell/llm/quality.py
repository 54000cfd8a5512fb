"""Quality scores: random Fourier features, ridge from summed normal equations, isotonic calibration.

Document statistics are standardised and mapped to cosine features whose products approximate a
Gaussian kernel. Each partition of the training sample sums its own normal equations; the sums are
added by Spark, one row of the matrix at a time, and solved once. Ridge scores of a part of the
sample kept out of the fit are made probabilities by isotonic regression. A sampled row counts for
all rows of its label that it stands for, so that probabilities keep the labels' own proportion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewell.llm.common import fold, share_kept, small_batches, stored, table, texts_of

STATISTICS = ("log_length", "log_words", "mean_word", "upper", "digits", "spaces", "marks", "symbols", "bars",
              "exclaims", "distinct_words", "repeated_lines", "line_length", "top_word", "short_words", "sentence_ends",
              "compressed")
SYMBOLS = "#$%&*@^~<>=+_\\{}[]"


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and the fit.

    per_label: expected rows of each label, taken by hash of the id. features: cosine features.
    width: of the kernel, in standard deviations times the root of the number of statistics.
    ridge: its penalty for a row. calibration: one row in so many is kept for the isotonic step.
    partitions: that sum normal equations.
    """

    per_label: int = 6_000
    features: int = 192
    width: float = 1.0
    ridge: float = 1e-3
    calibration: int = 4
    partitions: int = 8
    seed: int = 7


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero where there is none."""
    if not text:
        return [0.0] * len(STATISTICS)
    size = len(text)
    words = text.split()
    lowered = text.lower().split()
    kinds = set(lowered)
    lines = [line for line in text.split("\n") if line.strip()]
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ascii_counts = np.bincount(raw[raw < 128], minlength=128)
    count = lambda characters: float(sum(ascii_counts[ord(c)] for c in characters))
    letters = max(1.0, float(ascii_counts[65:91].sum() + ascii_counts[97:123].sum()))
    n = max(1, len(words))
    ends = np.array([len(w) for w in words]) if words else np.zeros(1)
    top = max(np.unique(np.array([hash_of(w) for w in lowered]), return_counts=True)[1]) if words else 0
    encoded = text.encode("utf-8")
    return [
        float(np.log1p(size)), float(np.log1p(len(words))), float(np.log1p(ends.mean())),
        float(ascii_counts[65:91].sum()) / letters, float(ascii_counts[48:58].sum()) / size,
        float(ascii_counts[32]) / size, count(".,;:'\"-()?") / size, count(SYMBOLS) / size, count("|") / n,
        count("!") / n, len(kinds) / n, 1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(size / max(1, len(lines)))), float(top) / n, float((ends <= 2).mean()), count(".?") / n,
        len(zlib.compress(encoded, 1)) / len(encoded),
    ]


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8"))


def _statistics(rows: DataFrame, kept: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """``stats`` of the texts in the second column, with the columns of ``kept`` from the others."""
    names = [name for name, _, _ in kept]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(text.as_py()) for text in batch.column(1)]
            columns = [batch.column(batch.schema.get_field_index(name)).cast(kind) for name, kind, _ in kept]
            yield pa.record_batch([*columns, pa.array(stats, pa.list_(pa.float64()))], names=[*names, "stats"])

    return rows.mapInArrow(measure, ", ".join([*(f"{n} {t}" for n, _, t in kept), "stats array<double>"]))


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -8, 8)
        out = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([out, np.ones((len(out), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.cosines(stats) @ self.weights, *self.steps), 0, 1)


def isotonic(raw: np.ndarray, label: np.ndarray, each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing probabilities by pooling adjacent violators: knots and their values.

    ``each`` is what a row counts, one where it is not given.
    """
    if not len(raw):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.lexsort((label, raw))
    knots, at = np.unique(raw[order], return_inverse=True)
    each = np.ones(len(raw)) if each is None else each
    weight = np.bincount(at, weights=each[order])
    total = np.bincount(at, weights=(each * label)[order])
    blocks: list[list[float]] = []  # sum, weight, knots
    for s, w in zip(total, weight):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    values = np.concatenate([np.full(int(k), s / w) for s, w, k in blocks])
    keep = np.ones(len(knots), bool)
    keep[1:-1] = (np.diff(values)[:-1] != 0) | (np.diff(values)[1:] != 0)
    return knots[keep], values[keep]


def normal_equations(rows: DataFrame, shape: Model, partitions: int, counts: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y, summed within each partition, then over partitions one matrix row at a time.

    ``counts`` is what a row of label 0 and one of label 1 count.
    """
    width = len(shape.phases) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            stats = np.array(batch.column(0).to_pylist()).reshape(-1, len(STATISTICS))
            x, y = shape.cosines(stats), np.array(batch.column(1).to_pylist(), float)
            total += (x * np.where(y == 1, counts[1], counts[0])[:, None]).T @ np.hstack([x, y[:, None]])
        at, column = np.divmod(np.arange(total.size), width + 1)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(column, pa.int32()), pa.array(total.ravel())],
                              names=["i", "j", "value"])

    parts = rows.select("stats", "label").repartition(partitions).mapInArrow(partial, "i int, j int, value double")
    summed = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    matrix = np.zeros((width, width + 1))
    matrix[summed["i"], summed["j"]] = summed["value"]
    return matrix[:, :-1], matrix[:, -1]


def combined(means: np.ndarray, deviations: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of groups together, one line of ``means`` and ``deviations`` for each; zero without rows."""
    part = (rows / max(1.0, rows.sum()))[:, None]
    mean = (part * means).sum(axis=0)
    return mean, np.sqrt((part * (deviations ** 2 + (means - mean) ** 2)).sum(axis=0))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from labels of documents outside the held-out fold (crc32 of the id mod 4 is 2).

    Fit and calibration take a sample of the labelled rows, bounded by ``per_label`` of each label. Each
    row counts one over its label's share, so both see the labels' own proportion at every size. Null ids
    and labels teach nothing; of a label given twice the lower counts. Without labels there is no model.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id", 4) != 2))
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None
    shares = {label: min(1.0, settings.per_label / n) for label, n in counts.items()}
    each = (1 / shares.get(0, 1.0), 1 / shares.get(1, 1.0))
    share = F.when(F.col("label") == 1, F.lit(shares.get(1, 1.0))).otherwise(F.lit(shares.get(0, 1.0)))
    sample = known.where(share_kept(F.col("doc_id"), share))
    rows = texts_of(docs).where(fold("doc_id", 4) != 2).join(F.broadcast(sample), "doc_id")
    found = stored(_statistics(rows.select("doc_id", "text", "label"),
                               [("doc_id", pa.int64(), "long"), ("label", pa.int32(), "int")]), "quality-sample")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(settings.calibration)) == 0
    moments = found.where(~apart).select("label", *[F.col("stats")[i].alias(s) for i, s in enumerate(STATISTICS)]).groupBy("label").agg(
        *[F.avg(s).alias(f"m{i}") for i, s in enumerate(STATISTICS)],
        *[F.stddev_pop(s).alias(f"d{i}") for i, s in enumerate(STATISTICS)], F.count(F.lit(1)).alias("rows")).orderBy("label").collect()
    size = len(STATISTICS)
    centre, scale = combined(np.array([m[1:1 + size] for m in moments]).reshape(-1, size),
                             np.array([m[1 + size:-1] for m in moments]).reshape(-1, size),
                             np.array([m["rows"] * each[m["label"]] for m in moments]))
    random = np.random.default_rng(settings.seed)
    shape = Model(centre, np.where(scale > 1e-9, scale, 1.0),
                  random.normal(size=(size, settings.features)) / (settings.width * np.sqrt(size)),
                  random.uniform(0, 2 * np.pi, settings.features), np.zeros(settings.features + 1),
                  (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    gram, moment = normal_equations(found.where(~apart), shape, settings.partitions, each)
    rows_fitted = max(1.0, gram[-1, -1])
    weights = np.linalg.solve(gram + settings.ridge * rows_fitted * np.eye(len(gram)) / len(gram), moment)
    kept = found.where(apart).select("stats", "label").toPandas()
    fitted = Model(shape.centre, shape.scale, shape.directions, shape.phases, weights, shape.steps)
    stats = np.array(kept["stats"].tolist()).reshape(-1, size)
    return Model(shape.centre, shape.scale, shape.directions, shape.phases, weights,
                 isotonic(fitted.cosines(stats) @ weights, kept["label"].to_numpy(float), np.array(each)[kept["label"].to_numpy(int)]))


def score_documents(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, one row per input row.

    Null and empty texts have statistics of zero and are scored by them. Without a model the score
    is one half. A null doc_id has a null held_out. Further columns change nothing.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(text.as_py()) for text in batch.column(1)]).reshape(-1, len(STATISTICS))
            scores = model.scores(stats) if model else np.full(len(stats), 0.5)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(spark, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Scores of ``docs`` by a model learned from them and the labels of the folder."""
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
