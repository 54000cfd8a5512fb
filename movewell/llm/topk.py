"""Exact top-k by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size, queries into chunks; a task holds one block and one
chunk. In a block every dimension is a list of rows sorted by its component. A query walks its
lists in parallel, downwards where its own component is positive and upwards where it is negative,
scores each row when it first meets it, and stops when the sum of products at the frontier, the
bound on all rows not met, is below the k-th best score. Blocks report k rows for each query and
the best of these are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Settings:
    """k: results of a query. block, chunk: expected vectors and queries of one task. first_depth:
    rows of each list that are walked before the bound is first tested; then twice as many each time."""

    k: int = 5
    block: int = 2048
    chunk: int = 1024
    first_depth: int = 16


class Lists:
    """The rows of one block and, for every dimension, their order by the component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.falling = np.argsort(-self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, self.falling, axis=0)

    def best(self, query: np.ndarray, own: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own; ties to the smaller id."""
        size = len(self.ids)
        used = np.flatnonzero(query)
        up = query[used] < 0
        met = np.zeros(size, bool)
        scores = np.full(size, np.iinfo(np.int64).min)
        depth = settings.first_depth
        while True:
            depth = min(depth, size)
            seen = np.zeros(size, bool)
            seen[self.falling[:depth, used[~up]]] = True
            seen[self.falling[size - depth:, used[up]]] = True
            new = np.flatnonzero(seen & ~met) if len(used) and depth < size else np.flatnonzero(~met)
            met[new] = True
            scores[new] = self.rows[new] @ query
            scores[self.ids == own] = np.iinfo(np.int64).min
            frontier = np.where(up, self.values[size - depth, used], self.values[depth - 1, used])
            bound = int(frontier @ query[used])
            if depth == size or met.all():
                break
            if len(scores) >= settings.k and np.partition(scores, size - settings.k)[size - settings.k] > bound:
                break
            depth *= 2
        found = np.flatnonzero(met & (self.ids != own))
        found = found[np.lexsort((self.ids[found], -scores[found]))][: settings.k]
        return self.ids[found], scores[found]


def integer_vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and floor(256 x) of each component; null vectors and those holding null or non-finite
    components are left out, and so are null ids. Rows that repeat wholly count once."""
    value = F.col(column).cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (table.where(F.col(id_column).isNotNull() & F.col(column).isNotNull() & sound)
            .select(F.col(id_column).cast("long").alias("vec_id"), F.transform(value, lambda x: F.floor(x * 256)).alias("vector"))
            .distinct())


def top_k(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query.

    Both tables have vec_id and vector (array of long). A query's own id is no candidate. Vectors of
    different length are not comparable: only those as long as the query are its candidates. With
    fewer than k candidates all are returned; empty tables give no rows.
    """
    rows, asked = vectors.count(), queries.count()
    blocks, chunks = max(1, -(-rows // settings.block)), max(1, -(-asked // settings.chunk))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    dealt = vectors.select("vec_id", "vector", F.size("vector").alias("width"), deal(blocks).alias("block"), every(chunks, "chunk"))
    asking = queries.select("vec_id", "vector", F.size("vector").alias("width"), deal(chunks).alias("chunk"), every(blocks, "block"))

    def search(candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(candidates) and len(wanted):
            lists = Lists(candidates["vec_id"].to_numpy(), np.array(candidates["vector"].tolist(), np.int64).reshape(len(candidates), -1))
            for own, vector in zip(wanted["vec_id"], wanted["vector"]):
                ids, scores = lists.best(np.asarray(vector, np.int64), own, settings)
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    key = ["block", "chunk", "width"]
    found = dealt.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= settings.k)
            .select("query_id", "rank", "vec_id", "score"))
