"""The registered queries of this subpackage: each takes (spark, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.llm import (attribution, bpe, decontamination, fim, language, neardup, outliers, quality, repair, secrets, topk,
                          toxicity, trie)
from movewell.llm.common import table
from movewell.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def registered(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir)

    REGISTRY[query.__name__] = run
    return run


@registered
def op1_topk(spark, sf_dir):
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@registered
def op2_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@registered
def op3_repair(spark, sf_dir):
    path = repair.write_shards(table(spark, sf_dir, "documents"), WORD_BPE)
    return repair.read_documents(spark, path)


@registered
def op4_attribution(spark, sf_dir):
    return attribution.section_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


@registered
def op5_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op6_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


@registered
def op7_quality(spark, sf_dir):
    return quality.quality(spark, sf_dir, table(spark, sf_dir, "documents"))


@registered
def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(spark, sf_dir, table(spark, sf_dir, "documents"))


@registered
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict_documents(docs, language.train(docs))


@registered
def op10_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@registered
def op11_fim(spark, sf_dir):
    made = fim.transform(table(spark, sf_dir, "documents"))
    digests = [F.sha2(text, 256).alias(f"{name}_sha256") for name, text in (
        ("output", F.col("output")), ("restored", fim.restored(F.col("output"), F.col("form"))))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@registered
def op12_outliers(spark, sf_dir):
    return outliers.judged(table(spark, sf_dir, "documents")).select("doc_id", *outliers.COUNTS, "base_failed", "kept")


@registered
def op13_trie(spark, sf_dir):
    return trie.trie(table(spark, sf_dir, "conversations"))
