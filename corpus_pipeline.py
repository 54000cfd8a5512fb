"""The corpus pipeline: documents pass through the stages in order, each written and read again.

Every stage decides for each row by its own text: rows that share a doc_id, or have none, are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from movewell.llm import bpe, decontamination, neardup, secrets, toxicity
from movewell.llm.common import discard, stored, table
from movewell.llm.queries import BYTE_BPE

NEAR_DUPLICATE_WORDS = 5


def reject_toxic(spark, docs, sf_dir):
    """The rows that the classifier does not call toxic. It learns from ``docs`` and the labels of the folder.

    A null or empty text has the constant's score; repeated rows go or stay together.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).where(F.col("score") < toxicity.REJECTED_FROM).select("row.*")


def keep_one_of_each_group(spark, docs, sf_dir):
    """One row of each group of near duplicates: the smallest doc_id (null last), then the smallest hash of the text.

    Of rows equal in doc_id and text the first in order of all columns stays. Texts without a word are
    near nothing, and all of their rows stay.
    """
    found = neardup.grouped(docs, neardup.Settings(words=NEAR_DUPLICATE_WORDS))
    texts = found.where("group IS NOT NULL").groupBy("group", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = texts.groupBy("group").agg(F.min(place).alias("first"))
    judged = stored(texts.join(first, "group").select("doc_id", "mark", "copies", (place == F.col("first")).alias("stays"))
                    .where("NOT stays OR copies > 1"), "pipeline-groups")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(F.col("text").cast("string")).alias("of_text"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of_text") == F.col("mark"))
    alone = rows.join(judged, same, "left_anti").select("row.*")
    repeated = rows.join(judged.where("stays"), same, "left_semi").groupBy("id", "of_text").agg(F.min("row").alias("row"))
    return alone.unionByName(repeated.select("row.*"))


def reject_leaks(spark, docs, sf_dir):
    """The rows that do not hold a benchmark item. A null text holds none; equal texts go or stay together."""
    named = F.conv(F.substring(F.sha2(F.col("text").cast("string"), 256), 1, 15), 16, 10).cast("long")
    found = decontamination.leaks(docs.select(named.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaking = stored(found.select(F.col("doc_id").alias("of_text")).distinct(), "pipeline-leaks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), named.alias("of_text"))
    return rows.join(leaking, "of_text", "left_anti").select("row.*")


def mask_secrets(spark, docs, sf_dir):
    """All rows, the secrets of their texts masked; a null text stays null."""
    return secrets.redact(docs)


def encode(spark, docs, sf_dir):
    """Token ids of every remaining row; a null text has none."""
    return bpe.encode_documents(docs, BYTE_BPE, with_ids=True)


STAGES = [("toxicity", reject_toxic), ("near duplicates", keep_one_of_each_group), ("decontamination", reject_leaks),
          ("secrets", mask_secrets), ("bpe", encode)]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``; the rows of the last stage. What a stage has read is removed."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
