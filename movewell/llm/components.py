"""Connected components of links, by smallest labels and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewell.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of a link (a, b); component is the smallest id reachable. A stored table.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    rounds grow with the logarithm of a chain's length. Labels are written after each round, and those of
    the round before removed; the driver sees one number, how many of them changed.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
                    .select("id", F.least("id", "near").alias("component"), F.lit(True).alias("changed")), "labels")
    while True:
        known = labels.select("id", "component")
        beside = (both.join(known.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
                  .agg(F.min("component").alias("near")))
        nearer = known.join(beside, "id").select(
            "id", F.least("component", "near").alias("target"), F.col("component").alias("before"))
        onward = known.select(F.col("id").alias("target"), F.col("component").alias("jumped"))
        step = stored(nearer.join(onward, "target").select(
            "id", F.least("target", "jumped").alias("component"),
            (F.least("target", "jumped") < F.col("before")).alias("changed")), "labels")
        discard(labels)
        labels = step
        if not step.agg(F.count_if("changed")).first()[0]:
            discard(both)
            return labels
