"""Notifications of activities that arrive after the back-fill marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewell.fixed_values import MARKER_TYPE
from movewell.functions.text import notification_text, plain_number
from movewell.sources.cdc import decode_envelope, has_body


def creations(messages: DataFrame) -> DataFrame:
    """Created activities with the partition and offset of their message."""
    decoded = decode_envelope(messages, "partition", "offset")
    return decoded.where((F.col("op") == "c") & has_body()).select("partition", "offset", "after.*")


def is_marker() -> Column:
    return F.col("type_activite").eqNullSafe(F.lit(MARKER_TYPE))


def may_hold_marker(messages: DataFrame) -> DataFrame:
    """Messages that can decode to a marker, found without parsing them.

    JSON can write the marker in only two ways: as it is, or with \\u escapes in it.
    """
    text = F.col("value").cast("string")
    return messages.where(text.contains(MARKER_TYPE) | text.contains("\\u"))


def barriers(created: DataFrame) -> DataFrame:
    """Offset of the first marker in each partition: one row per partition that has one."""
    return created.where(is_marker()).groupBy("partition").agg(F.min("offset").alias("barrier"))


def notifications(created: DataFrame, gates: DataFrame) -> DataFrame:
    """Texts for creations beyond their partition's barrier; closed partitions give nothing.

    The gates are broadcast because their number is bounded by the topic's partitions, and
    because joining on the partition by shuffle would send a whole partition to one task.
    """
    beyond = created.where(~is_marker()).join(
        F.broadcast(gates), "partition").where(F.col("offset") > F.col("barrier"))
    text = notification_text({
        "employee_id": F.col("employee_id"),
        "type_activite": F.col("type_activite"),
        "distance_m": plain_number(F.col("distance_m")),
        "duree_s": F.col("duree_s"),
        "date": F.date_format(F.timestamp_micros("date_debut"), "yyyy-MM-dd HH:mm"),
    })
    return beyond.select("partition", "offset", "id", text.alias("text"))
