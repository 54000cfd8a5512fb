"""Change records: subscribe, decode, flatten."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movewell.schemas import ACTIVITY, CHANGE_ENVELOPE, CHANGES, ENVELOPE, MESSAGE

KAFKA_DEFAULTS = {"startingOffsets": "earliest", "failOnDataLoss": "false"}


def read_cdc_stream(spark: SparkSession, fmt: str, options: Mapping[str, str]) -> DataFrame:
    """Messages as a stream with partition, offset and value.

    ``kafka`` starts from the earliest offset and tolerates lost ones; set ``minPartitions``
    when the topic has fewer partitions than the cluster has cores. Any file format reads a
    folder (option ``path``) of messages written with the same three columns.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        return reader.options(**{**KAFKA_DEFAULTS, **options}).load()
    return reader.schema(MESSAGE).options(**options).load()


def decode_envelope(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per message: the named message columns, then op, after and source_ts_ms.

    Parsing is permissive: what cannot be read becomes null and the row stays. The explode
    of a single value keeps the parse in an operator of its own; a plain projection would be
    merged into later filters, which would parse each message once per condition.
    """
    payload = F.from_json(F.col("value").cast("string"), ENVELOPE)["payload"]
    return messages.select(*keep, F.explode(F.array(payload)).alias("payload")).select(
        *keep, "payload.op", "payload.after", F.col("payload.source.ts_ms").alias("source_ts_ms"))


UNREADABLE, EMPTY = "unreadable", "empty"
_BROKEN = "_broken"
_WITH_BROKEN = T.StructType([*ENVELOPE.fields, T.StructField(_BROKEN, T.StringType())])


def decode_with_problem(messages: DataFrame, *keep: str) -> DataFrame:
    """As decode_envelope, with ``problem``: null, or why the message gives no activity.

    ``unreadable`` has text that is no JSON of the envelope's types (of a wrong type, the other fields are
    still decoded); ``empty`` has no payload: another JSON text, or no value at all.
    """
    text = F.col("value").cast("string")
    read = F.from_json(text, _WITH_BROKEN, {"columnNameOfCorruptRecord": _BROKEN})
    rows = messages.select(*keep, F.explode(F.array(F.struct(text.isNotNull().alias("given"), read.alias("read")))).alias("_m"))
    read = F.col("_m.read")
    problem = (F.when(F.col("_m.given") & (read.isNull() | read[_BROKEN].isNotNull()), UNREADABLE)
               .when(read["payload"].isNull(), EMPTY))
    payload = read["payload"]
    return rows.select(*keep, payload["op"].alias("op"), payload["after"].alias("after"),
                       payload["source"]["ts_ms"].alias("source_ts_ms"), problem.alias("problem"))


def flattened(decoded: DataFrame) -> DataFrame:
    return decoded.select("after.*").withColumn("date_debut_ts", F.timestamp_micros("date_debut"))


def decode_activities(messages: DataFrame) -> DataFrame:
    """Bronze rows. Every message gives one; deletes and unreadable ones are all null."""
    return flattened(decode_envelope(messages))


def decode_changes(messages: DataFrame) -> DataFrame:
    """Changes with partition, offset and operation; of a delete the id alone. Every message gives one row."""
    payload = F.from_json(F.col("value").cast("string"), CHANGE_ENVELOPE)["payload"]
    rows = messages.select("partition", "offset", F.explode(F.array(payload)).alias("payload"))
    known = F.coalesce(F.col("payload.after.id"), F.col("payload.before.id")).alias("id")
    others = [F.col(f"payload.after.{name}") for name in ACTIVITY.names if name != "id"]
    return (rows.select("partition", "offset", "payload.op", known, *others)
            .withColumn("date_debut_ts", F.timestamp_micros("date_debut")).select(*CHANGES.names))


def has_body(after: str = "after") -> Column:
    """An empty JSON object counts as no body, like a missing one."""
    return reduce(or_, (F.col(f"{after}.{field}").isNotNull() for field in ACTIVITY.names))
