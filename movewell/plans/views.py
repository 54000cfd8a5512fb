"""Domain views derived from the given tables, which hold no sport data of their own.

Customers become employees, orders become activities and change records, events become
metric samples. Every view covers its whole table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.fixed_values import (
    ACTIVITY_TYPES,
    BIKE_MODE,
    HR_ADDRESS,
    HR_DISTANCE,
    HR_ID,
    HR_MODE,
    HR_SALARY,
    HR_UNIT,
    MARKER_EMPLOYEE_ID,
    MARKER_TYPE,
    PROBE_EMPLOYEE_ID,
    WALK_MODE,
)
from movewell.functions.time import moment

AS_OF = datetime(2001, 8, 1)  # last order date
EVENTS_AS_OF = datetime(2024, 1, 31)
MARKER_ORDER = 303
TOPIC_PARTITIONS = 1  # Fixed value: the activity topic has one partition.

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


# Columns of the given tables that are used. Naming them spares a job that reads file footers.
_COLUMNS = {
    "nation": "n_nationkey INT, n_name STRING",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _address(custkey: Column) -> Column:
    """Shared by three customers, missing for some; every fourth customer gives the head office."""
    return (F.when(custkey % 13 == 0, F.lit(None).cast("string"))
             .when(custkey % 4 == 1, F.lit("siège"))
             .otherwise(F.concat(F.floor(custkey / 3).cast("string"), F.lit(" chemin du Moulin"))))


def hr_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HR rows with typed columns and an address."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    mode = (F.when(segment == "AUTOMOBILE", F.lit(WALK_MODE)).when(segment == "BUILDING", F.lit(BIKE_MODE))
             .when(segment == "HOUSEHOLD", F.lit(None).cast("string")).otherwise(F.lit("Transports en commun")))
    distance = F.when(key % 11 != 0, ((key * 7) % 400).cast("double") / F.lit(10.0))
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").select(
        key.alias("employee_id"), F.col("n_name").alias("bu"), mode.alias("moyen_dep"),
        (F.lit(30000.0) + F.col("c_acctbal")).alias("salaire_brut_annuel"),
        distance.alias("distance_km"), _address(key).alias("address"))


def hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hr_people(spark, sf_dir).drop("address")


def hr_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HR rows as a text sheet with untidy headers and some unusable numbers."""
    people, key = hr_people(spark, sf_dir), F.col("employee_id")
    return people.select(
        key.cast("string").alias(f" {HR_ID} "), F.col("bu").alias(HR_UNIT), F.col("moyen_dep").alias(f"{HR_MODE} "),
        F.when(key % 101 == 0, F.lit("n/a")).otherwise(F.col("salaire_brut_annuel").cast("string")).alias(HR_SALARY),
        F.col("distance_km").cast("string").alias(f" {HR_DISTANCE}"), F.col("address").alias(HR_ADDRESS))


def customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("employee_id"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as activities with their change code; the id doubles as the record offset."""
    key = F.col("o_orderkey")
    kind = F.when(key == MARKER_ORDER, F.lit(MARKER_TYPE)).when(key % 50 == 7, F.lit("natation"))
    for priority, name in zip(_PRIORITIES, ACTIVITY_TYPES):
        kind = kind.when(F.col("o_orderpriority") == priority, F.lit(name))
    code = F.when(key % 10 == 0, "u").when(key % 10 == 1, "d").when(key % 10 == 2, "r").otherwise("c")
    employee = (F.when(key == MARKER_ORDER, F.lit(MARKER_EMPLOYEE_ID)).when(key % 97 == 0, F.lit(PROBE_EMPLOYEE_ID))
                 .otherwise(F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), employee.alias("employee_id"), F.col("o_orderdate").alias("date_debut"),
        kind.alias("type_activite"), (F.col("o_totalprice") / F.lit(20.0)).alias("distance_m"),
        ((key * 37) % 9000).cast("int").alias("duree_s"),
        F.concat(F.lit("Commande \""), F.col("o_orderpriority"), F.lit("\"")).alias("commentaire"),
        code.alias("op"))


def kept_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities whose change record has a body: all but deletes."""
    return activities(spark, sf_dir).where(F.col("op") != "d")


def _micros(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", moment(datetime(1970, 1, 1)), F.col(ts))


def cdc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activities as change records, the way a topic delivers them: dealt by id, with an offset."""
    rows = activities(spark, sf_dir)
    body = F.struct("id", "employee_id", _micros("date_debut").alias("date_debut"), "type_activite",
                    "distance_m", "duree_s", "commentaire")
    after = F.when(F.col("op") != "d", body)
    record = F.struct(F.struct("op", after.alias("after"), F.struct(F.lit("activities").alias("db")).alias("source"))
                      .alias("payload"))
    partition = F.pmod(F.hash("id"), F.lit(TOPIC_PARTITIONS))
    return rows.select(partition.alias("partition"), F.col("id").alias("offset"),
                       F.to_json(record).cast("binary").alias("value"))


SECOND_MARKER = 304  # an order of another partition


def topic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change records dealt to three partitions by id; two of them have a marker, the third never opens."""
    text = F.col("value").cast("string")
    kind = F.concat(F.lit('"type_activite":"'), F.lit(MARKER_TYPE), F.lit('"'))
    marked = F.when(F.col("offset") == SECOND_MARKER, F.regexp_replace(text, '"type_activite":"[^"]*"', kind)).otherwise(text)
    return cdc_messages(spark, sf_dir).select(
        (F.col("offset") % 3).cast("int").alias("partition"), "offset", marked.cast("binary").alias("value"))


CHANGES_PER_ACTIVITY = 4


def change_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four change records for each activity: the order key over four is its id, the order key the offset.

    The last code of an activity decides whether it is there; deletes name it in ``before`` alone.
    """
    rows = activities(spark, sf_dir)
    key = F.floor(F.col("id") / CHANGES_PER_ACTIVITY).cast("int").alias("id")
    body = F.struct(key, "employee_id", _micros("date_debut").alias("date_debut"), "type_activite", "distance_m", "duree_s", "commentaire")
    before = F.when(F.col("op").isin("u", "d"), F.struct(key))
    record = F.struct(F.struct("op", before.alias("before"), F.when(F.col("op") != "d", body).alias("after")).alias("payload"))
    return rows.select(F.lit(0).alias("partition"), F.col("id").alias("offset"), F.to_json(record).cast("binary").alias("value"))


def damaged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change record damaged in one of eight ways, by its offset."""
    way, text = F.col("offset") % 8, F.col("value").cast("string")
    identifier = F.concat(F.lit('"id":'), F.col("offset").cast("string"), F.lit(","))
    broken = (F.when(way == 0, F.lit("not json"))
               .when(way == 1, F.lit("{}"))
               .when(way == 2, F.lit('{"payload":null}'))
               .when(way == 3, F.lit(""))
               .when(way == 4, F.lit(None).cast("string"))
               .when(way == 5, F.get_json_object(text, "$.payload"))
               .when(way == 6, F.replace(text, identifier, F.lit('"id":"abc",')))
               .otherwise(F.replace(text, identifier, F.concat(identifier, F.lit('"weather":"rain",')))))
    return cdc_messages(spark, sf_dir).withColumn("value", broken.cast("binary"))


def route_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored routing answer per distinct address, some refused, empty or incomplete."""
    lowest = (hr_people(spark, sf_dir).where(F.col("address").isNotNull())
              .groupBy("address").agg(F.min("employee_id").alias("k")))
    key, metres = F.col("k"), ((F.col("k") * 7919) % 60000).cast("string")
    element = (F.when(key % 11 == 0, F.lit('{"status":"NOT_FOUND"}'))
                .when(key % 19 == 0, F.lit('{"status":"OK"}'))
                .otherwise(F.concat(F.lit('{"status":"OK","distance":{"text":"?","value":'), metres, F.lit("}}"))))
    body = (F.when(key % 7 == 0, F.lit('{"status":"REQUEST_DENIED","rows":[]}'))
             .when(key % 17 == 0, F.lit('{"status":"OK","rows":[]}'))
             .when(key % 23 == 0, F.lit('{"status":"OK","rows":[{}]}'))
             .otherwise(F.concat(F.lit('{"status":"OK","rows":[{"elements":['), element, F.lit("]}]}"))))
    return lowest.select("address", body.alias("body"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as database sessions: state, database and application name."""
    user = F.col("user_id")
    application = F.when(user % 3 == 0, F.lit("psql")).otherwise(F.concat(F.lit("Connector "), user.cast("string")))
    return events(spark, sf_dir).select(
        F.col("event_type").alias("state"),
        F.when(F.col("event_id") % 5 == 0, F.lit("postgres")).otherwise(F.lit("activities")).alias("datname"),
        application.alias("application_name"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change messages: commit time in the record, arrival some milliseconds later."""
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value").cast("decimal(18,6)"))
    source = F.struct((F.floor(_micros("ts") / 1000)).alias("ts_ms"))
    record = F.to_json(F.struct(F.struct(F.lit("c").alias("op"), source.alias("source")).alias("payload")))
    return events(spark, sf_dir).select(
        "user_id", record.cast("binary").alias("value"), (F.col("ts") + delay).cast("timestamp").alias("timestamp"))
