"""What becomes of each kind of message."""

import json
from datetime import datetime, timezone

import pytest

from movewell.schemas import ACTIVITY, MESSAGE
from movewell.sources.cdc import KAFKA_DEFAULTS, decode_activities, decode_envelope, has_body

AFTER = {"id": 7, "employee_id": 12, "date_debut": 1751637799103123, "type_activite": "vélo",
         "distance_m": 5000.5, "duree_s": 1800, "commentaire": 'dit "bravo"'}


def envelope(op="c", after=AFTER, **more):
    return json.dumps({"payload": {"op": op, "after": after, **more}})


def messages(spark, *values):
    rows = [(0, offset, None if value is None else bytearray(value, "utf-8")) for offset, value in enumerate(values)]
    return spark.createDataFrame(rows, MESSAGE)


def decoded(spark, value):
    rows = decode_activities(messages(spark, value)).collect()
    assert len(rows) == 1  # every message gives exactly one bronze row
    return rows[0].asDict()


def test_complete_record(spark):
    row = decoded(spark, envelope())
    stamp = row.pop("date_debut_ts")
    assert row == AFTER
    assert stamp.astimezone(timezone.utc) == datetime(2025, 7, 4, 14, 3, 19, 103123, tzinfo=timezone.utc)


@pytest.mark.parametrize("value", ["not json", "", None, "{}", '{"payload":null}', json.dumps({"op": "c", "after": AFTER}),
                                   envelope("d", None)])
def test_unreadable_records_and_deletes_stay_as_null_rows(spark, value):
    assert set(decoded(spark, value).values()) == {None}


def test_wrong_type_nulls_only_its_field(spark):
    row = decoded(spark, envelope(after={**AFTER, "id": "abc"}))
    assert row["id"] is None
    assert row["employee_id"] == 12 and row["distance_m"] == 5000.5


def test_unknown_fields_are_ignored(spark):
    assert decoded(spark, envelope(after={**AFTER, "weather": "rain"}, ts_ms=1))["id"] == 7


def test_update_and_snapshot_read_keep_their_body(spark):
    rows = decode_activities(messages(spark, envelope("u"), envelope("r"), envelope("c"))).collect()
    assert [row["id"] for row in rows] == [7, 7, 7]


def test_source_commit_time_is_optional(spark):
    rows = decode_envelope(messages(spark, envelope(), envelope(source={"ts_ms": 5})), "offset").collect()
    assert [row["source_ts_ms"] for row in rows] == [None, 5]


def test_empty_body_counts_as_missing(spark):
    rows = decode_envelope(messages(spark, envelope(after={}), envelope(after=None), envelope(after={"id": 1})), "offset")
    assert [row[0] for row in rows.orderBy("offset").select(has_body()).na.fill(False).collect()] == [False, False, True]


def test_kafka_reader_starts_early_and_tolerates_loss():
    assert KAFKA_DEFAULTS == {"startingOffsets": "earliest", "failOnDataLoss": "false"}


def test_wire_schema():
    assert ACTIVITY.simpleString() == ("struct<id:int,employee_id:int,date_debut:bigint,type_activite:string,"
                                       "distance_m:double,duree_s:int,commentaire:string>")
