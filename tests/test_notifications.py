import json
from datetime import datetime, timezone

from movewell.operators.notifications import barriers, creations, may_hold_marker, notifications
from movewell.schemas import MESSAGE

MARKER = "BACKFILL_COMPLETE"


def message(partition, offset, op="c", kind="vélo", **changes):
    after = {"id": offset, "employee_id": 3, "date_debut": 1751637799103123, "type_activite": kind,
             "distance_m": 5000.0, "duree_s": 1800, "commentaire": "x", **changes}
    return partition, offset, bytearray(json.dumps({"payload": {"op": op, "after": after}}), "utf-8")


def posted(spark, *messages):
    created = creations(spark.createDataFrame(messages, MESSAGE))
    return {(row["partition"], row["offset"]): row["text"] for row in notifications(created, barriers(created)).collect()}


def test_text(spark):
    texts = posted(spark, message(0, 1, kind=MARKER), message(0, 2, distance_m=1234.5))
    when = datetime.fromtimestamp(1751637799, timezone.utc).strftime("%Y-%m-%d %H:%M")
    assert texts[0, 2].split("\n") == [
        "*Nouvelle activité sportive !* :runner:", "> *Employé* : `3`", "> *Type*    : *vélo*",
        "> *Distance*: 1234.5 m", "> *Durée*   : 1800 s", f"> *Date*    : {when}"]


def test_only_creations_beyond_the_first_marker_of_their_partition(spark):
    texts = posted(
        spark, message(0, 1), message(0, 2, kind=MARKER), message(0, 3), message(0, 4, op="u"), message(0, 5, op="r"),
        message(0, 6, kind=MARKER), message(0, 7), message(1, 9), message(2, 1, kind=MARKER), message(2, 0), message(2, 8))
    assert set(texts) == {(0, 3), (0, 7), (2, 8)}


def test_marker_must_be_a_creation(spark):
    assert posted(spark, message(0, 1, op="u", kind=MARKER), message(0, 2)) == {}


def test_markers_are_found_without_parsing_the_rest(spark):
    escaped = MARKER.replace("C", "\\u0043")
    texts = [json.dumps({"payload": {"op": "c", "after": {"id": 1, "type_activite": "vélo"}}}, ensure_ascii=False),
             json.dumps({"payload": {"op": "c", "after": {"id": 2, "type_activite": MARKER}}}),
             json.dumps({"payload": {"op": "c", "after": {"id": 3, "type_activite": MARKER}}}).replace(MARKER, escaped)]
    rows = [(offset, offset, bytearray(text, "utf-8")) for offset, text in enumerate([*texts, "noise"])]
    messages = spark.createDataFrame([*rows, (9, 9, None)], MESSAGE)
    kept = may_hold_marker(messages)
    assert sorted(r["offset"] for r in kept.collect()) == [1, 2]
    assert sorted(r["partition"] for r in barriers(creations(kept)).collect()) == [1, 2]
    assert barriers(creations(kept)).exceptAll(barriers(creations(messages))).isEmpty()
    assert barriers(creations(messages)).exceptAll(barriers(creations(kept))).isEmpty()


def test_missing_bodies_are_skipped_and_missing_values_named(spark):
    empty = (0, 5, bytearray(b'{"payload":{"op":"c","after":{}}}'))
    gone = (0, 6, bytearray(b'{"payload":{"op":"c","after":null}}'))
    noise = (0, 7, bytearray(b"noise"))
    texts = posted(spark, message(0, 1, kind=MARKER), empty, gone, noise, message(0, 8, kind=None))
    assert set(texts) == {(0, 8)}
    assert "*None*" in texts[0, 8]
