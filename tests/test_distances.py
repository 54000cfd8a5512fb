import json

import pytest

from movewell.operators.distances import declaration_check, distance_enrich, distinct_addresses
from movewell.plans import views
from movewell.rules import DEFAULT
from movewell.sources.routes import parse_distances


def answer(status="OK", element_status="OK", value=12345):
    element = {"status": element_status, "distance": {"text": "x", "value": value}}
    return {"status": status, "rows": [{"elements": [element]}]}


@pytest.mark.parametrize("body, km", [
    (answer(), 12.35),
    (answer(value=0), 0.0),
    (answer(status="REQUEST_DENIED"), None),
    (answer(element_status="NOT_FOUND"), None),
    ({"status": "OK", "rows": []}, None),
    ({"status": "OK"}, None),
    ({"status": "OK", "rows": [{}]}, None),
    ({"status": "OK", "rows": [{"elements": []}]}, None),
    ({"status": "OK", "rows": [{"elements": [{"status": "OK"}]}]}, None),
    ({"status": "OK", "rows": [{"elements": [{"status": "OK", "distance": {}}]}]}, None),
    ("garbage", None),
    (None, None),
])
def test_answers(spark, body, km):
    text = body if body is None or isinstance(body, str) else json.dumps(body)
    frame = spark.createDataFrame([("home", text)], "address string, body string")
    assert [tuple(row) for row in parse_distances(frame).collect()] == [("home", km)]


def test_addresses_without_null_or_copies(spark):
    frame = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "address string")
    assert sorted(row[0] for row in distinct_addresses(frame).collect()) == ["a", "b"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_enrichment_keeps_every_row(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    hr = spark.createDataFrame([(1, "a", 9.0), (2, "b", 9.0), (3, None, 9.0), (4, "c", 9.0)], "id int, address string, distance_km double")
    known = spark.createDataFrame([("a", 2.0), ("a", 1.5), ("b", None)], "address string, distance_km double")
    rows = {row["id"]: row["distance_km"] for row in distance_enrich(hr, known).collect()}
    assert rows == {1: 1.5, 2: None, 3: None, 4: None}  # old distances are replaced


def test_declaration_totals(spark, tables):
    rows = declaration_check(views.hr(spark, tables), DEFAULT).groupBy("declaration_correcte").count().collect()
    assert {row[0]: row[1] for row in rows} == {False: 18, True: 132}
