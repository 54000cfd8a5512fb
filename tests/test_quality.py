import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from movewell.operators import quality
from movewell.operators.quality import BETWEEN, IN_SET, NOT_NULL, Expectation
from movewell.plans import views

SCHEMA = "id int, employee_id int, date_debut timestamp_ntz, type_activite string, distance_m double, duree_s int"
NOW = datetime(2025, 8, 1)
GOOD = (1, 10, datetime(2025, 7, 1), "vélo", 5000.0, 1800)


def row(number, **changes):
    return {**dict(zip(("id", "employee_id", "date_debut", "type_activite", "distance_m", "duree_s"), GOOD)),
            "id": number, **changes}


ROWS = [
    row(1),
    row(2, employee_id=None),
    row(3, employee_id=77),
    row(4, employee_id=77, distance_m=20000.5),
    row(5, distance_m=None, duree_s=None, type_activite=None, date_debut=None),
    row(6, distance_m=float("nan")),
    row(7, duree_s=599),
    row(8, duree_s=7200, distance_m=0.0),
    row(9, date_debut=datetime(2024, 7, 31)),
    row(10, date_debut=datetime(2025, 8, 1, 1, 0)),
    row(11, date_debut=datetime(2025, 8, 1, 1, 1)),
    row(12, type_activite="natation"),
    row(13, type_activite="BACKFILL_COMPLETE", employee_id=0, duree_s=0),
]


@pytest.fixture
def inputs(spark):
    frame = spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA)
    ids = spark.createDataFrame([(10,), (11,), (10,), (None,)], "employee_id bigint")
    return frame, quality.with_date_bounds(quality.ACTIVITY_SUITE, NOW), {"employee_id": ids}


def test_statistics(inputs):
    rows = quality.dq_statistics(*inputs).orderBy("rule_no").collect()
    assert [r["unexpected_count"] for r in rows] == [1, 2, 1, 1, 2, 1]
    assert {(r["rows_read"], r["rows_checked"]) for r in rows} == {(13, 12)}
    assert not any(r["success"] for r in rows)


def test_violations_name_row_rule_and_value(inputs):
    found = {(r["id"], r["rule_no"], r["value"]) for r in quality.dq_violations(*inputs).collect()}
    assert found == {(2, 0, None), (3, 1, "77"), (4, 1, "77"), (4, 2, "20000.5"), (7, 3, "599"),
                     (9, 4, "2024-07-31 00:00:00"), (11, 4, "2025-08-01 01:01:00"), (12, 5, "natation")}


def test_violations_without_broadcast(inputs, no_broadcast):
    assert quality.dq_violations(*inputs).count() == 8


def test_violations_agree_with_statistics_on_the_tables(spark, tables):
    suite = quality.with_date_bounds(quality.ACTIVITY_SUITE, views.AS_OF)
    arguments = (views.activities(spark, tables), suite, {"employee_id": views.customer_ids(spark, tables)})
    counted = {r["rule_no"]: r["unexpected_count"] for r in quality.dq_statistics(*arguments).collect()}
    listed = {r["rule_no"]: r["count"] for r in quality.dq_violations(*arguments).groupBy("rule_no").count().collect()}
    assert counted == {0: 0, 1: 16, 2: 297, 3: 406, 4: 1285, 5: 30}
    assert listed == {number: count for number, count in counted.items() if count}


def test_invalid_ids(inputs):
    frame, _, references = inputs
    assert [r[0] for r in quality.invalid_employee_ids(frame, references["employee_id"]).collect()] == [77]


def test_summary_and_failure(inputs, spark):
    statistics = quality.dq_statistics(*inputs)
    summary = quality.dq_summary(statistics).first()
    assert (summary["evaluated"], summary["successful"], summary["unsuccessful"]) == (6, 0, 6)
    with pytest.raises(quality.ValidationFailed) as failed:
        quality.require_success(statistics)
    assert failed.value.failures[1] == (IN_SET, "employee_id", 2)
    good = spark.createDataFrame([GOOD], SCHEMA)
    quality.require_success(quality.dq_statistics(good, *inputs[1:]))
    passed = quality.dq_summary(quality.dq_statistics(good, *inputs[1:])).first()
    assert (passed["success_percent"], passed["success"]) == (100.0, True)


def test_hot_unknown_value_is_joined_once(spark):
    rows = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("employee_id"))
    known = spark.range(0, 9000).where("id <> 5").toDF("employee_id")
    found = quality.unknown_values(rows, "employee_id", known).collect()
    assert [tuple(r) for r in found] == [(5, 3001)]  # 3000 by rule, and id 5 itself


def test_stored_suite():
    stored = {"expectations": [
        {"expectation_type": NOT_NULL, "kwargs": {"column": "a"}, "meta": {}},
        {"expectation_type": IN_SET, "kwargs": {"column": "a", "value_set": []}},
        {"expectation_type": BETWEEN, "kwargs": {"column": "b", "min_value": 1, "max_value": 5}},
        {"expectation_type": BETWEEN, "kwargs": {"column": "date_debut", "min_value": "later", "max_value": "later"}},
        {"expectation_type": IN_SET, "kwargs": {"column": "c", "value_set": ["x", "y"]}},
        {"expectation_type": NOT_NULL, "kwargs": {"column": "commentaire"}},
    ]}
    suite = quality.without_column(quality.suite_from_json(json.dumps(stored)), "commentaire")
    assert suite == (Expectation(NOT_NULL, "a"), Expectation(IN_SET, "a"), Expectation(BETWEEN, "b", None, 1, 5),
                     Expectation(BETWEEN, "date_debut"), Expectation(IN_SET, "c", ("x", "y")))
    assert quality.with_date_bounds(suite, NOW)[3].highest == datetime(2025, 8, 1, 1)
    stored["expectations"].append({"expectation_type": "expect_magic", "kwargs": {"column": "a"}})
    with pytest.raises(ValueError, match="expect_magic"):
        quality.suite_from_json(json.dumps(stored))


def test_unbound_rule_is_refused(spark):
    frame = spark.createDataFrame([GOOD], SCHEMA)
    with pytest.raises(ValueError, match="date_debut"):
        quality.violates(Expectation(BETWEEN, "date_debut"), frame)


def test_one_sided_rule(spark):
    frame = spark.createDataFrame([(1,), (5,), (None,)], "n int")
    rule = Expectation(BETWEEN, "n", lowest=3)
    assert [r[0] for r in frame.select(quality.violates(rule, frame)).collect()] == [True, False, False]
