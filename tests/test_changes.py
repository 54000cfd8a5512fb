"""Updates and deletes applied: against replaying the log one change at a time."""

import json
import random

from pyspark.sql import functions as F

from movewell.operators.changes import current_rows
from movewell.schemas import MESSAGE
from movewell.sources.activities import read_changes
from movewell.sources.cdc import decode_changes, read_cdc_stream
from movewell.streaming.bronze import start_changes
from movewell.streaming.runs import finish


def change(offset, op, key, employee=1):
    row = {"id": key, "employee_id": employee, "date_debut": 1_700_000_000_000_000 + offset}
    payload = {"op": op, "before": {"id": key} if op in "ud" else None, "after": None if op == "d" else row}
    return key % 2, offset, bytearray(json.dumps({"payload": payload}), "utf-8")


def log(size=600, seed=7):
    rng = random.Random(seed)
    rows, there = [], set()
    for offset in range(size):
        key = rng.choice([1, 1, 1, *range(40)])
        op = rng.choice("ud") if key in there else rng.choice("cr")
        there.symmetric_difference_update({key} if op in "crd" else ())
        rows.append(change(offset, op, key, rng.randrange(5)))
    return rows


def replayed(rows):
    state = {}
    for _, offset, value in sorted(rows, key=lambda r: r[1]):
        try:
            payload = json.loads(value or b"").get("payload")
        except ValueError:
            continue
        if not payload:
            continue
        if payload["op"] == "d":
            state.pop(payload["before"]["id"], None)
        else:
            state[payload["after"]["id"]] = offset, payload["after"]["employee_id"]
    return state


def found(changes):
    return {r["id"]: (r["offset"], r["employee_id"]) for r in current_rows(changes).collect()}


NOISE = [(0, 10_000, bytearray(b"noise")), (0, 10_001, None), (1, 10_002, bytearray(b'{"payload":null}')),
         (1, 10_003, bytearray(b'{"payload":{"op":"d","before":null,"after":null}}'))]


def test_the_last_change_of_each_row_decides(spark):
    rows = log()
    messages = spark.createDataFrame([*rows, *NOISE], MESSAGE).repartition(5)
    assert found(decode_changes(messages)) == replayed(rows)
    assert 0 < len(replayed(rows)) < 41


def test_a_stream_of_changes_equals_the_batch(spark, tmp_path):
    """In three runs, the files of each in any order; counts follow updates and deletes down as well as up."""
    rows, counts = log(), []
    for low in range(0, 600, 200):
        spark.createDataFrame(rows[low:low + 200], MESSAGE).repartition(4).write.mode("append").parquet(f"{tmp_path}/log")
        messages = read_cdc_stream(spark, "parquet", {"path": f"{tmp_path}/log", "maxFilesPerTrigger": "2"})
        finish(start_changes(messages, f"{tmp_path}/changes", f"{tmp_path}/ck"))
        changes = read_changes(spark, f"{tmp_path}/changes")
        assert changes.count() == low + 200
        assert found(changes) == replayed(rows[:low + 200])
        counts.append(len(found(changes)))
    assert changes.where(F.col("op") == "d").select("id").where("id IS NULL").isEmpty()


def test_no_changes_and_a_row_that_only_goes(spark):
    assert found(decode_changes(spark.createDataFrame([], MESSAGE))) == {}
    assert found(decode_changes(spark.createDataFrame([change(1, "d", 5), *NOISE], MESSAGE))) == {}


def test_each_task_sends_one_row_per_key(spark):
    plan = current_rows(decode_changes(spark.createDataFrame(log(), MESSAGE)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and plan.count("Exchange") == 1
