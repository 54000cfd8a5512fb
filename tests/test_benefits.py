"""Truth tables of the bonus and the declaration, against plain Python."""

import itertools
import math

from pyspark.sql import functions as F

from movewell.fixed_values import BIKE_MODE, WALK_MODE
from movewell.functions.benefits import bonus_euros, commute_eligible, declaration_plausible, wellness_flag
from movewell.rules import DEFAULT

MODES = (WALK_MODE, BIKE_MODE, "Transports en commun", None)
DISTANCES = (0.0, 14.99, 15.0, 15.01, 24.99, 25.0, 25.01, None, math.nan)
LIMITS = {WALK_MODE: 15.0, BIKE_MODE: 25.0}


def expected_eligible(mode, distance):
    return mode in LIMITS and distance is not None and distance <= LIMITS[mode]


def expected_plausible(mode, distance):
    return not (mode in LIMITS and distance is not None and distance > LIMITS[mode])


def test_every_mode_and_bound(spark):
    cases = list(itertools.product(MODES, DISTANCES))
    frame = spark.createDataFrame(cases, "mode string, km double").select(
        "mode", "km", commute_eligible(F.col("mode"), F.col("km"), DEFAULT).alias("eligible"),
        declaration_plausible(F.col("mode"), F.col("km"), DEFAULT).alias("plausible"))
    rows = frame.collect()
    assert len(rows) == len(cases)
    for row in rows:
        assert row["eligible"] is expected_eligible(row["mode"], row["km"]), row
        assert row["plausible"] is expected_plausible(row["mode"], row["km"]), row


def test_bonus_amount(spark):
    cases = [(True, 40000.0), (False, 40000.0), (True, None), (False, None)]
    rows = spark.createDataFrame(cases, "eligible boolean, salary double").select(
        bonus_euros(F.col("eligible"), F.col("salary"), DEFAULT).alias("euros")).collect()
    assert [row["euros"] for row in rows] == [40000.0 * 0.05, 0.0, None, 0.0]


def test_wellness_bound_is_inclusive(spark):
    rows = spark.createDataFrame([(14,), (15,), (16,)], "n bigint").select(wellness_flag(F.col("n"), DEFAULT).alias("f"))
    assert [row["f"] for row in rows.collect()] == [False, True, True]
