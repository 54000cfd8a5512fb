from pyspark.sql import functions as F

from movewell.fixed_values import ERROR_STEPS, RATE_STEPS, UP_STEPS
from movewell.functions.status import matches_fully, spark_metric_name, threshold_status
from movewell.functions.text import metres_to_km, plain_number


def test_kilometres_equal_python_rounding_for_every_metre(spark):
    rows = spark.range(0, 400_001).select("id", metres_to_km(F.col("id")).alias("km")).collect()
    wrong = [(row["id"], row["km"]) for row in rows if row["km"] != round(row["id"] / 1000, 2)]
    assert wrong == []


def test_kilometres_beyond_a_thousand(spark):
    metres = [999_995, 1_000_005, 12_345_678, 99_999_995]
    rows = spark.createDataFrame([(m,) for m in metres], "m bigint").select(metres_to_km(F.col("m")).alias("km")).collect()
    assert [row["km"] for row in rows] == [round(m / 1000, 2) for m in metres]


def test_numbers_read_as_in_python(spark):
    numbers = [0.0, 5000.0, 800.25, 0.5, 0.001, 0.0005, 0.00012, 9999999.5, 10000000.0, 12345678.25, 123456789012345.0, -20000000.5]
    rows = spark.createDataFrame([(n,) for n in numbers], "n double").select(plain_number(F.col("n")).alias("t")).collect()
    assert [row["t"] for row in rows] == [str(n) for n in numbers]


def test_numbers_of_every_size_keep_their_digits(spark):
    numbers = [s * m * 10.0 ** e for e in range(-300, 301) for m in (1.0, 1.5, 7.25) for s in (1, -1)]
    numbers += [0.000123456789012345, 1e-05, 1e16, 1e15, 123456789.0, 9999999.999, 1e7, 0.001, 0.00099999, float("nan")]
    rows = spark.createDataFrame([(n,) for n in numbers], "n double").select("n", plain_number(F.col("n")).alias("t")).collect()
    wrong = [(row["n"], row["t"]) for row in rows if row["t"].lower() != str(row["n"])]
    assert [w for w in wrong if float(w[1]) != w[0]] == []  # the same value always
    assert len(wrong) <= len(numbers) // 20  # an older Java writes a digit more than needed for a few


def test_threshold_steps(spark):
    values = [None, -1.0, 0.0, 0.5, 1.0, 79.9, 80.0, 500.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    colours = {name: [row[0] for row in frame.select(threshold_status(F.col("v"), steps)).collect()]
               for name, steps in (("up", UP_STEPS), ("rate", RATE_STEPS), ("errors", ERROR_STEPS))}
    assert colours["up"] == [None, "green", "dark-red", "dark-red", "green", "green", "green", "green"]
    assert colours["rate"] == [None, "green", "green", "green", "green", "green", "red", "red"]
    assert colours["errors"] == [None, "green", "green", "green", "red", "red", "red", "red"]


def test_step_order_does_not_matter(spark):
    frame = spark.createDataFrame([(5,), (50,)], "v int")
    shuffled = ((10, "b"), (None, "base"), (40, "c"), (1, "a"))
    assert [row[0] for row in frame.select(threshold_status(F.col("v"), shuffled)).collect()] == ["a", "c"]


def test_metric_names_and_full_match(spark):
    frame = spark.createDataFrame([("bronze",), ("gold",), ("golden",), ("a\ngold",)], "app string")
    kept = frame.where(matches_fully(F.col("app"), "bronze|gold")).select(spark_metric_name(F.col("app"))).collect()
    assert [row[0] for row in kept] == ["spark_bronze", "spark_gold"]
