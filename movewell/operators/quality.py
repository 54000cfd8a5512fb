"""Declarative data quality: a suite of rules compiled to column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movewell.fixed_values import ACTIVITY_TYPES, GENERATED_SECONDS, MARKER_TYPE
from movewell.functions.time import moment
from movewell.operators.joins import key_counts

NOT_NULL = "expect_column_values_to_not_be_null"
IN_SET = "expect_column_values_to_be_in_set"
BETWEEN = "expect_column_values_to_be_between"


@dataclass(frozen=True)
class Expectation:
    """One rule. An IN_SET rule with ``values=None`` is checked against a reference table."""

    kind: str
    column: str
    values: tuple[Any, ...] | None = None
    lowest: Any = None
    highest: Any = None

    @property
    def by_reference(self) -> bool:
        return self.kind == IN_SET and self.values is None


Suite = tuple[Expectation, ...]

# The rules activity rows are held to. The bounds of date_debut depend on the
# run (with_date_bounds) and the employee ids come from HR.
ACTIVITY_SUITE: Suite = (
    Expectation(NOT_NULL, "employee_id"),
    Expectation(IN_SET, "employee_id"),
    Expectation(BETWEEN, "distance_m", lowest=0, highest=20000),
    Expectation(BETWEEN, "duree_s", lowest=GENERATED_SECONDS[0], highest=GENERATED_SECONDS[1]),
    Expectation(BETWEEN, "date_debut"),
    Expectation(IN_SET, "type_activite", values=ACTIVITY_TYPES),
)


class ValidationFailed(Exception):
    """Raised with the failed rules; ``failures`` holds (rule, column, unexpected count)."""

    def __init__(self, failures: list[tuple[str, str, int]]):
        self.failures = failures
        super().__init__("; ".join(f"{kind} on {column}: {count} unexpected" for kind, column, count in failures))


def suite_from_json(text: str) -> Suite:
    """A stored suite. An empty value set stands for a reference table, text bounds for run-time ones."""
    def parse(entry: Mapping[str, Any]) -> Expectation:
        given = entry["kwargs"]
        bounds = [None if isinstance(bound, str) else bound
                  for bound in (given.get("min_value"), given.get("max_value"))]
        values = tuple(given["value_set"]) if given.get("value_set") else None
        if entry["expectation_type"] not in (NOT_NULL, IN_SET, BETWEEN):
            raise ValueError(f"unknown expectation {entry['expectation_type']}")
        return Expectation(entry["expectation_type"], given["column"], values, *bounds)

    return tuple(parse(entry) for entry in json.loads(text)["expectations"])


def without_column(suite: Suite, column: str) -> Suite:
    return tuple(rule for rule in suite if rule.column != column)


def with_date_bounds(suite: Suite, as_of: datetime, column: str = "date_debut") -> Suite:
    """Bounds for the date rule: the 365 days up to ``as_of``, and one hour of clock drift."""
    bounds = {"lowest": as_of - timedelta(days=365), "highest": as_of + timedelta(hours=1)}
    return tuple(replace(rule, **bounds) if rule.kind == BETWEEN and rule.column == column else rule
                 for rule in suite)


def is_checked(marker_column: str = "type_activite") -> Column:
    """Every row but the back-fill marker; rows without a type stay."""
    return ~F.col(marker_column).eqNullSafe(F.lit(MARKER_TYPE))


def _literal(bound: Any) -> Column:
    return moment(bound) if isinstance(bound, datetime) else F.lit(bound)


def violates(rule: Expectation, rows: DataFrame) -> Column:
    """True where the value breaks the rule. Only the not-null rule looks at missing values."""
    value = F.col(rule.column)
    if isinstance(rows.schema[rule.column].dataType, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)  # a NaN is a missing number
    if rule.kind == NOT_NULL:
        return value.isNull()
    if rule.kind == IN_SET:
        fits = value.isin(*rule.values)
    else:
        limits = [value >= _literal(rule.lowest)] if rule.lowest is not None else []
        limits += [value <= _literal(rule.highest)] if rule.highest is not None else []
        if not limits:
            raise ValueError(f"the rule on {rule.column} has no bounds yet")
        fits = limits[0] if len(limits) == 1 else limits[0] & limits[1]
    return F.coalesce(~fits, F.lit(False))


def _typed(rows: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    return rows.withColumn(column, F.col(column).cast(reference.schema[0].dataType))


def unknown_values(rows: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Distinct non-null values missing from the one-column reference, with their row counts.

    Values are counted before they meet the reference: each task sends one row per value,
    so a value that fills a third of the table is joined as a single row.
    """
    known = reference.toDF(column).dropna().distinct()
    return key_counts(_typed(rows, column, reference), column).join(known, column, "left_anti")


def rows_with_unknown_value(rows: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Rows whose non-null value is missing from the one-column reference.

    A reference within Spark's broadcast limit is looked up in the scan; beyond it rows and
    reference are shuffled, and partitions made large by a hot value are split at run time.
    """
    values = _typed(rows, column, reference).where(F.col(column).isNotNull())
    return values.join(reference.toDF(column).dropna(), column, "left_anti")


def _totals(rows: DataFrame, suite: Suite, references: Mapping[str, DataFrame]) -> DataFrame:
    """One row: rows read, rows checked and r0, r1, ... unexpected values per rule.

    All literal rules share one scan without a shuffle. A reference rule adds a scan of its
    column, aggregated per value.
    """
    checked = is_checked()
    literal = [(number, rule) for number, rule in enumerate(suite) if not rule.by_reference]
    totals = rows.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(checked).alias("rows_checked"),
        *(F.count_if(checked & violates(rule, rows)).alias(f"r{number}") for number, rule in literal))
    for number, rule in enumerate(suite):
        if rule.by_reference:
            unknown = unknown_values(rows.where(checked), rule.column, references[rule.column])
            unexpected = unknown.agg(F.coalesce(F.sum("occurrences"), F.lit(0)))
            totals = totals.withColumn(f"r{number}", unexpected.scalar())
    return totals


def dq_by_part(rows: DataFrame, suite: Suite, references: Mapping[str, DataFrame], part: str = "part") -> DataFrame:
    """One row per part and rule with rows read, rows checked and the unexpected count. The counts of parts add up.

    Each task sends one row per part for the literal rules, and one per part and value for a reference rule.
    """
    checked = is_checked()
    literal = [(number, rule) for number, rule in enumerate(suite) if not rule.by_reference]
    totals = rows.groupBy(part).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(checked).alias("rows_checked"),
        *(F.count_if(checked & violates(rule, rows)).alias(f"r{number}") for number, rule in literal))
    for number, rule in enumerate(suite):
        if rule.by_reference:
            reference = references[rule.column]
            values = _typed(rows.where(checked), rule.column, reference).where(F.col(rule.column).isNotNull())
            counted = values.groupBy(part, rule.column).agg(F.count(F.lit(1)).alias("occurrences"))
            unknown = counted.join(reference.toDF(rule.column).dropna().distinct(), rule.column, "left_anti")
            sums = unknown.groupBy(F.col(part).alias("_part")).agg(F.sum("occurrences").alias(f"r{number}"))
            totals = totals.join(sums, F.col(part).eqNullSafe(F.col("_part")), "left").drop("_part")
    results = F.array(*(F.struct(F.lit(number).alias("rule_no"), F.coalesce(F.col(f"r{number}"), F.lit(0)).alias("unexpected_count"))
                        for number in range(len(suite))))
    return totals.select(part, "rows_read", "rows_checked", F.inline(results))


def dq_merged(by_part: DataFrame, suite: Suite) -> DataFrame:
    """The statistics of all parts together, as dq_statistics gives them for the whole table."""
    names = F.array(*(F.struct(F.lit(rule.kind).alias("expectation"), F.lit(rule.column).alias("column_name")) for rule in suite))
    sums = by_part.groupBy("rule_no").agg(*(F.sum(c).alias(c) for c in ("rows_read", "rows_checked", "unexpected_count")))
    named = sums.withColumn("_name", F.get(names, F.col("rule_no")))
    return named.select("rows_read", "rows_checked", "rule_no", "_name.expectation", "_name.column_name", "unexpected_count",
                        (F.col("unexpected_count") == 0).alias("success"))


def dq_statistics(rows: DataFrame, suite: Suite, references: Mapping[str, DataFrame]) -> DataFrame:
    """One row per rule with its unexpected count."""
    results = F.array(*(
        F.struct(F.lit(number).alias("rule_no"), F.lit(rule.kind).alias("expectation"),
                 F.lit(rule.column).alias("column_name"), F.col(f"r{number}").alias("unexpected_count"))
        for number, rule in enumerate(suite)))
    return (_totals(rows, suite, references)
            .select("rows_read", "rows_checked", F.inline(results))
            .withColumn("success", F.col("unexpected_count") == 0))


def dq_summary(statistics: DataFrame) -> DataFrame:
    """One row: rules evaluated, passed and failed, and the percentage passed."""
    passed, evaluated = F.count_if("success"), F.count(F.lit(1))
    return statistics.agg(
        F.max("rows_read").alias("rows_read"), F.max("rows_checked").alias("rows_checked"),
        evaluated.alias("evaluated"), passed.alias("successful"),
        (evaluated - passed).alias("unsuccessful"),
        (passed * 100.0 / evaluated).alias("success_percent"),
        (evaluated == passed).alias("success"))


def dq_violations(rows: DataFrame, suite: Suite, references: Mapping[str, DataFrame],
                  key: str = "id") -> DataFrame:
    """One row per broken rule and checked row: the key, the rule and the value as text.

    Literal rules are decided in the scan. A reference rule joins only (key, value) pairs.
    """
    def evidence(number: int, rule: Expectation) -> Column:
        return F.struct(F.lit(number).alias("rule_no"), F.lit(rule.kind).alias("expectation"),
                        F.lit(rule.column).alias("column_name"),
                        F.col(rule.column).cast("string").alias("value"))

    checked = rows.where(is_checked())
    literal = [(number, rule) for number, rule in enumerate(suite) if not rule.by_reference]
    found = []
    if literal:
        broken = [violates(rule, rows) for _, rule in literal]
        evidences = F.array_compact(F.array(*(
            F.when(fails, evidence(number, rule)) for fails, (number, rule) in zip(broken, literal))))
        found.append(checked.where(reduce(or_, broken)).select(key, F.inline(evidences)))
    for number, rule in enumerate(suite):
        if rule.by_reference:
            unknown = rows_with_unknown_value(checked.select(key, rule.column), rule.column, references[rule.column])
            found.append(unknown.select(key, F.inline(F.array(evidence(number, rule)))))
    return reduce(DataFrame.unionByName, found)


def invalid_employee_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct employee ids of checked activities that HR does not know."""
    return unknown_values(rows.where(is_checked()), "employee_id", ids).select("employee_id")


def evaluated(statistics: DataFrame) -> DataFrame:
    """The statistics as local rows, one per rule: what reads them later scans nothing again."""
    return statistics.sparkSession.createDataFrame(statistics.collect(), statistics.schema)


def require_success(statistics: DataFrame) -> None:
    """Raise if a rule failed. The driver sees one row per rule, never data rows."""
    failed = statistics.where(~F.col("success")).orderBy("rule_no")
    failures = [(row["expectation"], row["column_name"], row["unexpected_count"]) for row in failed.collect()]
    if failures:
        raise ValidationFailed(failures)
