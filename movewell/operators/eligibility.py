"""Benefit eligibility: commute bonus, activity counts and their join."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewell.functions.benefits import bonus_euros, commute_eligible, wellness_flag
from movewell.functions.time import moment
from movewell.operators.joins import left_join_unique
from movewell.rules import Rules
from movewell.schemas import GOLD


def commute_bonus(hr: DataFrame, rules: Rules) -> DataFrame:
    """One row per HR row: the bonus flag, its amount, and the flag again as declaration."""
    flagged = hr.withColumn(
        "prime_sportive", commute_eligible(F.col("moyen_dep"), F.col("distance_km"), rules))
    amount = bonus_euros(F.col("prime_sportive"), F.col("salaire_brut_annuel"), rules)
    return flagged.select(
        "employee_id", "bu", "prime_sportive", amount.alias("montant_prime_euros"), "distance_km",
        F.col("prime_sportive").alias("declaration_correcte"))


def trailing(activities: DataFrame, as_of: datetime, days: int, when: str = "date_debut_ts") -> DataFrame:
    """Activities of the ``days`` up to ``as_of``; the filter reaches the scan."""
    return activities.where(F.col(when).between(moment(as_of - timedelta(days=days)), moment(as_of)))


def activity_counts(activities: DataFrame) -> DataFrame:
    """Activities per employee.

    Only the id is read, rows without one are dropped in the scan, and partial counts leave
    each task as one row per employee, so a busy employee costs no more than a quiet one. The
    id takes its join type before grouping, which keeps the grouping's partitioning usable.
    """
    return (activities.where(F.col("employee_id").isNotNull())
            .groupBy(F.col("employee_id").cast("bigint").alias("employee_id"))
            .agg(F.count(F.lit(1)).alias("nb_activites")))


def wellness_days(activities: DataFrame, rules: Rules) -> DataFrame:
    """Activities per employee with the well-being flag."""
    return with_wellness_flag(activity_counts(activities), rules)


def with_wellness_flag(counts: DataFrame, rules: Rules) -> DataFrame:
    return counts.withColumn("jours_bien_etre", wellness_flag(F.col("nb_activites"), rules))


def gold_from_counts(hr: DataFrame, counts: DataFrame, rules: Rules) -> DataFrame:
    """Every HR row with its bonus and activity count; employees without activity get 0."""
    joined = left_join_unique(commute_bonus(hr, rules), with_wellness_flag(counts, rules), "employee_id")
    return joined.withColumns({
        "nb_activites": F.coalesce("nb_activites", F.lit(0).cast("bigint")),
        "jours_bien_etre": F.coalesce("jours_bien_etre", F.lit(False)),
    }).select(*GOLD.names)


def gold_of_changed(hr: DataFrame, counts: DataFrame, rules: Rules) -> DataFrame:
    """The gold rows of the employees in ``counts`` alone. The counts are read once."""
    return commute_bonus(hr, rules).join(with_wellness_flag(counts, rules), "employee_id").select(*GOLD.names)


def gold_eligibility(hr: DataFrame, activities: DataFrame, rules: Rules) -> DataFrame:
    return gold_from_counts(hr, activity_counts(activities), rules)
