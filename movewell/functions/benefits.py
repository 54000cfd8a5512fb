"""Predicates and amounts of the commute benefit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from movewell.fixed_values import BIKE_MODE, WALK_MODE
from movewell.rules import Rules


def commute_limit_km(mode: Column, rules: Rules) -> Column:
    """Longest commute that the mode may cover; null for modes that earn nothing."""
    return (F.when(mode == WALK_MODE, F.lit(rules.max_walk_km))
             .when(mode == BIKE_MODE, F.lit(rules.max_bike_km)))


def commute_eligible(mode: Column, distance_km: Column, rules: Rules) -> Column:
    """True within the limit, bounds included. A missing mode or distance is never eligible."""
    return F.coalesce(distance_km <= commute_limit_km(mode, rules), F.lit(False))


def bonus_euros(eligible: Column, salary: Column, rules: Rules) -> Column:
    return F.when(eligible, salary * F.lit(rules.percent)).otherwise(F.lit(0.0))


def declaration_plausible(mode: Column, distance_km: Column, rules: Rules) -> Column:
    """False only when a sport mode is declared beyond its limit.

    Spark sorts NaN above every number, so a NaN distance is made null first: an unknown
    distance never contradicts a declaration.
    """
    known = F.when(~F.isnan(distance_km), distance_km)
    return ~F.coalesce(known > commute_limit_km(mode, rules), F.lit(False))


def wellness_flag(count: Column, rules: Rules) -> Column:
    return count >= F.lit(rules.min_activities)
