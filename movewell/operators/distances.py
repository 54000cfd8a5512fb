"""Commute distances: addresses to resolve, enrichment of HR, declaration check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewell.functions.benefits import declaration_plausible
from movewell.operators.joins import left_join_unique
from movewell.rules import Rules


def distinct_addresses(hr: DataFrame, address: str = "address") -> DataFrame:
    return hr.select(address).dropna().distinct()


def distance_enrich(hr: DataFrame, distances: DataFrame, address: str = "address") -> DataFrame:
    """HR rows with the distance of their address; null where it is unknown.

    The distances should hold one row per address. If an address was answered more than
    once, the shortest known distance is used, so the join cannot multiply HR rows.
    """
    lookup = distances.groupBy(address).agg(F.min("distance_km").alias("distance_km"))
    return left_join_unique(hr.drop("distance_km"), lookup, address)


def declaration_check(hr: DataFrame, rules: Rules) -> DataFrame:
    return hr.withColumn(
        "declaration_correcte", declaration_plausible(F.col("moyen_dep"), F.col("distance_km"), rules))
