"""Indicators over the published gold table, in SQL as BI clients would ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from movewell.fixed_values import GOLD_VIEW

# Money is summed as decimals, so the total does not depend on the order of addition.
_MEASURES = """
    count(*) AS employees,
    sum(CASE WHEN prime_sportive THEN 1 ELSE 0 END) AS primes,
    CAST(sum(CAST(montant_prime_euros AS DECIMAL(18, 4))) AS DOUBLE) AS total_primes_euros,
    sum(CASE WHEN jours_bien_etre THEN 1 ELSE 0 END) AS bien_etre,
    sum(nb_activites) AS activites
"""


def kpi_by_unit(spark: SparkSession, table: str = GOLD_VIEW) -> DataFrame:
    return spark.sql(f"SELECT bu, {_MEASURES} FROM {table} GROUP BY bu")


def kpi_total(spark: SparkSession, table: str = GOLD_VIEW) -> DataFrame:
    return spark.sql(f"SELECT {_MEASURES} FROM {table}")
