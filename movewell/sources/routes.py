"""Route responses: the distance in a stored answer of the routing service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewell.functions.text import metres_to_km
from movewell.schemas import ROUTE_RESPONSE


def response_metres(body: Column) -> Column:
    """Metres in the first element; null unless the answer and the element both say OK."""
    answer = F.from_json(body, ROUTE_RESPONSE)
    element = F.get(F.get(answer["rows"], F.lit(0))["elements"], F.lit(0))
    both_ok = (answer["status"] == "OK") & (element["status"] == "OK")
    return F.when(both_ok, element["distance"]["value"])


def parse_distances(responses: DataFrame, address: str = "address", body: str = "body") -> DataFrame:
    """(address, distance_km) for each response."""
    return responses.select(
        F.col(address).alias("address"), metres_to_km(response_metres(F.col(body))).alias("distance_km"))
