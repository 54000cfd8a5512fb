"""Status colours and metric names of the stream-health views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_status(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Colour of the highest step the value reaches; the base colour below all, null for null."""
    base = next((colour for bound, colour in steps if bound is None), None)
    bounds = sorted((step for step in steps if step[0] is not None), reverse=True)
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, colour in bounds:
        chain = chain.when(value >= F.lit(bound), F.lit(colour))
    return chain.otherwise(F.lit(base))


def spark_metric_name(name: Column) -> Column:
    return F.concat(F.lit("spark_"), name)


def matches_fully(text: Column, pattern: str) -> Column:
    """Regular-expression match of the whole text, the way metric selectors match labels."""
    return text.rlike(rf"\A(?:{pattern})\z")
