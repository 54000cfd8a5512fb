"""Numbers and texts as people see them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from movewell.fixed_values import NOTIFICATION_LINES


def metres_to_km(metres: Column) -> Column:
    """Kilometres with two decimals.

    format_number rounds the binary value itself and sends exact ties to the even digit,
    as the services that wrote the existing distances do; round() works on the decimal
    digits and would differ for about one metre value in twenty.
    """
    return F.replace(F.format_number(metres / F.lit(1000.0), 2), F.lit(","), F.lit("")).cast("double")


def plain_number(number: Column) -> Column:
    """A double as Python writes it: plain from 0.0001 to below 1e16, else with a two-digit exponent.

    The string cast has the digits, but turns to exponents outside [0.001, 10 000 000). They are
    moved to where Python has them, none lost.
    """
    text, size = number.cast("string"), F.abs(number)
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    head = F.regexp_extract(text, r"^-?(\d)\.(\d+)E", 1)
    tail = F.regexp_replace(F.regexp_extract(text, r"^-?(\d)\.(\d+)E", 2), "0+$", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), head, tail)
    whole = F.rpad(tail, F.greatest(power, F.length(tail)), "0")
    rest = F.substring(whole, power + 1, F.length(whole))
    large = F.concat(sign, head, F.substring(whole, F.lit(1), power), F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(
        F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    scientific = F.concat(sign, head, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail)), exponent)
    return (F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e-3), small)
            .when((size >= 1e7) & (size < 1e16), large).otherwise(scientific))


def notification_text(columns: dict[str, Column]) -> Column:
    """Fill the notification template; a missing value reads 'None'."""
    def line(template: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", template)  # text, name, text, name, ...
        parts = [F.coalesce(columns[piece].cast("string"), F.lit("None")) if position % 2 else F.lit(piece)
                 for position, piece in enumerate(pieces) if piece]
        return F.concat(*parts)

    return F.concat_ws("\n", *(line(template) for template in NOTIFICATION_LINES))
