"""Text to number with Python's rules, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's float() and int() accept as text.
FLOAT_PATTERN = r"^[+-]?([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"
SPECIAL_PATTERN = r"^[+-]?(inf|infinity|nan)$"
INT_PATTERN = r"^[+-]?[0-9](_?[0-9])*$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_float(text: Column) -> Column:
    """``float(text)`` as a double, NULL where Python would raise."""
    body = _trimmed(text)
    bare = F.lower(F.regexp_replace(body, r"^[+-]", ""))
    special = (
        F.when(bare == "nan", F.lit(float("nan")))
        .when(body.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    plain = F.replace(body, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(body.rlike(FLOAT_PATTERN), plain).when(F.lower(body).rlike(SPECIAL_PATTERN), special)


def parse_int(text: Column) -> Column:
    """``int(text)`` as a bigint, NULL where Python would raise or the value needs more than 64 bits."""
    body = _trimmed(text)
    return F.when(body.rlike(INT_PATTERN), F.replace(body, F.lit("_"), F.lit("")).try_cast("bigint"))


def whole_part(number: Column) -> Column:
    """The value cut towards zero, still a double, so no range is lost."""
    return number - (number % F.lit(1.0))


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def half_even(number: Column, digits: int) -> Column:
    """Round to ``digits`` decimals with ties to the even digit."""
    return F.bround(number, digits).cast("double")
