"""Values as the contract messages print them.

Messages follow Python's ``str`` and ``repr``: text is quoted, floats use the
shortest form with an exponent only from 1e16 up and below 1e-4.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE_TEXT = "None"


def kind_of(data_type: T.DataType) -> str:
    """The Python type name a column's values would carry."""
    if isinstance(data_type, T.StringType):
        return "str"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.FractionalType,)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "Timestamp"
    if isinstance(data_type, T.DateType):
        return "date"
    return data_type.typeName()


def float_text(value: Column) -> Column:
    """A double in Python's shortest notation, from Spark's own shortest digits."""
    number = value.cast("double")
    plain = number.cast("string")
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(plain, "^-|E.*$", "")
    exponent = F.regexp_extract(plain, "E(-?[0-9]+)$", 1).cast("int")
    whole = F.substring_index(digits, ".", 1)
    fraction = F.regexp_replace(F.substring_index(digits, ".", -1), "^0$", "")
    run = F.concat(whole, fraction)
    size = F.abs(number)

    shifted = F.rpad(run, exponent + 1, "0")
    rest = run.substr(exponent + 2, F.length(run))
    large = F.concat(sign, shifted, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    small = F.concat(sign, F.lit("0.000"), run)
    mantissa = F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    scientific = F.concat(
        sign, mantissa, F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"),
    )
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), plain)
        .when((size >= 1e7) & (size < 1e16), large)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(scientific)
    )


def as_text(value: Column, kind: str) -> Column:
    """``str(value)`` for a column of the given kind; NULL stays NULL."""
    if kind == "float":
        return float_text(value)
    if kind == "bool":
        return F.initcap(value.cast("string"))
    return value.cast("string")


def quoted(text: Column) -> Column:
    """``repr`` of a text value."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), double).otherwise(single)


def as_literal(value: Column, kind: str) -> Column:
    """``repr(value)`` for a column of the given kind."""
    text = as_text(value, kind)
    return quoted(text) if kind == "str" else text


def blank_to_null(value: Column) -> Column:
    """Empty text counts as absent, the way an ``or`` chain skips it."""
    return F.when(value != "", value)


def first_filled(*values: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(value) for value in values])


def optional_items(*items: tuple[Column, Column]) -> Column:
    """An array holding, in order, the text of each ``(condition, text)`` that holds.

    Built by concatenation, which keeps the expression inside generated code.
    """
    none = F.array().cast(T.ArrayType(T.StringType()))
    if not items:
        return none
    return F.concat(*[F.when(condition, F.array(text)).otherwise(none) for condition, text in items])
