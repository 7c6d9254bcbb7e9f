"""Timestamps as ISO-8601 text in UTC. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts by the shape of the text, for text Spark's own parsing does not take.
# Where a shape has two layouts, the second is for a first number that cannot be a month.
SHAPED_LAYOUTS = (
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", ("M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss")),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", ("yyyy/M/d",)),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", ("yyyy/M/d H:mm:ss",)),
    (r"^[0-9]{8}$", ("yyyyMMdd",)),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", ("d MMM yyyy",)),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", ("MMM d, yyyy",)),
)


def parse_timestamp(text: Column) -> Column:
    """Text to timestamp, NULL where no layout fits. Text without an offset is UTC.

    Spark's own parsing comes first. Only text it refuses is matched by shape, so a
    layout is tried only where it should fit: a failing layout costs an exception.
    """
    shaped = None
    for shape, layouts in SHAPED_LAYOUTS:
        tried = F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in layouts])
        shaped = F.when(text.rlike(shape), tried) if shaped is None else shaped.when(text.rlike(shape), tried)
    return F.coalesce(F.try_to_timestamp(text), shaped)


def iso_utc(moment: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.ffffff]+00:00``; the fraction only where it is not zero."""
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.date_format(moment, ".SSSSSS"))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def epoch_seconds(moment: Column) -> Column:
    return F.unix_micros(moment) / F.lit(1_000_000)


def moment_literal(iso_text: str) -> Column:
    return F.lit(iso_text).cast("timestamp")
