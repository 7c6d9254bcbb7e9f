"""Text, number, time and draw expressions against Python."""

import math
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from contractflow.functions import draws, numbers, text, times

FLOATS = [0.0, -0.0, 1.0, -5.0, 0.1, 29.99, 1e-3, 9.99e-4, 1.5e-4, 1e-4, 9.9e-5, 1e-5, -2.5e-7, 1e6, 9999999.0, 1e7,
          12345678.0, 123456789.125, -1.25e10, 9007199254740993.0, 1e15, 1.5e15, 9.999e15, 1e16, 1.5e16, -3e22, 1e100,
          1.5e-100, float("inf"), float("-inf"), float("nan"), 1 / 3, 2e16 / 3]


def test_floats_print_as_python_prints_them(spark):
    frame = spark.createDataFrame([(v,) for v in FLOATS], "v double")
    shown = frame.select("v", text.float_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in shown] == [repr(v) for v in FLOATS]


TEXTS = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\there", "line\nbreak", ""]


def test_quotes_follow_repr(spark):
    frame = spark.createDataFrame([(v,) for v in TEXTS], "v string")
    assert [r[0] for r in frame.select(text.quoted(F.col("v"))).collect()] == [repr(v) for v in TEXTS]


NUMBERS = ["12", "12.0", " 7 ", "-3", "+4", "1_000", "1__0", "abc", "", ".5", "5.", ".", "1e3", "1E-2", "inf", "-Infinity",
           "nan", "0x10", "12d", "1f", "9223372036854775807", "9223372036854775808", "--1", "1 2"]


def _python(convert, value):
    try:
        return convert(value)
    except ValueError:
        return None


def test_text_to_number_follows_python(spark):
    frame = spark.createDataFrame([(v,) for v in NUMBERS], "v string")
    found = frame.select(numbers.parse_float(F.col("v")).alias("f"), numbers.parse_int(F.col("v")).alias("i")).collect()
    for value, row in zip(NUMBERS, found):
        wanted = _python(float, value)
        same_nan = wanted is not None and math.isnan(wanted) and math.isnan(row["f"])
        assert same_nan or row["f"] == wanted, value
        whole = _python(int, value)
        assert row["i"] == (whole if whole is None or abs(whole) < 2**63 else None), value


@pytest.mark.parametrize("given, wanted", [
    ("2026-04-07 12:00:00", "2026-04-07T12:00:00+00:00"),
    ("2026-04-07T12:00:00+05:00", "2026-04-07T07:00:00+00:00"),
    ("2026-04-07T12:00:00.5", "2026-04-07T12:00:00.500000+00:00"),
    ("2026-04", "2026-04-01T00:00:00+00:00"),
    ("04/07/2026", "2026-04-07T00:00:00+00:00"),
    ("13/04/2026", "2026-04-13T00:00:00+00:00"),
    ("20260407", "2026-04-07T00:00:00+00:00"),
    ("garbage", None),
])
def test_timestamps_become_iso_utc(spark, given, wanted):
    frame = spark.createDataFrame([(given,)], "v string")
    assert frame.select(times.iso_utc(times.parse_timestamp(F.col("v")))).first()[0] == wanted


def test_epoch_text_round_trip(spark):
    moment = datetime(2026, 4, 5, 12, 0, 0, 250000, timezone.utc)
    frame = spark.createDataFrame([(moment.isoformat(),)], "v string")
    assert frame.select(times.epoch_seconds(F.try_to_timestamp("v"))).first()[0] == moment.timestamp()


def test_draws_do_not_depend_on_partitioning(spark):
    def drawn(ids):
        return {r["id"]: (r["a"], r["b"]) for r in draws.seeded(ids, "id").select(
            "id", draws.draw(5).alias("a"), draws.normal(8).alias("b")).collect()}
    assert drawn(spark.range(0, 500, 1, 1)) == drawn(spark.range(0, 500, 1, 7).repartition(3))


def test_draws_are_spread_evenly_and_streams_differ(spark):
    n = 20000
    frame = draws.seeded(spark.range(n), "id").select(
        draws.below(3, 10).alias("a"), draws.below(4, 10).alias("b"), draws.normal(6).alias("z"),
        draws.below(9, 10**12).alias("wide"))
    rows = frame.collect()
    slack = 4 * math.sqrt(n * 0.1 * 0.9)
    assert all(abs(c - n / 10) < slack for c in Counter(r["a"] for r in rows).values())
    pairs = Counter((r["a"], r["b"]) for r in rows)
    assert len(pairs) == 100 and max(pairs.values()) < n / 100 + 6 * math.sqrt(n / 100)
    assert len({r["wide"] for r in rows}) == n and 0.45 < sum(r["wide"] for r in rows) / n / 10**12 < 0.55
    mean = sum(r["z"] for r in rows) / n
    spread = math.sqrt(sum((r["z"] - mean) ** 2 for r in rows) / (n - 1))
    assert abs(mean) < 4 / math.sqrt(n) and abs(spread - 1) < 4 / math.sqrt(2 * n)
