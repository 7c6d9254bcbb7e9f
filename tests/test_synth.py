"""Profiles and synthetic rows: shapes, rates, bounds and repeatability."""

import math

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from contractflow.checks.queries import QUERIES
from contractflow.operators import profiling, synth
from contractflow.sources import views

RUN_AT = "2026-04-05T12:00:00+00:00"
N = 4000


def near(share, rate, n):
    return abs(share - rate) < 4 * math.sqrt(rate * (1 - rate) / n) + 1e-9


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(1, 51).select(F.concat(F.lit("ART-"), "id").alias("product_id"), F.col("id").alias("_row"))


def test_profile_kinds_at_the_limit(spark):
    frame = spark.range(2000).select(
        (F.col("id") % 20).alias("few"), (F.col("id") % 21).alias("many"), F.lit(None).cast("double").alias("nothing"),
        F.lit("x").alias("word"), F.when(F.col("id") % 4 > 0, F.lit("2026-04")).alias("sales_period"),
        F.lit("soon").alias("due_date"), F.col("id").alias("update_count"),
        F.when(F.col("id") % 10 == 0, float("nan")).otherwise(F.col("id") / 7).alias("measure"))
    found = {p.name: p for p in profiling.profile(frame)}
    assert {n: p.kind for n, p in found.items()} == {
        "few": "categorical", "many": "numeric", "nothing": "constant", "word": "categorical",
        "sales_period": "timestamp", "due_date": "categorical", "update_count": "numeric", "measure": "numeric"}
    assert found["sales_period"].null_rate == 0.25 and found["measure"].null_rate == 0.1
    assert found["sales_period"].min == found["sales_period"].max == 1774_994_400 + 7200
    made = synth.generate(synth.row_ids(spark, 10), [found["nothing"]])
    assert made.where("nothing is not null").count() == 0


def test_frequencies_add_up(spark):
    frame = views.warehouse(spark, SMALL)
    profiles = profiling.profile(frame)
    sums = profiling.value_frequencies(frame, profiles).groupBy("column").agg(F.sum("probability").alias("p"))
    assert all(abs(r["p"] - 1) < 1e-9 for r in sums.collect())


def test_sampled_columns_follow_their_profile(spark):
    profiles = [
        profiling.ColumnProfile("c", profiling.CATEGORICAL, 100, 80, values=(("a", 60), ("b", 20))),
        profiling.ColumnProfile("n", profiling.NUMERIC, 100, 100, 10.0, 2.0, 7.0, 13.0),
        profiling.ColumnProfile("t", profiling.TIMESTAMP, 10, 10, min=0.0, max=100.0)]
    rows = synth.generate(synth.row_ids(spark, N), profiles).collect()
    assert near(sum(r["c"] is None for r in rows) / N, 0.2, N)
    assert near(sum(r["c"] == "a" for r in rows) / N, 0.6, N)
    assert all(7.0 <= r["n"] <= 13.0 for r in rows)
    assert abs(sum(r["n"] for r in rows) / N - 10) < 0.15
    assert all("1970-01-01T00:00:00" <= r["t"] <= "1970-01-01T00:01:40+00:00" for r in rows)
    with pytest.raises(RuntimeError):
        synth.generate(synth.row_ids(spark, 1), [])


def test_domains_of_any_size_are_drawn_alike(spark):
    """64 and 65 values around the limit of lists, and thousands; one value holds half of all rows."""
    for many in (64, 65, 3000):
        source = spark.range(4 * many).select(
            F.when(F.col("id") % 4 > 0, F.when(F.col("id") % 4 == 1, F.concat(F.lit("v"), (F.col("id") / 4).cast("int"))).otherwise("hot")).alias("name"))
        listed, tabled = (profiling.with_domains(source, profiling.profile(source, ["name"]), limit) for limit in (5000, 1))
        assert tabled[0].values == () and len(listed[0].values) == many + 1
        rows = synth.generate(synth.row_ids(spark, N), tabled).collect()
        assert len(rows) == N and near(sum(r["name"] is None for r in rows) / N, 0.25, N)
        assert near(sum(r["name"] == "hot" for r in rows) / N, 0.5, N)
        if many < 100:
            assert {tuple(r) for r in rows} == {tuple(r) for r in synth.generate(synth.row_ids(spark, N), listed).collect()}
    with pytest.raises(RuntimeError):
        synth.generate(synth.row_ids(spark, 1), profiling.profile(source, ["name"]))


def test_warehouse_rules(spark):
    rows = synth.warehouse_rules(synth.row_ids(spark, N)).collect()
    codes = dict(synth.COLORS)
    assert len({r["product_id"] for r in rows}) == N
    for r in rows:
        assert r["product_id"] == f"{r['article_id']}-{codes[r['color']]}-{r['size']}"
        assert (r["reorder_threshold"], r["max_capacity"], r["unit_cost"]) == (50, 500, 30.0)
    assert {r["size"] for r in rows} == set(synth.SIZES)


def test_manufacturing_rules(spark, pool):
    rows = synth.manufacturing_rules(pool, 50, RUN_AT)(synth.row_ids(spark, N)).collect()
    assert near(sum(r["product_id"].islower() for r in rows) / N, 0.2, N)
    assert near(sum(r["defect_count"] is None for r in rows) / N, 0.05, N)
    assert sorted(int(r["production_batch_id"][6:]) for r in rows) == list(range(60001, 60001 + N))


def test_sales_rules(spark, pool):
    rows = synth.sales_rules(pool, 50, RUN_AT)(synth.row_ids(spark, N)).collect()
    assert near(sum(r["product_id"] is None for r in rows) / N, 0.05, N)
    assert near(sum(r["units_sold"] < 0 for r in rows) / N, 0.03, N)
    assert all(len(r["receipt_id"]) == 8 and int(r["receipt_id"], 16) >= 0 for r in rows)
    assert {r["store_id"] for r in rows} == set(synth.STORES)


def test_legacy_rules(spark, pool):
    rows = synth.legacy_rules(pool, 50, RUN_AT)(synth.row_ids(spark, N)).collect()
    assert min(r["historical_period"] for r in rows) == "2023-04" and max(r["historical_period"] for r in rows) == "2026-03"
    assert {r["market_region"] for r in rows} == set(synth.REGIONS)


def test_iot_rows_and_resends(spark, pool):
    rows = synth.iot_rows(synth.row_ids(spark, N), pool, 50, RUN_AT).collect()
    copies = len(rows) - len({r["event_id"] for r in rows})
    assert len({r["event_id"] for r in rows}) == N and near(copies / len(rows), 0.03, N)
    assert all(5 <= r["current_stock_on_shelf"] <= 150 and 10 <= int(r["battery_level"][:-1]) <= 100 for r in rows)


def test_weather_rows(spark):
    rows = synth.weather_rows(synth.row_ids(spark, N), RUN_AT).collect()
    assert near(sum(r["city"] == "Lahore" for r in rows) / N, 0.4, N)
    assert near(sum(r["weather_description"] == "clear sky" for r in rows) / N, 0.2 / 0.9, N)
    assert all(-10 <= r["temperature"] <= 50 and 0 <= r["humidity"] <= 100 for r in rows)


def test_rows_repeat_on_any_partitioning(spark, pool):
    def made(ids):
        return sorted(map(tuple, synth.sales_rules(pool, 50, RUN_AT)(ids).collect()))
    assert made(synth.row_ids(spark, 300)) == made(synth.row_ids(spark, 300).repartition(13))


def test_hook_is_applied(spark):
    profile = profiling.ColumnProfile("n", profiling.NUMERIC, 100, 100, 10.0, 2.0, 7.0, 13.0)
    made = synth.upsample(synth.row_ids(spark, 5), [profile], hook=lambda df: df.withColumn("seen", F.lit(True)))
    assert made.where("seen").count() == 5


def test_no_orphan_keys(spark):
    assert QUERIES["synth_fk"](spark, SMALL).first()["orphans"] == 0
