"""First-wins deduplication against brute force, with a hot key, and its plans."""

import random

import pytest
from conftest import SMALL, plan_of
from pyspark.sql import functions as F

from contractflow.model import SALES
from contractflow.operators import dedup, rows
from contractflow.operators.normalize import normalize
from contractflow.sources import views


def skewed(spark, n=3000):
    """A third of the rows share one key, a tenth have none."""
    rng = random.Random(7)
    data = []
    for i in range(1, n + 1):
        roll = rng.random()
        key = "HOT" if roll < 0.33 else None if roll < 0.43 else "" if roll < 0.45 else f"k{rng.randrange(n // 2)}"
        product = None if rng.random() < 0.3 else f"k{rng.randrange(n // 2)}"
        data.append((key, product, i))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "receipt_id string, product_id string, _row bigint").repartition(6)


def brute(data, within=lambda row: 0):
    seen, kept, dropped = set(), set(), set()
    for key, product, row in sorted(data, key=lambda r: r[2]):
        value = key or product
        if value and (within(row), value) in seen:
            dropped.add(row)
            continue
        if value:
            seen.add((within(row), value))
        kept.add(row)
    return kept, dropped


def test_both_forms_agree_with_brute_force(spark):
    data, frame = skewed(spark)
    kept, dropped = brute(data)
    assert {r["_row"] for r in dedup.keep_first(frame, "receipt_id").collect()} == kept
    marked = dedup.mark_duplicates(frame, "receipt_id").collect()
    assert len(marked) == len(data)
    assert {r["_row"] for r in marked if r["_dup"]} == dropped
    counted = dedup.duplicate_counts(frame, "receipt_id").first()
    assert (counted["rows"], counted["duplicates"]) == (len(data), len(dropped))


def test_slices_forget_each_other(spark):
    data, frame = skewed(spark)
    sliced = rows.with_slices(frame, 100, None)
    marked = dedup.mark_duplicates(sliced, "receipt_id", within=["batch_id"]).collect()
    assert {r["_row"] for r in marked if r["_dup"]} == brute(data, lambda row: (row - 1) // 100)[1]


def test_keeping_the_first_limits_before_the_shuffle(spark):
    plan = plan_of(dedup.keep_first(skewed(spark)[1], "receipt_id"))
    assert plan.count("WindowGroupLimit") == 2  # one on each side of the exchange


def test_marking_uses_no_window(spark):
    frame = normalize(views.sales(spark, SMALL), SALES)
    plan = plan_of(dedup.mark_duplicates(frame, "receipt_id"))
    assert "Window" not in plan and "partial_min" in plan


def test_duplicate_count_does_not_depend_on_the_row_order(spark):
    """Ordered by all columns instead of the file position, as many rows are dropped."""
    frame = normalize(views.sales(spark, "/root/testdata/sf0.01"), SALES)
    order = ["receipt_id", "product_id", "sale_timestamp", "units_sold", "store_id", "_row"]
    assert frame.count() - dedup.keep_first(frame, "receipt_id", order).count() == 13930


def test_row_numbers_over_several_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    numbered = rows.scan_with_rows(spark, path).collect()
    assert sorted(r["_row"] for r in numbered) == list(range(1, 1001))
    assert all(r["id"] == r["_row"] - 1 for r in numbered)


def test_first_rows_open_only_the_files_they_need(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 10).write.parquet(path)
    first = rows.scan_first_rows(spark, 150, path)
    assert sorted((r["_row"], r["id"]) for r in first.collect()) == [(i + 1, i) for i in range(150)]
    assert len(first.inputFiles()) == 2


def test_numbering_by_order_spreads_ties(spark):
    frame = spark.range(2000).withColumn("v", F.when(F.col("id") < 1500, 1).otherwise(F.col("id")))
    numbered = rows.number_by_order(frame.repartition(5), ["v"]).orderBy("_row").collect()
    assert [r["_row"] for r in numbered] == list(range(1, 2001))
    assert [r["v"] for r in numbered] == sorted(r["v"] for r in numbered)


@pytest.mark.parametrize("size, cap, wanted", [(10, 2, {1: 10, 2: 10}), (10, None, {1: 10, 2: 10, 3: 5})])
def test_slices(spark, size, cap, wanted):
    frame = spark.range(1, 26).withColumnRenamed("id", "_row")
    found = {r["batch_id"]: r["count"] for r in rows.with_slices(frame, size, cap).groupBy("batch_id").count().collect()}
    assert found == wanted


def test_rows_are_flagged_before_they_grow(spark):
    """The join that flags duplicates carries rows as they arrived; normalized texts and messages are made behind it."""
    from contractflow.model import SALES
    from contractflow.plans import batch
    from contractflow.sources import views
    judged = batch.judge(views.sales(spark, "/root/testdata/sf0.001"), SALES)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "_moment_sale_timestamp" in above and "_moment_sale_timestamp" not in below
