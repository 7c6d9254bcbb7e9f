"""Contract outcomes on literal rows."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from contractflow.model import CONTRACTS, DATASETS, IOT, LEGACY, MANUFACTURING, SALES, SOURCES, WAREHOUSE, WEATHER, ViolationPolicy
from contractflow.operators import contracts
from contractflow.plans import batch

GOOD = {
    WAREHOUSE: dict(product_id="ART-1001-MID-M", article_id="ART-1001", product_name="Slim Fit Tee",
                    color="Midnight Black", size="M", reorder_threshold=100, max_capacity=500, unit_cost=29.99),
    MANUFACTURING: dict(production_batch_id="BATCH-1", product_id="ART-1", mfg_timestamp="2026-04-07T12:00:00+00:00",
                        quantity_produced=10, defect_count=1.0),
    SALES: dict(receipt_id="R1", product_id="ART-1", sale_timestamp="2026-04-07T12:00:00+00:00", units_sold=2, store_id="S"),
    LEGACY: dict(old_product_code="OLD-1", historical_period="2026-04", total_monthly_sales=5, market_region="Asia"),
    IOT: dict(event_id="e1", timestamp="2026-04-07T12:00:00+00:00", product_id="ART-1", shelf_location="ZONE-A",
              current_stock_on_shelf=5, battery_level="64%"),
    WEATHER: dict(city="Lahore", temperature=25.0, humidity=60, weather_description="clear sky", timestamp="2026-04-07"),
}
TYPES = {str: "string", int: "bigint", float: "double"}


def frame_of(spark, source, types=None, **changes):
    row = {**GOOD[source], **changes}
    types = types or {}
    schema = ", ".join(
        f"`{n}` " + types.get(n, TYPES.get(type(v), TYPES[type(GOOD[source][n])])) for n, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


def outcome(spark, source, types=None, **changes):
    """Contract only."""
    frame = frame_of(spark, source, types, **changes)
    return contracts.apply_contract(frame, CONTRACTS[source]).first()


def full(spark, source, types=None, **changes):
    """Normalization, deduplication and contract."""
    frame = frame_of(spark, source, types, **changes).withColumn("_row", F.lit(1).cast("bigint"))
    return batch.judge(frame, source, compat=True).first()


def test_good_rows_pass(spark):
    for source in (WAREHOUSE, MANUFACTURING, SALES, IOT, WEATHER):
        assert outcome(spark, source)["_status"] == "PASS", source


def test_contract_smoke_report(spark):
    bad = spark.createDataFrame(
        [(None, None, 500, -5.0)], "product_id string, reorder_threshold bigint, max_capacity bigint, unit_cost double")
    row = contracts.apply_contract(bad, CONTRACTS[WAREHOUSE]).first()
    assert row["_status"] == "QUARANTINE"
    assert row["_violations"] == [
        "Required field 'product_id' is missing or null.",
        "Required field 'reorder_threshold' is missing or null.",
        "Field 'product_id' is NULL but not nullable.",
        "Field 'reorder_threshold' is NULL but not nullable.",
        "Field 'unit_cost' value -5.0 below min 0.0.",
    ]


@pytest.mark.parametrize("source, changes, status, messages", [
    (WAREHOUSE, dict(size="XXXL"), "QUARANTINE",
     ["Field 'size' value 'XXXL' not in allowed set {'L', 'M', 'S', 'XL', 'XS', 'XXL'}."]),
    (WAREHOUSE, dict(unit_cost=30), "QUARANTINE", ["Field 'unit_cost' expected float, got int (value=30)."]),
    (WAREHOUSE, dict(max_capacity=0), "QUARANTINE", ["Field 'max_capacity' value 0 below min 1."]),
    (SALES, dict(product_id=None), "PASS", []),
    (SALES, dict(units_sold=-2), "PASS", []),
    (SALES, dict(receipt_id=None), "QUARANTINE",
     ["Required field 'receipt_id' is missing or null.", "Field 'receipt_id' is NULL but not nullable."]),
    (SALES, dict(units_sold=None), "QUARANTINE", ["Field 'units_sold' is NULL but not nullable."]),
    (SALES, dict(units_sold=2.5), "PASS", []),
    (IOT, dict(shelf_location="ZONE-X"), "QUARANTINE",
     ["Field 'shelf_location' value 'ZONE-X' not in allowed set {'ZONE-A', 'ZONE-B', 'ZONE-C'}."]),
    (IOT, dict(current_stock_on_shelf=10000), "PASS", []),
    (IOT, dict(current_stock_on_shelf=10001), "QUARANTINE",
     ["Field 'current_stock_on_shelf' value 10001 above max 10000."]),
    (IOT, dict(battery_level=None), "PASS", []),
    (WEATHER, dict(temperature=25), "QUARANTINE", ["Field 'temperature' expected float, got int (value=25)."]),
    (WEATHER, dict(temperature=float("nan")), "QUARANTINE", ["Field 'temperature' is NULL but not nullable."]),
    (WEATHER, dict(humidity=101), "QUARANTINE", ["Field 'humidity' value 101 above max 100."]),
])
def test_quarantine_contracts(spark, source, changes, status, messages):
    row = outcome(spark, source, **changes)
    assert (row["_status"], row["_violations"]) == (status, messages)


@pytest.mark.parametrize("quantity, status, value, coercions, violations", [
    ("12", "COERCED", 12, ["'quantity_produced': '12' → 12"], []),
    ("1_000", "COERCED", 1000, ["'quantity_produced': '1_000' → 1000"], []),
    ("12.5", "QUARANTINE", None, [], ["Field 'quantity_produced' expected int, got str (value='12.5')."]),
    ("abc", "QUARANTINE", None, [], ["Field 'quantity_produced' expected int, got str (value='abc')."]),
    ("-3", "QUARANTINE", -3, [], ["Field 'quantity_produced' value -3 below min 0."]),
    ("-3.5", "QUARANTINE", None, [], ["Field 'quantity_produced' expected int, got str (value='-3.5').",
                                      "Field 'quantity_produced' value -3.5 below min 0."]),
])
def test_text_quantities_are_coerced(spark, quantity, status, value, coercions, violations):
    row = outcome(spark, MANUFACTURING, quantity_produced=quantity)
    assert (row["_status"], row["_coercions"], row["_violations"]) == (status, coercions, violations)
    assert row["_fixed_quantity_produced"] == value
    assert row["quantity_produced"] == quantity  # the quarantined form is not coerced


def test_coercion_also_cuts_fractions_of_rows_with_another_violation(spark):
    row = outcome(spark, MANUFACTURING, quantity_produced=5.7, defect_count=3)
    assert row["_status"] == "COERCED"
    assert row["_coercions"] == ["'quantity_produced': 5.7 → 5", "'defect_count': 3 → 3.0"]
    assert (row["_fixed_quantity_produced"], row["_fixed_defect_count"]) == (5.0, 3.0)
    kept = outcome(spark, MANUFACTURING, quantity_produced=5.7)
    assert (kept["_status"], kept["_fixed_quantity_produced"]) == ("PASS", 5.7)


def test_infinite_count_fails_the_row(spark):
    row = outcome(spark, MANUFACTURING, quantity_produced=float("inf"), defect_count=3)
    assert row["_status"] == "ERROR"


def test_infinite_count_passes_without_other_violation(spark):
    assert outcome(spark, MANUFACTURING, quantity_produced=float("inf"))["_status"] == "PASS"


def test_numbers_in_text_columns_become_text(spark):
    row = outcome(spark, MANUFACTURING, production_batch_id=7, product_id=1.5)
    assert row["_status"] == "COERCED"
    assert row["_coercions"] == ["'production_batch_id': 7 → '7'", "'product_id': 1.5 → '1.5'"]


def test_negative_quantity_stays_quarantined(spark):
    assert outcome(spark, MANUFACTURING, quantity_produced=-3)["_violations"] == [
        "Field 'quantity_produced' value -3 below min 0."]


def test_values_read_from_text_files_are_typed_one_by_one(spark):
    frame = spark.createDataFrame(
        [("p", "a", "n", "c", "M", "5", "10", "30"), ("p", "a", "n", "c", "M", "x", "10", "2.5")],
        "product_id string, article_id string, product_name string, color string, size string, "
        "reorder_threshold string, max_capacity string, unit_cost string")
    judged = contracts.apply_contract(frame, CONTRACTS[WAREHOUSE], SOURCES[WAREHOUSE].numeric_fields())
    good, bad = judged.orderBy("reorder_threshold").collect()
    assert good["_status"] == "PASS" and good["_fixed_unit_cost"] == 30.0
    assert bad["_violations"] == ["Field 'reorder_threshold' expected int, got str (value='x')."]


def test_reject_policy(spark):
    strict = replace(CONTRACTS[SALES], policy=ViolationPolicy.REJECT)
    row = contracts.apply_contract(frame_of(spark, SALES, units_sold=None), strict).first()
    assert (row["_status"], row["_violations"]) == ("REJECT", ["Field 'units_sold' is NULL but not nullable."])


def test_no_contract_passes(spark):
    assert contracts.apply_contract(frame_of(spark, SALES, units_sold=None), None).first()["_status"] == "PASS"


def test_normalization_outcomes(spark):
    row = full(spark, MANUFACTURING, product_id="art-1001-mid-m")
    assert row["_status"] == "PASS" and row["product_id"] == "ART-1001-MID-M"
    assert row["_changes"] == [
        "NORMALIZE | field=product_id | 'art-1001-mid-m' → 'ART-1001-MID-M' | reason=uppercase_policy"]
    row = full(spark, MANUFACTURING, defect_count=None)
    assert (row["_status"], row["defect_count"]) == ("PASS", 0.0)
    assert row["_changes"] == ["IMPUTE | field=defect_count | null → 0.0 | reason=manufacturing_imputation_policy"]
    row = full(spark, SALES, sale_timestamp="2026-04-07 12:00:00")
    assert row["sale_timestamp"] == "2026-04-07T12:00:00+00:00" and row["_n_changes"] == 1
    row = full(spark, SALES, sale_timestamp="garbage")
    assert (row["_status"], row["sale_timestamp"]) == ("PASS", "garbage")
    assert "parse_error=" in row["_changes"][0] and row["_changes"][0].endswith("value_kept='garbage'")


def test_missing_defect_column_is_imputed(spark):
    frame = frame_of(spark, MANUFACTURING).drop("defect_count").withColumn("_row", F.lit(1).cast("bigint"))
    assert batch.judge(frame, MANUFACTURING).first()["defect_count"] == 0.0


def test_legacy_rows_in_both_modes(spark):
    row = full(spark, LEGACY)
    assert (row["_status"], row["_coercions"], row["product_id"]) == ("COERCED", [], "OLD-1")
    row = full(spark, LEGACY, total_monthly_sales=None)
    assert row["_violations"] == ["Field 'total_monthly_sales' is NULL but not nullable."]
    frame = frame_of(spark, LEGACY).withColumn("_row", F.lit(1).cast("bigint"))
    assert batch.judge(frame, LEGACY).first()["_status"] == "PASS"


def test_legacy_periods_of_one_product(spark):
    rows = spark.createDataFrame(
        [("OLD-1", "2026-03", 5, "Asia", 1), ("OLD-1", "2026-04", 5, "Asia", 2)],
        "old_product_code string, historical_period string, total_monthly_sales bigint, market_region string, _row bigint")
    assert [r["_status"] for r in batch.judge(rows, LEGACY, compat=True).orderBy("_row").collect()] == [
        "COERCED", "DUPLICATE"]
    assert [r["_status"] for r in batch.judge(rows, LEGACY).orderBy("_row").collect()] == ["PASS", "PASS"]


def test_registry():
    assert set(CONTRACTS) == set(SOURCES) and len(CONTRACTS) == 6 and len(DATASETS) == 6
    for source_id, contract in CONTRACTS.items():
        assert {f.name for f in contract.fields} == {n for n, _ in SOURCES[source_id].expected_schema}
        assert set(contract.required_fields) <= {f.name for f in contract.fields}
    assert CONTRACTS[MANUFACTURING].policy is CONTRACTS[LEGACY].policy is ViolationPolicy.AUTO_COERCE
    with pytest.raises(KeyError):
        contracts.contract_of("src_unknown")
