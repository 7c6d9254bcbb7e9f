"""The test tables seen as the six sources, with dirt planted by key arithmetic.

Each view is a projection (one is an aggregate), so it works at any size, and
another SQL engine can repeat it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.functions import times
from contractflow.operators.rows import ROW, scan_first_rows, scan_with_rows


def _table(spark: SparkSession, folder: str, name: str, first: int | None = None) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return scan_with_rows(spark, path) if first is None else scan_first_rows(spark, first, path)


def _every(column: str, step: int, at: int = 0) -> Column:
    return F.col(column) % step == at


def _list_item(position: Column, *values: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def sales(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """Line items as receipts: real duplicate keys, NULLs, returns, odd timestamps."""
    return _sales_of(_table(spark, folder, "lineitem", first))


def sales_as_of(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """The receipts as a table held them on a day: of the two years before it, returns known a year after the sale."""
    items, then = _table(spark, folder, "lineitem"), F.lit(day).cast("date")
    known = items.where((F.col("l_shipdate") <= then) & (F.col("l_shipdate") > F.add_months(then, -24)))
    open_ = F.col("l_shipdate") > F.add_months(then, -12)
    return _sales_of(known.withColumn("l_returnflag", F.when(~open_, F.col("l_returnflag"))))


def _sales_of(items: DataFrame) -> DataFrame:
    shipped = F.col("l_shipdate").cast("string")
    sold = F.col("l_quantity").cast("bigint")
    return items.select(
        F.when(~_every("l_suppkey", 97), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("receipt_id"),
        F.when(~_every("l_partkey", 20), F.concat(F.lit("part-"), "l_partkey")).alias("product_id"),
        F.when(_every("l_suppkey", 89, 1), F.lit("not a date"))
        .when(_every("l_suppkey", 13, 2), F.date_format("l_shipdate", "MM/dd/yyyy"))
        .when(_every("l_suppkey", 17, 3), F.concat(F.replace(shipped, F.lit(" "), F.lit("T")), F.lit("+05:00")))
        .when(_every("l_suppkey", 19, 4), F.concat(F.replace(shipped, F.lit(" "), F.lit("T")), F.lit("+00:00")))
        .when(_every("l_suppkey", 23, 5), F.concat(shipped, F.lit(".250")))
        .otherwise(shipped).alias("sale_timestamp"),
        F.when(~_every("l_partkey", 33), F.when(F.col("l_returnflag") == "R", -sold).otherwise(sold))
        .alias("units_sold"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        ROW,
    )


def warehouse(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as the product master."""
    price = F.col("p_retailprice")
    size = F.col("p_size").cast("bigint")
    return _table(spark, folder, "part").select(
        F.when(~_every("p_partkey", 110, 9), F.concat(F.lit("part-"), "p_partkey")).alias("product_id"),
        F.when(~_every("p_partkey", 70, 3), F.col("p_brand")).alias("article_id"),
        F.col("p_name").alias("product_name"),
        F.substring_index("p_name", " ", 1).alias("color"),
        _list_item(F.col("p_size") % 7, "XS", "S", "M", "L", "XL", "XXL", "XXXL").alias("size"),
        F.when(~_every("p_partkey", 40, 7), size).alias("reorder_threshold"),
        F.when(_every("p_partkey", 60, 11), F.lit(0)).otherwise(size * 10).cast("bigint").alias("max_capacity"),
        F.when(_every("p_partkey", 50), -price).when(_every("p_partkey", 90, 13), F.lit(float("nan")))
        .otherwise(price).alias("unit_cost"),
        ROW,
    )


def manufacturing(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as production batches; the quantity is text, some of it unusable."""
    return _table(spark, folder, "orders").select(
        F.concat(F.lit("batch-"), F.when(_every("o_orderkey", 10, 1), F.col("o_orderkey") - 1)
                 .otherwise(F.col("o_orderkey"))).alias("production_batch_id"),
        F.when(~_every("o_custkey", 50), F.concat(F.lit("part-"), "o_custkey")).alias("product_id"),
        F.col("o_orderdate").cast("string").alias("mfg_timestamp"),
        F.when(_every("o_orderkey", 40, 3), F.lit("12.5"))
        .when(_every("o_orderkey", 40, 7), F.lit("abc"))
        .when(_every("o_orderkey", 40, 11), F.lit("-3"))
        .when(~_every("o_orderkey", 40, 13), (F.col("o_custkey") % 500).cast("string"))
        .alias("quantity_produced"),
        F.when(_every("o_orderkey", 90, 17), F.lit(-1.5))
        .when(~_every("o_orderkey", 20, 5), (F.col("o_orderkey") % 70) / F.lit(10.0))
        .alias("defect_count"),
        ROW,
    )


def legacy(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly sales per part. A row is identified by code and period."""
    monthly = (
        spark.read.parquet(f"{folder}/lineitem.parquet")
        .groupBy("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("historical_period"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("_sold"))
    )
    return monthly.select(
        F.concat(F.lit("old-"), "l_partkey").alias("old_product_code"),
        "historical_period",
        F.when(_every("l_partkey", 25), F.lit(None)).when(_every("l_partkey", 31), -F.col("_sold"))
        .otherwise(F.col("_sold")).cast("bigint").alias("total_monthly_sales"),
        F.when(~_every("l_partkey", 10), _list_item(
            F.col("l_partkey") % 6, "Europe", "Americas", "Asia", "MENA", "APAC", "North America"))
        .alias("market_region"),
    )


def _iot_columns() -> list[Column]:
    return [
        F.col("event_id").cast("string").alias("event_id"),
        times.iso_utc(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(~_every("event_id", 101), F.concat(F.lit("ART-"), "user_id")).alias("product_id"),
        F.when(F.col("event_type") == "click", F.lit("ZONE-B"))
        .when(F.col("event_type") == "purchase", F.lit("ZONE-C"))
        .when(F.col("event_type") == "error", F.lit("ZONE-X"))
        .otherwise(F.lit("ZONE-A")).alias("shelf_location"),
        F.round(F.col("value") * 100).cast("bigint").alias("current_stock_on_shelf"),
        F.when(~_every("event_id", 40, 1), F.concat(F.get_json_object("props", "$.k"), F.lit("%")))
        .alias("battery_level"),
    ]


def iot_from_events(events: DataFrame) -> DataFrame:
    return events.select(*_iot_columns())


def iot(spark: SparkSession, folder: str) -> DataFrame:
    return iot_from_events(spark.read.parquet(f"{folder}/events.parquet"))


def iot_with_resends(events: DataFrame) -> DataFrame:
    """Readings where every event id divisible by 33 arrives twice, as an exact copy."""
    copies = F.when(_every("event_id", 33), F.lit(2)).otherwise(F.lit(1))
    return events.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*_iot_columns())


def weather_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Readings nested the way the weather service sends them."""
    charge = F.get_json_object("props", "$.k").cast("bigint")
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_id"),
        _list_item(F.col("user_id") % 5, "Lahore", "Karachi", "Islamabad", "Rawalpindi", "Faisalabad").alias("city"),
        F.struct((F.col("value") / 4).alias("temp"), (charge + F.col("event_id") % 7).alias("humidity")).alias("main"),
        F.array(F.struct(F.col("event_type").alias("description"))).alias("weather"),
        times.iso_utc(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as ingestion jobs."""
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        F.concat(F.lit("job-"), "o_orderkey").alias("job_id"),
        F.concat(F.lit("src-"), "o_custkey").alias("source_id"),
        F.when(F.col("o_orderstatus") == "O", F.lit("running"))
        .when(F.col("o_orderstatus") == "F", F.lit("completed"))
        .otherwise(F.lit("failed")).alias("status"),
    )
