"""Synthetic rows drawn from column profiles, with the rules of each source.

Rows are built from row ids by column expressions. Every draw is a hash of the
row id (see ``functions.draws``), so the same ids give the same rows on any
cluster, and any number of rows is one narrow projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractflow.functions import draws, numbers, times
from contractflow.operators import profiling
from contractflow.operators.profiling import ColumnProfile
from contractflow.operators.rows import ROW

#: Ranges into which the ranks of a domain are cut.
BLOCKS = 2048

# Rule constants of the six sources.
COLORS = (
    ("Midnight Black", "MID"), ("Navy Blue", "NAV"), ("Olive Green", "OLI"), ("Classic White", "CLA"),
    ("Charcoal Grey", "GRY"), ("Burgundy Red", "BUR"))
SIZES = ("XS", "S", "M", "L", "XL", "XXL")
STORES = (
    "LDN-OXFORD", "LDN-KINGS", "NYC-5AVE", "NYC-MAIN", "DXB-MALL", "KHI-DOLMEN", "ISB-CENTAURUS",
    "LHR-LIBERTY", "PAR-CHAMPS", "BER-KURFUERSTENDAMM",
)
REGIONS = ("Europe", "Americas", "Asia", "MENA", "APAC", "North America")
ZONES = ("ZONE-A", "ZONE-B", "ZONE-C")
CITIES = (("Lahore", 40), ("Karachi", 30), ("Islamabad", 15), ("Rawalpindi", 10), ("Faisalabad", 5))
SKIES = (
    ("clear sky", 20), ("few clouds", 15), ("scattered clouds", 15), ("broken clouds", 10), ("shower rain", 10),
    ("rain", 10), ("thunderstorm", 5), ("snow", 3), ("mist", 2),
)
LOWERCASE_RATE, NULL_DEFECT_RATE = 0.20, 0.05
NULL_PRODUCT_RATE, RETURN_RATE = 0.05, 0.03
RESEND_RATE = 0.03
FIRST_ARTICLE, ARTICLE_STEP, FIRST_BATCH = 2000, 3, 60000

#: Draw streams of the rules; column draws use 100 and up, two per column.
_COLOR, _SIZE, _PRODUCT, _LOWER, _NULL_DEFECT, _RECEIPT = 21, 22, 23, 24, 25, 26
_NULL_PRODUCT, _STORE, _RETURN, _MONTHS, _REGION = 27, 28, 29, 30, 31
_EVENT, _ZONE, _STOCK, _BATTERY, _RESEND = 32, 33, 34, 35, 36
_COLUMNS = 100


def row_ids(spark: SparkSession, n: int, first: int = 1) -> DataFrame:
    return spark.range(first, first + n).withColumnRenamed("id", ROW)


# -- drawing one column ---------------------------------------------------------------

def weighted(rank: Column, values: tuple[tuple[str, int], ...]) -> Column:
    """The value a rank in [0, sum of weights) falls on; weights need not sum to one.

    ``rank`` should be a plain column: it is compared once per value.
    """
    chosen, reached = None, 0
    for value, weight in values[:-1]:
        reached += weight
        chosen = F.when(rank < reached, F.lit(value)) if chosen is None else chosen.when(rank < reached, F.lit(value))
    last = F.lit(values[-1][0])
    return last if chosen is None else chosen.otherwise(last)


def total_weight(values: tuple[tuple[str, int], ...]) -> int:
    return sum(weight for _, weight in values)


def clipped_normal(stream: int, mean: float, std: float, low: float, high: float) -> Column:
    value = F.lit(float(mean)) + F.lit(float(std)) * draws.normal(stream)
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def sample_column(profile: ColumnProfile, stream: int, rank: Column) -> Column:
    """One draw per seeded row from a profile whose values fit in the plan."""
    if profile.kind == profiling.CONSTANT:
        return F.lit(None).cast("string")
    if profile.kind == profiling.TIMESTAMP:
        low, high = int(profile.min * 1_000_000), int(profile.max * 1_000_000)
        micros = F.lit(low) + draws.below(stream, high - low + 1)
        value = times.iso_utc(F.timestamp_micros(micros))
    elif profile.kind == profiling.NUMERIC:
        value = clipped_normal(stream, profile.mean, profile.std or 0.0, profile.min, profile.max)
    else:
        value = weighted(rank, profile.values)
    if profile.null_rate > 0:
        return F.when(~draws.chance(stream + 500, profile.null_rate), value)
    return value


def sample_from_domain(rows: DataFrame, profile: ColumnProfile, stream: int) -> DataFrame:
    """Draw a column with many values by the ranks that its values cover.

    Ranks and drawn ranks are cut into ``BLOCKS`` ranges of equal length; in a range
    they are sorted together, and a draw takes the last value that begins at or before it.
    Draws are spread evenly, and a frequent value begins anew in each range it reaches, so ranges are
    of one size and nothing is matched pair by pair.
    """
    width = max(1, -(-profile.present // BLOCKS))
    carried, drawn = F.struct(*[F.col(f"`{n}`") for n in rows.columns]), draws.below(stream, profile.present)
    asked = rows.select(carried.alias("_carried"), drawn.alias("_at"), F.lit(None).cast("string").alias("_value"), F.lit(1).alias("_asks"))
    reached = F.sequence(F.expr(f"low DIV {width}"), F.expr(f"(low + count - 1) DIV {width}"))
    known = profile.domain.select("low", "value", F.explode(reached).alias("_block")).select(
        F.lit(None).cast(asked.schema["_carried"].dataType).alias("_carried"),
        F.greatest("low", F.col("_block") * width).alias("_at"), F.col("value").alias("_value"), F.lit(0).alias("_asks"))
    order = Window.partitionBy(F.expr(f"_at DIV {width}")).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(known).withColumn("_found", F.last("_value", ignorenulls=True).over(order)).where("_asks = 1")
    made = found.select("_carried.*", F.col("_found").alias(profile.name))
    if profile.null_rate > 0:
        made = made.withColumn(profile.name, F.when(~draws.chance(stream + 500, profile.null_rate), F.col(f"`{profile.name}`")))
    return made


def generate(
    ids: DataFrame,
    profiles: list[ColumnProfile],
    hook: Callable[[DataFrame], DataFrame] | None = None,
    skip: tuple[str, ...] = (),
) -> DataFrame:
    """Rows drawn column by column; ``hook`` applies the source's own rules.

    Categorical columns need their values attached (``profiling.with_domains``).
    Columns in ``skip`` are left to the hook.
    """
    if not profiles:
        raise RuntimeError("Profile the data before generating rows.")
    rows = draws.seeded(ids, ROW)
    ranks: dict[str, Column] = {}
    plain: dict[str, Column] = {}
    for i, profile in enumerate(profiles):
        if profile.name in skip:
            continue
        if profile.kind == profiling.CATEGORICAL and not profile.values:
            if profile.domain is None:
                raise RuntimeError(f"Column {profile.name} has no values attached.")
            rows = sample_from_domain(rows, profile, _COLUMNS + 2 * i)
            continue
        if profile.values:
            ranks[f"_rank_{i}"] = draws.below(_COLUMNS + 2 * i, total_weight(profile.values))
        plain[profile.name] = sample_column(profile, _COLUMNS + 2 * i, F.col(f"_rank_{i}"))
    made = (rows.withColumns(ranks) if ranks else rows).withColumns(plain)
    made = made.select(
        ROW, draws.SEED, *[F.col(f"`{p.name}`") for p in profiles if p.name not in skip])
    return draws.unseeded(made.transform(hook) if hook else made)


upsample = generate


# -- drawing a known key --------------------------------------------------------------

def draw_key(rows: DataFrame, pool: DataFrame, pool_size: int, key: str = "product_id", stream: int = _PRODUCT) -> DataFrame:
    """Add a key drawn uniformly from a key table with dense ``_row`` numbers."""
    aimed = draws.seeded(rows, ROW).withColumn("_pick", draws.below(stream, pool_size) + 1)
    return aimed.join(pool.select(F.col(ROW).alias("_pick"), F.col(key).alias("_drawn_key")), "_pick").drop("_pick")


# -- the rules of each source -----------------------------------------------------------

def _or(value: Column, default: float) -> Column:
    """Zero and NULL count as absent."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def _whole(value: Column) -> Column:
    return F.floor(F.abs(value)).cast("bigint")


def _number(rows: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("double") if name in rows.columns else F.lit(None).cast("double")


def warehouse_rules(rows: DataFrame) -> DataFrame:
    """A new stock unit per row: article number, colour and size make the product id."""
    row = F.col(ROW)
    article = (F.lit(FIRST_ARTICLE) + row * ARTICLE_STEP).cast("string")
    size = draws.pick(_SIZE, SIZES)
    return draws.unseeded(draws.seeded(rows, ROW).withColumns({
        "product_id": F.concat_ws("-", F.lit("ART"), article, draws.pick(_COLOR, [code for _, code in COLORS]), size),
        "article_id": F.concat(F.lit("ART-"), article),
        "color": draws.pick(_COLOR, [name for name, _ in COLORS]),
        "size": size,
        "reorder_threshold": F.greatest(F.lit(1).cast("bigint"), _whole(_or(_number(rows, "reorder_threshold"), 50.0))),
        "max_capacity": F.greatest(F.lit(10).cast("bigint"), _whole(_or(_number(rows, "max_capacity"), 500.0))),
        "unit_cost": numbers.half_even(
            F.greatest(F.lit(0.01), F.abs(_or(_number(rows, "unit_cost"), 30.0))), 2),
    }))


def manufacturing_rules(pool: DataFrame, pool_size: int, run_at: str) -> Callable[[DataFrame], DataFrame]:
    """New batches of known products: some ids in lower case, some defect counts missing."""
    def rules(rows: DataFrame) -> DataFrame:
        row, keyed = F.col(ROW), draw_key(rows, pool, pool_size)
        product = F.col("_drawn_key")
        defects = numbers.half_even(F.greatest(F.lit(0.0), F.coalesce(_number(rows, "defect_count"), F.lit(0.0))), 1)
        return keyed.withColumns({
            "production_batch_id": F.concat(F.lit("BATCH-"), (F.lit(FIRST_BATCH) + row).cast("string")),
            "product_id": F.when(draws.chance(_LOWER, LOWERCASE_RATE), F.lower(product)).otherwise(product),
            "quantity_produced": F.greatest(
                F.lit(1).cast("bigint"), _whole(_or(_number(rows, "quantity_produced"), 100.0))),
            "defect_count": F.when(~draws.chance(_NULL_DEFECT, NULL_DEFECT_RATE), defects),
            "mfg_timestamp": F.lit(run_at),
        }).drop("_drawn_key", draws.SEED)
    return rules


def sales_rules(pool: DataFrame, pool_size: int, run_at: str) -> Callable[[DataFrame], DataFrame]:
    """Receipts over known products and stores: some without a product, some returns."""
    def rules(rows: DataFrame) -> DataFrame:
        keyed = draw_key(rows, pool, pool_size)
        units = F.greatest(F.lit(1).cast("bigint"), _whole(_or(_number(rows, "units_sold"), 1.0)))
        return keyed.withColumns({
            "receipt_id": F.lpad(F.hex(draws.below(_RECEIPT, 16**8)), 8, "0"),
            "product_id": F.when(~draws.chance(_NULL_PRODUCT, NULL_PRODUCT_RATE), F.col("_drawn_key")),
            "sale_timestamp": F.lit(run_at),
            "store_id": draws.pick(_STORE, STORES),
            "units_sold": F.when(draws.chance(_RETURN, RETURN_RATE), -units).otherwise(units),
        }).drop("_drawn_key", draws.SEED)
    return rules


def legacy_rules(pool: DataFrame, pool_size: int, run_at: str) -> Callable[[DataFrame], DataFrame]:
    """Monthly totals of known products, one to 36 months (of 30 days) back."""
    def rules(rows: DataFrame) -> DataFrame:
        keyed = draw_key(rows, pool, pool_size)
        months = (draws.below(_MONTHS, 36) + 1).cast("int")
        back = F.date_sub(F.to_date(times.moment_literal(run_at)), months * 30)
        return keyed.withColumns({
            "product_id": F.col("_drawn_key"),
            "historical_period": F.date_format(back, "yyyy-MM"),
            "total_monthly_sales": _whole(_or(_number(rows, "total_monthly_sales"), 500.0)),
            "market_region": draws.pick(_REGION, REGIONS),
        }).drop("_drawn_key", draws.SEED)
    return rules


def iot_rows(
    ids: DataFrame, pool: DataFrame, pool_size: int, run_at: str, resend_rate: float = RESEND_RATE,
    rate: float = 1.0,
) -> DataFrame:
    """Shelf readings, ``rate`` per second; ``resend_rate`` of all rows are exact copies of another."""
    row, keyed = F.col(ROW), draw_key(ids, pool, pool_size)
    start = F.unix_micros(times.moment_literal(run_at))
    moment = F.timestamp_micros(start + F.floor(row * F.lit(1_000_000.0 / rate)).cast("bigint"))
    digest = F.md5(F.concat(F.lit("rfid:"), row.cast("string")).cast("binary"))
    parts = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    # A share r of all rows being copies means r / (1 - r) copies per reading.
    again = draws.chance(_RESEND, resend_rate / (1 - resend_rate))
    copies = F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    sent = keyed.withColumn("_copy", F.explode(copies)) if resend_rate > 0 else keyed
    return sent.select(
        ROW,
        F.concat_ws("-", *parts).alias("event_id"),
        times.iso_utc(moment).alias("timestamp"),
        F.col("_drawn_key").alias("product_id"),
        draws.pick(_ZONE, ZONES).alias("shelf_location"),
        (draws.below(_STOCK, 146) + 5).alias("current_stock_on_shelf"),
        F.concat((draws.below(_BATTERY, 91) + 10).cast("string"), F.lit("%")).alias("battery_level"),
    )


def weather_rows(ids: DataFrame, run_at: str) -> DataFrame:
    """City readings from the fixed profile."""
    ranked = draws.seeded(ids, ROW).withColumns({
        "_city": draws.below(_COLUMNS, total_weight(CITIES)),
        "_sky": draws.below(_COLUMNS + 6, total_weight(SKIES)),
    })
    return ranked.select(
        ROW,
        weighted(F.col("_city"), CITIES).alias("city"),
        clipped_normal(_COLUMNS + 2, 25.0, 10.0, -10.0, 50.0).alias("temperature"),
        clipped_normal(_COLUMNS + 4, 60.0, 20.0, 0.0, 100.0).alias("humidity"),
        weighted(F.col("_sky"), SKIES).alias("weather_description"),
        F.lit(run_at).alias("timestamp"),
    )
