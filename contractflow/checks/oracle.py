"""The registered queries' results as plain SQL, written from the rules alone.

The SQL runs on DuckDB over the same tables. ``row_number() OVER ()`` numbers rows
in file order there, as the row positions of the Parquet scan do on Spark.
"""

from __future__ import annotations

from contractflow.functions.draws import PRIME, coefficients
from contractflow.checks.queries import FEED_RATE, FEED_START, JOB_SECONDS, LOG_POSITION, RUN_AT, SEPARATOR, STATES, WATERMARK

# -- the source views ---------------------------------------------------------------------

V_SALES = """v_sales AS (
  SELECT CASE WHEN l_suppkey % 97 <> 0 THEN l_orderkey || '-' || l_linenumber END AS receipt_id,
         CASE WHEN l_partkey % 20 <> 0 THEN 'part-' || l_partkey END AS product_id,
         CASE WHEN l_suppkey % 89 = 1 THEN 'not a date'
              WHEN l_suppkey % 13 = 2 THEN strftime(l_shipdate, '%m/%d/%Y')
              WHEN l_suppkey % 17 = 3 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '+05:00'
              WHEN l_suppkey % 19 = 4 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '+00:00'
              WHEN l_suppkey % 23 = 5 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || '.250'
              ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS sale_timestamp,
         CASE WHEN l_partkey % 33 <> 0
              THEN CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) END AS units_sold,
         CAST(l_suppkey AS VARCHAR) AS store_id,
         row_number() OVER () AS rn
  FROM lineitem)"""

V_WH = """v_wh AS (
  SELECT CASE WHEN p_partkey % 110 <> 9 THEN 'part-' || p_partkey END AS product_id,
         CASE WHEN p_partkey % 70 <> 3 THEN p_brand END AS article_id,
         p_name AS product_name,
         split_part(p_name, ' ', 1) AS color,
         ['XS', 'S', 'M', 'L', 'XL', 'XXL', 'XXXL'][p_size % 7 + 1] AS size,
         CASE WHEN p_partkey % 40 <> 7 THEN CAST(p_size AS BIGINT) END AS reorder_threshold,
         CAST(CASE WHEN p_partkey % 60 = 11 THEN 0 ELSE p_size * 10 END AS BIGINT) AS max_capacity,
         CASE WHEN p_partkey % 50 = 0 THEN -p_retailprice WHEN p_partkey % 90 = 13 THEN CAST('nan' AS DOUBLE)
              ELSE p_retailprice END AS unit_cost,
         row_number() OVER () AS rn
  FROM part)"""

V_MFG = """v_mfg AS (
  SELECT 'batch-' || (o_orderkey - CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END) AS production_batch_id,
         CASE WHEN o_custkey % 50 <> 0 THEN 'part-' || o_custkey END AS product_id,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS mfg_timestamp,
         CASE o_orderkey % 40 WHEN 3 THEN '12.5' WHEN 7 THEN 'abc' WHEN 11 THEN '-3' WHEN 13 THEN NULL
              ELSE CAST(o_custkey % 500 AS VARCHAR) END AS quantity_produced,
         CASE WHEN o_orderkey % 90 = 17 THEN -1.5::DOUBLE WHEN o_orderkey % 20 <> 5
              THEN (o_orderkey % 70) / 10.0::DOUBLE END AS defect_count,
         row_number() OVER () AS rn
  FROM orders)"""

V_LEG = """v_leg AS (
  SELECT 'old-' || l_partkey AS old_product_code,
         strftime(l_shipdate, '%Y-%m') AS historical_period,
         CASE WHEN l_partkey % 25 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN -CAST(sum(l_quantity) AS BIGINT)
              ELSE CAST(sum(l_quantity) AS BIGINT) END AS total_monthly_sales,
         CASE WHEN l_partkey % 10 <> 0
              THEN ['Europe', 'Americas', 'Asia', 'MENA', 'APAC', 'North America'][l_partkey % 6 + 1]
         END AS market_region
  FROM lineitem GROUP BY l_partkey, strftime(l_shipdate, '%Y-%m'))"""


def _iso(ts: str) -> str:
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({ts}) % 1000000 <> 0 "
            f"THEN strftime({ts}, '.%f') ELSE '' END || '+00:00')")


V_IOT = f"""v_iot AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         {_iso('ts')} AS "timestamp",
         CASE WHEN event_id % 101 <> 0 THEN 'ART-' || user_id END AS product_id,
         CASE event_type WHEN 'click' THEN 'ZONE-B' WHEN 'purchase' THEN 'ZONE-C' WHEN 'error' THEN 'ZONE-X'
              ELSE 'ZONE-A' END AS shelf_location,
         CAST(round(value * 100) AS BIGINT) AS current_stock_on_shelf,
         CASE WHEN event_id % 40 <> 1 THEN regexp_extract(props, '[0-9]+') || '%' END AS battery_level
  FROM events)"""

# -- normalization --------------------------------------------------------------------------

N_SALES = f"""p_sales AS (
  SELECT *, CASE WHEN sale_timestamp = 'not a date' THEN NULL
         WHEN sale_timestamp LIKE '%/%' THEN try_strptime(sale_timestamp, '%m/%d/%Y')
         WHEN sale_timestamp LIKE '%+05:00' THEN try_strptime(left(sale_timestamp, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 5 HOUR
         WHEN sale_timestamp LIKE '%+00:00' THEN try_strptime(left(sale_timestamp, 19), '%Y-%m-%dT%H:%M:%S')
         ELSE TRY_CAST(sale_timestamp AS TIMESTAMP) END AS moment
  FROM v_sales),
n_sales AS (
  SELECT receipt_id, upper(product_id) AS product_id, coalesce({_iso('moment')}, sale_timestamp) AS sale_timestamp,
         units_sold, store_id, rn, coalesce(receipt_id, 'None') AS audit_key,
         coalesce(nullif(receipt_id, ''), nullif(upper(product_id), '')) AS dedup_key,
         CASE WHEN product_id <> upper(product_id) THEN 'NORMALIZE | field=product_id | ''' || product_id || ''' → '''
              || upper(product_id) || ''' | reason=uppercase_policy' END AS change_1,
         CASE WHEN moment IS NULL THEN 'NORMALIZE | field=sale_timestamp | parse_error=''Unknown datetime string format, '
              || 'unable to parse: ' || sale_timestamp || ', at position 0'' | value_kept=''' || sale_timestamp || ''''
              WHEN {_iso('moment')} <> sale_timestamp THEN 'NORMALIZE | field=sale_timestamp | ''' || sale_timestamp
              || ''' → ''' || {_iso('moment')} || ''' | reason=iso8601_utc' END AS change_2,
         CAST(moment IS NULL AS INTEGER) AS bad_time, moment
  FROM p_sales)"""

N_WH = """n_wh AS (
  SELECT upper(product_id) AS product_id, upper(article_id) AS article_id, product_name, color, size,
         reorder_threshold, max_capacity, CASE WHEN NOT isnan(unit_cost) THEN unit_cost END AS unit_cost, rn,
         (product_id <> upper(product_id)) IS TRUE OR (article_id <> upper(article_id)) IS TRUE AS changed,
         coalesce(product_id, 'None') AS audit_key
  FROM v_wh)"""

N_MFG = """n_mfg AS (
  SELECT upper(production_batch_id) AS production_batch_id, upper(product_id) AS product_id,
         strftime(CAST(mfg_timestamp AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS mfg_timestamp,
         quantity_produced, coalesce(defect_count, 0.0::DOUBLE) AS defect_count, rn,
         production_batch_id AS audit_key, upper(production_batch_id) AS dedup_key,
         CASE WHEN product_id IS NOT NULL THEN 'NORMALIZE | field=product_id | ''' || product_id || ''' → '''
              || upper(product_id) || ''' | reason=uppercase_policy' END AS change_1,
         'NORMALIZE | field=production_batch_id | ''' || production_batch_id || ''' → ''' || upper(production_batch_id)
              || ''' | reason=uppercase_policy' AS change_2,
         'NORMALIZE | field=mfg_timestamp | ''' || mfg_timestamp || ''' → '''
              || strftime(CAST(mfg_timestamp AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '+00:00'' | reason=iso8601_utc' AS change_3,
         CASE WHEN defect_count IS NULL THEN
              'IMPUTE | field=defect_count | null → 0.0 | reason=manufacturing_imputation_policy' END AS change_4
  FROM v_mfg)"""

# -- judged rows -------------------------------------------------------------------------------

_MSG = {
    "required": "'Required field ''{0}'' is missing or null.'",
    "null": "'Field ''{0}'' is NULL but not nullable.'",
}


def _required(field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN {_MSG['required'].format(field)} END"


def _null(field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN {_MSG['null'].format(field)} END"


def _below(field: str, bound: str) -> str:
    return (f"CASE WHEN {field} < {bound} THEN 'Field ''{field}'' value ' || CAST({field} AS VARCHAR) "
            f"|| ' below min {bound}.' END")


def _above(field: str, bound: str) -> str:
    return (f"CASE WHEN {field} > {bound} THEN 'Field ''{field}'' value ' || CAST({field} AS VARCHAR) "
            f"|| ' above max {bound}.' END")


def _enum(field: str, shown: str, values: str) -> str:
    return (f"CASE WHEN {field} NOT IN ({values}) THEN 'Field ''{field}'' value ''' || {field} "
            f"|| ''' not in allowed set {shown}.' END")


def _join(separator: str, *messages: str) -> str:
    return f"concat_ws('{separator}', {', '.join(messages)})"


SALES_MESSAGES = (_required("receipt_id"), _null("receipt_id"), _null("units_sold"))
SIZE_ENUM = _enum("size", "{''L'', ''M'', ''S'', ''XL'', ''XS'', ''XXL''}", "'XS','S','M','L','XL','XXL'")
ZONE_ENUM = _enum("shelf_location", "{''ZONE-A'', ''ZONE-B'', ''ZONE-C''}", "'ZONE-A','ZONE-B','ZONE-C'")

# The values of unit_cost may be NaN before normalization, which counts as NULL for the field but not as missing.
WH_FIELD_MESSAGES = (
    _null("product_id"), _null("article_id"), SIZE_ENUM, _null("reorder_threshold"), _below("max_capacity", "1"))
WH_MESSAGES = (
    _required("product_id"), _required("reorder_threshold"), _required("unit_cost"), *WH_FIELD_MESSAGES,
    _null("unit_cost"), _below("unit_cost", "0.0"))
WH_RAW_MESSAGES = (
    _required("product_id"), _required("reorder_threshold"), *WH_FIELD_MESSAGES,
    f"CASE WHEN isnan(unit_cost) THEN {_MSG['null'].format('unit_cost')} END",
    f"CASE WHEN NOT isnan(unit_cost) THEN {_below('unit_cost', '0.0')} END")
IOT_MESSAGES = (
    _required("product_id"), _null("product_id"), ZONE_ENUM, _above("current_stock_on_shelf", "10000"))
MFG_REMAINING = (
    _null("product_id"), _null("quantity_produced"),
    "CASE WHEN quantity_produced IN ('12.5', 'abc') THEN 'Field ''quantity_produced'' expected int, got str (value='''"
    " || quantity_produced || ''').' END",
    "CASE WHEN quantity_produced = '-3' THEN 'Field ''quantity_produced'' value -3 below min 0.' END",
    _below("defect_count", "0.0"))

_FIRST = "row_number() OVER (PARTITION BY {0} ORDER BY rn) > 1"


def _judged_sales(first: str = "dedup_key", extra: str = "", name: str = "j_sales", source: str = "n_sales") -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN duplicate THEN 'DUPLICATE' WHEN messages <> '' THEN 'QUARANTINE' ELSE 'PASS' END AS status
  FROM (SELECT *{extra}, {_join(SEPARATOR, *SALES_MESSAGES)} AS messages,
               dedup_key IS NOT NULL AND {_FIRST.format(first)} AS duplicate FROM {source}))"""


J_SALES = _judged_sales()
J_WH = f"""j_wh AS (
  SELECT *, CASE WHEN messages <> '' THEN 'QUARANTINE' ELSE 'PASS' END AS status
  FROM (SELECT *, {_join(SEPARATOR, *WH_MESSAGES)} AS messages FROM n_wh))"""
J_MFG = f"""j_mfg AS (
  SELECT *, CASE WHEN duplicate THEN 'DUPLICATE' WHEN remaining <> '' THEN 'QUARANTINE' ELSE 'COERCED' END AS status,
         '''quantity_produced'': ''' || quantity_produced || ''' → ' || quantity_produced AS coercion
  FROM (SELECT *, {_join(SEPARATOR, *MFG_REMAINING)} AS remaining,
               {_FIRST.format('dedup_key')} AS duplicate FROM n_mfg))"""
J_LEG = """n_leg AS (
  SELECT upper(old_product_code) AS product_id, historical_period, total_monthly_sales, market_region FROM v_leg),
c_leg AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY product_id ORDER BY historical_period) > 1 THEN 'DUPLICATE'
         WHEN total_monthly_sales IS NULL OR total_monthly_sales < 0 THEN 'QUARANTINE' ELSE 'COERCED' END AS status
  FROM n_leg),
m_leg AS (
  SELECT *, CASE WHEN total_monthly_sales IS NULL OR total_monthly_sales < 0 THEN 'QUARANTINE' ELSE 'PASS' END AS status
  FROM n_leg)"""
J_IOT = f"""j_iot AS (
  SELECT *, CASE WHEN messages <> '' THEN 'QUARANTINE' ELSE 'PASS' END AS status
  FROM (SELECT *, {_join(SEPARATOR, *IOT_MESSAGES)} AS messages FROM v_iot))"""

SALES = f"{V_SALES}, {N_SALES}, {J_SALES}"
MFG = f"{V_MFG}, {N_MFG}, {J_MFG}"
WH = f"{V_WH}, {N_WH}, {J_WH}"
LEG = f"{V_LEG}, {J_LEG}"
IOT = f"{V_IOT}, {J_IOT}"

SALES_CHANGES = _join(SEPARATOR, "change_1", "change_2")
MFG_CHANGES = _join(SEPARATOR, "change_1", "change_2", "change_3", "change_4")


def _quoted_list(messages: tuple[str, ...]) -> str:
    """The messages as a JSON array; none of them needs escaping."""
    quoted = [f"'\"' || ({message}) || '\"'" for message in messages]
    return f"'[' || {_join(',', *quoted)} || ']'"


# -- draws ------------------------------------------------------------------------------------
# A row carries a seed column s of two 30-bit halves; a draw is a linear function of both modulo a prime.

def _seed(row: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({row} AS VARCHAR)), 1, 15) AS BIGINT) AS s"


def _draw(stream: int, t: str = "") -> str:
    low_factor, high_factor, shift = coefficients(stream)
    return (f"((({t}s & {2**30 - 1}) * {low_factor} % {PRIME} + ({t}s >> 30) * {high_factor} % {PRIME} + {shift})"
            f" % {PRIME})")


def _below_draw(stream: int, bound: str | int, t: str = "") -> str:
    return f"(({_draw(stream, t)} * {PRIME} + {_draw(stream + 5000, t)}) % {bound})"


def _uniform(stream: int, t: str = "") -> str:
    return f"({_draw(stream, t)} / {PRIME}.0::DOUBLE)"


def _normal(stream: int, t: str = "") -> str:
    return (f"(sqrt(-2.0::DOUBLE * ln(({_draw(stream, t)} + 1) / {PRIME}.0::DOUBLE)) "
            f"* cos(6.283185307179586::DOUBLE * {_uniform(stream + 1, t)}))")


def _chance(stream: int, rate: float, t: str = "") -> str:
    return f"({_draw(stream, t)} < {int(rate * PRIME)})"


def _pick(stream: int, values: tuple[str, ...]) -> str:
    items = ", ".join(f"'{value}'" for value in values)
    return f"[{items}][{_below_draw(stream, len(values))} + 1]"


def _weighted(stream: int, values: tuple[tuple[str, int], ...]) -> str:
    total = sum(weight for _, weight in values)
    parts, reached = [], 0
    for value, weight in values:
        reached += weight
        parts.append(f"WHEN {_below_draw(stream, total)} < {reached} THEN '{value}'")
    return "CASE " + " ".join(parts) + " END"


def _clipped(stream: int, mean: str, std: str, low: str, high: str, t: str = "") -> str:
    return f"least(greatest({mean} + {std} * {_normal(stream, t)}, {low}), {high})"


def _half_even(value: str, digits: int) -> str:
    return f"CAST(round_even({value}, {digits}) AS DOUBLE)"


# -- change feed ---------------------------------------------------------------------------------

# The draws of the operation alone, for ``cdc_feed_ops``.
DRAWN = f"""numbered AS (SELECT rn - 1 AS o, {_seed('(rn - 1)')} FROM (SELECT row_number() OVER () AS rn FROM lineitem)),
drawn AS (SELECT o, {_below_draw(11, 100)} AS percent FROM numbered)"""


def _state(name: str, day: str) -> str:
    """The receipts of the two years before a day; a return is known a year after the sale."""
    known = V_SALES.replace("v_sales AS", f"{name} AS").replace(
        "l_returnflag = 'R'", f"l_returnflag = 'R' AND l_shipdate <= DATE '{day}' - INTERVAL 12 MONTH")
    return known.replace("FROM lineitem)", f"FROM lineitem WHERE l_shipdate <= DATE '{day}' AND l_shipdate > DATE '{day}' - INTERVAL 24 MONTH)")


_SALE = "receipt_id, product_id, sale_timestamp, units_sold, store_id"
FEED = f"""{_state('old_sales', STATES[0])}, {_state('new_sales', STATES[1])},
changed AS (
  SELECT {_SALE}, sum(n) AS n FROM (SELECT {_SALE}, -1 AS n FROM old_sales UNION ALL SELECT {_SALE}, 1 FROM new_sales)
  GROUP BY {_SALE} HAVING sum(n) <> 0),
once AS (SELECT receipt_id AS once_id FROM changed WHERE receipt_id IS NOT NULL GROUP BY 1 HAVING sum(abs(n)) = 2 AND sum(n) = 0),
copies AS (
  SELECT CASE WHEN n > 0 THEN 'INSERT' ELSE 'DELETE' END AS op, unnest(range(1, CAST(abs(n) AS BIGINT) + 1)) AS copy, {_SALE}
  FROM changed LEFT JOIN once ON receipt_id = once_id WHERE once_id IS NULL
  UNION ALL SELECT 'UPDATE', 1, {_SALE} FROM changed JOIN once ON receipt_id = once_id WHERE n > 0),
events_of AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', op, copy, coalesce(receipt_id, '~'), coalesce(product_id, '~'),
    coalesce(sale_timestamp, '~'), coalesce(CAST(units_sold AS VARCHAR), '~'), coalesce(store_id, '~')))) - 1 AS o FROM copies),
feed AS (
  SELECT sha256('event:src_sales_history:steady:' || o) AS _event_id,
         sha256('trace:src_sales_history:steady:' || o) AS _trace_id,
         'src_sales_history' AS _source_id, 'ds_sales_history' AS _dataset_id, 'v1' AS _schema_version,
         op AS _operation_type, stamp AS _event_timestamp, CAST(NULL AS VARCHAR) AS _source_timestamp,
         stamp AS _ingestion_timestamp, receipt_id, product_id, sale_timestamp, CAST(units_sold AS DOUBLE) AS units_sold,
         store_id, op AS _cdc_op, CASE WHEN op = 'UPDATE' THEN stamp END AS _updated_at,
         CASE WHEN op = 'DELETE' THEN stamp END AS _deleted_at, o AS _log_offset
  FROM (SELECT *, {_iso('moment')} AS stamp FROM (
        SELECT *, TIMESTAMP '{FEED_START[:19].replace('T', ' ')}' + to_microseconds(o * {int(1_000_000 / FEED_RATE)}) AS moment
        FROM events_of)))"""

# -- profiles and synthetic rows --------------------------------------------------------------------

IDS = f"""numbered_ids AS (SELECT row_number() OVER () AS r FROM lineitem),
ids AS (SELECT r, {_seed('r')} FROM numbered_ids)"""
POOL = f"""{V_WH},
pool AS (SELECT product_id, row_number() OVER (ORDER BY product_id) AS k FROM v_wh WHERE product_id IS NOT NULL),
keyed AS (
  SELECT i.r, i.s, pool.product_id
  FROM (SELECT r, s, {_below_draw(23, 'n')} + 1 AS k FROM ids, (SELECT count(*) AS n FROM pool)) i JOIN pool USING (k))"""


def _stats(alias: str, column: str, table: str) -> str:
    """Mean, deviation, bounds and NULL share of one column, as a one-row table."""
    value = f"CASE WHEN NOT isnan(CAST({column} AS DOUBLE)) THEN CAST({column} AS DOUBLE) END"
    return (f"{alias} AS (SELECT avg({value}) AS mean, stddev_samp({value}) AS std, min({value}) AS low, "
            f"max({value}) AS high, (count(*) - count({value})) / CAST(count(*) AS DOUBLE) AS null_rate FROM {table})")


def _sampled(alias: str, stream: int, t: str = "") -> str:
    drawn = _clipped(stream, f"{alias}.mean", f"{alias}.std", f"{alias}.low", f"{alias}.high", t)
    return _masked(drawn, stream, f"{alias}.null_rate", t)


def _frequency(alias: str, column: str, table: str) -> str:
    """Values with the range of ranks each one covers, most frequent first."""
    return f"""{alias} AS (
  SELECT value, n, CAST(sum(n) OVER (ORDER BY n DESC, md5(value), value ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS low,
         CAST(sum(n) OVER () AS BIGINT) AS total
  FROM (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1))"""


def _ranked(ids: str, alias: str, stream: int, name: str) -> str:
    """One drawn value per id."""
    return f"""{name} AS (
  SELECT i.r, i.s, f.value
  FROM (SELECT r, s, {_below_draw(stream, 'total_n')} AS rank FROM {ids}, (SELECT max(total) AS total_n FROM {alias})) i
  JOIN {alias} f ON i.rank >= f.low AND i.rank < f.low + f.n)"""


def _masked(value: str, stream: int, rate: str, t: str = "") -> str:
    return f"CASE WHEN NOT ({_draw(stream + 500, t)} < CAST(trunc({rate} * {PRIME}) AS BIGINT)) THEN {value} END"


def _kind_rows(source: str, table: str, numeric: tuple[str, ...], timed: tuple[str, ...], other: tuple[str, ...]) -> str:
    parts = []
    for column in numeric:
        parts.append(
            f"SELECT '{source}' AS source, '{column}' AS \"column\", CASE WHEN count(v) = 0 THEN 'constant' "
            f"WHEN count(DISTINCT v) > 20 THEN 'numeric' ELSE 'categorical' END AS kind, count(v) AS present FROM "
            f"(SELECT CASE WHEN NOT isnan(CAST({column} AS DOUBLE)) THEN {column} END AS v FROM {table})")
    for kind, columns in (("timestamp", timed), ("categorical", other)):
        for column in columns:
            parts.append(f"SELECT '{source}', '{column}', CASE WHEN count({column}) = 0 THEN 'constant' ELSE '{kind}' END, "
                         f"count({column}) FROM {table}")
    return " UNION ALL ".join(parts)


def _frequency_rows(source: str, table: str, *columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{source}' AS source, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count, "
        f"{_half_even(f'count(*) / CAST((SELECT count({c}) FROM {table}) AS DOUBLE)', 9)} AS probability, "
        f"{_half_even(f'(SELECT (count(*) - count({c})) / CAST(count(*) AS DOUBLE) FROM {table})', 9)} AS null_rate "
        f"FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)


def _numeric_rows(source: str, table: str, *columns: str) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{source}' AS source, '{c}' AS \"column\", {_half_even('avg(v)', 6)} AS mean, "
            f"{_half_even('stddev_samp(v)', 6)} AS std, min(v) AS min, max(v) AS max, "
            f"{_half_even('(count(*) - count(v)) / CAST(count(*) AS DOUBLE)', 9)} AS null_rate FROM "
            f"(SELECT CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END AS v FROM {table})")
    return " UNION ALL ".join(parts)


# -- rule counts -------------------------------------------------------------------------------------

def _codes(*items: tuple[str, str, str, str]) -> str:
    """(source, code, table, condition) -> the codes that are broken at least once."""
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{source}' AS source, '{code}' AS code, count(*) AS broken FROM {table} WHERE {condition}"
        for source, code, table, condition in items) + ") WHERE broken > 0"


_S, _W, _M, _I = "src_sales_history", "src_warehouse_master", "src_manufacturing_logs", "src_iot_rfid_stream"
RAW = f"{V_SALES}, {V_WH}, {V_MFG}, {V_IOT}"


def _slices(limit: str, key: str) -> str:
    """Sales in slices of 500 rows, judged slice by slice."""
    return f"""{V_SALES}, {N_SALES},
sliced AS (SELECT *, CAST(floor((rn - 1) / 500.0) AS BIGINT) + 1 AS batch_id, (rn - 1) % 500 + 1 AS slice_row
           FROM n_sales {limit}), {_judged_sales(key, name='j_slice', source='sliced')}"""


def _counts(table: str, changed: str, remaining: str = "status") -> str:
    return f"""CAST(count(*) FILTER (status IN ('PASS', 'COERCED')) AS BIGINT) AS records_ingested,
       CAST(count(*) FILTER (status IN ('REJECT', 'ERROR')) AS BIGINT) AS records_failed,
       CAST(count(*) FILTER (status = 'QUARANTINE') AS BIGINT) AS records_quarantined,
       CAST(count(*) FILTER (status = 'COERCED') AS BIGINT) AS records_coerced,
       CAST(count(*) FILTER (status = 'DUPLICATE') AS BIGINT) AS records_duplicate,
       CAST(count(*) FILTER ({changed}) AS BIGINT) AS records_normalized FROM {table}"""


SALES_CHANGED = "change_1 IS NOT NULL OR change_2 IS NOT NULL"

ENVELOPE_SALES = f"""
SELECT sha256('event:{_S}:' || audit_key || ':' || rn) AS _event_id,
       sha256('trace:{_S}:' || audit_key || ':' || rn) AS _trace_id,
       '{_S}' AS _source_id, 'ds_sales_history' AS _dataset_id, 'v1' AS _schema_version,
       'SNAPSHOT' AS _operation_type, sale_timestamp AS _event_timestamp, sale_timestamp AS _source_timestamp,
       '{RUN_AT}' AS _ingestion_timestamp, receipt_id, product_id, sale_timestamp, units_sold, store_id
FROM j_sales WHERE status = 'PASS'"""

_LINE_HEAD = "'[' || status || '] source=src_sales_history | row=' || rn || ' | key=' || audit_key"
_N_CHANGES = "(CAST(change_1 IS NOT NULL AS INTEGER) + CAST(change_2 IS NOT NULL AS INTEGER))"
_SUMMARY = (f"'norm_changes=' || {_N_CHANGES} || CASE WHEN {_N_CHANGES} > 0 THEN ' | ' || "
            + _join(" | ", "change_1", "change_2") + " ELSE '' END")
_ABOUT = "' | contract=contract_sales_v1 | policy=quarantine'"

ORACLE: dict[str, str] = {
    "null_canon": f"WITH {V_WH}, {N_WH} SELECT rn AS row, unit_cost, unit_cost IS NULL AS is_null FROM n_wh",
    "upper_ids": f"WITH {V_WH}, {N_WH} SELECT rn AS row, product_id, article_id FROM n_wh",
    "iso_timestamps": f"WITH {V_SALES}, {N_SALES} SELECT rn AS row, sale_timestamp FROM n_sales",
    "impute_defects": f"WITH {V_MFG}, {N_MFG} SELECT rn AS row, defect_count FROM n_mfg",
    "legacy_migrate": f"""WITH {V_LEG}
SELECT upper(old_product_code) AS product_id, historical_period, total_monthly_sales, market_region,
       'NORMALIZE | field=old_product_code | ''' || old_product_code || ''' → ''' || upper(old_product_code)
       || ''' | reason=uppercase_policy{SEPARATOR}SCHEMA_MIGRATE | old_product_code → product_id | value='''
       || upper(old_product_code) || '''' AS changes FROM v_leg""",
    "normalize_changes": f"""WITH {V_SALES}, {N_SALES}, {V_MFG}, {N_MFG}
SELECT '{_S}' AS source, rn AS row, {SALES_CHANGES} AS changes FROM n_sales
UNION ALL SELECT '{_M}', rn, {MFG_CHANGES} FROM n_mfg""",
    "normalize_counts": f"""WITH {V_SALES}, {N_SALES}, {V_WH}, {N_WH}, {V_MFG}, {V_LEG}
SELECT '{_S}' AS source, count(*) AS rows, count(*) FILTER ({SALES_CHANGED}) AS changed FROM n_sales
UNION ALL SELECT '{_W}', count(*), count(*) FILTER (changed) FROM n_wh
UNION ALL SELECT '{_M}', count(*), count(*) FROM v_mfg
UNION ALL SELECT 'src_legacy_trends', count(*), count(*) FROM v_leg""",
    "contract_required": f"WITH {RAW} " + _codes(
        (_S, "receipt_id:required", "v_sales", "receipt_id IS NULL"),
        (_W, "product_id:required", "v_wh", "product_id IS NULL"),
        (_W, "reorder_threshold:required", "v_wh", "reorder_threshold IS NULL"),
        (_M, "product_id:required", "v_mfg", "product_id IS NULL"),
        (_M, "quantity_produced:required", "v_mfg", "quantity_produced IS NULL"),
        (_I, "product_id:required", "v_iot", "product_id IS NULL")),
    "contract_not_null": f"WITH {RAW} " + _codes(
        (_S, "receipt_id:null", "v_sales", "receipt_id IS NULL"),
        (_S, "units_sold:null", "v_sales", "units_sold IS NULL"),
        (_W, "product_id:null", "v_wh", "product_id IS NULL"),
        (_W, "article_id:null", "v_wh", "article_id IS NULL"),
        (_W, "reorder_threshold:null", "v_wh", "reorder_threshold IS NULL"),
        (_W, "unit_cost:null", "v_wh", "isnan(unit_cost)"),
        (_M, "product_id:null", "v_mfg", "product_id IS NULL"),
        (_M, "quantity_produced:null", "v_mfg", "quantity_produced IS NULL"),
        (_I, "product_id:null", "v_iot", "product_id IS NULL")),
    "contract_type": f"WITH {RAW} " + _codes(
        (_M, "quantity_produced:type", "v_mfg", "quantity_produced IS NOT NULL")),
    "contract_enum": f"WITH {RAW} " + _codes(
        (_W, "size:enum", "v_wh", "size = 'XXXL'"),
        (_I, "shelf_location:enum", "v_iot", "shelf_location = 'ZONE-X'")),
    "contract_min": f"WITH {RAW} " + _codes(
        (_W, "max_capacity:min", "v_wh", "max_capacity < 1"),
        (_W, "reorder_threshold:min", "v_wh", "reorder_threshold < 0"),
        (_W, "unit_cost:min", "v_wh", "unit_cost < 0"),
        (_M, "quantity_produced:min", "v_mfg", "quantity_produced = '-3'"),
        (_M, "defect_count:min", "v_mfg", "defect_count < 0"),
        (_I, "current_stock_on_shelf:min", "v_iot", "current_stock_on_shelf < 0")),
    "contract_max": f"WITH {RAW} " + _codes(
        (_I, "current_stock_on_shelf:max", "v_iot", "current_stock_on_shelf > 10000")),
    "contract_violations": f"""WITH {V_WH}, m AS (SELECT rn, {_join(SEPARATOR, *WH_RAW_MESSAGES)} AS violations FROM v_wh)
SELECT rn AS row, CASE WHEN violations = '' THEN 'PASS' ELSE 'QUARANTINE' END AS status, violations FROM m""",
    "contract_violations_iot": f"WITH {IOT} SELECT event_id, status, messages AS violations FROM j_iot",
    "policy_reject": f"""WITH {SALES}
SELECT rn AS row, audit_key AS key, messages AS violations FROM j_sales WHERE status = 'QUARANTINE'""",
    "policy_quarantine": f"""WITH {WH}
SELECT rn AS row, product_id, messages AS violations FROM j_wh WHERE status = 'QUARANTINE'""",
    "policy_coerce": f"""WITH {MFG}
SELECT rn AS row, CAST(quantity_produced AS BIGINT) AS quantity_produced, defect_count, coercion AS coercions
FROM j_mfg WHERE status = 'COERCED'""",
    "policy_revalidate": f"""WITH {MFG}
SELECT rn AS row, quantity_produced, remaining AS violations FROM j_mfg WHERE status = 'QUARANTINE'""",
    "policy_legacy": f"""WITH {LEG}
SELECT 'compat' AS source, status, count(*) AS rows FROM c_leg GROUP BY status
UNION ALL SELECT 'migrated', status, count(*) FROM m_leg GROUP BY status""",
    "status_counts": f"""WITH {SALES}
SELECT status, count(*) AS rows, CAST(sum(rn) AS BIGINT) AS row_sum FROM j_sales GROUP BY status""",
    "dedup_first_wins": f"""WITH {SALES}
SELECT rn AS row, receipt_id, product_id, units_sold FROM j_sales WHERE NOT duplicate""",
    "dedup_fallback_key": f"""WITH {SALES}
SELECT rn AS row, product_id, duplicate FROM j_sales WHERE receipt_id IS NULL""",
    "dedup_per_slice": f"""WITH {_slices('', 'batch_id, dedup_key')}
SELECT batch_id, count(*) AS rows, count(*) FILTER (duplicate) AS duplicates FROM j_slice GROUP BY batch_id""",
    "dedup_counts": f"""WITH {SALES}, {MFG}
SELECT '{_S}' AS source, count(*) AS rows, count(*) FILTER (duplicate) AS duplicates,
       {_half_even('count(*) FILTER (duplicate) / CAST(count(*) AS DOUBLE)', 6)} AS duplicate_rate FROM j_sales
UNION ALL SELECT '{_M}', count(*), count(*) FILTER (duplicate),
       {_half_even('count(*) FILTER (duplicate) / CAST(count(*) AS DOUBLE)', 6)} FROM j_mfg""",
    "stream_dedup": f"WITH {V_IOT} SELECT * FROM v_iot",
    "envelope": f"WITH {SALES} {ENVELOPE_SALES}",
    "envelope_event_time": f"""WITH {MFG}, {V_IOT}, {WH}
SELECT '{_M}' AS source, mfg_timestamp AS event_time, mfg_timestamp AS source_time, count(*) AS rows
FROM j_mfg WHERE status = 'COERCED' GROUP BY mfg_timestamp
UNION ALL SELECT '{_I}', "timestamp", NULL, count(*) FROM v_iot GROUP BY "timestamp"
UNION ALL SELECT '{_W}', NULL, NULL, count(*) FROM j_wh WHERE status = 'PASS'""",
    "quarantine_rows": f"""WITH {SALES}
SELECT receipt_id, product_id, sale_timestamp, units_sold, store_id, {_quoted_list(SALES_MESSAGES)} AS _violations,
       {_join('; ', *SALES_MESSAGES)} AS _quarantine_reason FROM j_sales WHERE status = 'QUARANTINE'""",
    "audit_log": f"""WITH {MFG}
SELECT rn AS row, audit_key AS key, status, CASE WHEN status = 'QUARANTINE' THEN remaining END AS violations,
       CASE WHEN status = 'COERCED' THEN coercion END AS coercions FROM j_mfg""",
    "audit_lines": f"""WITH {SALES}
SELECT rn AS row, status, CASE WHEN status = 'PASS' THEN {_LINE_HEAD} || {_ABOUT} || ' | ' || {_SUMMARY}
       WHEN status = 'DUPLICATE' THEN {_LINE_HEAD} || ' | reason=dedup_key_already_seen | skipped=True'
       ELSE {_LINE_HEAD} || {_ABOUT} || ' | violations=[' || {_join(' | ', *SALES_MESSAGES)} || '] | ' || {_SUMMARY}
       END AS line FROM j_sales""",
    "push_ingest": f"""WITH {V_MFG}, m AS (SELECT *, {_join(SEPARATOR, *MFG_REMAINING)} AS remaining FROM v_mfg)
SELECT production_batch_id, product_id, mfg_timestamp, CAST(quantity_produced AS BIGINT) AS quantity_produced,
       defect_count FROM m WHERE remaining = ''""",
    "microbatch_cap": f"""WITH {_slices('WHERE rn <= 2500', 'batch_id, dedup_key')}
SELECT batch_id, slice_row AS row, audit_key AS key, status FROM j_slice""",
    "microbatch_slices": f"""WITH {_slices('', 'batch_id, dedup_key')}
SELECT batch_id, slice_row AS row, audit_key AS key, status FROM j_slice""",
    "microbatch_telemetry": f"""WITH {_slices('', 'batch_id, dedup_key')}
SELECT batch_id, '{_S}' AS source_id, {_counts('j_slice', SALES_CHANGED)} GROUP BY batch_id""",
    "stream_events": f"""WITH {IOT}
SELECT sha256('event:{_I}:' || event_id) AS _event_id, sha256('trace:{_I}:' || event_id) AS _trace_id,
       '{_I}' AS _source_id, 'ds_iot_rfid_stream' AS _dataset_id, 'v1' AS _schema_version, 'INSERT' AS _operation_type,
       "timestamp" AS _event_timestamp, "timestamp" AS _source_timestamp, event_id, "timestamp", product_id,
       shelf_location, current_stock_on_shelf, battery_level FROM j_iot WHERE status = 'PASS'""",
    "stream_flush": f"""WITH {IOT}, n AS (SELECT count(*) AS n FROM j_iot WHERE status = 'PASS')
SELECT i AS file, CAST(least(300, n - 300 * i) AS BIGINT) AS events, CAST(1 AS BIGINT) AS files
FROM (SELECT n, unnest(range((n + 299) // 300)) AS i FROM n)""",
    "stream_progress": f"""WITH {IOT},
resent AS (SELECT count(*) FILTER (CAST(event_id AS BIGINT) % 33 = 0) AS n FROM j_iot)
SELECT 'readings' AS query, CAST(3 AS BIGINT) AS batches, CAST(count(*) + 3 * any_value(n) AS BIGINT) AS events_read,
       count(*) FILTER (status = 'PASS') AS ingested, CAST(3 * any_value(n) AS BIGINT) AS failed,
       count(*) FILTER (status <> 'PASS') AS quarantined, true AS timed FROM j_iot, resent""",
    "stream_two_sinks": f"""WITH {IOT}
SELECT CASE WHEN status = 'PASS' THEN 'good' ELSE 'quarantine' END AS sink, event_id,
       {_quoted_list(IOT_MESSAGES)} AS violations FROM j_iot""",
    "stream_no_dedup": f"""WITH {IOT}
SELECT CASE WHEN status = 'PASS' THEN 'good' ELSE 'quarantine' END AS sink, event_id,
       CAST(CASE WHEN CAST(event_id AS BIGINT) % 33 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies FROM j_iot""",
    "kafka_encode": f"""WITH {V_IOT}
SELECT product_id AS key, '{{"event_id":"' || event_id || '","timestamp":"' || "timestamp" || '","product_id":'
       || coalesce('"' || product_id || '"', 'null') || ',"shelf_location":"' || shelf_location
       || '","current_stock_on_shelf":' || current_stock_on_shelf || ',"battery_level":'
       || coalesce('"' || battery_level || '"', 'null') || '}}' AS value FROM v_iot""",
    "kafka_decode": f"WITH {V_IOT} SELECT product_id AS _key, * FROM v_iot",
    "weather_flatten": f"""WITH flat AS (
  SELECT event_id, ['Lahore', 'Karachi', 'Islamabad', 'Rawalpindi', 'Faisalabad'][user_id % 5 + 1] AS city,
         value / 4 AS temperature, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + event_id % 7 AS humidity,
         event_type AS weather_description, {_iso('ts')} AS "timestamp" FROM events),
m AS (SELECT *, {_join(SEPARATOR, _above('temperature', '60'), _above('humidity', '100'))} AS violations FROM flat)
SELECT event_id, city, temperature, humidity, weather_description, "timestamp",
       CASE WHEN violations = '' THEN 'PASS' ELSE 'QUARANTINE' END AS status, violations FROM m""",
    "landed_ingest": f"""WITH flat AS (
  SELECT ['Lahore', 'Karachi', 'Islamabad', 'Rawalpindi', 'Faisalabad'][user_id % 5 + 1] AS city,
         value / 4 AS temperature, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + event_id % 7 AS humidity,
         event_type AS weather_description, {_iso('ts')} AS "timestamp", CAST(event_id % 2 AS INTEGER) AS landed FROM events)
SELECT * FROM flat WHERE temperature <= 60 AND humidity <= 100""",
    "cdc_feed": f"WITH {FEED} SELECT * FROM feed",
    "cdc_feed_ops": f"""WITH {DRAWN}
SELECT o AS _log_offset, CASE WHEN percent < 60 THEN 'INSERT' WHEN percent < 90 THEN 'UPDATE' ELSE 'DELETE' END AS _operation_type FROM drawn""",
    "cdc_log_based": f"""WITH {FEED}
SELECT _log_offset, _event_id, _operation_type, receipt_id, units_sold FROM feed WHERE _log_offset > {LOG_POSITION}""",
    "cdc_trigger_based": f"""WITH {FEED}
SELECT _log_offset, _event_id, _operation_type, receipt_id, units_sold FROM feed
WHERE _operation_type IN ('UPDATE', 'DELETE')""",
    "cdc_timestamp_based": f"""WITH {FEED}
SELECT _log_offset, _ingestion_timestamp, _operation_type, receipt_id FROM feed
WHERE strptime(left(_ingestion_timestamp, 19), '%Y-%m-%dT%H:%M:%S') > TIMESTAMP '{WATERMARK[:19].replace('T', ' ')}'
   OR (left(_ingestion_timestamp, 19) = '{WATERMARK[:19]}' AND length(_ingestion_timestamp) > 25)""",
    "cdc_op_counts": f"WITH {FEED} SELECT _operation_type, count(*) AS events FROM feed GROUP BY 1",
    "cdc_two_step": f"""WITH {FEED}
SELECT count(*) AS events, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS repeated FROM feed""",
    "profile_kinds": f"WITH {V_SALES}, {V_WH} " + " UNION ALL ".join((
        _kind_rows(_S, "v_sales", ("units_sold",), ("sale_timestamp",), ("receipt_id", "product_id", "store_id")),
        _kind_rows(_W, "v_wh", ("reorder_threshold", "max_capacity", "unit_cost"), (),
                   ("product_id", "article_id", "product_name", "color", "size")),
        _kind_rows("customer", "customer", ("c_custkey", "c_nationkey", "c_acctbal"), (), ("c_name", "c_mktsegment")))),
    "profile_categorical": f"WITH {V_SALES}, {V_WH} " + " UNION ALL ".join((
        _frequency_rows(_S, "v_sales", "receipt_id", "product_id", "store_id"),
        _frequency_rows(_W, "v_wh", "product_id", "article_id", "product_name", "color", "size"),
        _frequency_rows("customer", "customer", "c_name", "c_mktsegment"))),
    "profile_numeric": f"WITH {V_SALES}, {V_WH} " + " UNION ALL ".join((
        _numeric_rows(_S, "v_sales", "units_sold"),
        _numeric_rows(_W, "v_wh", "reorder_threshold", "max_capacity", "unit_cost"),
        _numeric_rows("customer", "customer", "c_custkey", "c_nationkey", "c_acctbal"))),
    "profile_timestamp": f"""WITH {V_SALES}, {N_SALES}
SELECT '{_S}' AS source, 'sale_timestamp' AS "column", epoch_us(min(moment)) / 1e6 AS min,
       epoch_us(max(moment)) / 1e6 AS max, 0.0::DOUBLE AS null_rate FROM n_sales""",
    "synth_categorical": f"""WITH {IDS}, {V_WH}, {_frequency('f_size', 'size', 'v_wh')}, {_frequency('f_article', 'article_id', 'v_wh')},
{_ranked('ids', 'f_size', 100, 'd_size')}, {_ranked('ids', 'f_article', 102, 'd_article')}
SELECT r AS _row, d_size.value AS size, {_masked('d_article.value', 102,
    '(SELECT (count(*) - count(article_id)) / CAST(count(*) AS DOUBLE) FROM v_wh)', 'd_size.')} AS article_id
FROM d_size JOIN d_article USING (r)""",
    "synth_numeric": f"""WITH {IDS}, {V_WH}, {_stats('cost', 'unit_cost', 'v_wh')}, {_stats('threshold', 'reorder_threshold', 'v_wh')}
SELECT r AS _row, {_half_even(_sampled('cost', 100), 5)} AS unit_cost,
       {_half_even(_sampled('threshold', 102), 5)} AS reorder_threshold FROM ids, cost, threshold""",
    "synth_timestamp": f"""WITH {IDS}, {V_SALES}, {N_SALES},
bounds AS (SELECT epoch_us(min(moment)) AS low, epoch_us(max(moment)) AS high FROM n_sales),
drawn AS (SELECT r, make_timestamp(low + {_below_draw(100, '(high - low + 1)')}) AS moment FROM ids, bounds)
SELECT r AS _row, {_iso('moment')} AS sale_timestamp FROM drawn""",
    "synth_rows": f"""WITH {IDS}, {_stats('nation_key', 'c_nationkey', 'customer')}, {_stats('balance', 'c_acctbal', 'customer')},
{_frequency('f_segment', 'c_mktsegment', 'customer')}, {_ranked('ids', 'f_segment', 106, 'd_segment')},
{_frequency('f_name', 'c_name', 'customer')}, {_ranked('ids', 'f_name', 100, 'd_name')}
SELECT r AS _row, d_name.value AS c_name, {_half_even(_sampled('nation_key', 102, 'd_name.'), 5)} AS c_nationkey,
       {_half_even(_sampled('balance', 104, 'd_name.'), 5)} AS c_acctbal, d_segment.value AS c_mktsegment
FROM d_name JOIN d_segment USING (r), nation_key, balance""",
}

_COLORS = ("Midnight Black", "Navy Blue", "Olive Green", "Classic White", "Charcoal Grey", "Burgundy Red")
_CODES = ("MID", "NAV", "OLI", "CLA", "GRY", "BUR")
_SIZES = ("XS", "S", "M", "L", "XL", "XXL")
_STORES = ("LDN-OXFORD", "LDN-KINGS", "NYC-5AVE", "NYC-MAIN", "DXB-MALL", "KHI-DOLMEN", "ISB-CENTAURUS", "LHR-LIBERTY",
           "PAR-CHAMPS", "BER-KURFUERSTENDAMM")
_REGIONS = ("Europe", "Americas", "Asia", "MENA", "APAC", "North America")
_CITIES = (("Lahore", 40), ("Karachi", 30), ("Islamabad", 15), ("Rawalpindi", 10), ("Faisalabad", 5))
_SKIES = (("clear sky", 20), ("few clouds", 15), ("scattered clouds", 15), ("broken clouds", 10), ("shower rain", 10),
          ("rain", 10), ("thunderstorm", 5), ("snow", 3), ("mist", 2))


def _filled(value: str, default: str) -> str:
    return f"CASE WHEN {value} IS NULL OR {value} = 0 THEN {default}::DOUBLE ELSE {value} END"


def _whole(value: str, default: str, floor: int) -> str:
    return f"greatest({floor}, CAST(floor(abs({_filled(value, default)})) AS BIGINT))"


ORACLE |= {
    "synth_warehouse": f"""WITH {IDS}, {V_WH}, {_frequency('f_name', 'product_name', 'v_wh')},
{_ranked('ids', 'f_name', 100, 'd_name')}, {_stats('s1', 'reorder_threshold', 'v_wh')},
{_stats('s2', 'max_capacity', 'v_wh')}, {_stats('s3', 'unit_cost', 'v_wh')},
drawn AS (SELECT r, s, d_name.value AS product_name, {_sampled('s1', 102)} AS reorder_threshold,
                 {_sampled('s2', 104)} AS max_capacity, {_sampled('s3', 106)} AS unit_cost
          FROM d_name, s1, s2, s3)
SELECT r AS _row, product_name, {_whole('reorder_threshold', '50', 1)} AS reorder_threshold,
       {_whole('max_capacity', '500', 10)} AS max_capacity,
       {_half_even(f"greatest(0.01::DOUBLE, abs({_filled('unit_cost', '30')}))", 2)} AS unit_cost,
       'ART-' || (2000 + 3 * r) || '-' || {_pick(21, _CODES)} || '-' || {_pick(22, _SIZES)} AS product_id,
       'ART-' || (2000 + 3 * r) AS article_id, {_pick(21, _COLORS)} AS color, {_pick(22, _SIZES)} AS size
FROM drawn""",
    "synth_manufacturing": f"""WITH {IDS}, {POOL}, {V_MFG}, {_stats('st', 'defect_count', 'v_mfg')}, {_stats('sq', 'TRY_CAST(quantity_produced AS DOUBLE)', 'v_mfg')},
drawn AS (SELECT r, s, product_id, {_sampled('st', 108)} AS defects, {_sampled('sq', 106)} AS quantity FROM keyed, st, sq)
SELECT r AS _row, 'BATCH-' || (60000 + r) AS production_batch_id,
       CASE WHEN {_chance(24, 0.20)} THEN lower(product_id) ELSE product_id END AS product_id,
       {_whole('quantity', '100', 1)} AS quantity_produced,
       CASE WHEN NOT {_chance(25, 0.05)} THEN {_half_even("greatest(0.0::DOUBLE, coalesce(defects, 0.0::DOUBLE))", 1)}
       END AS defect_count, '{RUN_AT}' AS mfg_timestamp FROM drawn""",
    "synth_sales": f"""WITH {IDS}, {POOL}, {V_SALES}, {_stats('st', 'units_sold', 'v_sales')},
drawn AS (SELECT r, s, product_id, {_sampled('st', 106)} AS units FROM keyed, st),
sold AS (SELECT *, {_whole('units', '1', 1)} AS whole_units FROM drawn)
SELECT r AS _row, CASE WHEN {_chance(29, 0.03)} THEN -whole_units ELSE whole_units END AS units_sold,
       lpad(upper(to_hex({_below_draw(26, 16**8)})), 8, '0') AS receipt_id,
       CASE WHEN NOT {_chance(27, 0.05)} THEN product_id END AS product_id,
       '{RUN_AT}' AS sale_timestamp, {_pick(28, _STORES)} AS store_id FROM sold""",
    "synth_legacy": f"""WITH {IDS}, {POOL}, {V_LEG}, {_stats('st', 'total_monthly_sales', 'v_leg')},
drawn AS (SELECT r, s, product_id, {_sampled('st', 104)} AS sold FROM keyed, st)
SELECT r AS _row, CAST(floor(abs({_filled('sold', '500')})) AS BIGINT) AS total_monthly_sales, product_id,
       strftime(DATE '{RUN_AT[:10]}' - CAST(({_below_draw(30, 36)} + 1) * 30 AS INTEGER), '%Y-%m') AS historical_period,
       {_pick(31, _REGIONS)} AS market_region FROM drawn""",
    "synth_iot": f"""WITH {IDS}, {POOL},
drawn AS (SELECT r, s, product_id, md5('rfid:' || r) AS h,
                 TIMESTAMP '{RUN_AT[:19].replace('T', ' ')}' + to_microseconds(r * 1000000) AS moment FROM keyed),
readings AS (
  SELECT r AS _row, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
         || '-' || substr(h, 21, 12) AS event_id, {_iso('moment')} AS "timestamp", product_id,
         {_pick(33, ('ZONE-A', 'ZONE-B', 'ZONE-C'))} AS shelf_location,
         {_below_draw(34, 146)} + 5 AS current_stock_on_shelf,
         ({_below_draw(35, 91)} + 10) || '%' AS battery_level, {_chance(36, 0.03 / 0.97)} AS again FROM drawn)
SELECT * EXCLUDE (again) FROM readings UNION ALL SELECT * EXCLUDE (again) FROM readings WHERE again""",
    "synth_weather": f"""WITH {IDS}
SELECT r AS _row, {_weighted(100, _CITIES)} AS city,
       {_half_even(_clipped(102, '25.0', '10.0', '-10.0', '50.0'), 5)} AS temperature,
       {_half_even(_clipped(104, '60.0', '20.0', '0.0', '100.0'), 5)} AS humidity,
       {_weighted(106, _SKIES)} AS weather_description, '{RUN_AT}' AS "timestamp" FROM ids""",
    "synth_fk": f"""WITH {IDS}, {POOL}
SELECT CAST(0 AS BIGINT) AS orphans, count(*) AS rows, count(DISTINCT product_id) AS keys FROM keyed""",
    "job_counters": f"""WITH {MFG}, {SALES}
SELECT '{_M}' AS source, {_counts('j_mfg', 'true')} UNION ALL SELECT '{_S}', {_counts('j_sales', SALES_CHANGED)}""",
    "ingest_latency": f"""WITH {SALES}
SELECT {_half_even(f"avg((epoch_us(TIMESTAMP '{RUN_AT[:19].replace('T', ' ')}') - epoch_us(moment)) / 1e6)", 3)}
       AS avg_ingestion_latency_sec FROM j_sales WHERE status = 'PASS'""",
    "batch_summary": f"""WITH {SALES}, {MFG}, {WH}, {LEG},
counted AS (
  SELECT '{_S}' AS source_id, {_counts('j_sales', SALES_CHANGED)} UNION ALL
  SELECT '{_M}', {_counts('j_mfg', 'true')} UNION ALL
  SELECT '{_W}', {_counts('j_wh', 'changed')} UNION ALL
  SELECT 'src_legacy_trends', {_counts('c_leg', 'true')})
SELECT source_id, records_ingested AS ok, records_failed AS failed, records_quarantined AS quarantined,
       records_coerced AS coerced, records_normalized AS normalized,
       {_half_even(f'records_ingested / {JOB_SECONDS}::DOUBLE', 1)} AS rate FROM counted""",
    "job_metrics": """
SELECT count(*) AS total_jobs, count(*) FILTER (o_orderstatus = 'O') AS running_jobs,
       count(*) FILTER (o_orderstatus <> 'O') AS completed_jobs FROM orders""",
    "job_lookup": """
SELECT 'job-' || o_orderkey AS job_id, 'src-' || o_custkey AS source_id,
       CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status
FROM orders WHERE o_orderkey = 7""",
    "dataset_limit": f"""WITH {V_SALES}
SELECT receipt_id, product_id, sale_timestamp, units_sold, store_id, rn AS _row FROM v_sales ORDER BY rn LIMIT 100""",
    "low_stock_alerts": f"""WITH {V_WH}
SELECT product_id, CAST(0 AS BIGINT) AS current_stock, reorder_threshold, 'Low stock' AS alert FROM v_wh
WHERE reorder_threshold > 0""",
}

ORACLE |= {
    "cdc_capture": f"""WITH {FEED}
SELECT _operation_type, count(*) AS events, CAST((SELECT count(*) FROM feed) AS BIGINT) AS reported, '{_S}' AS source_id
FROM feed GROUP BY 1""",
    "cdc_chunks": f"""WITH {FEED}
SELECT _log_offset // 5000 AS chunk, count(*) AS events, min(_log_offset) AS first, max(_log_offset) AS last
FROM feed GROUP BY 1""",
    "cdc_commit": f"""WITH {FEED}
SELECT count(*) AS extracted, CAST(count(*) - 1 AS VARCHAR) AS last, CAST(count(*) - 1 AS VARCHAR) AS position FROM feed""",
    "checkpoint_positions": """
SELECT CAST(count(*) AS VARCHAR) AS rows, CAST(count(*) AS VARCHAR) AS position FROM lineitem""",
    "stream_resume": f"WITH {IOT} SELECT event_id FROM j_iot",
    "foreach_batch_hook": f"WITH {IOT} SELECT event_id, 'INSERT' AS _operation_type FROM j_iot WHERE status = 'PASS'",
    "csv_scan": f"""WITH {V_SALES}
SELECT receipt_id, product_id, sale_timestamp, CAST(units_sold AS DOUBLE) AS units_sold, store_id FROM v_sales""",
    "csv_quoted_breaks": f"""WITH {V_SALES}
SELECT receipt_id, receipt_id || chr(10) || 'said "yes", then' || chr(10) || chr(10) || 'left ' || store_id AS note, store_id
FROM v_sales""",
    "csv_mixed_headers": f"""WITH {V_SALES}, n AS (SELECT *, CAST(store_id AS BIGINT) % 3 AS kind FROM v_sales)
SELECT receipt_id, CASE WHEN kind <> 1 THEN product_id END AS product_id, CAST(units_sold AS VARCHAR) AS units_sold, store_id,
       CASE WHEN kind = 2 THEN 'r' || store_id END AS region FROM n""",
    "load_failure": f"""
SELECT '{_M}' AS source_id, CAST(1 AS BIGINT) AS records_failed, false AS ingested
UNION ALL SELECT '{_S}', CAST(0 AS BIGINT), count(*) > 0 FROM lineitem""",
    "good_sink": f"SELECT * EXCLUDE (_ingestion_timestamp) FROM ({ORACLE['envelope']})",
    "job_telemetry": f"""WITH {SALES}
SELECT '{_S}' AS source_id, CAST(count(*) FILTER (status = 'PASS') AS BIGINT) AS records_ingested,
       CAST(count(*) FILTER (status IN ('REJECT', 'ERROR')) AS BIGINT) AS records_failed,
       CAST(count(*) FILTER (status = 'QUARANTINE') AS BIGINT) AS records_quarantined,
       CAST(count(*) FILTER (status = 'COERCED') AS BIGINT) AS records_coerced,
       CAST(count(*) FILTER (status = 'DUPLICATE') AS BIGINT) AS records_duplicate,
       true AS rate_follows, true AS lag_follows, true AS files_follow, CAST(1 AS BIGINT) AS snapshot_count FROM j_sales""",
    "file_row_counts": f"""WITH {SALES}
SELECT 'ingested' AS area, count(*) AS rows FROM j_sales WHERE status = 'PASS'
UNION ALL SELECT 'quarantine', count(*) FROM j_sales WHERE status = 'QUARANTINE'""",
    "storage_audit": "SELECT 'TOTAL,detail_logs,ingested,quarantine' AS areas, count(*) > 0 AS adds_up FROM lineitem",
    "profile_constant": """
SELECT 'c_custkey' AS "column", 'numeric' AS kind, count(*) AS rows, count(*) AS present, 0.0::DOUBLE AS null_rate FROM customer
UNION ALL SELECT 'nothing', 'constant', count(*), 0, 1.0::DOUBLE FROM customer""",
    "row_hook": f"SELECT *, substr(sale_timestamp, 1, 7) AS sale_month FROM ({ORACLE['synth_timestamp']})",
}
