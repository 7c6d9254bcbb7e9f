"""Sources, datasets, jobs and contracts as plain metadata."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


# The names each metadata attribute may take.

class SourceType(str, Enum):
    DB = "db"
    API = "api"
    STREAM = "stream"
    FILE = "file"


class ExtractionMode(str, Enum):
    PULL = "pull"
    PUSH = "push"
    QUERY = "query"


class ChangeCaptureMode(str, Enum):
    FULL_SNAPSHOT = "full_snapshot"
    INCREMENTAL = "incremental"
    CDC_LOG_BASED = "cdc_log_based"
    CDC_TRIGGER_BASED = "cdc_trigger_based"
    STREAM_EVENT = "stream_event"


class IngestionFrequency(str, Enum):
    REAL_TIME = "real_time"
    HOURLY = "hourly"
    DAILY = "daily"
    WEEKLY = "weekly"
    ON_DEMAND = "on_demand"


class ClassificationLevel(str, Enum):
    PUBLIC = "public"
    INTERNAL = "internal"
    CONFIDENTIAL = "confidential"
    RESTRICTED = "restricted"


class ExecutionMode(str, Enum):
    BATCH = "batch"
    MICRO_BATCH = "micro_batch"
    STREAMING = "streaming"
    CDC_CONTINUOUS = "cdc_continuous"


class OperationType(str, Enum):
    INSERT = "INSERT"
    UPDATE = "UPDATE"
    DELETE = "DELETE"
    SNAPSHOT = "SNAPSHOT"


class ViolationPolicy(str, Enum):
    REJECT = "reject"
    QUARANTINE = "quarantine"
    AUTO_COERCE = "auto_coerce"


@dataclass(frozen=True)
class FieldConstraint:
    """Rules for one column: type, NULLs, allowed values and inclusive bounds."""

    name: str
    dtype: str
    nullable: bool = False
    allowed_values: tuple[str, ...] | None = None
    unit: str | None = None
    min_value: float | int | None = None
    max_value: float | int | None = None


@dataclass(frozen=True)
class DataContract:
    """All rules for one source and what to do with a row that breaks one."""

    contract_id: str
    source_id: str
    version: str
    required_fields: tuple[str, ...]
    fields: tuple[FieldConstraint, ...]
    policy: ViolationPolicy = ViolationPolicy.QUARANTINE
    nullable_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class DataSource:
    source_id: str
    name: str
    source_type: SourceType
    extraction_mode: ExtractionMode
    change_capture_mode: ChangeCaptureMode
    ingestion_frequency: IngestionFrequency
    expected_schema: tuple[tuple[str, str], ...]
    connection_info: tuple[tuple[str, str], ...] = ()
    tags: tuple[str, ...] = ()

    def typed_schema(self) -> T.StructType:
        """Declared types; timestamps stay text, as the contracts check them."""
        return T.StructType([T.StructField(n, _SPARK_TYPES[t], True) for n, t in self.expected_schema])

    def raw_schema(self) -> T.StructType:
        """Every column as text, for files whose numbers may be dirty."""
        return T.StructType([T.StructField(n, T.StringType(), True) for n, _ in self.expected_schema])

    def numeric_fields(self) -> tuple[str, ...]:
        return tuple(n for n, t in self.expected_schema if t in ("int", "float"))


@dataclass(frozen=True)
class Dataset:
    dataset_id: str
    name: str
    domain: str
    classification_level: ClassificationLevel
    schema_version: str
    retention_policy: str
    owner: str
    description: str = ""


@dataclass(frozen=True)
class IngestionJob:
    """Links a source to a dataset. Retries and timeouts are the cluster's business."""

    job_id: str
    source_id: str
    dataset_id: str
    execution_mode: ExecutionMode = ExecutionMode.BATCH
    batch_size: int | None = None
    max_retries: int = 3
    timeout_seconds: int = 3600
    options: dict = field(default_factory=dict)


_SPARK_TYPES = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "datetime": T.StringType(),
}

WAREHOUSE = "src_warehouse_master"
MANUFACTURING = "src_manufacturing_logs"
SALES = "src_sales_history"
LEGACY = "src_legacy_trends"
IOT = "src_iot_rfid_stream"
WEATHER = "src_weather_api"

SCHEMA_VERSION = "v1"
OWNER = "data-engineering-team"

# The first-wins key of each batch source.
DEDUP_KEYS = {
    SALES: "receipt_id",
    MANUFACTURING: "production_batch_id",
    WAREHOUSE: "product_id",
    LEGACY: "old_product_code",
}

# Sources as registered (columns, extraction, frequency).
SOURCES = {
    source.source_id: source
    for source in (
        DataSource(
            WAREHOUSE, "Warehouse Master", SourceType.FILE, ExtractionMode.PULL,
            ChangeCaptureMode.FULL_SNAPSHOT, IngestionFrequency.DAILY,
            (("product_id", "str"), ("article_id", "str"), ("product_name", "str"), ("color", "str"),
             ("size", "str"), ("reorder_threshold", "int"), ("max_capacity", "int"), ("unit_cost", "float")),
            tags=("supply-chain", "master-data", "batch"),
        ),
        DataSource(
            MANUFACTURING, "Manufacturing Logs", SourceType.FILE, ExtractionMode.PULL,
            ChangeCaptureMode.INCREMENTAL, IngestionFrequency.DAILY,
            (("production_batch_id", "str"), ("product_id", "str"), ("mfg_timestamp", "datetime"),
             ("quantity_produced", "int"), ("defect_count", "float")),
            tags=("supply-chain", "manufacturing", "batch"),
        ),
        DataSource(
            SALES, "Sales History", SourceType.FILE, ExtractionMode.PULL,
            ChangeCaptureMode.INCREMENTAL, IngestionFrequency.DAILY,
            (("receipt_id", "str"), ("product_id", "str"), ("sale_timestamp", "datetime"),
             ("units_sold", "int"), ("store_id", "str")),
            tags=("supply-chain", "sales", "batch"),
        ),
        DataSource(
            LEGACY, "Legacy Trends", SourceType.FILE, ExtractionMode.PULL,
            ChangeCaptureMode.FULL_SNAPSHOT, IngestionFrequency.WEEKLY,
            (("old_product_code", "str"), ("historical_period", "str"),
             ("total_monthly_sales", "int"), ("market_region", "str")),
            tags=("supply-chain", "legacy", "analytics", "batch"),
        ),
        DataSource(
            IOT, "IoT RFID Stream", SourceType.STREAM, ExtractionMode.PUSH,
            ChangeCaptureMode.STREAM_EVENT, IngestionFrequency.REAL_TIME,
            (("event_id", "str"), ("timestamp", "datetime"), ("product_id", "str"),
             ("shelf_location", "str"), ("current_stock_on_shelf", "int"), ("battery_level", "str")),
            tags=("supply-chain", "iot", "streaming", "real-time"),
        ),
        DataSource(
            WEATHER, "Weather API", SourceType.API, ExtractionMode.PULL,
            ChangeCaptureMode.INCREMENTAL, IngestionFrequency.HOURLY,
            (("city", "str"), ("temperature", "float"), ("humidity", "int"),
             ("weather_description", "str"), ("timestamp", "datetime")),
            tags=("external", "weather", "api", "pull"),
        ),
    )
}

# Datasets as registered (domain, classification, retention).
DATASETS = {
    dataset.dataset_id: dataset
    for dataset in (
        Dataset("ds_warehouse_master", "Warehouse Master Dataset", "supply_chain",
                ClassificationLevel.INTERNAL, SCHEMA_VERSION, "forever", OWNER),
        Dataset("ds_manufacturing_logs", "Manufacturing Logs Dataset", "supply_chain",
                ClassificationLevel.INTERNAL, SCHEMA_VERSION, "365 days", OWNER),
        Dataset("ds_sales_history", "Sales History Dataset", "supply_chain",
                ClassificationLevel.CONFIDENTIAL, SCHEMA_VERSION, "365 days", OWNER),
        Dataset("ds_legacy_trends", "Legacy Trends Dataset", "supply_chain",
                ClassificationLevel.INTERNAL, SCHEMA_VERSION, "forever", OWNER),
        Dataset("ds_iot_rfid_stream", "IoT RFID Stream Dataset", "supply_chain",
                ClassificationLevel.INTERNAL, SCHEMA_VERSION, "90 days", OWNER),
        Dataset("ds_weather_api", "Weather API Dataset", "external",
                ClassificationLevel.PUBLIC, SCHEMA_VERSION, "30 days", OWNER),
    )
}

# Allowed sizes and shelf zones, and the six contracts.
SIZES = ("XS", "S", "M", "L", "XL", "XXL")
ZONES = ("ZONE-A", "ZONE-B", "ZONE-C")

CONTRACTS = {
    contract.source_id: contract
    for contract in (
        DataContract(
            "contract_warehouse_v1", WAREHOUSE, SCHEMA_VERSION,
            ("product_id", "reorder_threshold", "max_capacity", "unit_cost"),
            (
                FieldConstraint("product_id", "str"),
                FieldConstraint("article_id", "str"),
                FieldConstraint("product_name", "str"),
                FieldConstraint("color", "str"),
                FieldConstraint("size", "str", allowed_values=SIZES),
                FieldConstraint("reorder_threshold", "int", min_value=0),
                FieldConstraint("max_capacity", "int", min_value=1),
                FieldConstraint("unit_cost", "float", unit="USD", min_value=0.0),
            ),
            ViolationPolicy.QUARANTINE,
        ),
        DataContract(
            "contract_manufacturing_v1", MANUFACTURING, SCHEMA_VERSION,
            ("production_batch_id", "product_id", "mfg_timestamp", "quantity_produced"),
            (
                FieldConstraint("production_batch_id", "str"),
                FieldConstraint("product_id", "str"),
                FieldConstraint("mfg_timestamp", "str"),
                FieldConstraint("quantity_produced", "int", min_value=0),
                FieldConstraint("defect_count", "float", nullable=True, min_value=0.0),
            ),
            ViolationPolicy.AUTO_COERCE,
            ("defect_count",),
        ),
        DataContract(
            "contract_sales_v1", SALES, SCHEMA_VERSION,
            ("receipt_id", "sale_timestamp"),
            (
                FieldConstraint("receipt_id", "str"),
                FieldConstraint("product_id", "str", nullable=True),
                FieldConstraint("sale_timestamp", "str"),
                FieldConstraint("units_sold", "int"),
                FieldConstraint("store_id", "str", nullable=True),
            ),
            ViolationPolicy.QUARANTINE,
            ("product_id", "store_id"),
        ),
        DataContract(
            "contract_legacy_v1", LEGACY, SCHEMA_VERSION,
            ("old_product_code", "historical_period", "total_monthly_sales"),
            (
                FieldConstraint("old_product_code", "str"),
                FieldConstraint("historical_period", "str"),
                FieldConstraint("total_monthly_sales", "int", min_value=0),
                FieldConstraint("market_region", "str", nullable=True),
            ),
            ViolationPolicy.AUTO_COERCE,
            ("market_region",),
        ),
        DataContract(
            "contract_iot_v1", IOT, SCHEMA_VERSION,
            ("event_id", "timestamp", "product_id", "current_stock_on_shelf"),
            (
                FieldConstraint("event_id", "str"),
                FieldConstraint("timestamp", "str"),
                FieldConstraint("product_id", "str"),
                FieldConstraint("shelf_location", "str", allowed_values=ZONES),
                FieldConstraint("current_stock_on_shelf", "int", min_value=0, max_value=10000),
                FieldConstraint("battery_level", "str", nullable=True),
            ),
            ViolationPolicy.QUARANTINE,
            ("battery_level",),
        ),
        DataContract(
            "contract_weather_v1", WEATHER, SCHEMA_VERSION,
            ("city", "temperature", "humidity", "weather_description", "timestamp"),
            (
                FieldConstraint("city", "str"),
                FieldConstraint("temperature", "float", unit="Celsius", min_value=-50, max_value=60),
                FieldConstraint("humidity", "int", unit="%", min_value=0, max_value=100),
                FieldConstraint("weather_description", "str"),
                FieldConstraint("timestamp", "str"),
            ),
            ViolationPolicy.QUARANTINE,
        ),
    )
}


def dataset_for(source_id: str) -> str:
    """The dataset a source feeds: the same name with the other prefix."""
    return "ds_" + source_id.removeprefix("src_")


def source_for(dataset_id: str) -> str:
    return "src_" + dataset_id.removeprefix("ds_")
