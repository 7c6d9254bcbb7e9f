"""Batch jobs end to end on literal files."""

import json

import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from contractflow.model import CONTRACTS, MANUFACTURING, SALES, WAREHOUSE, WEATHER
from contractflow.operators import audit, contracts, serving, telemetry
from contractflow.plans import batch
from contractflow.sources import csv, files

SALES_CSV = """receipt_id,product_id,sale_timestamp,units_sold,store_id
R1,art-1,2026-04-07 12:00:00,2,S1
R2,,2026-04-07 12:00:01,-1,S1
R1,art-3,2026-04-07 12:00:02,4,S2
,art-4,2026-04-07 12:00:03,5,S2
,art-4,2026-04-07 12:00:04,6,S2
R6,art-6,04/07/2026,seven,S3
R7,art-7,not a time,7,S3
"""


@pytest.fixture
def sales_csv(tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(SALES_CSV)
    return str(path)


def test_csv_scan_numbers_rows_in_file_order(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for part in range(3):
        lines = ["receipt_id,product_id,sale_timestamp,units_sold,store_id"]
        lines += [f"R{part * 40 + i},p,2026-04-07,{i},s" for i in range(40)]
        (folder / f"part{part}.csv").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")  # several splits per file
    try:
        frame = files.read_source_csv(spark, str(folder), SALES)
        assert frame.rdd.getNumPartitions() > 3
        found = {r["_row"]: r["receipt_id"] for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == {i + 1: f"R{i}" for i in range(120)}


def test_load_failures_are_one_failure_each(spark, tmp_path, storage, sales_csv):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    for path in (str(tmp_path / "missing.csv"), str(empty)):
        with pytest.raises(files.LoadError):
            files.read_source_csv(spark, path, SALES)
        report = batch.ingest_csv(spark, path, SALES, storage)
        assert (report.records_failed, report.records_ingested) == (1, 0)
    table = batch.ingest_all(
        spark, {WAREHOUSE: str(tmp_path / "missing.csv"), MANUFACTURING: str(empty), SALES: sales_csv}, storage)
    assert {r["source_id"]: r["records_failed"] for r in table.collect()} == {MANUFACTURING: 1, SALES: 0}


def test_sinks(spark, storage, sales_csv):
    report = batch.ingest_csv(spark, sales_csv, SALES, storage)
    assert (report.records_ingested, report.records_quarantined, report.records_duplicate) == (3, 2, 2)
    assert report.records_normalized == 7 and report.snapshot_count == 1 and report.file_count_per_partition >= 1

    good = spark.read.parquet(storage.good(SALES)).orderBy("receipt_id").collect()
    assert [r["receipt_id"] for r in good] == ["R1", "R2", "R7"]
    assert [r["units_sold"] for r in good] == [2.0, -1.0, 7.0]
    assert good[0]["product_id"] == "ART-1" and good[0]["_event_timestamp"] == "2026-04-07T12:00:00+00:00"
    assert good[0]["_operation_type"] == "SNAPSHOT" and good[0]["_dataset_id"] == "ds_sales_history"
    assert len({r["_event_id"] for r in good}) == 3

    refused = spark.read.parquet(storage.quarantine(SALES)).orderBy("product_id").collect()
    assert json.loads(refused[1]["_violations"]) == ["Field 'units_sold' expected int, got str (value='seven')."]
    assert refused[0]["_quarantine_reason"] == (
        "Required field 'receipt_id' is missing or null.; Field 'receipt_id' is NULL but not nullable.")
    assert refused[1]["units_sold"] == "seven" and "_event_id" not in refused[0].asDict()

    entries = {r["row"]: r for r in spark.read.json(storage.audit(SALES)).collect()}
    assert [entries[i]["status"] for i in range(1, 8)] == [
        "PASS", "PASS", "DUPLICATE", "QUARANTINE", "DUPLICATE", "QUARANTINE", "PASS"]
    assert [entries[i]["key"] for i in (1, 4)] == ["R1", "None"]


def test_reruns_give_the_same_rows(spark, storage, sales_csv):
    def ids():
        batch.ingest_csv(spark, sales_csv, SALES, storage)
        return sorted(r[0] for r in spark.read.parquet(storage.good(SALES)).select("_event_id").collect())
    assert ids() == ids()


def test_statuses_partition_the_input(spark, sales_csv):
    frame = files.read_source_csv(spark, sales_csv, SALES)
    judged = batch.judge(frame, SALES, typed_per_value=("units_sold",))
    counted = telemetry.job_counters(judged).first()
    whole = sum(counted[n] for n in ("records_ingested", "records_failed", "records_quarantined", "records_duplicate"))
    assert whole == frame.count() == 7


def test_audit_json_leaves_absent_fields_out(spark, sales_csv):
    judged = batch.judge(files.read_source_csv(spark, sales_csv, SALES), SALES, typed_per_value=("units_sold",))
    entries = sorted((json.loads(r[0]) for r in audit.audit_json(audit.audit_rows(judged)).collect()), key=lambda e: e["row"])
    assert entries[0] == {"row": 1, "key": "R1", "status": "PASS"}
    assert entries[2] == {"row": 3, "key": "R1", "status": "DUPLICATE"}
    assert entries[5] == {"row": 6, "key": "R6", "status": "QUARANTINE",
                          "violations": ["Field 'units_sold' expected int, got str (value='seven')."]}


def test_long_lists_are_cut_in_log_lines(spark):
    frame = spark.createDataFrame(
        [(None, None, "a", "b", 1)], "product_id string, article_id string, product_name string, color string, _row bigint")
    judged = batch.judge(frame, WAREHOUSE)
    line = audit.record_lines(judged, WAREHOUSE, CONTRACTS[WAREHOUSE]).first()["line"]
    assert line.startswith("[QUARANTINE] source=src_warehouse_master | row=1 | key=None | contract=contract_warehouse_v1 ")
    assert "... (+1 more violations)] | norm_changes=0" in line
    many = frame.withColumns({
        "product_id": F.lit("a"), "article_id": F.lit("b"), "production_batch_id": F.lit("c"), "timestamp": F.lit("2026-04-07")})
    line = audit.record_lines(batch.judge(many, WAREHOUSE), WAREHOUSE, CONTRACTS[WAREHOUSE]).first()["line"]
    assert line.endswith(" (+1 more)") and "norm_changes=4 | NORMALIZE" in line


def test_record_lines_are_written_on_request(spark, storage, sales_csv):
    frame = files.read_source_csv(spark, sales_csv, SALES)
    batch.ingest(frame, SALES, storage, typed_per_value=("units_sold",), record_lines=True)
    lines = [r["value"] for r in spark.read.text(storage.record_lines(SALES)).collect()]
    assert len(lines) == 7 and any(line.startswith("[DUPLICATE] source=src_sales_history | row=3 | key=R1") for line in lines)


def test_unreadable_source_does_not_stop_the_others(spark, tmp_path, storage, sales_csv, monkeypatch):
    real = batch.ingest

    def broken(df, source_id, *rest, **named):
        if source_id == WAREHOUSE:
            df = df.withColumn("product_id", F.raise_error(F.lit("unreadable")).cast("string"))
        return real(df, source_id, *rest, **named)

    monkeypatch.setattr(batch, "ingest", broken)
    table = batch.ingest_all(spark, {WAREHOUSE: sales_csv, SALES: sales_csv}, storage)
    assert {r["source_id"]: r["records_failed"] for r in table.collect()} == {WAREHOUSE: 1, SALES: 0}


def csv_rows(spark, tmp_path, text, **options):
    path = tmp_path / "odd.csv"
    path.write_text(text)
    frame = files.read_source_csv(spark, str(path), SALES, **options)
    return frame.columns, [r.asDict() for r in frame.orderBy("_row").collect()]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    names, rows = csv_rows(spark, tmp_path, "store_id,note,units_sold,receipt_id\nS1,hello,2,R1\nNA,,nan,\"R \"\"2\"\", x\"\n")
    assert names == ["receipt_id", "units_sold", "store_id", "note", "_malformed", "_row"]
    assert rows[0] == {"receipt_id": "R1", "units_sold": "2", "store_id": "S1", "note": "hello", "_malformed": None, "_row": 1}
    assert rows[1] == {"receipt_id": 'R "2", x', "units_sold": None, "store_id": None, "note": None, "_malformed": None, "_row": 2}


def test_csv_quoted_line_breaks(spark, tmp_path):
    head = "receipt_id,product_id,sale_timestamp,units_sold,store_id\n"
    _, rows = csv_rows(spark, tmp_path, head + '"R\n1",p,2026-04-07,1,s\nR2,p,2026-04-07,2,s\n', multi_line=True)
    assert [(r["receipt_id"], r["units_sold"], r["_row"]) for r in rows] == [("R\n1", "1", 1), ("R2", "2", 2)]


def test_rows_with_other_fields_than_the_header_are_quarantined(spark, tmp_path, storage):
    path = tmp_path / "torn.csv"
    path.write_text("receipt_id,product_id,sale_timestamp,units_sold,store_id\nR1,p,2026-04-07,1,s\nR2,p,2026-04-07\nR3,p,2026-04-07,1,s,more\n")
    report = batch.ingest_csv(spark, str(path), SALES, storage)
    assert (report.records_ingested, report.records_quarantined) == (1, 2)
    refused = spark.read.parquet(storage.quarantine(SALES)).collect()
    assert {r["_quarantine_reason"] for r in refused} == {contracts.MALFORMED_MESSAGE}


def test_files_with_different_headers_are_read_by_their_own(spark, tmp_path, storage):
    (tmp_path / "d").mkdir()
    whole = "receipt_id,product_id,sale_timestamp,units_sold,store_id"
    for name, head, row in (("a", whole, "R1,p,2026-04-07,1,s"), ("b", "store_id,product_id,sale_timestamp,units_sold,receipt_id", "s2,p,2026-04-07,2,R2"),
                            ("c", "receipt_id,units_sold,extra", "R3,3,e"), ("d", whole, "R4,p,2026-04-07")):
        (tmp_path / "d" / f"{name}.csv").write_text(f"{head}\n\n{row}\n")
    frame = files.read_source_csv(spark, str(tmp_path / "d"), SALES)
    assert frame.columns == ["receipt_id", "product_id", "sale_timestamp", "units_sold", "store_id", "extra", "_malformed", "_row"]
    assert [tuple(r) for r in frame.orderBy("_row").collect()] == [
        ("R1", "p", "2026-04-07", "1", "s", None, None, 1), ("R2", "p", "2026-04-07", "2", "s2", None, None, 2),
        ("R3", None, None, "3", None, "e", None, 3), ("R4", "p", "2026-04-07", None, None, None, "R4,p,2026-04-07", 4)]
    report = batch.ingest_csv(spark, str(tmp_path / "d"), SALES, storage)
    assert (report.records_ingested, report.records_quarantined) == (2, 2)


@pytest.mark.parametrize("size, sent", [("300b", csv.SPLITS_SENT), ("300b", 0), ("1m", csv.SPLITS_SENT)])
def test_quoted_line_breaks_across_splits(spark, tmp_path, monkeypatch, size, sent):
    """Values with line breaks, quotes and empty lines, longer than many splits, against a plain reader."""
    import csv as plain
    import random
    draw, folder = random.Random(size), tmp_path / "d"
    folder.mkdir()
    expected, names = [], ["receipt_id", "product_id", "sale_timestamp", "units_sold", "store_id"]
    for f in range(3):
        with open(folder / f"f{f}.csv", "w", newline="") as out:
            writer = plain.writer(out, lineterminator="\r\n" if f == 1 else "\n")
            writer.writerow(names)
            for i in range(15):
                row = [f"R{f}-{i}"] + ["".join(draw.choices('ab,"\n', [8, 8, 1, 1, 2], k=draw.choice([0, 3, 20, 200]))) + "." for _ in range(4)]
                writer.writerow(row)
                expected.append(tuple(row))
    monkeypatch.setattr(csv, "SPLITS_SENT", sent)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = files.read_source_csv(spark, str(folder), SALES, multi_line=True).orderBy("_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["_row"] for r in rows] == list(range(1, 46))
    assert [tuple(r[n] for n in names) for r in rows] == expected


def test_a_rerun_without_good_rows_leaves_none(spark, tmp_path, storage, sales_csv):
    batch.ingest_csv(spark, sales_csv, SALES, storage)
    path = tmp_path / "bad.csv"
    path.write_text(SALES_CSV.splitlines()[0] + "\n,p,2026-04-07,1,s\n")
    assert batch.ingest_csv(spark, str(path), SALES, storage).records_ingested == 0
    assert files.read_parquet_or_none(spark, storage.good(SALES)) is None


def test_rows_identified_by_columns_are_audited(spark, storage):
    frame = spark.createDataFrame([("r1", "p", "2026-04-07", 1, "s"), (None, "p", "2026-04-07", 1, "s")],
                                  "receipt_id string, product_id string, sale_timestamp string, units_sold bigint, store_id string")
    report = batch.ingest(frame, SALES, storage, identity=["receipt_id", "sale_timestamp"], record_lines=True)
    assert (report.records_ingested, report.records_quarantined) == (1, 1)
    assert sorted(r["status"] for r in spark.read.json(storage.audit(SALES)).collect()) == ["PASS", "QUARANTINE"]
    assert spark.read.text(storage.record_lines(SALES)).count() == 2


def test_all_slices_are_kept_in_few_files(spark, storage):
    frame = spark.range(1, 3001).select(
        F.concat(F.lit("R"), "id").alias("receipt_id"), F.lit("p").alias("product_id"), F.lit("2026-04-07").alias("sale_timestamp"),
        F.lit(1).alias("units_sold"), F.lit("s").alias("store_id"), F.col("id").alias("_row"))
    found = batch.ingest_slices(frame, SALES, storage, 10)
    assert found.count() == 300 and found.agg(F.sum("records_ingested")).first()[0] == 3000
    assert files.data_files(spark, storage.micro_batch(SALES)) <= 8


def test_slices(spark, storage, sales_csv):
    frame = files.read_source_csv(spark, sales_csv, SALES)
    found = batch.ingest_slices(frame, SALES, storage, 2, 3, ("units_sold",)).orderBy("batch_id").collect()
    assert [(r["records_ingested"], r["records_quarantined"], r["records_duplicate"]) for r in found] == [
        (2, 0, 0), (1, 1, 0), (0, 2, 0)]
    assert spark.read.parquet(storage.micro_batch(SALES)).count() == 3
    log = spark.read.json(storage.audit(SALES, "microbatch"))
    assert sorted((r["batch_id"], r["row"]) for r in log.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_pushed_records(spark, storage):
    frame = spark.createDataFrame([("r", "p", "t", 1, "s"), (None, "p", "t", 1, "s")],
                                  "receipt_id string, product_id string, sale_timestamp string, units_sold bigint, store_id string")
    for total in (1, 2):
        report = batch.push_ingest(frame, SALES, storage)
        assert (report.records_ingested, report.records_quarantined) == (1, 1)
        assert spark.read.parquet(storage.good(SALES, "pushed")).count() == total
    with pytest.raises(KeyError):
        batch.push_records(frame, "src_unknown")


def test_telemetry_row(spark):
    report = telemetry.JobReport("j", SALES, "a", "b", 2.123456, records_ingested=10, avg_ingestion_latency_sec=1.23456789)
    row = telemetry.telemetry_table(spark, [report]).first()
    assert (row["duration_seconds"], row["throughput_rec_sec"], row["processing_lag_sec"]) == (2.1235, 4.71, 2.1235)
    assert row["avg_ingestion_latency_sec"] == 1.234568
    assert telemetry.JobReport("j", SALES, "a", "b", 0.0, records_ingested=5).throughput == 0.0


def test_storage_summaries(spark, storage, sales_csv):
    batch.ingest_csv(spark, sales_csv, SALES, storage)
    found = {r["area"]: r for r in audit.storage_audit(spark, storage.areas()).collect()}
    assert set(found) == {"ingested", "quarantine", "detail_logs", "TOTAL"}
    assert found["TOTAL"]["files"] == sum(r["files"] for area, r in found.items() if area != "TOTAL")
    counted = audit.file_row_counts(spark, "ingested", storage.area("ingested")).collect()
    assert sum(r["rows"] for r in counted) == 3


def test_weather_payloads(spark, tmp_path, storage):
    path = tmp_path / "weather.json"
    path.write_text(
        '{"city":"Lahore","main":{"temp":25,"humidity":60},"weather":[{"description":"rain"}],"timestamp":"2026-04-05"}\n'
        '{"city":"Lahore","main":{"temp":20.5,"humidity":101},"weather":[],"timestamp":"2026-04-05"}\n')
    flat = files.read_weather_json(spark, str(path))
    judged = contracts.apply_contract(flat, CONTRACTS[WEATHER]).orderBy("humidity").collect()
    assert [r["_status"] for r in judged] == ["PASS", "QUARANTINE"]
    assert (judged[0]["temperature"], judged[0]["weather_description"]) == (25.0, "rain")
    assert len(judged[1]["_violations"]) == 3
    assert batch.ingest(flat, WEATHER, storage).records_ingested == 1
    entries = sorted((r["row"], r["key"], r["status"]) for r in spark.read.json(storage.audit(WEATHER)).collect())
    assert entries == [(1, "row_1", "PASS"), (2, "row_2", "QUARANTINE")]
    with pytest.raises(files.LoadError):
        files.read_weather_json(spark, str(tmp_path / "none.json"))


def test_landed_payloads_are_taken_once(spark, tmp_path, storage):
    """A ledger of files; lines that are no JSON; the full load takes the folder too."""
    line = '{"city":"Lahore","main":{"temp":%d,"humidity":60},"weather":[{"description":"rain"}],"timestamp":"2026-04-05"}\n'
    folder = tmp_path / "landed"
    assert [r.records_failed for r in batch.ingest_landed(spark, str(folder), storage)] == [1]
    folder.mkdir()
    (folder / "a.json").write_text(line % 20 + "torn {\n" + line % 21)
    assert [(r.records_ingested, r.records_quarantined) for r in batch.ingest_landed(spark, str(folder), storage)] == [(2, 1)]
    assert batch.ingest_landed(spark, str(folder), storage) == []
    (folder / "b.json").write_text(line % 22)
    (folder / "b2.json").write_text("torn\n")
    table = batch.ingest_all(spark, {WEATHER: str(folder)}, storage)
    assert [(r["source_id"], r["records_ingested"]) for r in table.collect()] == [(WEATHER, 1)]
    good = spark.read.parquet(storage.good(WEATHER))
    assert sorted((r["temperature"], r["landed"]) for r in good.collect()) == [(20.0, 0), (21.0, 0), (22.0, 1)]
    assert good.select("_event_id").distinct().count() == 3
    assert spark.read.parquet(storage.quarantine(WEATHER)).count() == 2


def test_a_failed_landing_is_repeated(spark, tmp_path, storage, monkeypatch):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "a.json").write_text('{"city":"Lahore","main":{"temp":20,"humidity":60},"weather":[{"description":"x"}],"timestamp":"t"}\n')

    def fail(*_):
        raise Py4JError("no audit today")

    with monkeypatch.context() as patch:
        patch.setattr(batch.audit, "audit_rows", fail)
        assert [r.records_failed for r in batch.ingest_landed(spark, str(folder), storage)] == [1]
    assert [r.records_ingested for r in batch.ingest_landed(spark, str(folder), storage)] == [1]
    assert spark.read.parquet(storage.good(WEATHER)).count() == 1


def test_first_wins_asks_for_a_row_order(spark):
    frame = spark.createDataFrame([("r", "p", "t", 1, "s")],
                                  "receipt_id string, product_id string, sale_timestamp string, units_sold bigint, store_id string")
    with pytest.raises(ValueError):
        batch.judge(frame, SALES)
    with pytest.raises(ValueError):
        batch.judge(frame.drop("receipt_id"), SALES)


def test_catalogues_and_lookups(spark):
    assert serving.source_catalogue(spark).count() == 6
    levels = {r["dataset_id"]: r["classification_level"] for r in serving.dataset_catalogue(spark).collect()}
    assert levels["ds_sales_history"] == "confidential" and levels["ds_weather_api"] == "public"
    jobs = spark.createDataFrame([("a", "running"), ("b", "failed")], "job_id string, status string")
    assert serving.require_job(jobs, "b").first()["status"] == "failed"
    with pytest.raises(KeyError):
        serving.require_job(jobs, "c")
    assert telemetry.job_metrics(jobs).first().asDict() == {"total_jobs": 2, "running_jobs": 1, "completed_jobs": 1}


def test_alerts_use_a_stock_column_where_there_is_one(spark):
    frame = spark.createDataFrame([("a", 5, 10), ("b", 20, 10), ("c", 5, None)],
                                  "product_id string, current_stock bigint, reorder_threshold bigint")
    assert [r["product_id"] for r in serving.low_stock_alerts(frame).collect()] == ["a"]
    bare = serving.low_stock_alerts(frame.select("product_id")).collect()
    assert {(r["current_stock"], r["reorder_threshold"]) for r in bare} == {(0, 100)} and len(bare) == 3


def test_torn_rows_are_quarantined_without_a_contract(spark):
    rows = spark.createDataFrame([("a", None), ("b", "b,c")], "x string, _malformed string")
    judged = contracts.apply_contract(rows, None)
    assert [(r["_status"], r["_violations"]) for r in judged.orderBy("x").collect()] == [
        ("PASS", []), ("QUARANTINE", [contracts.MALFORMED_MESSAGE])]


def kept_frames(monkeypatch):
    """What the CSV reader writes on its way, by label."""
    real, seen = csv._kept, {}
    monkeypatch.setattr(csv, "_kept", lambda frame, label: (seen.__setitem__(label, frame), real(frame, label))[1])
    return seen


def test_splits_are_counted_without_their_texts(spark, tmp_path, monkeypatch):
    """No sort of the lines, and one parse a record however many columns there are."""
    (tmp_path / "d").mkdir()
    for name, head, row in (("a", "receipt_id,store_id,units_sold", "R1,s,1"), ("b", "store_id,receipt_id", "s,R2")):
        (tmp_path / "d" / f"{name}.csv").write_text(f"\n{head}\n{row}\n")
    seen = kept_frames(monkeypatch)
    frame = files.read_source_csv(spark, str(tmp_path / "d"), SALES)
    assert "Sort" not in seen["sizes"]._jdf.queryExecution().executedPlan().toString()
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 2
    assert [(r["receipt_id"], r["store_id"], r["units_sold"], r["_row"]) for r in frame.orderBy("_row").collect()] == [
        ("R1", "s", "1", 1), ("R2", "s", None, 2)]


def test_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "many.csv").write_text("receipt_id,note\n" + "".join(f'R{i},"a\nb, ""{i}"""\n' for i in range(4000)))
    size, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), kept_frames(monkeypatch)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        frame = files.read_source_csv(spark, str(tmp_path / "many.csv"), SALES, multi_line=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert seen["measured"].rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert frame.select("_row", "receipt_id", "note").orderBy("_row").collect() == [
        (i + 1, f"R{i}", f'a\nb, "{i}"') for i in range(4000)]
