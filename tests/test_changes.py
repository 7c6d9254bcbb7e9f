"""Change feed, extraction and checkpoints."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from contractflow.model import SALES
from contractflow.operators import cdc
from contractflow.plans import batch, changes
from contractflow.sources.checkpoints import load_position, save_position

START = "2026-04-05T00:00:00+00:00"


def sales_rows(spark, n, first=1):
    return spark.range(first, first + n).select(
        F.concat(F.lit("R"), "id").alias("receipt_id"), F.lit("P").alias("product_id"),
        F.lit(START).alias("sale_timestamp"), (F.col("id") % 9 + 1).alias("units_sold"), F.lit("S").alias("store_id"),
        F.col("id").alias("_row"))


def feed(spark, n, offset=0, scenario="steady"):
    rate, _ = changes.SCENARIOS[scenario]
    return cdc.change_feed(sales_rows(spark, n), sales_rows(spark, 50), SALES, START, rate, scenario, offset)


def test_operation_shares_and_targets(spark):
    rows = feed(spark, 5000).collect()
    share = {op: sum(r["_operation_type"] == op for r in rows) / len(rows) for op in ("INSERT", "UPDATE", "DELETE")}
    assert abs(share["INSERT"] - 0.6) < 0.03 and abs(share["UPDATE"] - 0.3) < 0.03 and abs(share["DELETE"] - 0.1) < 0.02
    assert sorted(r["_log_offset"] for r in rows) == list(range(5000))
    touched = {r["receipt_id"] for r in rows if r["_operation_type"] != "INSERT"}
    assert touched == {f"R{i}" for i in range(1, 51)}
    for r in rows:
        base = int(r["receipt_id"][1:]) % 9 + 1
        if r["_operation_type"] == "UPDATE":
            assert round(base * 0.8, 2) <= r["units_sold"] <= round(base * 1.2, 2)
            assert r["_updated_at"] == r["_ingestion_timestamp"] and r["_deleted_at"] is None
        else:
            assert r["units_sold"] == base


def test_new_envelope_wins_over_the_ingested_one(spark):
    judged = batch.judge(sales_rows(spark, 50), SALES)
    ingested = batch.good_rows(judged, SALES, START, also=("_row",))
    log = cdc.change_feed(sales_rows(spark, 200), ingested, SALES, START, 10.0)
    assert {r[0] for r in log.select("_operation_type").distinct().collect()} == {"INSERT", "UPDATE", "DELETE"}
    assert log.columns.count("_event_id") == 1


def test_nothing_existing_means_inserts_only(spark):
    for existing in (None, sales_rows(spark, 0)):
        log = cdc.change_feed(sales_rows(spark, 100), existing, SALES, START, 10.0)
        assert cdc.operation_counts(log).collect() == [("INSERT", 100)]


def literal_log(spark, rows):
    return spark.createDataFrame(rows, "_log_offset bigint, _operation_type string, _event_id string, _ingestion_timestamp string")


def test_literal_extractions(spark):
    stamps = ["2026-04-05T00:00:00+00:00", "2026-04-05T00:00:00.000001+00:00", "2026-04-05T00:00:01+00:00"]
    log = literal_log(spark, [
        (0, "INSERT", "a", stamps[0]), (1, "UPDATE", "b", stamps[0]), (2, "UPDATE", "b", stamps[1]),
        (3, "DELETE", "c", stamps[1]), (4, "INSERT", "d", stamps[2]), (5, "INSERT", "e", stamps[2])])

    def offsets(frame):
        return sorted(r["_log_offset"] for r in frame.collect())

    assert offsets(cdc.after_offset(log, 2)) == [3, 4, 5]
    assert offsets(cdc.after_offset(log, None)) == [0, 1, 2, 3, 4, 5]
    assert offsets(cdc.triggered(log)) == [1, 3]
    assert offsets(cdc.after_watermark(log, stamps[0])) == [2, 3, 4, 5]
    assert offsets(cdc.after_watermark(log, None)) == [0, 1, 2, 3, 4, 5]


def test_filters_reach_the_scan(spark, storage):
    changes.write_change_log(feed(spark, 300), storage, SALES, "steady")
    log = spark.read.parquet(storage.change_log(SALES, "steady"))
    for found in (cdc.after_offset(log, 100), cdc.after_watermark(log, START)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull" in plan and "GreaterThan(" in plan


@pytest.mark.parametrize("extract, strategy", [
    (changes.extract_by_log, "log"), (changes.extract_by_timestamp, "ts")])
def test_two_runs_over_a_growing_log_equal_one(spark, storage, extract, strategy):
    changes.write_change_log(feed(spark, 120), storage, SALES, "steady")
    assert extract(spark, storage, SALES, "steady").records_ingested == 120
    assert extract(spark, storage, SALES, "steady").records_ingested == 0
    changes.write_change_log(feed(spark, 80, offset=120), storage, SALES, "steady")
    assert extract(spark, storage, SALES, "steady").records_ingested == 80
    found = changes.read_extracted(spark, storage, SALES, strategy, "steady")
    assert sorted(r["_log_offset"] for r in found.collect()) == list(range(200))


@pytest.mark.parametrize("extract, strategy", [
    (changes.extract_by_log, "log"), (changes.extract_by_timestamp, "ts")])
def test_two_runs_numbered_from_one_are_both_found(spark, storage, extract, strategy):
    later = cdc.change_feed(sales_rows(spark, 100), sales_rows(spark, 50), SALES, "2026-04-06T00:00:00+00:00", 10.0)
    changes.write_change_log(feed(spark, 100), storage, SALES, "steady", "one")
    assert extract(spark, storage, SALES, "steady").records_ingested == 100
    changes.write_change_log(later, storage, SALES, "steady", "two")
    assert extract(spark, storage, SALES, "steady").records_ingested == 100
    found = changes.read_extracted(spark, storage, SALES, strategy, "steady")
    assert sorted(r["_log_offset"] for r in found.collect()) == list(range(200))
    assert found.select("_event_id").distinct().count() == 200
    changed = changes.read_change_log(spark, storage, SALES, "steady").where("_operation_type <> 'INSERT'").count()
    assert changes.extract_by_trigger(spark, storage, SALES, "steady").records_ingested == changed


def test_a_repeated_run_replaces_itself(spark, storage):
    later = cdc.change_feed(sales_rows(spark, 30), sales_rows(spark, 50), SALES, "2026-04-06T00:00:00+00:00", 10.0)
    for run in ("one", "one"):
        changes.write_change_log(feed(spark, 40), storage, SALES, "steady", run)
    changes.write_change_log(later, storage, SALES, "steady", "two")
    changes.write_change_log(feed(spark, 40), storage, SALES, "steady", "one")
    log = changes.read_change_log(spark, storage, SALES, "steady")
    assert sorted(r["_log_offset"] for r in log.collect()) == list(range(70))
    with pytest.raises(ValueError):
        changes.write_change_log(feed(spark, 5), storage, SALES, "steady", "early")


def test_gaps_in_the_existing_rows_fail(spark):
    with pytest.raises(Exception, match="without gaps"):
        cdc.change_feed(sales_rows(spark, 200), sales_rows(spark, 50).where("_row % 2 = 0"), SALES, START, 10.0).collect()


def test_scenarios_have_their_own_position(spark, storage):
    changes.write_change_log(feed(spark, 30), storage, SALES, "steady")
    changes.write_change_log(feed(spark, 40, scenario="burst"), storage, SALES, "burst")
    assert changes.extract_by_log(spark, storage, SALES, "steady").records_ingested == 30
    assert changes.extract_by_log(spark, storage, SALES, "burst").records_ingested == 40


def test_no_commit_without_a_write(spark, storage, monkeypatch):
    changes.write_change_log(feed(spark, 50), storage, SALES, "steady")
    real = changes._write_chunk

    def fails_after_writing(found, path, first, last):
        real(found, path, first, last)
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(changes, "_write_chunk", fails_after_writing)
    with pytest.raises(RuntimeError):
        changes.extract_by_log(spark, storage, SALES, "steady")
    assert load_position(spark, storage.checkpoint("log_based", SALES, "steady")) is None
    monkeypatch.setattr(changes, "_write_chunk", real)
    changes.write_change_log(feed(spark, 10, offset=50), storage, SALES, "steady")
    assert changes.extract_by_log(spark, storage, SALES, "steady").records_ingested == 60
    assert changes.read_extracted(spark, storage, SALES, "log", "steady").count() == 60


def test_trigger_extraction_reads_the_whole_log(spark, storage):
    changes.write_change_log(feed(spark, 200), storage, SALES, "steady")
    first = changes.extract_by_trigger(spark, storage, SALES, "steady").records_ingested
    assert first == changes.extract_by_trigger(spark, storage, SALES, "steady").records_ingested > 0


def test_missing_log_ends_quietly(spark, storage):
    for extract in (changes.extract_by_log, changes.extract_by_trigger, changes.extract_by_timestamp):
        assert extract(spark, storage, SALES, "steady").records_ingested == 0


def test_checkpoint_round_trip(spark, storage):
    path = storage.checkpoint("log_based", SALES, "steady")
    assert load_position(spark, path) is None
    for position in ("9", "10", "200"):
        save_position(spark, path, position)
        assert load_position(spark, path) == position


def test_snapshot_difference(spark):
    """Updates, equal rows, repeated keys, rows without a key, against a comparison of multisets by hand."""
    import random
    from collections import Counter
    draw = random.Random(5)
    names = "receipt_id string, product_id string, units_sold bigint"

    def rows():
        return [(draw.choice([None, *[f"R{i}" for i in range(40)]]), draw.choice("PQ"), draw.choice([None, 1, 2])) for _ in range(120)]

    old, new = rows(), rows()
    found = cdc.snapshot_changes(spark.createDataFrame(old, names), spark.createDataFrame(new, names), "receipt_id").collect()
    less, more = Counter(old) - Counter(new), Counter(new) - Counter(old)
    expected = Counter()
    for key in {r[0] for r in old + new}:
        gone, come = ([r for r in c.elements() if r[0] == key] for c in (less, more))
        if key is not None and len(gone) == len(come) == 1:
            expected[("UPDATE", *come[0])] += 1
        else:
            expected.update(("DELETE", *r) for r in gone)
            expected.update(("INSERT", *r) for r in come)
    assert Counter((r["_op"], r["receipt_id"], r["product_id"], r["units_sold"]) for r in found) == expected
    assert len({r["_digest"] for r in found}) == len(found)


def snapshot(spark, n, changed=0, gone=0):
    return sales_rows(spark, n - gone, 1 + gone).withColumn(
        "units_sold", F.when(F.col("_row") > n - changed, 99).otherwise(F.col("units_sold")))


def test_capture_job(spark, storage):
    report = changes.capture_changes(storage, SALES, snapshot(spark, 100), snapshot(spark, 120, 30, 10), "receipt_id", "burst", START, "r1")
    log = changes.read_change_log(spark, storage, SALES, "burst")
    counts = {r["_operation_type"]: r["events"] for r in cdc.operation_counts(log).collect()}
    assert counts == {"INSERT": 20, "UPDATE": 10, "DELETE": 10} and report.records_ingested == 40
    assert sorted(r[0] for r in log.select("_log_offset").collect()) == list(range(40))
    assert "Exchange rangepartitioning" not in plan_of(cdc.dense_offsets(cdc.snapshot_changes(snapshot(spark, 9), snapshot(spark, 8), "receipt_id")))


def test_overlapping_writers_lose_nothing(spark, storage):
    """Two runs claim at the same time; a repeated run that has grown doesn't reach into the next one."""
    frames = [feed(spark, n, scenario="burst") for n in (30, 40)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda x: changes.write_change_log(x[1], storage, SALES, "burst", f"w{x[0]}"), enumerate(frames)))
    offsets = sorted(r[0] for r in changes.read_change_log(spark, storage, SALES, "burst").select("_log_offset").collect())
    assert offsets == list(range(70))
    changes.write_change_log(feed(spark, 45, scenario="burst"), storage, SALES, "burst", "w0")
    offsets = sorted(r[0] for r in changes.read_change_log(spark, storage, SALES, "burst").select("_log_offset").collect())
    assert len(offsets) == len(set(offsets)) == 85 and max(offsets) == 114


def test_chunked_extraction_resumes_where_it_failed(spark, storage, monkeypatch):
    changes.write_change_log(feed(spark, 50, scenario="burst"), storage, SALES, "burst", "one")
    written, whole = [], changes._write_chunk

    def failing(found, path, first, last):
        written.append(first)
        if written == [0, 10, 20]:
            raise OSError("lost")
        return whole(found, path, first, last)

    monkeypatch.setattr(changes, "_write_chunk", failing)
    with pytest.raises(OSError):
        changes.extract_by_log(spark, storage, SALES, "burst", step=10)
    assert changes.read_extracted(spark, storage, SALES, "log", "burst").count() == 20
    assert changes.extract_by_log(spark, storage, SALES, "burst", step=10).records_ingested == 30
    assert written == [0, 10, 20, 20, 30, 40]
    found = changes.read_extracted(spark, storage, SALES, "log", "burst")
    assert sorted(r[0] for r in found.select("_log_offset").collect()) == list(range(50))
    assert load_position(spark, storage.checkpoint("log_based", SALES, "burst")) == "49"


def test_many_chunks_are_written_by_few_jobs(spark, storage, monkeypatch):
    """Chunks cost no job each; missing offsets make no chunk, and unlisted chunks aren't read."""
    whole = feed(spark, 400, scenario="burst")
    changes.write_change_log(whole.where("_log_offset NOT BETWEEN 100 AND 129"), storage, SALES, "burst", "one")
    spark.sparkContext.setJobGroup("many-chunks", "")
    monkeypatch.setattr(changes, "WAVE", 200)
    report = changes.extract_by_log(spark, storage, SALES, "burst", step=10)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-chunks"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert report.records_ingested == 370 and jobs < 30
    found = changes.read_extracted(spark, storage, SALES, "log", "burst")
    assert sorted(r[0] for r in found.select("_log_offset").collect()) == [*range(100), *range(130, 400)]
    path = storage.extracted(SALES, "log", "burst")
    assert [int(n) for n in changes._names(spark, f"{path}/_manifest") if n[0] != "."] == [*range(0, 100, 10), *range(130, 400, 10)]


def test_a_feed_compares_its_states_once(spark):
    """What reads a feed again, as a job does that counts, writes and extracts it, shuffles no state again."""
    found = cdc.snapshot_feed(snapshot(spark, 300), snapshot(spark, 400, 90, 10), "receipt_id", SALES, START, 10.0)
    plan = plan_of(found)
    assert "hashpartitioning(receipt_id" not in plan and "hashpartitioning(_part" in plan
    rows = found.select("_log_offset", "_event_id", "receipt_id").collect()
    assert sorted(r["_log_offset"] for r in rows) == list(range(110))
    assert {tuple(r) for r in found.select("_log_offset", "_event_id", "receipt_id").collect()} == {tuple(r) for r in rows}


def test_dense_offsets_follow_the_digests(spark):
    digests = [f"{(i * 2654435761) % (1 << 32):08x}" for i in range(3000)]
    found = cdc.dense_offsets(spark.createDataFrame([(d, d) for d in digests], "_digest string, name string").repartition(7), first_offset=5)
    assert [r["name"] for r in found.orderBy("_log_offset").collect()] == sorted(digests)
    assert sorted(r["_log_offset"] for r in found.collect()) == list(range(5, 3005))
