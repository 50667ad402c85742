"""Plans of reports over stored receipts, and the table that follows a receipt tree."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from vigilake.operators import reports
from vigilake.plans import catalog, receipts
from vigilake.sources import files
from vigilake.streaming import jobs

SF = "/root/testdata/sf0.001"
READERS = (
    "receipt_count", "report_by_day", "report_by_class", "report_by_verdict", "receipts_touching_class", "receipts_having_class", "enforced_blocks",
    "prune_candidates", "prune_by_age", "prune_emptied_days", "resource_lookup", "retention_listing", "siem_rows", "receipt_sql",
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", READERS)
def test_reports_only_read_the_store(spark, name):
    text = plan(catalog.all_queries()[name](spark, SF))
    assert len(re.findall("FileScan parquet", text)) == 1 and "Generate inline" not in text
    # No pattern is searched and no receipt hashed again; only a report's own columns are hashed for the comparison.
    hashes = text.count("sha2(")
    assert "rlike" not in text.lower() and "regexp" not in text and hashes <= 2
    if name not in ("receipts_touching_class", "enforced_blocks"):
        assert not hashes


def test_pruning_reads_partitions(spark):
    stored = receipts.stored(spark, SF)
    day = F.lit("2025-02-03").cast("date")
    aged, emptied = plan(reports.older_than(stored, day, 30)), plan(reports.emptied_days(stored, day, 30))
    assert re.search(r"PartitionFilters: \[[^\]]*day", aged) and re.search(r"PartitionFilters: \[[^\]]*held", aged)
    assert re.search(r"PartitionFilters: \[[^\]]*day", emptied) and re.search(r"ReadSchema: struct<>", emptied)


def test_classes_read_only_their_names(spark):
    text = plan(reports.by_class(receipts.stored(spark, SF)))
    assert re.search(r"ReadSchema: struct<receipt:struct<data_classes_touched:array<struct<class:string>>>>", text)


def test_store_keeps_unreadable_receipts_and_reads_files_once(spark, tmp_path):
    tree, table, name = str(tmp_path / "tree"), str(tmp_path / "table"), f"store-{uuid.uuid4().hex}"
    raw = receipts.built(spark, SF).limit(6).select("raw").collect()
    for part in (raw[:3], raw[3:]):
        lines = [r.raw for r in part] + ["{cut off"]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(tree)
        jobs.store_receipts(spark, tree, table, name, once=True).awaitTermination()
    stored = files.receipt_table(spark, table)
    assert sorted((r.status, r.day is None) for r in stored.collect()) == [("FAIL", True)] * 2 + [("OK", False)] * 6


def test_parents_are_looked_up_in_the_store(spark):
    text = plan(catalog.all_queries()["parent_lookup"](spark, SF))
    assert len(re.findall("FileScan parquet", text)) <= 4 and "Python" not in text and "events.parquet" not in text


@pytest.mark.parametrize("name", ["strip_blocks", "purge_marked"])
def test_history_reads_marked_turns_once_written(spark, name):
    text = plan(catalog.all_queries()[name](spark, SF))
    assert "conversations.parquet" not in text and len(re.findall("FileScan parquet", text)) <= 2
