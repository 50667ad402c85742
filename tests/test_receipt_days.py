"""Receipts by day: files follow the days, not days times tasks."""

from pathlib import Path

from pyspark.sql import functions as F

from vigilake import schemas
from vigilake.sinks import files as sinks
from vigilake.sources import files


def receipts(spark):
    """400 receipts of 10 days and one without a day, every day in every one of 16 tasks."""
    rows = spark.range(0, 400, 1, 16)
    day = F.when(F.col("id") < 399, F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 10).cast("int")))
    return rows.select(F.lit(None).cast(schemas.RECEIPT).alias("receipt"), F.col("id").cast("string").alias("raw"), day.alias("day"))


def test_a_day_is_written_by_one_task(spark, tmp_path):
    made = receipts(spark)
    sinks.write_receipt_table(made, str(tmp_path / "table"))
    sinks.write_receipts(made, str(tmp_path / "lines"))
    for form in ("table", "lines"):
        assert len(list((tmp_path / form).rglob("part-*"))) == 11
    kept = files.receipt_table(spark, str(tmp_path / "table"))
    expected = sorted((r.raw, str(r.day), False) for r in made.collect())
    assert sorted((r.raw, str(r.day), r.held) for r in kept.collect()) == expected
    assert files.receipt_lines(spark, str(tmp_path / "lines")).count() == 400


def test_the_table_is_listed_once_and_pruned_by_day(spark, tmp_path):
    sinks.write_receipt_table(receipts(spark), str(tmp_path))
    table = files.receipt_table(spark, str(tmp_path))
    assert table.columns == ["receipt", "raw", "day", "held"] and [table.schema[c].dataType.simpleString() for c in ("day", "held")] == ["date", "boolean"]
    plan = table.where("day < '2025-01-03' and not held").select("raw")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
