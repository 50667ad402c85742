"""No row is lost, and costs do not grow with the square of a row's size."""

import time

import pytest
from pyspark.sql import functions as F

from vigilake.functions.spread import prefix_sum, salted_lookup
from vigilake.functions.text import spans
from vigilake.operators import history
from vigilake.sources import files


def test_turns_without_a_key_stay(spark):
    turns = [(1, 1, "user", "a"), (None, 1, "user", "b"), (2, None, "user", "c")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("is_block", F.lit(False))
    for clean in (history.strip_blocks, history.purge_marked):
        assert sorted(r.text for r in clean(df).collect()) == ["a", "b", "c"]
    summed = prefix_sum(df, ["conv_id"], F.col("turn"), ["turn"], "n")
    assert sorted((r.text, r.n) for r in summed.collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_a_broken_run_dump_is_named(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"run_id": "1"}]')
    assert files.run_dumps(spark, str(tmp_path)).count() == 1
    (tmp_path / "cut.json").write_text('[{"run_id": "1"')
    with pytest.raises(Exception, match="not a run dump: .*cut.json"):
        files.run_dumps(spark, str(tmp_path)).collect()


def test_more_hot_keys_than_any_limit(spark):
    left = spark.range(9_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 1_500).alias("k"))
    right = spark.range(1_400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = sorted((r.id, r.v or -1) for r in salted_lookup(left, right, "k", how, "id", min_rows=2).collect())
        assert got == sorted((r.id, r.v or -1) for r in left.join(right, "k", how).collect())


def test_spans_of_dense_texts(spark):
    def seconds(hits):
        text = spark.createDataFrame([("ab " * hits,)], "t string")
        began = time.perf_counter()
        found = text.select(spans(F.col("t"), "ab").alias("s")).first().s
        assert len(found) == hits and found[-1].start == 3 * (hits - 1)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(24_000) < 8 * seconds(6_000) + 2
