"""Skew helpers against plain models, and the shape of plans."""

import random

from pyspark.sql import functions as F

from vigilake.functions.once import with_once
from vigilake.functions.spread import hot_keys, prefix_sum, salted_lookup, spread
from vigilake.operators.policies import PolicySet
from vigilake.plans import base, evaluation


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_sum_equals_a_running_sum(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), i, rng.randrange(-3, 4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    got = {(r.k, r.i): r.s for r in prefix_sum(df, ["k"], F.floor(F.col("i") / 50), ["i"], "s", F.col("v")).collect()}
    sums = {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        assert got[k, i] == sums[k]


def test_salted_lookup_equals_a_join(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + [None, f"k{i % 40}", "none"])) for i in range(3000)]
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(30)], "k string, v string")
    known = dict(r for r in right.collect())
    assert hot_keys(left, "k", 100).count() >= 1
    for how in ("left", "inner"):
        got = sorted((r.id, r.v) for r in salted_lookup(left, right, "k", how, "id", min_rows=100).collect())
        expected = [(i, known.get(k)) for i, k in rows if how == "left" or k in known]
        assert got == sorted(expected)


def test_spread_leaves_large_inputs_alone(spark):
    wide = spark.range(0, 1000, 1, 64)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 10, 1, 2), "id").rdd.getNumPartitions() == 16


def test_costly_columns_run_once_and_other_filters_reach_the_scan(spark):
    docs = base.table(spark, "/root/testdata/sf0.001", "documents")
    once = with_once(docs.select("doc_id", "lang", "text"), {"h": F.regexp_extract_all("text", F.lit("(z+)"), F.lit(0))})
    plan = plan_of(once.where("size(h) > 1 and lang = 'en'").select("doc_id", F.transform("h", lambda x: F.size("h"))))
    assert plan.count("regexp_extract_all") == 1
    assert "EqualTo(lang,en)" in plan


def test_evaluation_is_narrow(spark):
    docs = base.table(spark, "/root/testdata/sf0.001", "documents")
    tagged = evaluation.classify.with_hits(docs, "text", [base.PII], "response")
    done = evaluation.evaluate(
        tagged, base.DOC_POLICIES, text="text", hits="hits", direction="response", clock=base.CLOCK, key="doc_id"
    ).where("evaluation.final_verdict = 'redacted'")
    plan = plan_of(done)
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    assert plan.count("regexp_extract_all") == 3
    assert PolicySet((), "empty").policies == ()
