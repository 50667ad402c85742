import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vigilake.operators.classify import HIT
from vigilake.operators.evaluate import FAIL_CLOSED_MESSAGE, OP, Clock, evaluate, redact_spans
from vigilake.operators.exchange import evaluate_exchanges
from vigilake.operators.policies import Policy, PolicySet
from vigilake.operators.taxonomy import taxonomy

CLOCK = Clock(datetime.datetime(2024, 5, 6, 7, 8, 9))
TEXT = "abcdefghijklmnopqrst"


def rule(policy_id, verdict="block", classes=("n:a",), mode="any_of", direction="prompt", destination="any", **more):
    config = {"block": {"user_message": f"stop {policy_id}"}, "redact": {"redact_with": "<{class}>"}, "alert": {}}[verdict]
    return Policy(policy_id, "1", direction, destination, mode, classes, verdict, **{**config, **more})


def run(spark, rules, hits=(), error=None, destination="external_vendor", location="prompt", merge=False):
    found = [(c, s, e, TEXT[s:e], location, i) for i, (c, s, e) in enumerate(hits)]
    df = spark.createDataFrame([(1, TEXT, found)], f"id int, text string, hits array<{HIT}>")
    done = evaluate(
        df, PolicySet(tuple(rules), "v"), text="text", hits="hits", direction="prompt", clock=CLOCK, key="id",
        destination=destination, error=None if error is None else F.lit(error), merge_overlaps=merge,
    )
    return done.first().evaluation


A, B = ("n:a", 2, 5), ("n:b", 8, 10)


@pytest.mark.parametrize(
    ("rules", "hits", "destination", "location"),
    [
        ([], [A], "external_vendor", "prompt"),
        ([rule("r_x")], [B], "external_vendor", "prompt"),
        ([rule("r_x", direction="response")], [A], "external_vendor", "prompt"),
        ([rule("r_x", destination="internal")], [A], "external_vendor", "prompt"),
        ([rule("r_x", mode="all_of", classes=("n:a", "n:b"))], [A], "external_vendor", "prompt"),
        ([rule("r_x")], [A], "external_vendor", "response"),
    ],
)
def test_nothing_fires(spark, rules, hits, destination, location):
    e = run(spark, rules, hits, destination=destination, location=location)
    assert (e.final_verdict, e.mutated_text, e.block_user_message) == ("allowed", TEXT, None)
    (d,) = e.decisions
    assert (d.policy_id, d.verdict, d.enforcement_mode, d.would_have_blocked) == (None, "allowed", "enforced", None)
    assert d.evaluated_at == "2024-05-06T07:08:09Z" and d.policy_set_version == "v"


def test_block_nulls_the_text_and_takes_the_first_message(spark):
    e = run(spark, [rule("r_b"), rule("r_a"), rule("r_c", "alert")], [A])
    assert (e.final_verdict, e.mutated_text, e.block_user_message) == ("blocked", None, "stop r_a")
    assert [d.policy_id for d in e.decisions] == ["r_a", "r_b", "r_c"]


def test_redaction_and_evidence(spark):
    e = run(spark, [rule("r_a", "redact", ("n:a", "n:b"), redact_with="[{class}]")], [B, A])
    assert e.mutated_text == "ab[n:a]fgh[n:b]klmnopqrst"
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    assert [tuple(r) for r in e.decisions[0].redactions_applied] == [
        ("prompt", sha("cde"), sha("[n:a]")), ("prompt", sha("ij"), sha("[n:b]"))
    ]
    narrowed = run(spark, [rule("r_a", "redact", ("n:a", "n:b"), classes_to_redact=("n:b",))], [A, B])
    assert narrowed.mutated_text == "abcdefgh<n:b>klmnopqrst"


def test_inner_span_fires_without_evidence(spark):
    outer, inner, partly = ("n:a", 2, 8), ("n:b", 3, 5), ("n:b", 6, 11)
    rules = [rule("r_a", "redact"), rule("r_b", "redact", ("n:b",))]
    e = run(spark, rules, [outer, inner])
    assert e.mutated_text == "ab<n:a>ijklmnopqrst"
    assert [len(d.redactions_applied) for d in e.decisions] == [1, 0]
    assert run(spark, rules, [outer, partly]).mutated_text == "ab<n:a>ijklmnopqrst"
    assert run(spark, rules, [outer, partly], merge=True).mutated_text == "ab<n:a>lmnopqrst"


def test_precedence(spark):
    redact, alert, block = rule("r_r", "redact"), rule("r_s", "alert"), rule("r_t")
    blocked = run(spark, [redact, alert, block], [A])
    assert blocked.final_verdict == "blocked" and not blocked.decisions[0].redactions_applied
    alerted = run(spark, [redact, alert], [A])
    # An alert outranks a redaction, and then the text stays as it was.
    assert (alerted.final_verdict, alerted.mutated_text) == ("alerted", TEXT)
    record = alerted.decisions[1].alert_id
    assert record.id.startswith("alert_2024-05-06_07-08-09_") and len(record.id) == 50
    assert (record.delivery_status, record.delivered_at) == ("pending", None)


def test_audit_only(spark):
    rules = [rule("r_a", audit_only=True), rule("r_b", "redact", audit_only=True)]
    e = run(spark, rules, [A])
    assert (e.final_verdict, e.mutated_text) == ("allowed", TEXT)
    assert [(d.enforcement_mode, d.would_have_blocked) for d in e.decisions] == [("audit_only", True), ("audit_only", False)]
    mixed = run(spark, [*rules, rule("r_c", "redact")], [A])
    assert mixed.final_verdict == "redacted" and mixed.decisions[2].would_have_blocked is None


def test_classifier_error(spark):
    opened, closed = rule("r_a", "redact"), rule("r_c", on_classifier_error="fail_closed")
    e = run(spark, [opened], [A], error="classifier_timeout")
    assert (e.final_verdict, e.mutated_text) == ("allowed", TEXT)
    e = run(spark, [opened, closed], error="classifier_timeout")
    assert (e.final_verdict, e.mutated_text, e.block_user_message) == ("blocked", None, "stop r_c")
    assert [(d.verdict, d.would_have_blocked, d.enforcement_mode) for d in e.decisions] == [
        ("allowed", False, "error"), ("blocked", True, "error")
    ]
    assert all(d.error_reason == "classifier_timeout" and d.matched_classes == [] for d in e.decisions)
    # Without a message of its own, and although it is audit-only, a fail-closed rule blocks.
    silent = rule("r_x", "redact", on_classifier_error="fail_closed", audit_only=True)
    assert run(spark, [silent], error="classifier_exception").block_user_message == FAIL_CLOSED_MESSAGE
    (d,) = run(spark, [], error="taxonomy_load_error").decisions
    assert (d.policy_id, d.verdict, d.enforcement_mode, d.would_have_blocked) == (None, "allowed", "error", False)


def python_redact(text, ops):
    out, cursor, applied = "", 0, []
    for start, pid, _, end, _, template in sorted(ops, key=lambda o: o[:3]):
        if start >= cursor:
            out, cursor = out + text[cursor:start] + template, end
            applied.append(pid)
    return out + text[cursor:], applied


def test_overlaps_equal_a_python_model(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        text = "".join(rng.choice("abé\U0001f600 z") for _ in range(30))
        ops = []
        for n in range(rng.randrange(8)):
            start = rng.randrange(29)
            end = rng.randrange(start + 1, 31)
            ops.append((start, rng.choice(["p1", "p2", "p3"]), n, end, text[start:end], rng.choice(["#", "<x>", "[é]"])))
        rows.append((i, text, ops))
    df = spark.createDataFrame(rows, f"id int, text string, ops array<{OP}>")
    done = df.select("id", redact_spans(F.col("text"), F.col("ops"), "prompt").alias("r")).collect()
    for row in done:
        text, applied = python_redact(rows[row.id][1], rows[row.id][2])
        assert (row.r.text, [a.policy_id for a in row.r.applied]) == (text, applied)


def test_blocked_prompt_stops_the_exchange(spark):
    words = taxonomy("n", [{"class": "a", "recognizer": "keyword_list", "pattern": ["stop"]}, {"class": "b", "recognizer": "keyword_list", "pattern": ["hide"]}])
    rules = PolicySet((rule("p_a"), rule("p_b", "redact", ("n:b",)), rule("r_b", "redact", ("n:b",), direction="response")), "v")
    rows = [(1, "stop it", "hide"), (2, "hide it", "hide that"), (3, "fine", None), (4, "hide", "")]
    df = spark.createDataFrame(rows, "exchange_id int, prompt string, response string")

    def run_mode(mode):
        return {r.exchange_id: r for r in evaluate_exchanges(df, [words], rules, CLOCK, mode=mode).collect()}

    chat, passed = run_mode("chat"), run_mode("passthrough")
    assert (chat[1].verdict, chat[1].final_response, chat[1].response_eval, len(chat[1].all_hits)) == ("blocked", "", None, 1)
    assert (chat[2].final_prompt, chat[2].final_response) == ("<n:b> it", "<n:b> that")
    assert (passed[2].final_prompt, passed[2].verdict) == ("hide it", "redacted")
    assert (chat[3].final_response, len(chat[3].decisions)) == ("", 1)
    assert (chat[4].response_eval.final_verdict, chat[4].final_response) == ("allowed", "")
    with pytest.raises(ValueError):
        evaluate_exchanges(df, [words], rules, CLOCK, mode="other")
