import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vigilake.operators import receipts, reports, validate
from vigilake.operators.evaluate import Clock
from vigilake.operators.exchange import evaluate_exchanges
from vigilake.operators.policies import Policy, PolicySet
from vigilake.operators.taxonomy import taxonomy
from vigilake.sinks import files as sinks
from vigilake.sources import files

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9, 120)
CLOCK = Clock(NOW)
TEXTS = [
    "plain", 'quote " and \\ and /', "tab\t newline\n return\r bell\x07 esc\x1b us\x1f vt\x0b", "literal \\u001F and \\\\u000B",
    "emoji \U0001f600 é ü ñ", "\x1f\x1f\\\x1e", "secret word", '"receipt_hash":""', "    \x7f",
]


def canonical(doc):
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def python_hash(raw):
    doc = json.loads(raw)
    doc["evidence"]["receipt_hash"] = ""
    return "sha256:" + hashlib.sha256(canonical(doc).encode()).hexdigest()


@pytest.fixture(scope="module")
def built(spark):
    words = taxonomy("n", [{"class": "a", "recognizer": "keyword_list", "pattern": ["secret"]}])
    rules = PolicySet(
        (Policy("p_a", "1", "prompt", "any", "any_of", ("n:a",), "redact", redact_with="[{class}]"),
         Policy("r_a", "1", "response", "any", "any_of", ("n:a",), "alert")), "v",
    )
    rows = [(i, t, t + "!", ("u", None, "d", None), ("t", None, "m", None, None)) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(
        rows,
        "exchange_id int, prompt string, response string, actor struct<user_id:string,user_role:string,department:string,"
        "auth_method:string>, tool struct<tool_id:string,tool_version:string,model_id:string,model_vendor:string,endpoint:string>",
    )
    made = receipts.build_receipts(evaluate_exchanges(df, [words], rules, CLOCK), CLOCK.now, retention_days=7)
    return made.cache()


def test_receipts_hash_like_python(built):
    rows = built.orderBy("exchange_id").collect()
    for row in rows:
        doc = json.loads(row.raw)
        assert canonical(doc) == row.raw
        assert doc["evidence"]["receipt_hash"] == python_hash(row.raw) == row.receipt.evidence.receipt_hash
        assert doc["actor"] == {"user_id": "u", "department": "d"}
        assert doc["retention"]["retain_until"] == "2024-05-13"
        assert doc["retention"]["deletable_after"] == "2024-05-13T07:08:09.000120+00:00"
        assert doc["timestamp"] == "2024-05-06T07:08:09.000120Z"
        assert doc["response"]["text_length_chars"] == len(doc["response"]["text"])
    masked = json.loads(rows[6].raw)
    assert masked["prompt"]["text"] == "[n:a] word" and masked["response"]["text"] == "secret word!"
    assert [d["verdict"] for d in masked["policy_decisions"]] == ["redacted", "alerted"]
    assert len({r.receipt.receipt_id for r in rows}) == len(rows)


def test_receipts_are_valid(built):
    assert validate.invalid(built).count() == 0
    assert receipts.verify_summary(receipts.verify(built)).first().result == "PASS"


def test_tampering_shows(spark, built):
    raw = built.where("exchange_id = 2").first().raw
    doc = json.loads(raw)
    odd_key = json.loads(raw)
    odd_key["tool"]["\U0001f600"], odd_key["tool"]["ﬁ"], odd_key["tool"]["f"] = 1, 2, 1.50
    odd_key["evidence"]["receipt_hash"] = python_hash(json.dumps(odd_key))
    twice = json.loads(raw)
    twice["tool"]["receipt_hash"] = "x"
    twice["evidence"]["receipt_hash"] = python_hash(json.dumps(twice))
    cases = [
        ("as written", raw, "OK"),
        ("indented", json.dumps(doc, indent=2), "OK"),
        ("escaped", json.dumps(doc, ensure_ascii=True), "OK"),
        ("undeclared, fractional and astral members", json.dumps(odd_key), "OK"),
        ("hash member elsewhere too", json.dumps(twice), "OK"),
        ("changed text", raw.replace("newline", "newl1ne"), "FAIL"),
        ("changed hash", raw.replace("sha256:", "sha256:0", 1), "FAIL"),
        ("no hash", json.dumps({**doc, "evidence": {}}), "FAIL"),
        ("null hash", json.dumps({**doc, "evidence": {"receipt_hash": None}}), "FAIL"),
        ("no object", "[]", "FAIL"),
        ("no JSON", "not json", "FAIL"),
        ("cut", raw[:-1], "FAIL"),
        ("more behind", raw + "}", "FAIL"),
        ("a second value behind", raw + "\n{}", "FAIL"),
        ("blank behind", raw + " \n", "OK"),
        ("nothing", None, "FAIL"),
    ]
    df = spark.createDataFrame([(n, r) for n, r, _ in cases], "name string, raw string")
    got = {r["name"]: r.status for r in receipts.verify(df).collect()}
    assert got == {n: s for n, _, s in cases}
    summary = receipts.verify_summary(receipts.verify(df)).first()
    assert (summary.receipts, summary.failures, summary.result) == (16, 10, "FAIL")


def test_no_receipts_fail_unless_allowed(spark):
    none = receipts.verify(spark.createDataFrame([], "raw string"))
    assert receipts.verify_summary(none).first().result == "FAIL"
    assert receipts.verify_summary(none, allow_empty=True).first().result == "PASS"


def test_violations_are_listed_by_path(spark, built):
    base = json.loads(built.where("exchange_id = 6").first().raw)

    def broken(change):
        doc = json.loads(json.dumps(base))
        change(doc)
        return json.dumps(doc)

    cases = {
        broken(lambda d: d["actor"].pop("user_id")): ["actor.user_id: required"],
        broken(lambda d: d["tool"].pop("model_id")): ["tool.model_id: required"],
        broken(lambda d: d["tool"].update(extra=1)): [],
        broken(lambda d: d.update(extra=1)): ["extra: unknown field"],
        broken(lambda d: d.pop("prompt")): ["prompt: required"],
        broken(lambda d: d.update(receipt_id="rcp_1")): ["receipt_id: has the wrong format"],
        broken(lambda d: d["policy_decisions"][0].update(error_reason="why")): [
            "policy_decisions[000000].error_reason: must be one of classifier_timeout, classifier_exception, taxonomy_load_error, policy_eval_exception"
        ],
        broken(lambda d: d["policy_decisions"][0].pop("policy_set_version")): ["policy_decisions[000000].policy_set_version: required"],
        broken(lambda d: d["policy_decisions"][1]["alert_id"].update(delivery_status="lost")): [
            "policy_decisions[000001].alert_id.delivery_status: must be one of pending, delivered, failed"
        ],
        broken(lambda d: d["policy_decisions"][0]["redactions_applied"][0].pop("after_hash")): [
            "policy_decisions[000000].redactions_applied[000000].after_hash: required"
        ],
        broken(lambda d: d["response"].update(tokens_used="5", text_length_chars=-1)): [
            "response.text_length_chars: must not be negative", "response.tokens_used: must be integer or null"
        ],
        broken(lambda d: d["data_classes_touched"][0].update(instances=1.5)): ["data_classes_touched[000000].instances: must be integer"],
        broken(lambda d: d["data_classes_touched"][0].update(instances=2.0)): [],
        broken(lambda d: d["prompt"].update(context_references=[{"fields_accessed": [1]}, 5])): [
            "prompt.context_references[000000].fields_accessed: must hold strings only", "prompt.context_references[000001]: must be object"
        ],
        "nothing": ["receipt: must be object"],
    }
    df = spark.createDataFrame([(raw,) for raw in cases], "raw string")
    assert {r.raw: r.violations for r in validate.with_violations(df).collect()} == cases


def test_receipt_tree_and_reports(spark, built, tmp_path):
    tree = tmp_path / "tree" / "2024-05-06"
    tree.mkdir(parents=True)
    rows = built.collect()
    for row in rows:
        (tree / f"{row.receipt.receipt_id}.json").write_text(json.dumps(json.loads(row.raw), indent=2), encoding="utf-8")
    (tree / "broken.json").write_text("{")
    (tree / "other.txt").write_text("x")
    scanned = files.with_receipt(files.receipt_files(spark, str(tmp_path / "tree")))
    assert reports.count(scanned).first().receipts == len(rows) + 1
    checked = receipts.verify(scanned)
    assert {r.status: r["count"] for r in checked.groupBy("status").count().collect()} == {"OK": len(rows), "FAIL": 1}
    assert reports.records_packet(checked).where("integrity = 'OK'").count() == len(rows)
    view = reports.register(scanned.where("receipt is not null"))
    assert reports.sql(spark, "SELECT count(*) AS n FROM receipts WHERE actor.user_id = 'u'").first().n == len(rows)
    assert "prompt" in view.columns
    sinks.write_receipts(built, str(tmp_path / "lines"))
    back = files.with_receipt(files.receipt_lines(spark, str(tmp_path / "lines")))
    assert receipts.verify_summary(receipts.verify(back)).first().result == "PASS"
    assert (tmp_path / "lines" / "day=2024-05-06").is_dir()


def test_retention(spark, built):
    held = built.withColumn("receipt", F.col("receipt").withField("retention.legal_hold", F.col("exchange_id") == 1))
    due = lambda day: reports.prune_candidates(held, F.lit(day).cast("date")).count()
    # The day itself is not past.
    assert (due("2024-05-13"), due("2024-05-14")) == (0, len(TEXTS) - 1)
    aged = reports.older_than(held, F.lit("2024-05-20").cast("date"), 7)
    assert aged.count() == len(TEXTS) - 1
    assert reports.emptied_days(held, F.lit("2024-05-20").cast("date"), 7).count() == 0
    assert reports.emptied_days(built, F.lit("2024-05-20").cast("date"), 7).first().receipts == len(TEXTS)


def test_compact_receipt(spark):
    df = spark.createDataFrame([("block", ["r1"]), ("allow", ["None"])], "verdict string, matched_rules array<string>")
    made = receipts.compact_receipts(df, device_owner=F.lit("laptop"), now=CLOCK.now)
    for row in made.collect():
        doc = json.loads(row.raw)
        assert python_hash(row.raw) == "sha256:" + doc["evidence"]["receipt_hash"]
        assert doc["evidence"]["timestamp"] == "2024-05-06T07:08:09Z"
    assert {r.status for r in receipts.verify_compact(made).collect()} == {"OK"}
    bent = made.withColumn("raw", F.replace("raw", F.lit("laptop"), F.lit("desktop")))
    assert {r.status for r in receipts.verify_compact(bent).collect()} == {"FAIL"}
