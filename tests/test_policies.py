import copy
import hashlib
import json

import pytest

from vigilake.operators import policies

GOOD = {
    "schema_version": "1.0", "policy_id": "mask_dates", "policy_version": "1", "description": None,
    "match": {"direction": "response", "destination": "any", "classes": {"any_of": ["phi:dob", "phi:mrn"]}},
    "verdict": "redact", "redact_config": {"redact_with": "[{class}]", "classes_to_redact": ["phi:dob"]},
}
BLOCK = {**{k: v for k, v in GOOD.items() if k != "redact_config"}, "verdict": "block", "block_config": {"user_message": "no"}}
ALERT = {**{k: v for k, v in GOOD.items() if k != "redact_config"}, "verdict": "alert", "alert_config": {"webhook": None}}


def change(base, path, value=None, drop=False):
    doc = copy.deepcopy(base)
    *parents, last = path.split(".")
    holder = doc
    for p in parents:
        holder = holder[p]
    if drop:
        del holder[last]
    else:
        holder[last] = value
    return doc


WRONG = [
    change(GOOD, "redact_config", drop=True),
    change(GOOD, "block_config", {"user_message": "x"}),
    change(GOOD, "verdict", "allow"),
    change(GOOD, "match.classes", {}),
    change(GOOD, "match.classes", {"any_of": ["a:b"], "all_of": ["a:b"]}),
    change(GOOD, "match.classes", {"any_of": []}),
    change(GOOD, "match.classes", {"all_of": ["dob"]}),
    change(GOOD, "match.classes.none_of", ["a:b"]),
    change(GOOD, "match.direction", "both"),
    change(GOOD, "match.destination", drop=True),
    change(GOOD, "match.extra", 1),
    change(GOOD, "match", drop=True),
    change(GOOD, "redact_config.redact_with", "[{index}]"),
    change(GOOD, "redact_config.redact_with", ""),
    change(GOOD, "redact_config.redact_with", drop=True),
    change(GOOD, "redact_config.classes_to_redact", []),
    change(GOOD, "redact_config.classes_to_redact", ["phi:other"]),
    change(GOOD, "redact_config.classes_to_redact", ["dob"]),
    change(GOOD, "redact_config.more", 1),
    change(ALERT, "alert_config.webhook", "/relative"),
    change(BLOCK, "block_config.user_message", ""),
    change(GOOD, "policy_id", "Mask"),
    change(GOOD, "policy_id", "mask-dates"),
    change(GOOD, "policy_id", "ab"),
    change(GOOD, "policy_id", "1abc"),
    change(GOOD, "policy_id", drop=True),
    change(GOOD, "policy_version", ""),
    change(GOOD, "schema_version", "2.0"),
    change(GOOD, "priority", 1),
    change(GOOD, "audit_only", "yes"),
    change(GOOD, "on_classifier_error", "maybe"),
    change(GOOD, "description", 5),
    ["not", "a", "mapping"],
]
RIGHT = [
    GOOD, BLOCK, ALERT, change(ALERT, "alert_config.webhook", "https://x.example"), change(GOOD, "audit_only", True),
    change(GOOD, "match.classes", {"all_of": ["phi:dob"]}), change(GOOD, "on_classifier_error", "fail_closed"),
    change(GOOD, "redact_config.classes_to_redact", drop=True),
]


def raw(spark, docs):
    rows = [(f"{i:03}.yaml", None, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, policies.RAW)


def test_every_rule_is_checked(spark):
    found = {r.file for r in policies.validation_errors(raw(spark, WRONG)).collect()}
    assert found == {f"{i:03}.yaml" for i in range(len(WRONG))}
    assert policies.validation_errors(raw(spark, RIGHT)).collect() == []


def test_duplicates_count_among_valid_files_only(spark):
    docs = [change(GOOD, "policy_id", "one_rule"), change(WRONG[0], "policy_id", "two_rule"),
            change(GOOD, "policy_id", "two_rule"), change(GOOD, "policy_id", "one_rule"), change(GOOD, "policy_id", "one_rule")]
    told = sorted(r.file for r in policies.load_errors(raw(spark, docs)).where("message like 'duplicate%'").collect())
    assert told == ["003.yaml", "004.yaml"]


def test_directory_loading(spark, tmp_path):
    import yaml

    with pytest.raises(FileNotFoundError):
        policies.load_policies(spark, tmp_path / "none")
    empty = policies.load_policies(spark, tmp_path)
    assert empty == policies.PolicySet((), "empty")
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(GOOD))
    (tmp_path / "a.yml").write_text(yaml.safe_dump(change(BLOCK, "policy_id", "stop_dates")))
    (tmp_path / "note.txt").write_text("ignored")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.yaml").write_text("- broken")
    loaded = policies.load_policies(spark, tmp_path)
    assert [p.policy_id for p in loaded.policies] == ["stop_dates", "mask_dates"]
    lines = [f"{n}:{hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()}" for n in ("a.yml", "b.yaml")]
    assert loaded.version == hashlib.sha256("\n".join(lines).encode()).hexdigest()[:12]
    assert policies.as_dataframe(spark, loaded).count() == 2
    (tmp_path / "b.yaml").rename(tmp_path / "z.yaml")
    assert policies.load_policies(spark, tmp_path).version != loaded.version
    (tmp_path / "x.yaml").write_text("a: [1")
    (tmp_path / "y.yaml").write_text("- 1")
    (tmp_path / "y2.yaml").write_text(yaml.safe_dump(GOOD))
    with pytest.raises(policies.PolicyLoadError) as failed:
        policies.load_policies(spark, tmp_path)
    assert {f for f, _ in failed.value.errors} == {"x.yaml", "y.yaml", "z.yaml"}
    with pytest.raises(NotADirectoryError):
        policies.load_policies(spark, tmp_path / "note.txt")
