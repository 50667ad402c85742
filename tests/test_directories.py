"""Policy directories and taxonomies checked as tables, against the loaders of single ones."""

import json
import re

import pytest
from pyspark.sql import functions as F

from test_policies import BLOCK, GOOD, WRONG, change
from vigilake.operators import policies, taxonomy
from vigilake.plans import evaluation
from vigilake.sources import files


def scans(df) -> int:
    return len(re.findall(r"FileScan|Scan ExistingRDD|LocalTableScan", df._jdf.queryExecution().executedPlan().toString()))


def test_many_directories_equal_the_loader_of_one(spark, tmp_path):
    layout = {
        "good": {"b.yaml": json.dumps(GOOD), "a.yml": json.dumps(BLOCK | {"policy_id": "stop_it"}), "notes.txt": "x"},
        "good/below": {"c.yaml": json.dumps(GOOD)},
        "twice": {"a.yaml": json.dumps(GOOD), "b.yml": json.dumps(GOOD), "c.yaml": json.dumps(GOOD)},
        "bad": {"a.yaml": "x: [", "b.yaml": "- 1", "c.yaml": json.dumps(WRONG[0]), "d.yaml": b"\xff\xfe\xff", "e.yaml": "~"},
        # An id that an invalid file declares is free.
        "free": {"a.yaml": json.dumps(change(GOOD, "policy_version", "")), "b.yaml": json.dumps(GOOD)},
    }
    for folder, content in layout.items():
        (tmp_path / folder).mkdir(parents=True)
        for name, text in content.items():
            (tmp_path / folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    read = policies.read_directories(files.policy_files(spark, str(tmp_path)))
    sets = {r.directory.split(tmp_path.name + "/")[1]: r for r in policies.directory_sets(read).collect()}
    errors = {}
    for r in policies.load_errors(read, "directory").collect():
        errors.setdefault(r.directory.split(tmp_path.name + "/")[1], []).append((r.file, r.message))
    assert sets.keys() == layout.keys() and sets["good"].n_files == 2
    for folder in layout:
        try:
            loaded = policies.load_policies(spark, tmp_path / folder)
            assert sets[folder].policy_set_version == loaded.version and folder not in errors
        except policies.PolicyLoadError as exc:
            assert sets[folder].policy_set_version is None and sets[folder].n_errors == len(errors[folder])
            plain = lambda found: sorted((f, m.split(":")[0] if "UTF" not in m and "YAML" not in m and not m.startswith("unreadable") else "unread") for f, m in found)
            assert plain(errors[folder]) == plain(exc.errors)


def test_load_errors_read_their_input_once(spark):
    found = policies.load_errors(evaluation.policy_files(spark, "/root/testdata/sf0.001"))
    assert scans(found) == 1


CLASSES = [
    {"class": "a", "recognizer": "regex", "pattern": r"\d{3}"}, {"class": "a", "recognizer": "regex", "pattern": r"(?P<x>a)\Z"},
    {"class": "a", "recognizer": "regex", "pattern": "(?P<x>a)(?P=x)"}, {"class": "a", "recognizer": "regex", "pattern": "("},
    {"class": "a", "recognizer": "regex", "pattern": "x*"}, {"class": "a", "recognizer": "regex", "pattern": "x|"}, {"class": "a", "recognizer": "regex", "pattern": r"(?=a)"},
    {"class": "a", "recognizer": "regex", "pattern": ["x"]}, {"class": "", "recognizer": "regex", "pattern": "x"}, {"recognizer": "regex", "pattern": "x"},
    {"class": "a", "recognizer": "regex", "pattern": None}, {"class": "a", "pattern": "x"}, {"class": "a", "recognizer": "other", "pattern": "x"},
    {"class": "a", "recognizer": "keyword_list", "pattern": []}, {"class": "a", "recognizer": "keyword_list", "pattern": "x"}, {"class": "a", "recognizer": "keyword_list", "pattern": ["x", 5]},
    {"class": "a", "recognizer": "spacy_ner", "pattern": "PERSON"}, {"class": "a", "recognizer": "spacy_ner", "pattern": 5}, 7, None, {},
]


def refused(document) -> bool:
    try:
        taxonomy.taxonomy(document["namespace"], document["classes"])
    except taxonomy.TaxonomyError:
        return True
    return False


def test_taxonomy_table_agrees_with_the_loader(spark):
    documents = [{"namespace": "n", "classes": [CLASSES[0], c]} for c in CLASSES]
    documents += [{"namespace": n, "classes": [CLASSES[0]]} for n in ("", "a:b", "ok")] + [{"namespace": "n", "classes": []}]
    rows = [(str(i), json.dumps(d)) for i, d in enumerate(documents)] + [("x", "[]"), ("y", None), ("z", "{broken")]
    found = taxonomy.taxonomy_violations(spark.createDataFrame(rows, "file string, body string"))
    got = found.collect()
    assert {r.file for r in got} == {str(i) for i, d in enumerate(documents) if refused(d)} | {"x", "y", "z"}
    assert {r.position for r in got if r.file.isdigit() and int(r.file) < len(CLASSES)} == {1}
    assert len(got) == len({r.file for r in got}) and scans(found) == 1


@pytest.mark.parametrize("pattern", [r"\bword\b", r"(?i)a+b", r"(?<!x)y", r"[\w.]+@x"])
def test_good_patterns_have_no_error(spark, pattern):
    assert spark.createDataFrame([(pattern,)], "p string").select(taxonomy.pattern_error(F.col("p"))).first()[0] is None
