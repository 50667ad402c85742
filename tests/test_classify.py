import random
import re

import pytest
from pyspark.sql import functions as F

from vigilake.operators import classify
from vigilake.operators.taxonomy import TaxonomyError, as_dataframe, load_taxonomy, shipped, taxonomy


def hits_of(spark, texts, taxonomies, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = classify.with_hits(df, "text", taxonomies, **options).orderBy("id").collect()
    return [[(h.cls, h.start, h.end, h.text) for h in r.hits] for r in rows]


# Own samples: characters of several bytes around hits, letters that fold unusually, and near misses.
ODD = [
    "", "nothing to see", "ñ7766-5544-3322-1100ñ", "\U0001f680 9081 7263 5445 3627 \U0001f680 SSN: 902-11-7744",
    "ring (312) 808-6161 or +1 206 747 3030", "born on 7/9/64, DOB 1988-11-02; date of birth: 30 June 2001",
    "WARFARIN with warfarın, Insulin glargine.", "٧٦٥٤٣٢١٠٧٦٥٤٣٢١٠ eastern digits", "MRN-90817 MRN: 555123",
    "17 Birch Ln Unit 9, 2208 W Juniper Pl.", "HDL: 61.5% TSH 2 mIU/L", "J45.2 asthma\nJ45.2\nnothing else",
    "q.r@firm.net m@outlook.com n@outlook.com.firm.edu", "$3.4K and USD 2,750,000 or $ 9,876", "ſuite 40 Elm ſt", "40 Elm Kt",
    "Mrs. Patel saw patient Okonkwo and Linda Park", "Globex Globexes, Umbrella Logistics.",
]


def test_spans_equal_python_matches(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(ODD)[:30] + rng.choice(" \n.é") for _ in range(6)) for _ in range(60)]
    taxonomies = [shipped("phi"), shipped("generic")]
    got = hits_of(spark, texts, taxonomies)
    for text, found in zip(texts, got):
        expected = []
        for c in (c for t in taxonomies for c in t.classes):
            python = re.compile(re.sub(r"^\(\?iuU\)", "", c.pattern), re.IGNORECASE)
            expected += [(c.name, m.start(), m.end(), m.group()) for m in python.finditer(text)]
        assert found == expected, text


def test_longest_keyword_wins_and_words_are_whole(spark):
    words = taxonomy("v", [{"class": "n", "recognizer": "keyword_list", "pattern": ["Acme", "Acme Corp", "C++ Ltd", "a.b"]}])
    assert [h[3] for h in hits_of(spark, ["acme corp, Acmes, ACME; aXb a.b"], [words])[0]] == ["acme corp", "ACME", "a.b"]


def test_fold_by_class(spark):
    rows = [([("a", 0, 1, "x", "prompt", 0), ("b", 2, 3, "x", "prompt", 1), ("a", 0, 1, "x", "response", 2)],), ([],)]
    df = spark.createDataFrame(rows, f"hits array<{classify.HIT}>")
    got = [[tuple(c) for c in r.c] for r in df.select(classify.data_classes(F.col("hits")).alias("c")).collect()]
    assert got == [[("a", 2, True, True), ("b", 1, True, False)], []]


@pytest.mark.parametrize(
    ("namespace", "classes"),
    [
        ("a:b", [{"class": "x", "recognizer": "regex", "pattern": "x"}]),
        ("", [{"class": "x", "recognizer": "regex", "pattern": "x"}]),
        ("a", []),
        ("a", [{"class": "x", "recognizer": "magic", "pattern": "x"}]),
        ("a", [{"class": "x", "recognizer": "regex"}]),
        ("a", [{"class": "x", "recognizer": "regex", "pattern": ["x"]}]),
        ("a", [{"class": "x", "recognizer": "keyword_list", "pattern": []}]),
        ("a", [{"class": "x", "recognizer": "regex", "pattern": "x*"}]),
        ("a", [{"class": "x", "recognizer": "regex", "pattern": "(x"}]),
        ("a", [{"class": "x", "recognizer": "spacy_ner", "pattern": ["PERSON"]}]),
    ],
)
def test_wrong_taxonomies_are_refused(namespace, classes):
    with pytest.raises(TaxonomyError):
        taxonomy(namespace, classes)


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("namespace: n\nclasses:\n  - {class: c, recognizer: regex, pattern: 'q+'}\n")
    loaded = load_taxonomy(tmp_path / "t.yaml")
    assert [r.cls for r in as_dataframe(spark, [loaded, shipped("phi")]).collect()][:2] == ["n:c", "phi:patient_name"]
    (tmp_path / "bad.yaml").write_text("- 1\n")
    with pytest.raises(TaxonomyError):
        load_taxonomy(tmp_path / "bad.yaml")


def test_entity_recognizer(spark):
    names = taxonomy("who", [{"class": "p", "recognizer": "spacy_ner", "pattern": "PERSON"}])
    with pytest.raises(ValueError, match="who:p"):
        hits_of(spark, ["x"], [names])

    def model(texts):
        return [[("PERSON", 0, 2), ("ORG", 1, 3)] if t else [] for t in texts]

    assert hits_of(spark, ["anna", None], [names], recognizer=model) == [[("who:p", 0, 2, "an")], []]


def test_location_is_checked(spark):
    with pytest.raises(ValueError):
        hits_of(spark, ["x"], [shipped("phi")], location="answer")


CORPUS = [
    ("Card 4000 1234 5678 9010 was charged.", ["generic:pci_card_pan"]),
    ("My SSN: 321-54-9876 please.", ["generic:pii_ssn"]),
    ("Send it to clerk@county.gov today.", ["generic:confidential_internal_email"]),
    ("Reach me at 415-555-0199.", ["generic:pii_phone"]),
    ("The offer is $2.5M net.", ["generic:confidential_contract_value"]),
    ("Globex will deliver.", ["generic:confidential_vendor_name"]),
    ("Patient takes Lisinopril daily.", ["phi:medication"]),
    ("DOB: 01/02/1960 on file.", ["phi:patient_dob"]),
    ("MRN: 445566 admitted.", ["phi:mrn"]),
    ("TSH 2.1 was normal.", ["phi:lab_result"]),
    ("The meeting is at noon.", []),
    ("Write to me at someone@gmail.com.", []),
    ("We sold 12 units in 2020.", []),
    ("Version 1.2.3 is out.", []),
]


def test_quality_on_a_labelled_corpus(spark):
    df = spark.createDataFrame(CORPUS, "text string, expected array<string>")
    scored = classify.with_expectation(classify.with_hits(df, "text", [shipped("phi"), shipped("generic")]), "expected")
    row = classify.quality(scored).first()
    assert row.precision >= 0.9 and row.recall >= 0.9
    assert classify.mismatches(scored).count() == row.fp + row.fn == 0
    nothing = classify.quality(scored.where("tp + fp + fn = 0")).first()
    assert (nothing.precision, nothing.recall) == (1.0, 1.0)
