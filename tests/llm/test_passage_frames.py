"""Texts are hashed once for their seeds, and frames follow parts of the table, not texts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilake.llm import passages


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklm", k=5)) for _ in range(n))


def docs_of(spark):
    shared = [prose(i, 70) for i in range(12)]
    rows = [(i, f"{prose(100 + i, 30)} {shared[i % 12]} {prose(200 + i, 30)}") for i in range(36)] + [(90, None), (91, "few words"), (92, shared[0])]
    return spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)


def test_seeds_are_made_once(spark, monkeypatch):
    made, real = [], passages._seeds
    calls = spark.sparkContext.accumulator(0)

    def counted(texts, settings):
        made.append(real(texts, settings))

        def passed(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch

        return made[-1].mapInPandas(passed, made[-1].schema)

    monkeypatch.setattr(passages, "_seeds", counted)
    docs = docs_of(spark)
    classes = passages.text_classes(docs, "doc_id", "text")
    found = passages.candidates(docs, classes, "text")
    assert found.count() > 0 and calls.value == made[0].count()


def test_a_frame_holds_the_texts_of_a_part(spark, monkeypatch):
    frames = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(passages.DataFrame, "mapInPandas", told(passages.DataFrame.mapInPandas, frames))
    docs = docs_of(spark)
    _, spans = passages.repeated(docs)
    assert spans.count() >= 24
    # One a task and step, with few tasks; there were more than one a text.
    assert frames.value < docs.count()


def told(real, frames):
    def mapped(df, fn, schema):
        def counting(batches):
            for frame in fn(batches):
                if schema.startswith(("key bigint, cls bigint, doc", "a bigint, slice")):
                    frames.add(1)
                yield frame

        return real(df, counting, schema)

    return mapped


def shards_of(texts, keys, places, shards=3):
    """A part's rows: text i is (cls, doc) and has the given keys."""
    return passages._part([(c, d, shards, np.array(p, np.int64), np.array(k, np.int64)) for (c, d), k, p in zip(texts, keys, places, strict=True)])


def test_a_shard_gets_one_text_of_a_part_for_a_key():
    """A passage in very many texts of a part is met there; one entry for each part is looked up."""
    texts = [(100 + i, 1000 - i) for i in range(50)]
    rows = shards_of(texts, [[7, 7, 10_000 + i] for i in range(50)], [[3, 5, 9]] * 50)
    sent = passages._unpack(list(rows["entries"][~rows["met"]]))
    met = passages._unpack(list(rows["entries"][rows["met"]]))
    assert len(sent["key"]) == 51 and sent["many"].sum() == 1
    assert len(met["key"]) == 100 and len(np.unique(met["key"])) == 1
    # The one looked up is the first in the order of keys: the last text here.
    assert sent["text"][sent["many"]].tolist() == [[951, 149]]


@pytest.mark.parametrize("cut", [1, 3, 5])
def test_parts_meet_as_one_group_does(cut):
    """Firsts and entries equal a plain grouping, wherever parts are cut; copies of a text count as one."""
    rng = random.Random(cut)
    docs = [(rng.choice(range(20, 30)), i) for i in range(15)]
    own = {c: [rng.randrange(40) for _ in range(6)] for c, _ in docs}
    parts = [docs[i : i + cut] for i in range(0, len(docs), cut)]
    rows = pd.concat([shards_of(p, [own[c] for c, _ in p], [list(range(6))] * len(p)) for p in parts])
    got = pd.concat([passages._meet(shard) for _, shard in rows.groupby("shard")])
    firsts = {r.key: (r.a, r.a_place) for r in got[got["kind"] == passages.FIRST].itertuples()}
    found = {(r.cls, r.place, r.a, r.a_place) for r in got[got["kind"] == passages.LINKED].itertuples()}
    found |= {(r.cls, r.place, *firsts[r.key]) for r in got[got["kind"] == passages.OPEN].itertuples()}
    first_doc = {c: min(d for k, d in docs if k == c) for c in own}
    groups: dict = {}
    for c in own:
        for place, key in enumerate(own[c]):
            groups.setdefault(key, []).append((first_doc[c], c, place))
    wanted = {(c, place, *min(g)[1:]) for g in groups.values() if len({c for _, c, _ in g}) > 1 for _, c, place in g}
    assert found == wanted


def test_shuffles_behind_a_written_step_are_removed(spark):
    """They stayed until the driver happened to collect them, and added up over the steps."""
    kept = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = kept.size()
    # In several parts, since one part is grouped without a shuffle.
    docs = docs_of(spark).repartition(4)
    _, spans = passages.repeated(docs)
    assert spans.where(F.size("spans") > 0).count() >= 24
    assert kept.size() - before <= 2
    assert spark.conf.get(passages.SHUFFLE_CLEANUP, None) is None
