"""History inside request bodies against a fold in plain Python, and as-of lookups against a scan."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from vigilake.functions.spread import as_of_lookup
from vigilake.operators import bodies, history, traffic

BLOCK, MASKED, ORIGINAL = "withheld by rule", "call # now", "call 555 now"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def message(surface, role, text):
    if surface == "gemini":
        return {"role": "model" if role == "assistant" else role, "parts": [{"text": text}, {"inline": 1}]}
    if surface == "anthropic":
        return {"role": role, "content": [{"type": "text", "text": text}, {"type": "image", "id": 7}]}
    if surface == "chatgpt":
        return {"role": role, "content": text}
    if surface == "chatgpt_web":
        return {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}}
    return {"sender": "human" if role == "user" else role, "text": text, "uuid": "u-1"}


def fold(turns):
    """(kept turns, stripped, swapped) by one pass with a list of all kept turns."""
    kept, stripped = [], 0
    for role, text in turns:
        if role == "assistant" and text == BLOCK:
            if kept and kept[-1][0] == "user":
                kept.pop()
            stripped += 1
        else:
            kept.append((role, text))
    back = [(r, ORIGINAL if r == "assistant" and t == MASKED else t) for r, t in kept]
    return back, stripped, sum(a != b for a, b in zip(kept, back, strict=True))


def body_of(surface, turns):
    key = "contents" if surface == "gemini" else "messages"
    return {"model": "m", "n": 12345678901234567, "deep": {"é": [1.5, None, {"x": True}]}, key: [message(surface, r, t) for r, t in turns]}


RECORDS = [("block", sha(BLOCK), None, 5), ("swap", sha(MASKED), "older", 2), ("swap", sha(MASKED), ORIGINAL, 4), ("swap", sha(MASKED), "later", 50)]


def records(spark):
    return spark.createDataFrame(RECORDS, "kind string, text_hash string, original string, at bigint")


def test_bodies_equal_a_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        turns = [(rng.choice(["user", "assistant", "system"]), rng.choice([BLOCK, MASKED, "plain", ""])) for _ in range(rng.randrange(12))]
        surface = traffic.SURFACES[i % 5]
        rows.append((i, surface, json.dumps(body_of(surface, turns), ensure_ascii=False), 10))
        kept, stripped, swapped = fold(turns)
        want[i] = body_of(surface, kept), stripped, swapped, json.dumps(body_of(surface, turns), ensure_ascii=False)
    requests = spark.createDataFrame(rows, "id bigint, surface string, request_body string, at bigint")
    got = bodies.clean_history(requests, ["id"], "at", records(spark), lambda at: F.floor(at / 3)).collect()
    assert len(got) == 60
    for r in got:
        body, stripped, swapped, raw = want[r.id]
        assert (r.stripped, r.swapped) == (stripped, swapped) and r.request_body == raw
        assert json.loads(r.history_body) == body, r.id
        if not stripped and not swapped:
            assert r.history_body == raw


def test_only_what_was_recorded_before_counts(spark):
    turns = [("user", "a"), ("assistant", BLOCK), ("user", "b"), ("assistant", MASKED)]
    body = json.dumps(body_of("chatgpt", turns))
    requests = spark.createDataFrame([(t, "chatgpt", body, t) for t in (1, 2, 3, 4, 5, 6, 50, 51)], "id bigint, surface string, request_body string, at bigint")
    got = {r.id: r for r in bodies.clean_history(requests, ["id"], "at", records(spark), lambda at: F.floor(at / 4)).collect()}
    said = {t: [m["content"] for m in json.loads(r.history_body)["messages"]] for t, r in got.items()}
    whole = ["a", BLOCK, "b"]
    assert said[1] == said[2] == [*whole, MASKED]  # recorded at the same time is not before
    assert said[3] == said[4] == [*whole, "older"] and said[5] == [*whole, ORIGINAL]
    assert said[6] == said[50] == ["b", ORIGINAL] and said[51] == ["b", "later"]


def test_odd_bodies_stay(spark):
    known = spark.createDataFrame([(sha(BLOCK),), (sha("a\n\n\n\nb"),), (sha("a\n\nb"),)], "text_hash string")
    cases = [
        (1, "chatgpt", "{broken", 0), (2, "chatgpt", None, 0), (3, "unknown", json.dumps({"messages": [{"role": "assistant", "content": BLOCK}]}), 0),
        (4, "anthropic", json.dumps({"messages": "none"}), 0), (5, "chatgpt", json.dumps({"messages": [3, None, "x", {"role": "assistant", "content": [BLOCK]}]}), 0),
        (6, "chatgpt", json.dumps({"messages": [3, {"role": "assistant", "content": BLOCK}]}), 1),
        (7, "chatgpt_web", json.dumps({"messages": [{"author": {"role": "assistant"}, "content": {"parts": ["a", "", "b"]}}]}), 1),
        (8, "claude_web", json.dumps({"messages": [{"role": None, "sender": "human", "text": "q"}, {"sender": "model", "text": BLOCK}]}), 1),
        (9, "anthropic", json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": BLOCK}]}), 1),
    ]
    requests = spark.createDataFrame([c[:3] for c in cases], "id bigint, surface string, request_body string")
    got = {r.id: r for r in bodies.strip_blocks_in_body(requests, ["id"], known).collect()}
    assert {i: r.stripped for i, r in got.items()} == {c[0]: c[3] for c in cases}
    assert all(got[c[0]].history_body == c[2] for c in cases if not c[3])
    left = {i: json.loads(got[i].history_body)["messages"] for i in (6, 7, 8, 9)}
    # A user turn whose ``role`` is null is no user turn: its sender is not looked at.
    assert left == {6: [3], 7: [], 8: [{"role": None, "sender": "human", "text": "q"}], 9: []}


def test_swap_leaves_other_parts(spark):
    pairs = spark.createDataFrame([(sha(MASKED), ORIGINAL), (sha("same"), "same")], "text_hash string, original string")
    turns = [("assistant", MASKED), ("user", MASKED), ("assistant", "same")]
    rows = [(i, s, json.dumps(body_of(s, turns))) for i, s in enumerate(traffic.SURFACES)]
    got = bodies.swap_back_in_body(spark.createDataFrame(rows, "id bigint, surface string, request_body string"), ["id"], pairs).collect()
    for r in got:
        assert r.swapped == 1
        assert json.loads(r.history_body) == body_of(r.surface, [("assistant", ORIGINAL), ("user", MASKED), ("assistant", "same")])


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of_lookup_equals_a_scan(spark, width):
    rng = random.Random(width)
    left = [(i, rng.choice(["hot", "hot", "b", "c", None]), rng.randrange(100)) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "b"]), t, f"v{t}") for t in rng.sample(range(100), 40)] + [("c", 3, None)]
    got = as_of_lookup(
        spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v string"), "k", "t", lambda t: F.floor(t / width), "v"
    )
    want = set()
    for i, k, t in left:
        before = [(u, v) for x, u, v in right if x == k and u < t and v is not None]
        if before:
            want.add((i, k, t, max(before)[1]))
    assert {tuple(r) for r in got.collect()} == want


def test_recorded_rows(spark):
    evals = "struct<final_verdict:string>"
    rows = [
        (1, "blocked", "No.", None, None, "", None), (2, "redacted", None, "secret", "redacted", "#", None), (3, "redacted", None, "x", "allowed", "x", None),
        (4, "blocked", "", "a", "blocked", "a", None), (5, "redacted", None, "", "redacted", "", None),
    ]
    df = spark.createDataFrame(rows, "t int, verdict string, block_message string, response string, rv string, final_response string, z string")
    df = df.withColumn("response_eval", F.struct(F.col("rv").alias("final_verdict")).cast(evals))
    got = {(r.kind, r.text_hash, r.original, r.at) for r in history.recorded(df, F.col("t")).collect()}
    assert got == {("block", sha("No."), None, 1), ("swap", sha("#"), "secret", 2)}
