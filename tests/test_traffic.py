import datetime
import json
from urllib.parse import parse_qs, quote_plus

import pytest
from pyspark.sql import functions as F

from vigilake.functions import variant as V
from vigilake.operators import sanitize, traffic

SCHEMA = "id int, surface string, request_body string, response_body string"


def normalised(spark, surface, requests=(), responses=()):
    pairs = [(i, surface, json.dumps(b), "{}") for i, b in enumerate(requests)] or [
        (i, surface, "{}", json.dumps(b)) for i, b in enumerate(responses)
    ]
    rows = traffic.normalise(spark.createDataFrame(pairs, SCHEMA)).orderBy("id").collect()
    return [r.prompt if requests else r.response for r in rows]


def text(t, **more):
    return {"type": "text", "text": t, **more}


PROMPTS = {
    "gemini": [
        ({"systemInstruction": {"parts": [{"text": "s"}]}, "contents": [{"role": "user", "parts": [{"text": "a"}]},
          {"role": "model", "parts": [{"text": "m"}]}, {"role": "user", "parts": [{"text": "b"}, {"text": ""}, {"x": 1}, {"text": "c"}]}]}, "s\n\nb\n\nc"),
        ({"systemInstruction": {}, "system_instruction": {"parts": [{"text": "s2"}]}, "contents": [{"role": "model", "parts": []}]}, "s2"),
        ({"contents": None}, ""), ({"contents": ["x", {"role": "user", "parts": [{"text": " \n pad "}]}]}, "pad"),
    ],
    "anthropic": [
        ({"system": "s", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "m"}, {"role": "user", "content": [text("b"), {"type": "image"}, text("c")]}]}, "s\n\nb\n\nc"),
        ({"system": [text("s1"), {"type": "x", "text": "no"}, text("s2")], "messages": [{"role": "user", "content": "b"}]}, "s1\n\ns2\n\nb"),
        ({"messages": [{"role": "user", "content": "first"}, {"role": "user", "content": None}]}, ""),
    ],
    "chatgpt": [
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "a"}, {"role": "user", "content": [text("b")]}]}, "s\n\na"),
        ({"messages": [{"role": "system", "content": "s"}, {"role": "system", "content": ""}, {"role": "user", "content": "a"}]}, "s\n\n\n\na"),
        ({"messages": []}, ""),
    ],
    "chatgpt_web": [
        ({"messages": [{"author": {"role": "system"}, "content": {"parts": ["s", ""]}}, {"author": {"role": "user"}, "content": {"parts": ["a", 5, "b"]}}]}, "s\n\na\n\nb"),
        ({"messages": [{"author": {"role": "user"}, "content": {"parts": ["a"]}}, {"author": {"role": "user"}, "content": "text"}]}, "a"),
        ({"messages": [{"author": {"role": "user"}, "content": {"parts": ["a"]}}, {"author": {"role": "user"}}]}, ""),
    ],
    "claude_web": [
        ({"prompt": "  p ", "text": "t"}, "p"), ({"prompt": " ", "text": "t"}, "t"), ({"content": [text("a"), "b", {"type": "x"}]}, "a\n\nb"),
        ({"prompt": [], "messages": [{"sender": "human", "text": "h"}]}, "h"),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "", "sender": "human", "content": "", "text": "b"}, {"sender": "assistant", "text": "c"}]}, "b"),
        ({"messages": [{"role": "assistant", "content": "c"}]}, ""),
    ],
}
RESPONSES = {
    "gemini": [({"candidates": [{"content": {"parts": [{"text": "a"}, {"f": 1}]}}, {"content": {"parts": [{"text": "b"}]}}, 5]}, "a\n\nb"), ({}, "")],
    "anthropic": [({"content": [text("a"), {"type": "tool_use", "text": "no"}, text("b"), text("")]}, "a\n\nb"), ({"content": None}, "")],
    "chatgpt": [({"choices": [{"message": {"content": "a"}}, {"message": {"content": None}}, {"message": {"content": "b"}}]}, "a\n\nb")],
    "chatgpt_web": [({"message": {"content": {"parts": ["a", "", "b", {}]}}}, "a\n\nb"), ({"message": None}, "")],
    "claude_web": [({"completion": ""}, ""), ({"content": "c"}, "c"), ({"completion": 5, "content": [text("a"), text("b")]}, "a\n\nb"), ({}, "")],
}


@pytest.mark.parametrize("surface", traffic.SURFACES)
def test_texts(spark, surface):
    assert normalised(spark, surface, requests=[b for b, _ in PROMPTS[surface]]) == [t for _, t in PROMPTS[surface]]
    assert normalised(spark, surface, responses=[b for b, _ in RESPONSES[surface]]) == [t for _, t in RESPONSES[surface]]


REWRITES = [
    ("gemini", {"candidates": [{"content": {"role": "model", "parts": [{"f": 1}, {"text": "a"}, {"text": "b"}]}, "n": 1}, {"n": 2}], "u": None},
     {"candidates": [{"content": {"role": "model", "parts": [{"f": 1}, {"text": "NEW"}]}, "n": 1}, {"n": 2}], "u": None}),
    ("gemini", {"candidates": [{"n": 1}]}, {"candidates": [{"n": 1, "content": {"parts": [{"text": "NEW"}]}}]}),
    ("gemini", {}, {"candidates": [{"content": {"role": "model", "parts": [{"text": "NEW"}]}, "finishReason": "STOP", "index": 0}]}),
    ("anthropic", {"id": 1, "content": [{"type": "tool_use", "input": {"x": [1.5, None]}}, text("a", cited=1), text("b")]},
     {"id": 1, "content": [{"type": "tool_use", "input": {"x": [1.5, None]}}, text("NEW")]}),
    ("anthropic", {"content": [{"type": "tool_use"}]}, {"content": [text("NEW"), {"type": "tool_use"}]}),
    ("chatgpt", {"choices": [{"message": {"role": "assistant", "content": "a"}, "i": 0}, {"i": 1}]},
     {"choices": [{"message": {"role": "assistant", "content": "NEW"}, "i": 0}, {"i": 1}]}),
    ("chatgpt_web", {"message": {"id": "m", "content": {"parts": ["a", "b"], "content_type": "text"}}},
     {"message": {"id": "m", "content": {"parts": ["NEW"], "content_type": "text"}}}),
    ("chatgpt_web", {}, {"message": {"content": {"parts": ["NEW"]}}}),
    ("claude_web", {"completion": None, "content": "c"}, {"completion": "NEW", "content": "c"}),
    ("claude_web", {"content": [text("a"), {"type": "x"}]}, {"content": [text("NEW"), {"type": "x"}]}),
    ("claude_web", {"content": "c"}, {"content": "NEW"}),
    ("claude_web", {}, {"content": "NEW"}),
]


def test_rewritten_responses(spark):
    rows = [(i, s, "{}", json.dumps(b)) for i, (s, b, _) in enumerate(REWRITES)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fresh", F.lit("NEW"))
    got = [json.loads(r.rewritten) for r in traffic.redacted_responses(df, "fresh").orderBy("id").collect()]
    assert got == [e for _, _, e in REWRITES]


def test_rewritten_turns(spark):
    cases = [
        ("gemini", {"role": "model", "parts": [{"text": "a"}, {"f": 1}]}, {"role": "model", "parts": [{"text": "NEW"}, {"f": 1}]}),
        ("anthropic", {"role": "assistant", "content": "a"}, {"role": "assistant", "content": "NEW"}),
        ("anthropic", {"content": [{"type": "x"}]}, {"content": [text("NEW"), {"type": "x"}]}),
        ("anthropic", {"content": 5}, {"content": "NEW"}),
        ("chatgpt", {"content": ["x"]}, {"content": "NEW"}),
        ("chatgpt_web", {"content": {"parts": ["a"], "k": 1}}, {"content": {"parts": ["NEW"], "k": 1}}),
        ("claude_web", {"content": [text("a")], "text": "t"}, {"content": [text("NEW")], "text": "t"}),
        ("claude_web", {"sender": "assistant"}, {"sender": "assistant", "text": "NEW"}),
    ]
    df = spark.createDataFrame([(i, s, json.dumps(m)) for i, (s, m, _) in enumerate(cases)], "id int, surface string, m string")
    doc = df.withColumn("doc", V.parse_strict(F.col("m")))
    made = doc.select("id", F.to_json(traffic.per_surface(lambda s: traffic.rewrite_turn(F.col("doc"), s, F.lit("NEW")))).alias("o"))
    assert [json.loads(r.o) for r in made.orderBy("id").collect()] == [e for _, _, e in cases]


def test_block_payloads_read_back(spark):
    now = F.lit(datetime.datetime(2024, 1, 1))
    df = spark.createDataFrame([(s,) for s in traffic.SURFACES], "surface string")
    made = df.withColumn("response_body", traffic.per_surface(lambda s: traffic.block_payload(s, F.lit("m"), F.lit('no "x"\n'), now)))
    back = traffic.normalise(made.withColumn("request_body", F.lit("{}")))
    assert {r.response for r in back.collect()} == {'no "x"\n'}


def test_unreadable_bodies_give_null(spark):
    df = spark.createDataFrame([(1, "gemini", "{", None), (2, "other", "{}", "{}")], SCHEMA)
    assert [(r.prompt, r.response) for r in traffic.normalise(df).orderBy("id").collect()] == [("", ""), (None, None)]


def test_generic_prompts(spark):
    cases = [
        ({"prompt": "", "text": "t"}, ""), ({"content": "c"}, "c"), ({"messages": [{"role": "user", "content": "a"}, {"author": {"role": "user"}, "content": {"parts": []}}]}, "a"),
        ({"messages": [{"sender": "human", "text": [text("a"), "b", {"type": "x"}]}, {"role": "assistant", "content": "z"}]}, "a\n\nb"),
        ({"messages": [{"role": "assistant", "content": "z"}]}, None), ({}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(cases)], "id int, b string")
    got = df.select("id", traffic.generic_prompt(V.parse_strict(F.col("b"))).alias("p")).orderBy("id").collect()
    assert [r.p for r in got] == [p for _, p in cases]


def form(tree):
    return "f.req=" + quote_plus(json.dumps(tree)) + "&at=tok~en"


def test_nested_prompts(spark):
    deep = "the question"
    for _ in range(300):
        deep = [deep]
    cases = [
        (form([None, json.dumps([["abc123", "at_xyz", "see http://x", [json.dumps(["what is it?", "later"])]]])]), "what is it?"),
        (form(deep), "the question"), (form(["short", "longer-than-ten-chars"]), "longer-than-ten-chars"), (form(["no", "id_1", "[broken"]), None),
        (form({"a": "object members are not searched"}), None), ("f.req=notjson", None), ("x=1", None), (None, None),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "id int, b string")
    found = df.withColumn("p", traffic.nested_prompt("b")).withColumn("r", traffic.nested_replace("b", "p", F.lit("safe é")))
    rows = found.orderBy("id").collect()
    assert [r.p for r in rows] == [p for _, p in cases]
    assert "safe é" in json.dumps(json.loads(parse_qs(rows[1].r)["f.req"][0]), ensure_ascii=False)
    assert rows[2].r.endswith("&at=tok%7Een") and json.loads(parse_qs(rows[2].r)["f.req"][0]) == ["short", "safe é"]
    assert rows[5].r == "f.req=notjson" and rows[7].r is None


def delta(t):
    return "data: " + json.dumps({"type": "content_block_delta", "delta": {"text": t}})


def reached(*parts):
    return "data: " + json.dumps({"message": {"content": {"parts": list(parts)}}})


CHUNKS = [
    ("a", 1, "claude", delta("wor") + "\n" + delta("ld") + "\ndata: [DONE]\n"),
    ("a", 0, "claude", "event: x\n" + delta("hello ") + "\ndata: {bro"),
    ("a", 5000, "claude", delta("!")),
    ("a", 2, "claude", 'data: {"type": "ping", "delta": {"text": "no"}}'),
    ("b", 0, "chatgpt", reached("he") + "\n" + reached("hello ", "world") + "\n" + reached("hell")),
    ("b", 1, "chatgpt", reached("hello world and more")),
    ("b", 2, "chatgpt", "data: [DONE]"),
    ("c", 0, "chatgpt", "nothing here"),
]


def test_assembly(spark):
    df = spark.createDataFrame(CHUNKS, "stream_id string, seq bigint, vendor string, data string")
    assert {r.stream_id: r.text for r in traffic.assemble(df).collect()} == {"a": "hello world!", "b": "hello world and more"}


def test_sanitizer(spark):
    patterns = {"d": [r"\b\d{4}\b", r"\b\d{2}/\d{2}\b"], "w": ["stop"], "n": [r"[A-Z]$"]}
    rules = [sanitize.Rule("note", "allow", "n"), sanitize.Rule("hide_d", "redact", "d"), sanitize.Rule("halt", "block", "w"),
             sanitize.Rule("late", "block", "w", block_message="late"), sanitize.Rule("none", "redact", "missing")]
    df = spark.createDataFrame([("a 1234 b 01/02",), ("Stop 1234",), ("fine",), ("word\\$1 9999",)], "t string")
    got = [(r.verdict, r.processed, r.matched_rules) for r in sanitize.sanitize(df, "t", patterns, rules).collect()]
    assert got == [
        ("redact", "a [REDACTED_HIDE_D] b [REDACTED_HIDE_D]", ["hide_d"]),
        ("block", sanitize.DEFAULT_BLOCK_MESSAGE, ["halt"]),
        ("allow", "fine", ["note"]),
        ("redact", "word\\$1 [REDACTED_HIDE_D]", ["hide_d"]),
    ]


def test_label_keeping_mask(spark):
    df = spark.createDataFrame([("DOB: 01/02/1990, born on 1990-01-02; date of birth  3-4-90; dob 1990",)], "t string")
    assert df.select(sanitize.mask_labelled(F.col("t")).alias("m")).first().m == (
        "DOB: [redacted], born on [redacted]; date of birth  [redacted]; dob 1990"
    )
