import hashlib
import random

from pyspark.sql import functions as F

from vigilake.functions import spread
from vigilake.operators import history

TURNS = "conv_id int, turn int, role string, text string, is_block boolean"


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system"])
            rows.append((conv, turn * 3, role, f"t{turn}", role == "assistant" and rng.random() < 0.6))
    return rows


def python_strip(turns):
    kept = []
    for t in turns:
        if t[4]:
            if kept and kept[-1][2] == "user":
                kept.pop()
        else:
            kept.append(t)
    return kept


def python_purge(turns):
    kept, i = [], 0
    while i < len(turns):
        if turns[i][2] == "user" and i + 1 < len(turns) and turns[i + 1][4]:
            i += 2
            continue
        if not turns[i][4]:
            kept.append(turns[i])
        i += 1
    return kept


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_strip_and_purge_equal_python_models(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK_TURNS", 7)
    rows = conversations(3)
    df = spark.createDataFrame(rows, TURNS)
    for operator, model in ((history.strip_blocks, python_strip), (history.purge_marked, python_purge)):
        got = sorted((r.conv_id, r.turn) for r in operator(df).collect())
        expected = sorted((t[0], t[1]) for turns in by_conversation(rows).values() for t in model(turns))
        assert got == expected
    counts = {r.conv_id: r.dropped for r in history.stripped_counts(df).collect()}
    assert counts == {c: n for c, n in ((c, sum(t[4] for t in ts)) for c, ts in by_conversation(rows).items()) if n}


def test_strip_inside_a_row_equals_the_table_form(spark):
    rows = conversations(4)
    df = spark.createDataFrame(rows, TURNS)
    packed = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "is_block"))).alias("turns"))
    kept = packed.select("conv_id", F.inline(history.strip_blocks_in_row(F.col("turns"))))
    assert sorted((r.conv_id, r.turn) for r in kept.collect()) == sorted((r.conv_id, r.turn) for r in history.strip_blocks(df).collect())


def test_swap_back_with_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_ROWS", 10)
    monkeypatch.setattr(spread.salted_lookup, "__defaults__", (10,))
    rows = [(1, t, "assistant" if t % 2 else "user", "[masked]" if t % 4 else f"own {t}") for t in range(400)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    known = spark.createDataFrame([("[masked]", "first", 1), ("[masked]", "last", 2), ("same", "same", 3), ("", "x", 4)], "redacted string, original string, seq int")
    pairs = history.redaction_pairs(known)
    assert pairs.count() == 2
    done = history.swap_back(turns, pairs).orderBy("turn").collect()
    assert len(done) == 400
    for (_, turn, role, text), row in zip(rows, done):
        swapped = role == "assistant" and text == "[masked]"
        assert (row.turn, row.swapped, row.text) == (turn, swapped, "last" if swapped else text)


def test_block_hashes(spark):
    told = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "text string")
    assert {r.text_hash for r in history.block_hashes(told).collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in "ab"}
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "a"), (1, 2, "model", "b"), (1, 3, "assistant", "c")], "conv_id int, turn int, role string, text string")
    marked = history.with_blocks(turns, history.block_hashes(told))
    assert [r.is_block for r in marked.orderBy("turn").collect()] == [False, True, True, False]
