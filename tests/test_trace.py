import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from vigilake.operators import registry, trace, traps
from vigilake.sources import files, lines


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def hook(**fields):
    return {"event": "AfterTool", "session_id": "session-one", **fields}


def translated(spark, path):
    return trace.translate(lines.hooks(lines.read_lines(spark, path))).orderBy("file", "line_no").collect()


def test_translation(spark, tmp_path):
    log = write(tmp_path / "hooks.jsonl", [
        {"event": "SESSION_START", "session_id": "session-one"},
        hook(operation="BASH", target="a", content="{'out': 'it''s', 'returncode': 0}", timestamp="t0", tool="Bash"),
        hook(operation="BASH", target="b", content="{'out': None, 'returncode': 1}", ts="t1"),
        "", "not json", "[]", '{"event": "AfterTool"} trailing', "   ",
        hook(operation="READ", target="c", content="{'x': 1}"),
        hook(operation="READ", target="c", content='{"x": [1, 2.5]}'),
        hook(op="READ", target="c", content="plain é", intent="go"),
        {"event": "AfterModel", "op": "decision", "operation": "x", "strategic_vector": {"intent": "see "}},
    ])
    nodes = translated(spark, log)
    assert [n.node_id for n in nodes] == [f"hsession--{i:05}" for i in range(1, 6)] + ["hunknown-00001"]
    assert [n.parent_id for n in nodes] == [None, *(f"hsession--{i:05}" for i in range(1, 5)), None]
    assert [n.audit_flags for n in nodes] == [[], [trace.CRITICAL], [], [], [trace.CIRCULAR], [trace.LOW]]
    assert [n.timestamp for n in nodes][:3] == ["t0", "t1", None]
    assert [n.name for n in nodes] == ["Bash", "bash", "read", "read", "read", "x"]
    assert (nodes[5].type, nodes[5].provenance, nodes[0].type) == ("NODE_LOGIC", trace.INJECTED, "NODE_TOOL")
    outputs = [json.loads(n.outputs) for n in nodes]
    assert outputs == [{"out": "its", "returncode": 0}, {"out": None, "returncode": 1}, {"x": 1}, {"x": [1, 2.5]}, {"text": "plain é"}, {}]
    assert json.loads(nodes[4].inputs) == {"target": "c", "cwd": None, "intent": "go"}


@pytest.mark.parametrize(
    ("content", "flagged"),
    [
        ("An error here", True), ("failures", False), ("FAILED", True), ("exit_code: 3", True), ("exitCode=0", False),
        ("returncode: -1", False), ('{"returncode": -1}', True), ("{'exit_code': True}", True), ('{"exit_code": 1.5}', True),
        ('{"exit_code": "0"}', False), ("{'exitCode': 0.0}", False), (None, False), ("", False), ("{'a': 1", False),
        ("{" + "'k': '" + "x" * 9000 + "', 'returncode': 7}", True), ("{'k': '" + "x" * 9000 + "', 'returncode': -7}", False),
    ],
)
def test_critical(spark, content, flagged):
    df = spark.createDataFrame([(content,)], "content string")
    row = trace.with_outputs(df).select(trace.critical().alias("c"), "outputs").first()
    assert row.c == flagged
    assert len(json.loads(row.outputs).get("text", "")) <= trace.OUTPUT_CHARS


def python_circular(events):
    recent, flags = deque(maxlen=10), []
    for op, target in events:
        hit = bool(op and target and target != "none" and sum(1 for e in recent if e == (op, target)) + 1 >= 3)
        flags.append(hit)
        if op and target:
            recent.append((op, target))
    return flags


@pytest.mark.parametrize("block", [10, 16, 65_536])
def test_circular_equals_a_bounded_queue(spark, monkeypatch, block):
    monkeypatch.setattr(trace, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = []
    for log in ("f1", "f2"):
        events = [(rng.choice(["a", "b", None, ""]) if rng.random() < 0.3 else "a", rng.choice(["x", "y", "none", "", None, "z"])) for _ in range(700)]
        rows += [(log, i, op, t, flag) for i, ((op, t), flag) in enumerate(zip(events, python_circular(events)))]
    df = spark.createDataFrame(rows, "file string, line_no int, op string, target string, expected boolean")
    got = trace.with_circular(df, scope=["file"], order="line_no", operation=F.col("op"), target=F.col("target"))
    assert got.count() == len(rows) and got.where("circular <> expected").count() == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    log = write(tmp_path / "big.log", [f"line {i} {'é' * (i % 50)}" for i in range(5000)])
    write(tmp_path / "small.log", ["one", "two"])
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        read = lines.read_lines(spark, str(tmp_path))
        rows = read.where(F.col("file").endswith("big.log")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line_no for r in rows] == list(range(5000))
    assert [int(r.line.split()[1]) for r in rows] == list(range(5000))
    assert log.endswith("big.log") and read.where(F.col("file").endswith("small.log")).count() == 2


def test_run_dump(spark, tmp_path):
    def run(i, kind, inputs, error=None, parent="r0"):
        return {"run_id": f"r{i}", "parent_run_id": parent, "run_type": kind, "name": "n", "inputs": inputs, "outputs": None,
                "error": error, "start_time": f"t{i}", "end_time": None}

    dump = [run(0, "chain", {"q": 1}, parent=None), run(1, "tool", {"a": 1, "b": 2}), run(2, "llm", {"a": 1}, error=""),
            run(3, "tool", {"b": 2, "a": 1}), run(4, "tool", {"a": 1, "b": 2}, error="boom"), run(5, "llm", {"q": 1})]
    (tmp_path / "d.json").write_text(json.dumps(dump, indent=1))
    nodes = trace.ingest_runs(files.run_dumps(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [n.type for n in nodes] == ["CLUSTER", "NODE_TOOL", "NODE_LOGIC", "NODE_TOOL", "NODE_TOOL", "NODE_LOGIC"]
    assert [n.audit_flags for n in nodes] == [[], [], [], [], [trace.CIRCULAR, trace.CRITICAL], []]
    assert {n.provenance for n in nodes} == {trace.EXTERNAL_RUN}


NODE = "file string, line_no int, node_id string, parent_id string, type string, name string, inputs string, provenance string, audit_flags array<string>"


def test_parents_edges_and_filters(spark):
    rows = [
        ("f", 0, "a", None, "T1", "n", '{"k":"' + "v" * 200 + '"}', "PROV_NATURAL", []),
        ("f", 1, "b", "a", "T2", "n", "{}", "PROV_INJECTED", ["F1"]),
        ("f", 2, "a", "", "T3", "n", '{"last":1}', "PROV_SPECULATIVE", ["F1", "F2"]),
        ("f", 3, "c", "a", "T2", "n", "{}", "PROV_SPECULATIVE", []),
        ("f", 4, "d", "missing", "T2", "n", "{}", None, ["F2"]),
    ]
    df = spark.createDataFrame(rows, NODE)
    parents = {r.node_id + str(r.line_no): (r.parent_type, r.parent_inputs) for r in trace.with_parent(df).collect()}
    assert parents == {"a0": (None, None), "b1": ("T3", '{"last":1}'), "a2": (None, None), "c3": ("T3", '{"last":1}'), "d4": (None, None)}
    assert sorted((r["from"], r.to, r.type) for r in trace.edges(df).collect()) == [
        ("a", "b", "INJECTION_LINK"), ("a", "c", "SPECULATIVE_BRANCH"), ("missing", "d", "CAUSAL_LINK")
    ]
    assert [r.line_no for r in trace.filter_nodes(df, "T2", "F1").collect()] == [1]
    assert trace.filter_nodes(df, node_id="a").count() == 2
    assert trace.with_parent(df.where("line_no = 0")).first().parent_inputs is None


def test_session_directory(spark, tmp_path):
    def node(i, **more):
        return {"node_id": f"n{i}", "parent_id": f"n{i - 1}" if i else None, **more}

    write(tmp_path / "h1" / "s1" / "a.jsonl", [
        node(0, provenance="PROV_NATURAL"), "broken", node(1, provenance="PROV_NATURAL"), node(2, provenance="PROV_INJECTED"),
        node(3, provenance="PROV_SPECULATIVE"), node(4), node(5, provenance=None)])
    write(tmp_path / "h2" / "s2" / "b.jsonl", [node(0)])
    nodes = trace.with_default_provenance(lines.session_nodes(spark, str(tmp_path)))
    assert [(r.host, r.session_id) for r in trace.sessions(nodes).collect()] == [("h1", "s1"), ("h2", "s2")]
    mine = nodes.where("session_id = 's1'")
    assert [r.provenance for r in mine.orderBy("line_no").collect()][-2:] == ["PROV_NATURAL", None]
    kinds = [r.type for r in trace.edges(mine).orderBy("to").collect()]
    assert kinds == ["CAUSAL_LINK", "INJECTION_LINK", "SPECULATIVE_BRANCH", "CAUSAL_LINK", "CAUSAL_LINK"]
    assert trace.edges(nodes.where("session_id = 'none'")).count() == 0


def test_traps(spark):
    nodes = spark.createDataFrame(
        [("a", "T", "n", [trace.CIRCULAR]), ("b", "T", "n", [trace.CRITICAL, trace.CIRCULAR, trace.CIRCULAR]), ("c", "T", "n", [])],
        "node_id string, type string, name string, audit_flags array<string>",
    )
    table = traps.add(traps.add(traps.empty(spark), "p", "ON_RETRY", "ACTION_HALT", limit=3), "p", "ON_ERROR", "ACTION_BRANCH")
    table = traps.add(table, "q", "ON_ERROR", "ACTION_HALT")
    assert [r.id for r in traps.of_project(table, "p").orderBy("id").collect()] == ["TRAP-1", "TRAP-2"]
    mine = traps.of_project(table, "p")
    for limit in ("-1", "10m"):  # sorted and broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        events = traps.match(nodes, mine)
        assert sorted((e.trap_id, e.node_id) for e in events.collect()) == [("TRAP-1", "a"), ("TRAP-1", "b"), ("TRAP-2", "b")]
    assert tuple(traps.summary(events, mine).first()) == (2, 3, True)
    paused = mine.withColumn("status", F.lit("paused"))
    assert tuple(traps.summary(traps.match(nodes, paused), paused).first()) == (0, 0, False)
    assert traps.clear(table, "p").count() == 1
    with pytest.raises(ValueError):
        traps.add(table, "p", "ON_SUNDAY", "ACTION_HALT")
    with pytest.raises(ValueError):
        traps.add(table, "p", "ON_ERROR", "ACTION_SING")


def test_registry(spark, tmp_path):
    write(tmp_path / "p1" / "b.json", ['{"id": 2, "description": "Fix the Gate"}'])
    write(tmp_path / "p1" / "a.json", ['{"id": 1, "description": "other"}'])
    write(tmp_path / "p1" / "c.json", ["{broken gate"])
    write(tmp_path / "p2" / "d.json", ['{"id": 3}'])
    tasks = files.registry_tasks(spark, str(tmp_path))
    assert [(r.file, json.loads(r.task)["id"]) for r in registry.snapshot(tasks, "p1").collect()] == [("a.json", 1), ("b.json", 2)]
    found = registry.search(tasks.where("project = 'p1'"), "GATE").collect()
    assert sorted(r.task for r in found) == ['{"description":"Fix the Gate","id":2}', "{}"]
