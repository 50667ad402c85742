"""Many small files: packed folders against loose ones, and how many files the queries and sinks write."""

import json
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vigilake.operators import trace
from vigilake.plans import evaluation, roundtrips
from vigilake.sinks import files as sinks
from vigilake.sources import files

TREE = {
    "a.yaml": b"a: 1\n", "b.yml": b"b", "notes.txt": b"no", ".hidden.yaml": b"h", "_note.yaml": b"h", "empty.yaml": b"",
    "of=x/c.yaml": b"\xff\xfe", "of=x/d.json": b'{"k": 1}', "of=x/y=1/e.yaml": b"e\r\ne", "below/f.yaml": b"f", "below/_g/h.yaml": b"x", "ayaml": b"x",
}


def written(path) -> int:
    return len(list(Path(path).rglob("part-*")))


def test_packed_folders_equal_loose_ones(spark, tmp_path):
    for name, content in TREE.items():
        (tmp_path / "loose" / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "loose" / "tree" / name).write_bytes(content)
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in TREE.items()], "path string, content binary")
    sinks.write_packed(rows, str(tmp_path / "packed" / "tree"))

    def told(df):
        return sorted(tuple(str(v).split("/tree")[-1] for v in row) for row in df.collect())

    sources = [
        lambda path, packed: files.policy_files(spark, path, packed=packed), lambda path, packed: files.policy_files(spark, path, "?.y[a-m]*l", packed=packed),
        lambda path, packed: files.registry_tasks(spark, path, "*.{yaml,json}", packed=packed).withColumn("raw", F.hex("raw")),
        lambda path, packed: files.receipt_files(spark, [path], packed=packed),
    ]
    for source in sources:
        loose = told(source(str(tmp_path / "loose" / "tree"), False))
        assert loose and told(source(str(tmp_path / "packed" / "tree"), True)) == loose
    near = files.text_files(spark, str(tmp_path / "packed" / "tree"), packed=True).collect()
    assert sorted(r.exchange_id.split("/tree/")[1] for r in near) == ["a.yaml", "ayaml", "b.yml", "notes.txt", "of=x/c.yaml", "of=x/d.json", "of=x/y=1/e.yaml"]


def test_a_tree_of_policies_is_packed(spark):
    path = roundtrips.policy_tree(spark, "/root/testdata/sf0.001")
    assert files.policy_files(spark, path, "*.txt", packed=True).count() == 200
    assert written(path) <= 2 * spark.sparkContext.defaultParallelism


def test_packed_files_without_a_key_are_kept(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "k int, v string")
    path = roundtrips.fresh(spark, "packed")
    sinks.write_packed(rows.select(*roundtrips.packed_file(F.col("v"), "k")), path)
    read = files.registry_tasks(spark, path, "*.txt", packed=True).collect()
    assert sorted((r.project, r.raw) for r in read) == [("k=1", "\n")] + [("k=__HIVE_DEFAULT_PARTITION__", "a\n")] * 2


def test_policies_are_spread_over_the_cores(spark):
    assert evaluation.policy_files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_chunks_are_written_where_their_documents_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(roundtrips, "fresh", lambda spark, name: str(tmp_path / name))
    roundtrips.chunk_stream(spark, "/root/testdata/sf0.001")
    assert written(tmp_path / "in-chunks") >= spark.sparkContext.defaultParallelism


def test_packed_lines_equal_loose_ones(spark, tmp_path):
    import random

    from vigilake.sources import lines

    rng, rows = random.Random(4), []
    for log in ("a", "of=x/b", "of=x/c", ".hidden"):
        for place in sorted(rng.sample(range(100_000), 60)):
            rows += [(f"{log}.log", place, part, value) for part, value in enumerate(rng.choices(["", "one", "é {}", '{"k": "v"}', "x\ry", " "], k=rng.randint(1, 3)))]
    for name in {r[0] for r in rows}:
        (tmp_path / "loose/tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "loose/tree" / name).write_text("".join(f"{r[3]}\n" for r in rows if r[0] == name), newline="")
    rng.shuffle(rows)
    sinks.write_packed_lines(spark.createDataFrame(rows, "path string, place bigint, part int, value string"), str(tmp_path / "packed/tree"), ("place", "part"))

    def told(read):
        return sorted((r.file.split("/tree/")[1], r.line_no, r.line) for r in read.collect())

    loose = told(lines.read_lines(spark, str(tmp_path / "loose/tree"), recursive=True))
    assert len(loose) > 300 and told(lines.read_lines(spark, str(tmp_path / "packed/tree"), recursive=True, packed=True)) == loose
    near = told(lines.read_lines(spark, str(tmp_path / "packed/tree"), "a*", packed=True))
    assert near == [r for r in loose if r[0] == "a.log"]


def test_hook_logs_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(roundtrips, "fresh", lambda spark, name: str(tmp_path / name))
    events = [(i, i * 7 % 400, "click", '{"k": 1}') for i in range(400)]
    rows = spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, props string").withColumn("ts", F.timestamp_seconds("event_id"))
    rows.write.parquet(str(tmp_path / "t" / "events.parquet"))
    roundtrips.hook_logs(spark, str(tmp_path / "t"))
    assert 0 < written(tmp_path / "hooks") <= 2 * spark.sparkContext.defaultParallelism


def test_runs_of_packed_dumps_stay_off_the_driver(spark, tmp_path):
    # A total for each run: from the packed files' size the optimizer would broadcast them.
    runs = [{"run_id": f"r{i}", "run_type": ("tool", "chain")[i % 2], "inputs": {"k": i % 4}} for i in range(40)]
    rows = spark.createDataFrame([(f"d{j}.json", bytearray(json.dumps(runs).encode())) for j in range(50)], "path string, content binary")
    sinks.write_packed(rows, str(tmp_path / "dumps"))
    nodes = trace.ingest_runs(files.run_dumps(spark, str(tmp_path / "dumps"), packed=True))
    found = nodes.collect()
    assert len(found) == 2000 and sum(trace.CIRCULAR in n.audit_flags for n in found) == 50 * 18
    assert "BroadcastExchange" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_row_groups_of_packed_files_are_small(spark, tmp_path):
    # A reader holds thousands of rows of a row group at once, here of 60 KB each.
    rows = spark.range(2000, numPartitions=1).select(F.concat("id", F.lit(".txt")).alias("path"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 480).alias("content"))
    sinks.write_packed(rows, str(tmp_path / "files"))
    (part,) = (tmp_path / "files").rglob("part-*.parquet")
    groups = pq.ParquetFile(part).metadata
    assert max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 500
