import datetime
import json
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F
from test_traffic import CHUNKS
from vigilake.operators import sanitize
from vigilake.operators.evaluate import Clock
from vigilake.operators.policies import Policy, PolicySet
from vigilake.operators.taxonomy import taxonomy
from vigilake.streaming import jobs

CLOCK = Clock(datetime.datetime(2024, 1, 1))
WORDS = taxonomy("n", [{"class": "a", "recognizer": "keyword_list", "pattern": ["world"]}])
RULES = PolicySet((Policy("r_a", "1", "response", "any", "any_of", ("n:a",), "redact", redact_with="#"),), "v")


def through(spark, df, make, tmp_path, name, partitions=2):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(partitions).write.parquet(source)
    stream = make(spark.readStream.schema(df.schema).parquet(source))
    jobs.start_files(stream, out, f"{name}-{uuid.uuid4().hex}", "parquet", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def test_streams_are_assembled_and_audited(spark, tmp_path):
    rows = [(*c, c[1] in (5000, 2) and c[:2] != ("a", 2)) for c in CHUNKS]
    df = spark.createDataFrame(rows, "stream_id string, seq bigint, vendor string, data string, last boolean")
    got = through(
        spark, df, lambda s: jobs.audited_streams(jobs.assembled_streams(s), [WORDS], RULES, CLOCK).select("exchange_id", "text", "verdict", "text_out"),
        tmp_path, "assembly", 1,
    )
    assert sorted(map(tuple, got)) == [
        ("a", "hello world!", "redacted", "hello #!"), ("b", "hello world and more", "redacted", "hello # and more")
    ]


def test_exchanges_become_receipts(spark, tmp_path):
    who = {"user_id": "u", "user_role": None, "department": None, "auth_method": None}
    what = {"tool_id": "t", "tool_version": None, "model_id": "m", "model_vendor": None, "endpoint": None}
    df = spark.createDataFrame(
        [(i, "q", "the world", tuple(who.values()), tuple(what.values())) for i in range(20)],
        f"exchange_id int, prompt string, response string, actor struct<{','.join(f'{k}:string' for k in who)}>, tool struct<{','.join(f'{k}:string' for k in what)}>",
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    built = jobs.receipts_of_exchanges(spark.readStream.schema(df.schema).parquet(source), [WORDS], RULES, CLOCK)
    jobs.start_receipts(built, out, f"receipts-{uuid.uuid4().hex}", once=True).awaitTermination()
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(lines) == 20 and {d["response"]["text"] for d in lines} == {"the #"}


def test_masking_is_per_chunk(spark, tmp_path):
    df = spark.createDataFrame([(1, "DOB: 01/02/1990"), (2, "DOB: 01/"), (3, "02/1990")], "seq int, data string")
    got = sorted((r.seq, r.data) for r in through(spark, df, jobs.masked_chunks, tmp_path, "mask"))
    assert got == [(1, "DOB: [redacted]"), (2, "DOB: 01/"), (3, "02/1990")]


def test_circular_state_survives_restarts(spark, tmp_path):
    source, out, name = str(tmp_path / "in"), str(tmp_path / "out"), f"log-{uuid.uuid4().hex}"
    schema = "file string, line_no bigint, session_id string, op string, target string"
    for batch in range(4):
        rows = [("f", batch * 2 + i, "s", "READ", "x" if batch != 2 else None) for i in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.start_files(jobs.live_circular(stream), out, name, "parquet", once=True).awaitTermination()
    rows = spark.read.parquet(out).orderBy("line_no").collect()
    assert [r.seq for r in rows] == list(range(1, 9))
    assert [r.circular for r in rows] == [False, False, True, True, False, False, True, True]


def test_checkpoints_go_to_the_shared_folder(spark):
    from vigilake.session import checkpoint_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_dir(spark) == (named or spark.sparkContext.getCheckpointDir())


def landed(spark, rows, schema, make, tmp_path, name):
    """Rows that land one file a run; each run goes on from the state of the one before."""
    source, out = str(tmp_path / "in"), str(tmp_path / f"out-{name}")
    for row in rows:
        spark.createDataFrame([row], schema).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        jobs.start_files(stream, out, name, "parquet", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_dates_split_over_chunks_are_masked(spark, tmp_path):
    texts = {
        "a": "He was born on  12/03/1990, DOB: 4/5/99 and DOB12/1/2000; xDOB: 1/1/2000 date of birth 1999-12-31!",
        "b": "éDOB: 1/2/2003 Born, DOB:: 1-2-20031 born o DOB: 199-1 dob 1/1/9",
    }
    rng = random.Random(2)
    for turn in range(3):
        rows = []
        for name, text in texts.items():
            at, seq = 0, 0
            while at < len(text):
                size = rng.randrange(1, 40 if turn else 8)
                rows.append((name, seq, text[at : at + size], at + size >= len(text) and name == "a"))
                at, seq = at + size, seq + 1
        schema = "stream_id string, seq bigint, data string, last boolean"
        source, out = str(tmp_path / f"in{turn}"), str(tmp_path / f"out{turn}")
        # Chunks of a stream in batches of three, in order.
        for low in range(0, 100, 3):
            part = [r for r in rows if low <= r[1] < low + 3]
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.settle(jobs.start_files(jobs.masked_streams(files, idle_ms=4000), out, f"masks-{uuid.uuid4().hex}", "parquet"), 120)
        got = {}
        for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r.stream_id, r.seq, r.part)):
            got[r.stream_id] = got.get(r.stream_id, "") + r.data
        whole = spark.createDataFrame(list(texts.items()), "id string, text string").select("id", sanitize.mask_labelled(F.col("text")).alias("text"))
        assert got == {r.id: r.text for r in whole.collect()}


def test_idle_streams_end_by_their_timer(spark, tmp_path):
    schema = "stream_id string, seq bigint, vendor string, data string, last boolean"
    frame = 'data: {"type": "content_block_delta", "delta": {"text": "%s"}}'
    rows = [("s", 0, "claude", frame % "one ", False), ("s", 1, "claude", frame % "two", False), ("t", 0, "claude", frame % "end", True), ("u", 0, "claude", "data: {}", False)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = jobs.assembled_streams(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle_ms=1500)
    out = str(tmp_path / "out")
    jobs.settle(jobs.start_files(stream, out, f"idle-{uuid.uuid4().hex}", "parquet"), 120)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("s", "claude", "one two"), ("t", "claude", "end")}


def test_open_streams_are_read_from_state(spark, tmp_path):
    schema = "stream_id string, seq bigint, vendor string, data string, last boolean"
    frame = 'data: {"type": "content_block_delta", "delta": {"text": "%s"}}'
    full = 'data: {"message": {"content": {"parts": ["%s"]}}}'
    rows = [("s", 0, "claude", frame % "one ", False), ("s", 1, "claude", frame % "two", False), ("c", 0, "chatgpt", full % "a", False), ("c", 1, "chatgpt", full % "ab", False)]
    name = f"open-{uuid.uuid4().hex}"
    done = landed(spark, rows, schema, lambda s: jobs.assembled_streams(s, idle_ms=3_600_000), tmp_path, name)
    assert done.count() == 0
    assert {tuple(r) for r in jobs.open_streams(spark, name).collect()} == {("s", "claude", "one two"), ("c", "chatgpt", "ab")}


def test_silent_sessions_are_forgotten(spark, tmp_path):
    schema = "file string, line_no bigint, session_id string, op string, target string"
    source, out, name = str(tmp_path / "in"), str(tmp_path / "out"), f"ttl-{uuid.uuid4().hex}"
    for batch, wait in enumerate((0, 3)):
        time.sleep(wait)
        spark.createDataFrame([("f", batch, "s", "READ", "x")], schema).write.mode("append").parquet(source)
        stream = jobs.live_circular(spark.readStream.schema(schema).parquet(source), session_ttl_ms=1500)
        jobs.start_files(stream, out, name, "parquet", once=True).awaitTermination()
    assert [r.seq for r in spark.read.parquet(out).orderBy("line_no").collect()] == [1, 1]


class Batches:
    """A query whose batches end one after the other: (seconds, rows read, state left)."""

    def __init__(self, *batches):
        self.batches, self.begun, self.isActive = batches, time.monotonic(), True

    @property
    def lastProgress(self):
        ended, told = self.begun, None
        for i, (seconds, rows, left) in enumerate(self.batches):
            ended += seconds
            if ended <= time.monotonic():
                told = {"timestamp": str(i), "numInputRows": rows, "stateOperators": [{"numRowsTotal": left}]}
        return told

    def exception(self):
        return None

    def stop(self):
        self.isActive = False


def test_long_work_is_waited_for():
    jobs.settle(Batches((1.5, 9, 4), (0.7, 0, 2), (0.7, 0, 0)), 1)
    with pytest.raises(TimeoutError):
        jobs.settle(Batches((0.1, 9, 4), *[(0.4, 0, 4)] * 10), 1)
