"""Streaming forms. Where an operator is a narrow stage the batch function is used as it is."""

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilake.functions.once import with_once
from vigilake.operators import reports, sanitize, traffic, traps
from vigilake.operators.evaluate import Clock
from vigilake.operators.exchange import evaluate_exchanges, evaluate_single_phase
from vigilake.operators.policies import PolicySet
from vigilake.operators.receipts import build_receipts, verify
from vigilake.operators.taxonomy import Taxonomy
from vigilake.session import checkpoint_dir
from vigilake.sinks.files import RECEIPT_PARTITIONS
from vigilake.sources.files import with_receipt
from vigilake.streaming import state


def _checkpoint(df: DataFrame, name: str) -> str:
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}"


def receipts_of_exchanges(
    exchanges: DataFrame, taxonomies: list[Taxonomy], policy_set: PolicySet, clock: Clock, **options
) -> DataFrame:
    """Receipts of exchanges as they arrive: stateless, the batch plan on a stream."""
    return build_receipts(evaluate_exchanges(exchanges, taxonomies, policy_set, clock), clock.now, **options)


def tail_receipts(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """Receipts as their files land, one per line."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).text(path)
    return with_receipt(lines.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path")))


def store_receipts(spark: SparkSession, tree: str, table: str, name: str = "store", once: bool = False) -> StreamingQuery:
    """Keep a table for reports up to date with a growing receipt tree.

    Each file is read, parsed and verified once, when it lands; the table is partitioned by day and
    legal hold and keeps the outcome as ``status``, unreadable receipts included (their day is NULL).
    """
    landed = tail_receipts(spark, tree)
    rows = verify(landed).select("receipt", "raw", "path", "status", "day", reports.held().alias("held"))
    writer = rows.writeStream.format("parquet").partitionBy(*RECEIPT_PARTITIONS).option("path", table)
    writer = writer.option("checkpointLocation", _checkpoint(rows, name)).queryName(name).outputMode("append")
    return _start(writer, spark, once)


def siem_lines(receipts: DataFrame) -> DataFrame:
    rows = reports.siem_rows(receipts)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def live_traps(nodes: DataFrame, trap_table: DataFrame) -> DataFrame:
    """Trap events of nodes as they arrive; the trap table is static."""
    return traps.match(nodes, trap_table)


def masked_chunks(chunks: DataFrame) -> DataFrame:
    """Mask labelled dates chunk by chunk; a date split over two chunks is not seen. masked_streams() sees it."""
    return chunks.withColumn("data", sanitize.mask_labelled(F.col("data")))


MASKED = "stream_id string, seq bigint, part int, before string, data string"


def masked_streams(chunks: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Mask labelled dates of streams (stream_id, seq, data, last), also those split over chunks.

    A chunk's end that may be the beginning of a labelled date is held back and comes with a later chunk,
    at the stream's ``last`` one, or after ``idle_ms`` without one (as part 1 of the last chunk). Joined
    in the order of (seq, part), a stream's chunks are its whole text, masked.
    """
    given = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", F.coalesce("data", F.lit("")).alias("data"), "last")
    cut = given.groupBy("stream_id").transformWithState(state.LabelledDates(idle_ms), MASKED, "Append", "ProcessingTime")
    masked = sanitize.mask_labelled(F.concat("before", "data"))
    return cut.select("stream_id", "seq", "part", F.substring(masked, F.length("before") + 1, F.length(masked)).alias("data"))


FLAGGED = "file string, line_no bigint, seq bigint, circular boolean"


def live_circular(events: DataFrame, session_ttl_ms: int | None = None) -> DataFrame:
    """Sequence numbers and circular flags of a live log (file, line_no, session_id, op, target).

    The state of a file is its last LOOKBACK eligible events and a counter per session; with
    ``session_ttl_ms`` a session that was silent for so long is forgotten and would count from 1 again.
    Lines must arrive in order, as a log is tailed; the look-back spans all sessions of a log, so
    a log is one key by nature, and many logs run in parallel.
    """
    usable = events.select("file", "line_no", *[F.coalesce(c, F.lit("")).alias(c) for c in ("session_id", "op", "target")])
    mode = "None" if session_ttl_ms is None else "ProcessingTime"
    return usable.groupBy("file").transformWithStateInPandas(state.CircularLog(session_ttl_ms), FLAGGED, "Append", mode)


ASSEMBLED = "stream_id string, vendor string, text string"


def assembled_streams(chunks: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Text of each stream at its end (stream_id, seq, vendor, data, last).

    A stream ends with its ``last`` chunk, or when none came for ``idle_ms``. The
    frames are parsed in the JVM; only their texts reach the state.
    """
    texts = with_once(chunks, {"text": traffic.frame_text(F.col("data"), F.col("vendor"))})
    given = texts.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", "vendor", "text", "last")
    return given.groupBy("stream_id").transformWithState(state.StreamAssembler(idle_ms), ASSEMBLED, "Append", "ProcessingTime")


def open_streams(spark: SparkSession, name: str) -> DataFrame:
    """Text so far of the streams that a stopped run of assembled_streams() left open."""
    stored = spark.read.format("statestore").option("flattenCollectionTypes", "false")
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    heads = stored.option("stateVarName", "head").load(path).select("key.stream_id", "value.vendor", "value.reached")
    texts = stored.option("stateVarName", "texts").load(path).select("key.stream_id", F.array_join(F.transform("list_value", lambda t: t["text"]), "").alias("joined"))
    left = heads.join(texts, "stream_id", "left")
    text = F.when(F.col("vendor") == "chatgpt", F.col("reached")).otherwise(F.coalesce("joined", F.lit("")))
    return left.select("stream_id", "vendor", text.alias("text")).where("text <> ''")


def settle(query: StreamingQuery, seconds: float = 600) -> None:
    """Wait until a query has read what is there and no key has state left, then stop it.

    The time counts from the last batch that read rows or changed how much state there is, and only a batch that
    ended is judged: however long it takes to read and evaluate what is there is no reason to give up.
    """
    seen, state_left, until = None, None, 0.0
    # Timers ask for batches without data forever, so processAllAvailable() would not return.
    while query.isActive:
        done = query.lastProgress
        if done and done["timestamp"] != seen:
            seen, left = done["timestamp"], sum(o["numRowsTotal"] for o in done["stateOperators"])
            if not done["numInputRows"] and not left:
                query.stop()
                return
            if done["numInputRows"] or left != state_left:
                state_left, until = left, time.monotonic() + seconds
            elif time.monotonic() > until:
                query.stop()
                raise TimeoutError(f"state was left as it is for {seconds} seconds")
        time.sleep(0.2)
    raise query.exception() or RuntimeError("the query was stopped before its state was empty")


def audited_streams(
    assembled: DataFrame, taxonomies: list[Taxonomy], policy_set: PolicySet, clock: Clock
) -> DataFrame:
    """Evaluate each assembled stream as a lone response."""
    records = assembled.select(F.col("stream_id").alias("exchange_id"), F.lit("response").alias("direction"), "text")
    return evaluate_single_phase(records, taxonomies, policy_set, clock)


# One start at a time changes the session's setting.
_SWITCHED = threading.Lock()


def _start(writer, spark: SparkSession, once: bool) -> StreamingQuery:
    if not once:
        return writer.start()
    # An operator with a processing-time timeout asks for another batch forever, so a run
    # over what is there must not go on without data. The query keeps the value it starts with.
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    with _SWITCHED:
        before = spark.conf.get(key, "true")
        spark.conf.set(key, "false")
        try:
            return writer.trigger(availableNow=True).start()
        finally:
            spark.conf.set(key, before)


def start_files(df: DataFrame, path: str, name: str, fmt: str = "json", once: bool = False) -> StreamingQuery:
    """Write a stream to files, exactly once, with its checkpoint in the shared folder."""
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", _checkpoint(df, name))
    writer = writer.queryName(name).outputMode("append")
    return _start(writer, df.sparkSession, once)


def start_receipts(built: DataFrame, path: str, name: str = "receipts", once: bool = False) -> StreamingQuery:
    """Receipt lines by day from a stream of build_receipts() rows."""
    lines = built.select("day", F.col("raw").alias("value"))
    writer = lines.writeStream.format("text").partitionBy("day").option("path", path)
    writer = writer.option("checkpointLocation", _checkpoint(built, name)).queryName(name).outputMode("append")
    return _start(writer, built.sparkSession, once)
