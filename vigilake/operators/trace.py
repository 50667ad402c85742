"""Agent logs as trace nodes: translation, run dumps, filters, edges."""

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigilake.functions import variant as V
from vigilake.functions.once import with_once
from vigilake.functions.spread import prefix_sum, salted_lookup
from vigilake.functions.text import truthy

# Names, limits and patterns of the node format.
SESSION_START = "SESSION_START"
CRITICAL, CIRCULAR, LOW = "FLAG_CRITICAL_FAILURE", "FLAG_CIRCULAR_REASONING", "FLAG_CONFIDENCE_LOW"
NATURAL, INJECTED, SPECULATIVE = "PROV_NATURAL", "PROV_INJECTED", "PROV_SPECULATIVE"
EXTERNAL_RUN = "PROV_EXTERNAL_LANGCHAIN"
LOOKBACK = 10
REPEATS = 3
OUTPUT_CHARS = 8192
PARENT_INPUT_CHARS = 100
ERROR_WORDS = r"(?iuU)\b(Error|Traceback|Exception|FAIL(?:ED|URE)?)\b"
NONZERO_EXIT = r"""(?U)['"]?(?:returncode|exit_code|exitCode)['"]?\s*[:=]\s*([1-9]\d*)"""
EXIT_KEYS = ("returncode", "exit_code", "exitCode")

# Rows of one task in ordered work; the look-back never spans more than two such blocks.
BLOCK_ROWS = 65_536


def hook_fields(doc: Column) -> dict[str, Column]:
    """Columns of one hook event, read from its JSON object."""
    names = ("event", "timestamp", "ts", "operation", "op", "session_id", "cwd", "tool", "target", "content", "intent")
    columns = {n: V.text_at(doc, f"$.{n}") for n in names}
    columns["strategic_intent"] = V.string_at(doc, "$.strategic_vector.intent")
    return columns


def operation(first: str = "operation", second: str = "op") -> Column:
    return F.coalesce(truthy(F.col(first)), truthy(F.col(second)))


def node_type(event: Column) -> Column:
    return F.when(event == "AfterTool", F.lit("NODE_TOOL")).otherwise(F.lit("NODE_LOGIC"))


def provenance() -> Column:
    """``op`` is looked at before ``operation`` here, unlike everywhere else."""
    injected = F.upper(operation("op", "operation")) == "DECISION"
    return F.when(F.coalesce(injected, F.lit(False)), F.lit(INJECTED)).otherwise(F.lit(NATURAL))


@F.pandas_udf(StringType())
def _python_literal(texts: pd.Series) -> pd.Series:
    """JSON of a dict written as a Python literal, None for anything else."""

    def one(text):
        if text is None:
            return None
        try:
            value = ast.literal_eval(text)
            return json.dumps(value, default=str) if isinstance(value, dict) else None
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None

    return texts.map(one)


def with_outputs(hooks: DataFrame, content: str = "content", out: str = "outputs") -> DataFrame:
    """Recover the structure of tool output: JSON, else a Python literal, else plain text.

    Only the first OUTPUT_CHARS characters are kept, as in the node format. Adds
    ``out`` as JSON text and ``exit_nonzero``: whether it holds a non-zero code.
    """
    text = F.substring(content, 1, OUTPUT_CHARS)
    shaped = text.startswith("{") & (text.contains("'") | text.contains('"'))
    parsed = with_once(hooks, {"__json": F.when(shaped, V.parse_strict(text))})
    rest = F.when(shaped & F.col("__json").isNull(), text)
    recovered = parsed.withColumn("__literal", _python_literal(rest))
    whole = with_once(recovered, {"__value": F.coalesce("__json", F.try_parse_json("__literal"))})

    def nonzero(key):
        value = V.at(F.col("__value"), f"$.{key}")
        number = F.when(V.kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint") != 0)
        return F.coalesce(number, F.when(V.kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")), F.lit(False))

    found = F.when(V.is_object(F.col("__value")), nonzero(EXIT_KEYS[0]) | nonzero(EXIT_KEYS[1]) | nonzero(EXIT_KEYS[2]))
    plain = F.when(truthy(F.col(content)).isNull(), F.lit("{}")).otherwise(F.to_json(F.struct(text.alias("text"))))
    return whole.withColumns(
        {out: F.coalesce(F.to_json("__value"), plain), "exit_nonzero": F.coalesce(found, F.lit(False))}
    ).drop("__json", "__literal", "__value")


def critical(content: str = "content") -> Column:
    """Error words or a non-zero exit code anywhere in the whole content, else in the parsed output."""
    raw = F.coalesce(F.col(content), F.lit(""))
    return raw.rlike(ERROR_WORDS) | raw.rlike(NONZERO_EXIT) | F.col("exit_nonzero")


def low_confidence(intent: str = "strategic_intent") -> Column:
    return F.coalesce(F.col(intent).endswith(" "), F.lit(False))


def with_circular(
    events: DataFrame,
    *,
    scope: list[str],
    order: str,
    operation: Column,
    target: Column,
    out: str = "circular",
    base: DataFrame | None = None,
) -> DataFrame:
    """Flag the third same (operation, target) within an event and the 10 eligible ones before it.

    Eligible events have an operation and a target; the target ``none`` takes a
    place in the look-back but is never flagged. ``order`` is a number that grows
    along the scope. The scope is cut into blocks of BLOCK_ROWS eligible events,
    and the last LOOKBACK of a block are copied into the next, so that one long
    scope is many tasks and the result is the same.
    """
    names = {"__op": truthy(operation), "__target": truthy(target)}
    named = events.withColumns(names)
    base = None if base is None else base.withColumns(names)
    eligible = F.col("__op").isNotNull() & F.col("__target").isNotNull()
    block_of_order = F.floor(F.col(order) / BLOCK_ROWS)
    placed = prefix_sum(named, scope, block_of_order, [order], "__r", F.when(eligible, 1).otherwise(0), base)
    own = F.when(eligible, F.floor(F.col("__r") / BLOCK_ROWS)).otherwise(block_of_order)
    copied = eligible & (F.col("__r") % BLOCK_ROWS >= BLOCK_ROWS - LOOKBACK)
    blocks = F.when(copied, F.array(own, own + 1)).otherwise(F.array(own))
    laid = placed.withColumn("__home", own).withColumn("__block", F.explode(blocks))
    window = (
        Window.partitionBy(*scope, "__op", "__target", "__block").orderBy("__r").rangeBetween(-LOOKBACK, -1)
    )
    earlier = F.count("*").over(window)
    flagged = eligible & (F.col("__target") != "none") & (earlier + 1 >= REPEATS)
    counted = laid.withColumn(out, F.coalesce(flagged, F.lit(False)))
    return counted.where("__block = __home").drop("__op", "__target", "__r", "__home", "__block")


def translate(hooks: DataFrame, *, circular_scope: list[str] | None = None) -> DataFrame:
    """Hook events to trace nodes.

    ``hooks`` has ``file``, ``line_no`` and the columns of hook_fields(). Node ids
    count per file and session; the parent is the session's previous node. The
    circular look-back runs over the whole file, over all its sessions, unless
    another ``circular_scope`` is given.
    """
    events = hooks.where(~F.col("event").eqNullSafe(SESSION_START))
    events = events.withColumn("session_id", F.coalesce("session_id", F.lit("unknown")))
    block = F.floor(F.col("line_no") / BLOCK_ROWS)
    numbered = prefix_sum(events, ["file", "session_id"], block, ["line_no"], "seq")
    flagged = with_circular(
        numbered,
        scope=circular_scope or ["file"],
        order="line_no",
        operation=operation(),
        target=F.col("target"),
        base=events,
    )

    def node_id(seq):
        # Zero-padded to five digits; longer numbers are written in full.
        number = seq.cast("string")
        padded = F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0"))
        return F.concat(F.lit("h"), F.substring("session_id", 1, 8), F.lit("-"), padded)

    ready = with_outputs(flagged)
    flags = F.array(
        F.when(critical(), F.lit(CRITICAL)), F.when(F.col("circular"), F.lit(CIRCULAR)), F.when(low_confidence(), F.lit(LOW))
    )
    inputs = F.to_json(F.struct("target", "cwd", "intent"), {"ignoreNullFields": "false"})
    return ready.select(
        "file",
        "line_no",
        F.coalesce(truthy(F.col("timestamp")), F.col("ts")).alias("timestamp"),
        node_id(F.col("seq")).alias("node_id"),
        F.when(F.col("seq") > 1, node_id(F.col("seq") - 1)).alias("parent_id"),
        node_type(F.col("event")).alias("type"),
        F.coalesce(truthy(F.col("tool")), F.lower(F.coalesce(operation(), F.lit("")))).alias("name"),
        inputs.alias("inputs"),
        "outputs",
        provenance().alias("provenance"),
        F.filter(flags, lambda f: f.isNotNull()).alias("audit_flags"),
        "session_id",
    )


def ingest_runs(runs: DataFrame) -> DataFrame:
    """External run records to trace nodes.

    ``runs`` has ``file``, ``pos`` and the fields of a run, with inputs and outputs
    as JSON text. A tool input seen anywhere earlier in its file is circular:
    inputs are numbered per file with the skew-safe prefix sum.
    """
    kind = (
        F.when(F.col("run_type") == "tool", F.lit("NODE_TOOL"))
        .when(F.col("run_type") == "chain", F.lit("CLUSTER"))
        .otherwise(F.lit("NODE_LOGIC"))
    )
    typed = runs.withColumn("type", kind)
    # Other runs get a key of their own each, so they neither repeat nor gather in one task.
    key = F.when(F.col("type") == "NODE_TOOL", F.sha2(F.coalesce("inputs", F.lit("null")), 256)).otherwise(F.concat(F.lit("#"), F.col("pos").cast("string")))
    numbered = prefix_sum(
        typed.withColumn("__input", key), ["file", "__input"], F.floor(F.col("pos") / BLOCK_ROWS), ["pos"], "__nth", many_totals=True
    )
    repeated = (F.col("type") == "NODE_TOOL") & (F.col("__nth") > 1)
    flags = F.array(
        F.when(repeated, F.lit(CIRCULAR)), F.when(truthy(F.col("error")).isNotNull(), F.lit(CRITICAL))
    )
    return numbered.select(
        "file",
        F.col("pos").alias("line_no"),
        F.col("start_time").alias("timestamp"),
        F.col("run_id").alias("node_id"),
        F.col("parent_run_id").alias("parent_id"),
        "type",
        "name",
        "inputs",
        "outputs",
        F.lit(EXTERNAL_RUN).alias("provenance"),
        F.filter(flags, lambda f: f.isNotNull()).alias("audit_flags"),
    )


def filter_nodes(
    nodes: DataFrame, node_type: str | None = None, flag: str | None = None, node_id: str | None = None
) -> DataFrame:
    """Nodes of a type, with a flag, with an id: all given conditions hold."""
    found = nodes
    if node_type:
        found = found.where(F.col("type") == node_type)
    if flag:
        found = found.where(F.array_contains("audit_flags", flag))
    if node_id:
        found = found.where(F.col("node_id") == node_id)
    return found


def with_parent(nodes: DataFrame, among: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Add the parent's id, type and shortened inputs.

    Where several nodes carry the same id the last one in ``order`` counts. A
    parent with very many children is split over tasks.
    """
    rank = F.struct(*(order or ["file", "line_no"]))
    index = (
        (nodes if among is None else among)
        .groupBy(F.col("node_id").alias("parent_id"))
        .agg(F.max_by(F.struct("type", F.substring(F.coalesce("inputs", F.lit("{}")), 1, PARENT_INPUT_CHARS).alias("inputs")), rank).alias("p"))
        .select("parent_id", F.col("p.type").alias("parent_type"), F.col("p.inputs").alias("parent_inputs"))
        .where("parent_id is not null and parent_id <> ''")
    )
    return salted_lookup(nodes, index, "parent_id", "left", "node_id")


def edges(nodes: DataFrame) -> DataFrame:
    """Typed edges of nodes that have a parent id; the parent itself need not exist."""
    kind = (
        F.when(F.col("provenance") == INJECTED, F.lit("INJECTION_LINK"))
        .when(F.col("provenance") == SPECULATIVE, F.lit("SPECULATIVE_BRANCH"))
        .otherwise(F.lit("CAUSAL_LINK"))
    )
    both = truthy(F.col("parent_id")).isNotNull() & truthy(F.col("node_id")).isNotNull()
    extra = [c for c in ("session_id",) if c in nodes.columns]
    return nodes.where(both).select(
        *extra, F.col("parent_id").alias("from"), F.col("node_id").alias("to"), kind.alias("type")
    )


def sessions(nodes: DataFrame) -> DataFrame:
    """Index of the (host, session_id) pairs present."""
    return nodes.select("host", "session_id").distinct().orderBy("host", "session_id")


def with_default_provenance(nodes: DataFrame, given: str = "has_provenance") -> DataFrame:
    """Natural provenance where the member is absent; an explicit null stays null."""
    return nodes.withColumn("provenance", F.when(~F.col(given), F.lit(NATURAL)).otherwise(F.col("provenance")))
