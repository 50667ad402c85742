"""Trace queries over the event table, read as one long agent log with a session per user."""

from pyspark.sql import functions as F

from vigilake import schemas
from vigilake.operators import registry, trace, traps
from vigilake.plans.base import Catalog, stored_once, table
from vigilake.sinks import files as sinks

CATALOG = Catalog()


def hook_events(spark, sf_dir, session: bool = True):
    """Events as hook-log entries: every event type is an operation on one of ten targets."""
    events = table(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    none = F.lit(None).cast("string")
    kind = F.col("event_type")
    code = k % 5
    content = (
        F.when(kind == "error", F.concat(F.lit("{'stdout': 'x', 'returncode': "), (code - 2).cast("string"), F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"exit_code": '), code.cast("string"), F.lit("}")))
        .when((kind == "view") & (k % 7 == 0), F.lit("Traceback of nothing"))
        .when(kind == "click", F.concat(F.lit("clicked "), k.cast("string")))
    )
    return events.select(
        F.lit("events.log").alias("file"),
        F.col("event_id").alias("line_no"),
        F.when(kind == "signup", "SESSION_START").when(kind == "view", "AfterModel").otherwise("AfterTool").alias("event"),
        F.when(k % 2 == 0, stamp).otherwise("").alias("timestamp"),
        F.when(k % 2 == 1, stamp).alias("ts"),
        F.when(k % 3 != 0, F.upper(kind)).alias("operation"),
        F.when(k % 3 == 0, F.when(k % 9 == 0, "decision").otherwise(kind)).alias("op"),
        F.when(F.col("user_id") % 50 != 0, F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0"))).alias("session_id"),
        none.alias("cwd"),
        F.when(k % 4 == 0, F.concat(F.lit("Tool"), (k % 8).cast("string"))).alias("tool"),
        F.when(k % 11 == 0, "none").when(k % 13 == 0, "").otherwise(F.concat(F.lit("t"), (k % 4).cast("string"))).alias("target"),
        content.alias("content"),
        none.alias("intent"),
        F.when(k % 17 == 0, F.lit("look at ")).otherwise(F.lit("look")).alias("strategic_intent"),
    )


# {scope} is what a log file is: the look-back and the numbering stay inside it.
HOOKS_SQL_OF = """WITH raw AS (SELECT *, (props::JSON->>'k')::INT AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events),
  hooks AS (SELECT event_id AS line_no, k, stamp, event_type AS kind,
      CASE WHEN user_id % 50 <> 0 THEN 'user' || lpad(user_id::VARCHAR, 6, '0') ELSE 'unknown' END AS session_id, user_id,
      CASE WHEN k % 3 <> 0 THEN upper(event_type) WHEN k % 9 = 0 THEN 'decision' ELSE event_type END AS oper,
      CASE WHEN k % 4 = 0 THEN 'Tool' || (k % 8) END AS tool,
      CASE WHEN k % 11 = 0 THEN 'none' WHEN k % 13 = 0 THEN '' ELSE 't' || (k % 4) END AS target,
      CASE WHEN event_type = 'error' THEN '{''stdout'': ''x'', ''returncode'': ' || (k % 5 - 2) || '}'
           WHEN event_type = 'purchase' THEN '{"exit_code": ' || (k % 5) || '}'
           WHEN event_type = 'view' AND k % 7 = 0 THEN 'Traceback of nothing'
           WHEN event_type = 'click' THEN 'clicked ' || k END AS content
    FROM raw WHERE event_type <> 'signup'),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY {scope}, session_id ORDER BY line_no) AS seq,
      sum(CASE WHEN target <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY {scope} ORDER BY line_no) AS r FROM hooks),
  flagged AS (SELECT *, CASE WHEN target IN ('', 'none') THEN false ELSE
      1 + count(*) OVER (PARTITION BY {scope}, oper, target ORDER BY r RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 3 END AS circular,
      CASE kind WHEN 'error' THEN k % 5 <> 2 WHEN 'purchase' THEN k % 5 <> 0 WHEN 'view' THEN k % 7 = 0 ELSE false END AS critical
    FROM numbered),
  nodes AS (SELECT *, 'h' || substr(session_id, 1, 8) || '-' || lpad(seq::VARCHAR, greatest(5, length(seq::VARCHAR))::INT, '0') AS node_id,
      CASE WHEN seq > 1 THEN 'h' || substr(session_id, 1, 8) || '-' || lpad((seq - 1)::VARCHAR, greatest(5, length((seq - 1)::VARCHAR))::INT, '0') END
        AS parent_id,
      CASE WHEN kind = 'view' THEN 'NODE_LOGIC' ELSE 'NODE_TOOL' END AS type,
      coalesce(tool, lower(oper)) AS name,
      CASE WHEN upper(oper) = 'DECISION' THEN 'PROV_INJECTED' ELSE 'PROV_NATURAL' END AS provenance,
      concat_ws(',', CASE WHEN critical THEN 'FLAG_CRITICAL_FAILURE' END, CASE WHEN circular THEN 'FLAG_CIRCULAR_REASONING' END,
        CASE WHEN k % 17 = 0 THEN 'FLAG_CONFIDENCE_LOW' END) AS flags,
      CASE WHEN kind = 'error' THEN '{"returncode":' || (k % 5 - 2) || ',"stdout":"x"}'
           WHEN kind = 'purchase' THEN '{"exit_code":' || (k % 5) || '}' WHEN content IS NULL THEN '{}'
           ELSE '{"text":"' || content || '"}' END AS outputs
    FROM flagged)"""
_HOOKS_SQL = HOOKS_SQL_OF.replace("{scope}", "TRUE")


def nodes(spark, sf_dir):
    return trace.translate(hook_events(spark, sf_dir))


def stored(spark, sf_dir):
    """The nodes as a stored table, which is what the questions about traces are asked of."""
    made = lambda path: sinks.write_node_table(nodes(spark, sf_dir), path)
    return spark.read.parquet(stored_once(spark, sf_dir, "node-store", made))


@CATALOG.query(
    "translate_nodes",
    f"""{_HOOKS_SQL} SELECT line_no, stamp AS timestamp, node_id, parent_id, type, name, provenance, flags AS audit_flags, outputs,
          '{{"target":"' || target || '","cwd":null,"intent":null}}' AS inputs FROM nodes""",
)
def translate_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).select(
        "line_no", "timestamp", "node_id", "parent_id", "type", "name", "provenance",
        F.array_join("audit_flags", ",").alias("audit_flags"), "outputs", "inputs",
    )


@CATALOG.query("circular_flag", f"{_HOOKS_SQL} SELECT line_no, circular FROM flagged")
def circular_flag(spark, sf_dir):
    events = hook_events(spark, sf_dir).where("event <> 'SESSION_START'")
    flagged = trace.with_circular(
        events, scope=["file"], order="line_no", operation=trace.operation(), target=F.col("target")
    )
    return flagged.select("line_no", "circular")


@CATALOG.query(
    "circular_flag_by_session",
    f"""{_HOOKS_SQL}, placed AS (SELECT *, sum(CASE WHEN target <> '' THEN 1 ELSE 0 END)
            OVER (PARTITION BY session_id ORDER BY line_no) AS rs FROM hooks)
       SELECT line_no, CASE WHEN target IN ('', 'none') THEN false ELSE 1 + count(*) OVER (PARTITION BY session_id, oper, target
            ORDER BY rs RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 3 END AS circular FROM placed""",
)
def circular_flag_by_session(spark, sf_dir):
    events = hook_events(spark, sf_dir).where("event <> 'SESSION_START'")
    named = events.withColumn("session_id", F.coalesce("session_id", F.lit("unknown")))
    flagged = trace.with_circular(
        named, scope=["file", "session_id"], order="line_no", operation=trace.operation(), target=F.col("target")
    )
    return flagged.select("line_no", "circular")


@CATALOG.query("critical_flag", f"{_HOOKS_SQL} SELECT line_no, critical FROM flagged")
def critical_flag(spark, sf_dir):
    events = hook_events(spark, sf_dir).where("event <> 'SESSION_START'")
    return trace.with_outputs(events).select("line_no", trace.critical().alias("critical"))


@CATALOG.query("low_confidence_flag", f"{_HOOKS_SQL} SELECT line_no, k % 17 = 0 AS low FROM hooks")
def low_confidence_flag(spark, sf_dir):
    events = hook_events(spark, sf_dir).where("event <> 'SESSION_START'")
    return events.select("line_no", trace.low_confidence().alias("low"))


@CATALOG.query(
    "filtered_nodes",
    f"""{_HOOKS_SQL} SELECT node_id, name FROM nodes WHERE type = 'NODE_TOOL' AND contains(flags, 'FLAG_CIRCULAR_REASONING')""",
)
def filtered_nodes(spark, sf_dir):
    return trace.filter_nodes(stored(spark, sf_dir), "NODE_TOOL", "FLAG_CIRCULAR_REASONING").select("node_id", "name")


@CATALOG.query(
    "parent_lookup",
    f"""{_HOOKS_SQL}, last AS (SELECT node_id, arg_max(type, line_no) AS type, arg_max(target, line_no) AS target
            FROM nodes GROUP BY node_id)
       SELECT n.line_no, n.node_id, n.parent_id, p.type AS parent_type,
              substr('{{"target":"' || p.target || '","cwd":null,"intent":null}}', 1, 100) AS parent_inputs
       FROM nodes n LEFT JOIN last p ON n.parent_id = p.node_id""",
)
def parent_lookup(spark, sf_dir):
    """Eight characters of the session id make node ids collide across sessions: the last one counts."""
    return trace.with_parent(stored(spark, sf_dir)).select("line_no", "node_id", "parent_id", "parent_type", "parent_inputs")


@CATALOG.query(
    "edges",
    f"""{_HOOKS_SQL} SELECT parent_id AS "from", node_id AS "to",
          CASE provenance WHEN 'PROV_INJECTED' THEN 'INJECTION_LINK' ELSE 'CAUSAL_LINK' END AS type
        FROM nodes WHERE parent_id IS NOT NULL""",
)
def edges(spark, sf_dir):
    return trace.edges(stored(spark, sf_dir)).select("from", "to", "type")


@CATALOG.query(
    "edge_types_with_defaults",
    """SELECT user_id, CASE event_type WHEN 'error' THEN 'INJECTION_LINK' WHEN 'click' THEN 'SPECULATIVE_BRANCH'
          ELSE 'CAUSAL_LINK' END AS type, count(*) AS edges,
          count(*) FILTER (event_type IN ('view', 'purchase')) AS defaulted FROM events GROUP BY ALL""",
)
def edge_types_with_defaults(spark, sf_dir):
    """Provenance is absent for some nodes (defaulted) and an explicit null for others (kept)."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("node_id"),
        F.lit("root").alias("parent_id"),
        F.when(kind == "error", "PROV_INJECTED").when(kind == "click", "PROV_SPECULATIVE").alias("provenance"),
        (~kind.isin("view", "purchase")).alias("has_provenance"),
    )
    full = trace.with_default_provenance(rows)
    session = full.withColumn("session_id", F.col("user_id").cast("string"))
    typed = trace.edges(session).withColumn("event", F.expr("substring(`to`, 2)").cast("bigint"))
    natural = full.select(F.expr("cast(substring(node_id, 2) as bigint)").alias("event"), (F.col("provenance") == "PROV_NATURAL").eqNullSafe(True).alias("d"))
    joined = typed.join(natural, "event")
    return joined.groupBy(F.col("session_id").cast("bigint").alias("user_id"), "type").agg(
        F.count("*").alias("edges"), F.sum(F.col("d").cast("bigint")).alias("defaulted")
    )


@CATALOG.query(
    "session_index", "SELECT DISTINCT 'host' || (user_id % 4) AS host, 'user' || user_id AS session_id FROM events"
)
def session_index(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("host"), F.col("user_id") % 4).alias("host"), F.concat(F.lit("user"), F.col("user_id")).alias("session_id")
    )
    return trace.sessions(rows)


# --- run dumps: line items as the runs of one dump per ship mode -------------


def runs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 3
    none = F.lit(None).cast("string")
    return items.select(
        F.concat(F.lit("dump-"), F.col("l_returnflag")).alias("file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent_run_id"),
        F.when(kind == 0, "tool").when(kind == 1, "chain").otherwise("llm").alias("run_type"),
        F.col("l_linestatus").alias("name"),
        F.concat(F.lit('{"part":'), F.col("l_partkey").cast("string"), F.lit("}")).alias("inputs"),
        none.alias("outputs"),
        F.when(F.col("l_quantity") > 45, "too many").when(F.col("l_quantity") > 40, "").alias("error"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_time"),
        none.alias("end_time"),
    )


@CATALOG.query(
    "ingest_runs",
    """SELECT file, pos AS line_no, l_orderkey || '-' || l_linenumber AS node_id, 'o' || l_orderkey AS parent_id, type,
          concat_ws(',', CASE WHEN type = 'NODE_TOOL' AND nth > 1 THEN 'FLAG_CIRCULAR_REASONING' END,
                    CASE WHEN l_quantity > 45 THEN 'FLAG_CRITICAL_FAILURE' END) AS audit_flags
        FROM (SELECT *, row_number() OVER (PARTITION BY file, type = 'NODE_TOOL', l_partkey ORDER BY pos) AS nth FROM (
          SELECT *, 'dump-' || l_returnflag AS file, l_orderkey * 10 + l_linenumber AS pos,
                 CASE l_linenumber % 3 WHEN 0 THEN 'NODE_TOOL' WHEN 1 THEN 'CLUSTER' ELSE 'NODE_LOGIC' END AS type FROM lineitem))""",
)
def ingest_runs(spark, sf_dir):
    done = trace.ingest_runs(runs(spark, sf_dir))
    return done.select("file", "line_no", "node_id", "parent_id", "type", F.array_join("audit_flags", ",").alias("audit_flags"))


# --- traps -------------------------------------------------------------------


def trap_table(spark):
    rows = [
        ("p", "TRAP-1", "ON_RETRY", "ACTION_HALT", 3, None, "active"),
        ("p", "TRAP-2", "ON_ERROR", "ACTION_BRANCH", None, None, "active"),
        ("p", "TRAP-3", "ON_ERROR", "ACTION_SOCRATIC", None, 0.5, "paused"),
        ("p", "TRAP-4", "ON_STATE_DRIFT", "ACTION_HALT", None, None, "active"),
        ("p", "TRAP-5", "ON_CONFIDENCE_LOW", "ACTION_SOCRATIC", None, 0.5, "active"),
    ]
    return spark.createDataFrame(rows, schemas.TRAP)


_EVENTS_SQL = f"""{_HOOKS_SQL}, traps(trap_id, "on", action, flag) AS (VALUES
      ('TRAP-1', 'ON_RETRY', 'ACTION_HALT', 'FLAG_CIRCULAR_REASONING'), ('TRAP-2', 'ON_ERROR', 'ACTION_BRANCH', 'FLAG_CRITICAL_FAILURE'),
      ('TRAP-5', 'ON_CONFIDENCE_LOW', 'ACTION_SOCRATIC', 'FLAG_CONFIDENCE_LOW')),
    fired AS (SELECT trap_id, "on", action, node_id, type AS node_type, name AS node_name, flags AS audit_flags
              FROM nodes JOIN traps ON contains(flags, flag))"""


@CATALOG.query("trap_events", f"{_EVENTS_SQL} SELECT * FROM fired")
def trap_events(spark, sf_dir):
    fired = traps.match(stored(spark, sf_dir), trap_table(spark))
    return fired.withColumn("audit_flags", F.array_join("audit_flags", ","))


@CATALOG.query(
    "trap_summary",
    f"""{_EVENTS_SQL} SELECT 4 AS traps, count(*) AS matches, bool_or(action = 'ACTION_HALT') AS halted FROM fired""",
)
def trap_summary(spark, sf_dir):
    table_ = trap_table(spark)
    return traps.summary(traps.match(stored(spark, sf_dir), table_), table_)


@CATALOG.query(
    "trap_maintenance",
    """SELECT project, count(*) AS n, max(id) AS last_id FROM (
         SELECT 'c' || c_nationkey AS project, 'TRAP-' || c_custkey AS id FROM customer WHERE c_nationkey <> 3
         UNION ALL SELECT 'c7', 'TRAP-' || (count(*) + 1) FROM customer WHERE c_nationkey = 7) GROUP BY project""",
)
def trap_maintenance(spark, sf_dir):
    """Customers as traps of a project per nation: one is added to a project, another project is cleared."""
    none = F.lit(None)
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("project"),
        F.concat(F.lit("TRAP-"), F.col("c_custkey").cast("string")).alias("id"),
        F.lit("ON_ERROR").alias("on"), F.lit("ACTION_HALT").alias("action"), none.cast("int").alias("limit"),
        none.cast("double").alias("threshold"), F.lit("active").alias("status"),
    )
    kept = traps.clear(traps.add(rows, "c7", "ON_RETRY", "ACTION_HALT"), "c3")
    return kept.groupBy("project").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


# --- registry: pages as task files -------------------------------------------


def tasks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    whole = F.to_json(F.struct(F.col("page_id").alias("id"), F.col("url").alias("title")))
    broken = F.col("page_id") % 5 == 2
    return pages.select(
        F.when(F.col("url").startswith("https"), "secure").otherwise("plain").alias("project"),
        F.concat(F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".json")).alias("file"),
        F.when(broken, F.concat(F.lit("{"), F.col("url"))).otherwise(whole).alias("raw"),
    )


_TASK_SQL = """SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'plain' END AS project,
    lpad(page_id::VARCHAR, 9, '0') || '.json' AS file, page_id % 5 = 2 AS broken,
    '{"id":' || page_id || ',"title":"' || url || '"}' AS task, url FROM pages"""


@CATALOG.query(
    "registry_snapshot", f"SELECT project, file, task FROM ({_TASK_SQL}) WHERE project = 'secure' AND NOT broken"
)
def registry_snapshot(spark, sf_dir):
    return registry.snapshot(tasks(spark, sf_dir), "secure")


@CATALOG.query(
    "registry_search",
    f"""SELECT file, CASE WHEN broken THEN '{{}}' ELSE task END AS task FROM ({_TASK_SQL})
        WHERE contains(lower(CASE WHEN broken THEN '{{' || url ELSE task END), 'blog.th')""",
)
def registry_search(spark, sf_dir):
    return registry.search(tasks(spark, sf_dir), "BLOG.th").select("file", "task")
