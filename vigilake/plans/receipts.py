"""Receipt queries: building, hashing, verifying, validating, reporting."""

from pyspark.sql import functions as F

from vigilake.operators import receipts, reports, validate
from vigilake.operators.receipts import build_receipts
from vigilake.operators.exchange import evaluate_exchanges
from vigilake.operators.policies import EMPTY_SET, PolicySet
from vigilake.operators.taxonomy import taxonomy
from vigilake.plans.base import CLOCK, NOW, NOW_ISO, TALK_SQL, Catalog, stored_once, table
from vigilake.plans.evaluation import CATALOG as EVALUATION
from vigilake.plans.evaluation import documents, sanitized, talk
from vigilake.sinks import files as sinks
from vigilake.sources import files

CATALOG = Catalog()

# Receipts of exchanges, spread over days by conversation and turn.
_MINUTES = "conv_id * 97 + turn"


def _when():
    return F.lit("2025-01-01 08:00:00").cast("timestamp") + F.expr(f"make_dt_interval(0, 0, {_MINUTES}, 0)")


def _references():
    """Every exchange refers to one record; several exchanges share it."""
    return F.array(
        F.struct(
            F.lit("read").alias("access_method"),
            F.array(F.lit("text")).alias("fields_accessed"),
            F.concat(F.lit("record:"), (F.col("conv_id") % 10).cast("string")).alias("resource_id"),
            F.lit("record").alias("type"),
        )
    )


def built(spark, sf_dir, **options):
    held = F.col("conv_id") % 7 == 0
    return build_receipts(
        talk(spark, sf_dir), _when(), legal_hold=held, retention_days=30, context_references=_references(), **options
    )


_RECEIPTS_SQL = f"""WITH {TALK_SQL}, stamped AS (
    SELECT *, TIMESTAMP '2025-01-01 08:00:00' + to_minutes({_MINUTES}) AS ts FROM talk),
  receipts AS (
    SELECT *, 'rcp_' || strftime(ts, '%Y-%m-%dT%H-%M-%S') || '_' || substr(sha256(exchange_id::VARCHAR), 1, 24) AS receipt_id,
           strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_text, strftime(ts + INTERVAL 30 DAY, '%Y-%m-%d') AS retain_until,
           strftime(ts + INTERVAL 30 DAY, '%Y-%m-%dT%H:%M:%S+00:00') AS deletable_after,
           conv_id % 7 = 0 AS legal_hold, 'user' || conv_id AS user_id, 'model-' || (turn % 4) AS model_id
    FROM stamped)"""


@CATALOG.query(
    "receipts_built",
    f"""{_RECEIPTS_SQL} SELECT exchange_id, receipt_id, ts_text AS timestamp, 'sha256:' || sha256(final_prompt) AS prompt_hash,
        length(final_prompt) AS prompt_chars, 'sha256:' || sha256(final_response) AS response_hash,
        length(final_response) AS response_chars, retain_until, deletable_after, legal_hold, user_id, model_id,
        CASE WHEN response_verdict IS NULL THEN 1
             ELSE 2 + (CASE WHEN rg > 0 AND rm > 0 THEN 1 ELSE 0 END)
                    + (CASE WHEN rl > 0 AND rm > 0 THEN 1 ELSE 0 END) END
        + (CASE WHEN pg > 0 AND pl > 0 THEN 1 ELSE 0 END) AS decisions FROM receipts""",
)
def receipts_built(spark, sf_dir):
    r = F.col("receipt")
    return built(spark, sf_dir).select(
        "exchange_id",
        r["receipt_id"].alias("receipt_id"),
        r["timestamp"].alias("timestamp"),
        r["prompt"]["text_hash"].alias("prompt_hash"),
        r["prompt"]["text_length_chars"].alias("prompt_chars"),
        r["response"]["text_hash"].alias("response_hash"),
        r["response"]["text_length_chars"].alias("response_chars"),
        r["retention"]["retain_until"].alias("retain_until"),
        r["retention"]["deletable_after"].alias("deletable_after"),
        r["retention"]["legal_hold"].alias("legal_hold"),
        r["actor"]["user_id"].alias("user_id"),
        r["tool"]["model_id"].alias("model_id"),
        F.size(r["policy_decisions"]).alias("decisions"),
    )


# Receipts of documents with one synthetic decision, so that the canonical text can be spelled out in SQL.
_DOC_OPEN = f"""'{{"actor":{{"user_id":"' || source || '"}},"data_classes_touched":[],"downstream_actions":[],"evidence":{{"capture_method":"http_proxy_intercept","captured_by":"vigilake","receipt_hash":"' || h || '","signature":null}},"external_trace_uri":null,"policy_decisions":[{{"alert_id":null,"enforcement_mode":"enforced","error_reason":null,"evaluated_at":"{NOW_ISO}","matched_classes":[],"policy_id":null,"policy_set_version":"empty","policy_version":null,"redactions_applied":[],"verdict":"allowed","would_have_blocked":null}},{{"alert_id":null,"enforcement_mode":"enforced","error_reason":null,"evaluated_at":"{NOW_ISO}","matched_classes":[],"policy_id":null,"policy_set_version":"empty","policy_version":null,"redactions_applied":[],"verdict":"allowed","would_have_blocked":null}}],"prompt":{{"context_references":[],"text":"Read it","text_hash":"sha256:' || sha256('Read it') || '","text_length_chars":7}},"receipt_id":"rcp_2025-03-04T05-06-07_' || substr(sha256(doc_id::VARCHAR), 1, 24) || '","response":{{"latency_ms":null,"text":' || to_json(text)::VARCHAR || ',"text_hash":"sha256:' || sha256(text) || '","text_length_chars":' || length(text) || ',"tokens_used":null}},"retention":{{"deletable_after":"2032-03-02T05:06:07.000089+00:00","legal_hold":false,"retain_until":"2032-03-02","retention_policy":"default_seven_year"}},"schema_version":"1.1","timestamp":"{NOW_ISO}","tool":{{"model_id":"m","tool_id":"' || lang || '"}}}}'"""
_DOC_RECEIPTS_SQL = f"""WITH opened AS (SELECT *, {_DOC_OPEN} AS body FROM (SELECT *, '' AS h FROM documents)),
  hashed AS (SELECT * EXCLUDE (h), 'sha256:' || sha256(body) AS h FROM opened)"""


def doc_receipts(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        "doc_id",
        F.lit("Read it").alias("prompt"),
        F.col("text").alias("response"),
        F.struct(
            F.col("source").alias("user_id"),
            *[F.lit(None).cast("string").alias(n) for n in ("user_role", "department", "auth_method")],
        ).alias("actor"),
        F.struct(
            F.col("lang").alias("tool_id"),
            F.lit("m").alias("model_id"),
            *[F.lit(None).cast("string").alias(n) for n in ("tool_version", "model_vendor", "endpoint")],
        ).alias("tool"),
    )
    # A class that never occurs: the hash of every whole document text is what is checked here.
    none = taxonomy("none", [{"class": "bell", "recognizer": "regex", "pattern": r"\x07\x07"}])
    done = evaluate_exchanges(rows, [none], PolicySet((), EMPTY_SET), CLOCK, key="doc_id")
    return build_receipts(done, CLOCK.now, key="doc_id")


@CATALOG.query("receipt_hashes", f"{_DOC_RECEIPTS_SQL} SELECT doc_id, h AS receipt_hash FROM hashed")
def receipt_hashes(spark, sf_dir):
    return doc_receipts(spark, sf_dir).select("doc_id", F.col("receipt.evidence.receipt_hash").alias("receipt_hash"))


def tampered(spark, sf_dir):
    """Stored receipts of all documents: some with a changed text, a changed hash, no hash, or cut off."""
    raw = F.col("raw")
    kind = F.col("doc_id") % 20
    changed = (
        F.when(kind == 3, F.replace(raw, F.lit('"Read it"'), F.lit('"Read me"')))
        .when(kind == 7, F.regexp_replace(raw, '"receipt_hash":"sha256:.', '"receipt_hash":"sha256:x'))
        .when(kind == 11, F.regexp_replace(raw, '"receipt_hash":"[^"]*",', ""))
        .when(kind == 13, F.substring(raw, 1, 200))
        .when(kind == 17, F.concat(raw, F.lit("\n")))
        .otherwise(raw)
    )
    return doc_receipts(spark, sf_dir).select("doc_id", changed.alias("raw"))


_STATUS_SQL = "CASE WHEN doc_id % 20 IN (3, 7, 11, 13) THEN 'FAIL' ELSE 'OK' END"


@CATALOG.query(
    "receipt_verify",
    f"""{_DOC_RECEIPTS_SQL} SELECT doc_id, {_STATUS_SQL} AS status,
          CASE WHEN doc_id % 20 = 7 THEN 'sha256:x' || substr(h, 9) WHEN doc_id % 20 IN (11, 13) THEN NULL ELSE h END AS stored
        FROM hashed""",
)
def receipt_verify(spark, sf_dir):
    return receipts.verify(tampered(spark, sf_dir)).select("doc_id", "status", "stored")


@CATALOG.query(
    "receipt_verify_summary",
    f"""SELECT count(*) AS receipts, count(*) FILTER ({_STATUS_SQL} = 'FAIL') AS failures, 'FAIL' AS result FROM documents""",
)
def receipt_verify_summary(spark, sf_dir):
    return receipts.verify_summary(receipts.verify(tampered(spark, sf_dir)))


@CATALOG.query(
    "receipt_validation",
    """SELECT doc_id, unnest([x FOR x IN [
         CASE WHEN doc_id % 20 = 3 THEN 'actor.user_id: required' END,
         CASE WHEN doc_id % 20 = 5 THEN 'policy_decisions[000000].enforcement_mode: must be one of enforced, audit_only, error' END,
         CASE WHEN doc_id % 20 = 5 THEN 'policy_decisions[000001].enforcement_mode: must be one of enforced, audit_only, error' END,
         CASE WHEN doc_id % 20 = 7 THEN 'evidence.receipt_hash: has the wrong format' END,
         CASE WHEN doc_id % 20 = 9 THEN 'response.text_length_chars: must be integer' END,
         CASE WHEN doc_id % 20 = 9 THEN 'note: unknown field' END,
         CASE WHEN doc_id % 20 = 13 THEN 'receipt: must be object' END] IF x IS NOT NULL]) AS violation FROM documents""",
)
def receipt_validation(spark, sf_dir):
    raw, kind = F.col("raw"), F.col("doc_id") % 20
    changed = (
        F.when(kind == 3, F.regexp_replace(raw, '"user_id":"[^"]*"', '"extra":1'))
        .when(kind == 5, F.replace(raw, F.lit('"enforced"'), F.lit('"loose"')))
        .when(kind == 7, F.regexp_replace(raw, '"receipt_hash":"[^"]*"', '"receipt_hash":"none"'))
        .when(kind == 9, F.regexp_replace(raw, r'"text_length_chars":\d+,"tokens_used"', '"text_length_chars":"9","tokens_used"'))
        .when(kind == 13, F.substring(raw, 1, 200))
        .otherwise(raw)
    )
    changed = F.when(kind == 9, F.regexp_replace(changed, r"^\{", '{"note":1,')).otherwise(changed)
    checked = validate.with_violations(doc_receipts(spark, sf_dir).select("doc_id", changed.alias("raw")))
    return checked.select("doc_id", F.explode("violations").alias("violation"))


# --- reports: over receipts as they are stored --------------------------------

def stored(spark, sf_dir):
    """The receipts' table, as reports find it."""
    path = stored_once(spark, sf_dir, "receipt-store", lambda path: sinks.write_receipt_table(built(spark, sf_dir), path))
    return files.receipt_table(spark, path)


@CATALOG.query("receipt_count", f"{_RECEIPTS_SQL} SELECT count(*) AS receipts FROM receipts")
def receipt_count(spark, sf_dir):
    return reports.count(stored(spark, sf_dir))


@CATALOG.query(
    "report_by_day", f"{_RECEIPTS_SQL} SELECT substr(ts_text, 1, 10) AS day, count(*) AS receipts FROM receipts GROUP BY 1"
)
def report_by_day(spark, sf_dir):
    return reports.volume_by_day(stored(spark, sf_dir))


_TOUCHED_SQL = f"""{_RECEIPTS_SQL}, touched AS (SELECT receipt_id, ts_text, model_id, exchange_id, final_prompt,
       prompt_verdict, response_verdict, cls FROM (
         SELECT *, unnest(['topic:motion', 'topic:link', 'topic:german']) AS cls,
                unnest([pm > 0, pl > 0, pg > 0]) AS p, unnest([rm > 0, rl > 0, rg > 0]) AS r FROM receipts)
       WHERE p OR (prompt_verdict <> 'blocked' AND coalesce(r, false)))"""


@CATALOG.query("report_by_class", f"{_TOUCHED_SQL} SELECT cls AS class, count(*) AS receipts FROM touched GROUP BY 1")
def report_by_class(spark, sf_dir):
    return reports.by_class(stored(spark, sf_dir))


# Verdict of each decision in order of policy id: prompt rules first, then response rules.
_VERDICTS_SQL = """[x FOR x IN [CASE WHEN pg > 0 THEN 'blocked' END, CASE WHEN pl > 0 THEN 'redacted' END,
      CASE WHEN pg = 0 AND pl = 0 THEN 'allowed' END,
      CASE WHEN response_verdict IS NOT NULL AND rg > 0 THEN 'alerted' END,
      CASE WHEN response_verdict IS NOT NULL AND rm > 0 AND rl > 0 THEN 'blocked' END,
      CASE WHEN response_verdict IS NOT NULL AND rm > 0 THEN 'redacted' END,
      CASE WHEN response_verdict IS NOT NULL AND rm = 0 AND rg = 0 THEN 'allowed' END] IF x IS NOT NULL]"""


@CATALOG.query(
    "report_by_verdict",
    f"""{_RECEIPTS_SQL} SELECT verdict, count(*) AS decisions FROM (SELECT unnest({_VERDICTS_SQL}) AS verdict FROM receipts)
        GROUP BY 1""",
)
def report_by_verdict(spark, sf_dir):
    return reports.by_verdict(stored(spark, sf_dir))


@CATALOG.query(
    "receipts_touching_class",
    f"""{_TOUCHED_SQL} SELECT r.receipt_id, r.ts_text AS timestamp, r.model_id, cls AS class,
          array_to_string({_VERDICTS_SQL}, ',') AS verdicts, sha256(r.final_prompt) AS prompt_sha
        FROM (SELECT exchange_id, cls FROM touched) t JOIN receipts r USING (exchange_id) WHERE starts_with(cls, 'topic:l') OR starts_with(cls, 'topic:m')""",
)
def receipts_touching_class(spark, sf_dir):
    rows = reports.touching(stored(spark, sf_dir), "topic:l", "topic:m")
    return rows.select(
        "receipt_id", "timestamp", "model_id", "class", F.array_join("verdicts", ",").alias("verdicts"),
        F.sha2("prompt_text", 256).alias("prompt_sha"),
    )


@CATALOG.query(
    "receipts_having_class",
    f"""{_TOUCHED_SQL} SELECT DISTINCT receipt_id FROM touched WHERE starts_with(cls, 'topic:g') AND ts_text > '2025-01-03'""",
)
def receipts_having_class(spark, sf_dir):
    return reports.having_class(stored(spark, sf_dir), "topic:g", "2025-01-03").select("receipt.receipt_id")


_BLOCKS_SQL = """[x FOR x IN [CASE WHEN pg > 0 THEN 'p_block_german[topic:german]' END,
     CASE WHEN response_verdict IS NOT NULL AND rm > 0 AND rl > 0 THEN 'r_block_both[topic:motion,topic:link]' END] IF x IS NOT NULL]"""


@CATALOG.query(
    "enforced_blocks",
    f"""{_RECEIPTS_SQL} SELECT receipt_id, ts_text AS timestamp, user_id AS actor, sha256(final_prompt) AS prompt_sha,
          array_to_string({_BLOCKS_SQL}, ';') AS blocks FROM receipts WHERE len({_BLOCKS_SQL}) > 0""",
)
def enforced_blocks(spark, sf_dir):
    shown = F.transform("blocks", lambda b: F.concat(b["policy_id"], F.lit("["), F.array_join(b["matched_classes"], ","), F.lit("]")))
    return reports.enforced_blocks(stored(spark, sf_dir)).select(
        "receipt_id", "timestamp", "actor", F.sha2("prompt", 256).alias("prompt_sha"), F.array_join(shown, ";").alias("blocks")
    )



def today():
    return F.lit("2025-02-03").cast("date")


@CATALOG.query(
    "prune_candidates",
    f"{_RECEIPTS_SQL} SELECT receipt_id, retain_until FROM receipts WHERE NOT legal_hold AND retain_until < '2025-02-03'",
)
def prune_candidates(spark, sf_dir):
    return reports.prune_candidates(stored(spark, sf_dir), today())


@CATALOG.query(
    "prune_by_age", f"{_RECEIPTS_SQL} SELECT receipt_id FROM receipts WHERE NOT legal_hold AND ts::DATE < DATE '2025-01-04'"
)
def prune_by_age(spark, sf_dir):
    return reports.older_than(stored(spark, sf_dir), today(), 30).select("receipt.receipt_id")


@CATALOG.query(
    "prune_emptied_days",
    f"""{_RECEIPTS_SQL} SELECT ts::DATE AS day, count(*) AS receipts FROM receipts WHERE ts::DATE < DATE '2025-01-04'
        GROUP BY 1 HAVING NOT bool_or(legal_hold)""",
)
def prune_emptied_days(spark, sf_dir):
    return reports.emptied_days(stored(spark, sf_dir), today(), 30)


@CATALOG.query("resource_lookup", f"{_RECEIPTS_SQL} SELECT receipt_id FROM receipts WHERE conv_id % 10 = 4")
def resource_lookup(spark, sf_dir):
    return reports.mentioning_resource(stored(spark, sf_dir), "record:4").select("receipt.receipt_id")


@CATALOG.query("resource_text_search", f"{_RECEIPTS_SQL} SELECT receipt_id FROM receipts WHERE conv_id % 10 = 4")
def resource_text_search(spark, sf_dir):
    return reports.mentioning_resource_anywhere(stored(spark, sf_dir), "record:4").select("receipt.receipt_id")


@CATALOG.query(
    "records_packet",
    f"""{_RECEIPTS_SQL} SELECT receipt_id, ts_text AS timestamp, '1.1' AS schema_version, sha256(final_prompt) AS prompt_sha,
          sha256(final_response) AS response_sha, retain_until, 'OK' AS integrity FROM receipts""",
)
def records_packet(spark, sf_dir):
    packet = reports.records_packet(receipts.verify(stored(spark, sf_dir)))
    return packet.select(
        "receipt_id", "timestamp", "schema_version", F.sha2("prompt_text", 256).alias("prompt_sha"),
        F.sha2("response_text", 256).alias("response_sha"), "retention.retain_until", "integrity",
    )


@CATALOG.query("retention_listing", f"{_RECEIPTS_SQL} SELECT receipt_id, retain_until, legal_hold FROM receipts")
def retention_listing(spark, sf_dir):
    return reports.retention_listing(stored(spark, sf_dir))


_SIEM_SQL = f"""{_RECEIPTS_SQL} SELECT receipt_id, ts_text AS timestamp, user_id, 'desk' AS tool_id, model_id,
    array_to_string({_VERDICTS_SQL}, ',') AS verdicts FROM receipts"""


@CATALOG.query("siem_rows", _SIEM_SQL)
def siem_rows(spark, sf_dir):
    rows = reports.siem_rows(stored(spark, sf_dir))
    return rows.withColumn("verdicts", F.array_join("verdicts", ",")).select(
        "receipt_id", "timestamp", "user_id", "tool_id", "model_id", "verdicts"
    )


@CATALOG.query(
    "siem_projection",
    f"""{_RECEIPTS_SQL} SELECT receipt_id, user_id AS actor, array_to_string({_VERDICTS_SQL}, ',') AS verdicts FROM receipts""",
)
def siem_projection(spark, sf_dir):
    rows = reports.siem_projection(stored(spark, sf_dir).select("raw"))
    return rows.select("receipt_id", "actor", F.array_join("verdicts", ",").alias("verdicts"))


@CATALOG.query(
    "receipt_sql",
    f"""{_RECEIPTS_SQL} SELECT model_id, count(*) AS receipts, sum(length(final_response)) AS response_chars,
          max(ts_text) AS latest FROM receipts GROUP BY model_id""",
)
def receipt_sql(spark, sf_dir):
    reports.register(stored(spark, sf_dir), "stored_receipts")
    return reports.sql(
        spark,
        """SELECT tool.model_id AS model_id, count(*) AS receipts, sum(response.text_length_chars) AS response_chars,
                  max(timestamp) AS latest FROM stored_receipts GROUP BY tool.model_id""",
    )


_COMPACT_SQL = f"""SELECT doc_id, '{{"evidence":{{"device_owner":"' || source || '","receipt_hash":"","timestamp":"2025-03-04T05:06:07Z"}},"matched_rules":["'
    || replace(rules, ',', '","') || '"],"verdict":"' || verdict || '"}}' AS body FROM ({EVALUATION.sql["sanitize"]}) JOIN documents USING (doc_id)"""


@CATALOG.query("compact_receipts", f"SELECT doc_id, sha256(body) AS receipt_hash, 'OK' AS status FROM ({_COMPACT_SQL})")
def compact_receipts(spark, sf_dir):
    """A small receipt of every sanitizer run, with its verdict and the rules that matched."""
    made = receipts.compact_receipts(sanitized(spark, sf_dir), device_owner=F.col("source"), now=F.lit(NOW))
    return receipts.verify_compact(made).select("doc_id", "receipt_hash", "status")
