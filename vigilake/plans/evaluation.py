"""Classification, policy and exchange queries."""

import re

from pyspark.sql import functions as F

from vigilake.operators import classify, policies, sanitize
from vigilake.operators.evaluate import decision_rows, evaluate, redact_spans
from vigilake.operators.exchange import PASSTHROUGH, dry_run, evaluate_exchanges, evaluate_single_phase
from vigilake.operators.receipts import build_receipts, verify
from vigilake.operators.taxonomy import taxonomy_violations as check_taxonomies
from vigilake.operators.taxonomy import shipped
from vigilake.plans.base import (
    CARD,
    CLOCK,
    DOC_POLICIES,
    EMAIL,
    FLAGS_SQL,
    IP,
    PII,
    TALK_POLICIES,
    TALK_SQL,
    TOPIC,
    WORDS,
    Catalog,
    decisions_sql,
    doc_destination,
    doc_error,
    exchanges,
    hits_sql,
    masked_words_sql,
    table,
    words_sql,
)

CATALOG = Catalog()
COUNTS = {"pii:card": "n_card", "pii:email": "n_email", "pii:ip": "n_ip"}


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id")


def doc_hits(spark, sf_dir):
    return classify.with_hits(documents(spark, sf_dir), "text", [PII], "response")


def doc_evaluation(spark, sf_dir, error=None):
    return evaluate(
        doc_hits(spark, sf_dir), DOC_POLICIES, text="text", hits="hits", direction="response", clock=CLOCK,
        key="doc_id", destination=doc_destination(), error=error,
    )


# --- classification ----------------------------------------------------------


@CATALOG.query(
    "hit_spans",
    f"""WITH hits AS ({hits_sql()})
    SELECT doc_id, cls, s AS start, s + length(hit) AS "end", hit AS text, 'response' AS location,
           row_number() OVER (PARTITION BY doc_id ORDER BY cls_rank, i) - 1 AS ord FROM hits""",
)
def hit_spans(spark, sf_dir):
    return classify.hit_rows(doc_hits(spark, sf_dir), ["doc_id"])


@CATALOG.query(
    "classify_counts",
    f"""WITH hits AS ({hits_sql()})
    SELECT cls, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM hits GROUP BY cls""",
)
def classify_counts(spark, sf_dir):
    # Distinct documents per class without a distinct shuffle: a document is one row here.
    hits = doc_hits(spark, sf_dir)
    per_doc = hits.select(F.explode(classify.data_classes(F.col("hits"))).alias("c")).select("c.class", "c.instances")
    return per_doc.groupBy(F.col("class").alias("cls")).agg(F.sum("instances").alias("hits"), F.count("*").alias("docs"))


def _shipped_sql(data_class) -> str:
    """Hits of a shipped class per document, from its pattern as it is loaded.

    DuckDB's patterns have no look-around, so by one rule for all classes: Java's flags and the look at the
    first letter go, what must follow is looked for behind the hit, and what must not follow an @ in the hit.
    """
    pattern = re.sub(r"^\(\?iuU\)(?:\(\?=\[[^\]]*\]\))?", "", data_class.pattern)
    core, _, ahead = pattern.partition("(?=")
    denied = re.search(r"@\(\?!([^)]*)\)", core)
    core = core.replace(denied.group(0), "@") if denied else core
    tests = [f"regexp_matches(substr(text, (s + length(hit) + 1)::BIGINT), '(?i)^{ahead[:-1]}')"] if ahead else []
    tests += [f"NOT regexp_matches(hit, '(?i)@(?:{denied.group(1)})')"] if denied else []
    hits = hits_sql(patterns={data_class.name: core})
    return f"""SELECT doc_id, cls, count(*) AS hits FROM ({hits}) JOIN documents USING (doc_id) WHERE {" AND ".join(tests) or "TRUE"} GROUP BY ALL"""


@CATALOG.query("shipped_taxonomies", "\nUNION ALL\n".join(_shipped_sql(c) for name in ("phi", "generic") for c in shipped(name).classes))
def shipped_taxonomies(spark, sf_dir):
    """All classes of the shipped taxonomies per document."""
    hits = classify.with_hits(documents(spark, sf_dir), "text", [shipped("phi"), shipped("generic")], "response")
    touched = hits.select("doc_id", F.explode(classify.data_classes(F.col("hits"))).alias("c"))
    return touched.select("doc_id", F.col("c.class").alias("cls"), F.col("c.instances").alias("hits"))


@CATALOG.query(
    "keyword_hits",
    "\nUNION ALL\n".join(
        f"SELECT conv_id, turn, '{cls}' AS cls, {words_sql('text', cls)} AS hits FROM conversations "
        f"WHERE {words_sql('text', cls)} > 0"
        for cls in WORDS
    ),
)
def keyword_hits(spark, sf_dir):
    turns = classify.with_hits(table(spark, sf_dir, "conversations", "conv_id", "turn"), "text", [TOPIC])
    touched = turns.select("conv_id", "turn", F.inline(classify.data_classes(F.col("hits"))))
    return touched.select("conv_id", "turn", F.col("class").alias("cls"), F.col("instances").alias("hits"))


def _word_recognizer(texts):
    """Stand-in entity model for the pluggable recognizer: all-capital words are names."""
    import re

    return [[("NAME", m.start(), m.end()) for m in re.finditer(r"(?<![^\W_])[A-Z]{3,}(?![^\W_])", t)] for t in texts]


@CATALOG.query(
    "entity_hits",
    """SELECT doc_id, count(*) AS hits FROM (
         SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM documents)
       WHERE regexp_full_match(w, '[A-Z]{3,}') GROUP BY doc_id""",
)
def entity_hits(spark, sf_dir):
    from vigilake.operators.taxonomy import taxonomy

    names = taxonomy("who", [{"class": "name", "recognizer": "spacy_ner", "pattern": "NAME"}])
    hits = classify.with_hits(documents(spark, sf_dir), "text", [names], "response", recognizer=_word_recognizer)
    return hits.select("doc_id", F.size("hits").alias("hits")).where("hits > 0")


@CATALOG.query(
    "data_classes",
    f"""WITH {TALK_SQL}, both_phases AS (
         SELECT exchange_id, cls, p, r FROM (
           SELECT exchange_id, unnest(['topic:motion', 'topic:link', 'topic:german']) AS cls,
                  unnest([pm, pl, pg]) AS p,
                  unnest([CASE WHEN prompt_verdict = 'blocked' OR response IS NULL THEN 0 ELSE x END
                          FOR x IN [coalesce(rm, 0), coalesce(rl, 0), coalesce(rg, 0)]]) AS r FROM talk))
       SELECT exchange_id, cls AS class, p + r AS instances, p > 0 AS in_prompt, r > 0 AS in_response
       FROM both_phases WHERE p + r > 0""",
)
def data_classes(spark, sf_dir):
    done = talk(spark, sf_dir)
    return done.select("exchange_id", F.inline(classify.data_classes(F.col("all_hits"))))


def expected():
    """What the labels of a corpus would say: a document is expected to hold e-mail when it holds an @."""
    return F.array_compact(
        F.array(
            F.when(F.col("text").contains("@"), F.lit("pii:email")),
            F.when(F.regexp_count("text", F.lit(r"\d{16}")) > 0, F.lit("pii:card")),
            F.when(F.col("text").contains("255."), F.lit("pii:ip")),
        )
    )


_QUALITY_SQL = f"""WITH {FLAGS_SQL}, truth AS (
    SELECT doc_id, [x FOR x IN [CASE WHEN contains(text, '@') THEN 'pii:email' END,
             CASE WHEN regexp_matches(text, '\\d{{16}}') THEN 'pii:card' END,
             CASE WHEN contains(text, '255.') THEN 'pii:ip' END] IF x IS NOT NULL] AS want,
           [x FOR x IN [CASE WHEN n_card > 0 THEN 'pii:card' END, CASE WHEN n_email > 0 THEN 'pii:email' END,
             CASE WHEN n_ip > 0 THEN 'pii:ip' END] IF x IS NOT NULL] AS got FROM flags),
  scored AS (SELECT *, len(list_intersect(got, want)) AS tp, len([x FOR x IN got IF NOT list_contains(want, x)]) AS fp,
             len([x FOR x IN want IF NOT list_contains(got, x)]) AS fn FROM truth)"""


@CATALOG.query(
    "classifier_quality",
    f"""{_QUALITY_SQL} SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
         CASE WHEN sum(tp) + sum(fp) = 0 THEN 1.0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fp)) END AS precision,
         CASE WHEN sum(tp) + sum(fn) = 0 THEN 1.0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fn)) END AS recall FROM scored""",
)
def classifier_quality(spark, sf_dir):
    return classify.quality(classify.with_expectation(doc_hits(spark, sf_dir).withColumn("want", expected()), "want"))


@CATALOG.query(
    "classifier_failures",
    f"""{_QUALITY_SQL} SELECT doc_id, array_to_string(list_sort(got), ',') AS got,
         array_to_string(list_sort(want), ',') AS want FROM scored WHERE fp > 0 OR fn > 0""",
)
def classifier_failures(spark, sf_dir):
    scored = classify.with_expectation(doc_hits(spark, sf_dir).withColumn("want", expected()), "want")
    return classify.mismatches(scored).select(
        "doc_id", F.array_join("got", ",").alias("got"), F.array_join(F.array_sort("want"), ",").alias("want")
    )


# --- policy decisions --------------------------------------------------------

_FIRED = decisions_sql(DOC_POLICIES.policies, "flags", "doc_id", COUNTS, "response")
_DECISIONS_SQL = f"""WITH {FLAGS_SQL}, fired AS ({_FIRED}),
  finals AS (SELECT f.doc_id, any_value(f.text) AS text, coalesce(max(rnk), 0) AS worst
             FROM flags f LEFT JOIN fired USING (doc_id) GROUP BY f.doc_id)"""
_VERDICT_SQL = "CASE worst WHEN 3 THEN 'blocked' WHEN 2 THEN 'alerted' WHEN 1 THEN 'redacted' ELSE 'allowed' END"
_MASKED_SQL = (
    f"regexp_replace(regexp_replace(text, '(?i){CARD}', '[pii:card]', 'g'), '(?i){IP}', '[pii:ip]', 'g')"
)


@CATALOG.query(
    "policy_decisions",
    f"""{_DECISIONS_SQL}, applied AS (SELECT doc_id, count(*) AS n FROM ({hits_sql()}) JOIN finals USING (doc_id)
             WHERE worst = 1 AND cls IN ('pii:card', 'pii:ip') GROUP BY doc_id)
       SELECT doc_id, policy_id, verdict, enforcement_mode, matched, would_have_blocked,
              CASE WHEN policy_id = 'mask_numbers' THEN coalesce(n, 0) ELSE 0 END AS redactions,
              verdict = 'alerted' AND enforcement_mode = 'enforced' AS has_alert
       FROM fired LEFT JOIN applied USING (doc_id)
       UNION ALL
       SELECT doc_id, NULL, 'allowed', 'enforced', '', NULL, 0, false FROM flags
       WHERE doc_id NOT IN (SELECT doc_id FROM fired)""",
)
def policy_decisions(spark, sf_dir):
    rows = decision_rows(doc_evaluation(spark, sf_dir), ["doc_id"])
    return rows.select(
        "doc_id", "policy_id", "verdict", "enforcement_mode", F.array_join("matched_classes", ",").alias("matched"),
        "would_have_blocked", F.size("redactions_applied").alias("redactions"),
        (F.col("alert_id.delivery_status") == "pending").eqNullSafe(True).alias("has_alert"),
    )


@CATALOG.query(
    "final_verdicts",
    f"""{_DECISIONS_SQL} SELECT doc_id, {_VERDICT_SQL} AS final_verdict,
         CASE WHEN worst = 3 THEN 'E-mail addresses stay inside.' END AS block_message,
         CASE WHEN worst = 3 THEN NULL WHEN worst = 1 THEN sha256({_MASKED_SQL}) ELSE sha256(text) END AS text_sha,
         'd0c5e7d0c5e7' AS policy_set_version FROM finals""",
)
def final_verdicts(spark, sf_dir):
    done = doc_evaluation(spark, sf_dir)
    return done.select(
        "doc_id",
        "evaluation.final_verdict",
        F.col("evaluation.block_user_message").alias("block_message"),
        F.sha2("evaluation.mutated_text", 256).alias("text_sha"),
        "evaluation.policy_set_version",
    )


@CATALOG.query(
    "decision_order",
    f"""{_DECISIONS_SQL} SELECT doc_id, coalesce(string_agg(policy_id, '>' ORDER BY policy_id), '-') AS decisions
        FROM flags LEFT JOIN fired USING (doc_id) GROUP BY doc_id""",
)
def decision_order(spark, sf_dir):
    ids = F.transform("evaluation.decisions", lambda d: F.coalesce(d["policy_id"], F.lit("-")))
    return doc_evaluation(spark, sf_dir).select("doc_id", F.array_join(ids, ">").alias("decisions"))


@CATALOG.query(
    "redaction_evidence",
    f"""{_DECISIONS_SQL}, hits AS ({hits_sql()})
       SELECT doc_id, 'mask_numbers' AS policy_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos,
              'response' AS location, 'sha256:' || sha256(hit) AS before_hash,
              'sha256:' || sha256('[' || cls || ']') AS after_hash
       FROM hits JOIN finals USING (doc_id) WHERE worst = 1 AND cls IN ('pii:card', 'pii:ip')""",
)
def redaction_evidence(spark, sf_dir):
    rows = decision_rows(doc_evaluation(spark, sf_dir), ["doc_id"])
    listed = rows.select("doc_id", "policy_id", F.posexplode("redactions_applied").alias("pos", "r"))
    return listed.select("doc_id", "policy_id", "pos", "r.location", "r.before_hash", "r.after_hash")


# E-mail addresses overlap the host names and user names inside them.
_OVERLAPPING = {"x:email": EMAIL, "x:host": r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\b", "x:number": r"\b\d+\b"}


@CATALOG.query(
    "redact_overlapping",
    f"""WITH hits AS ({hits_sql(patterns=_OVERLAPPING)}),
     ops AS (SELECT doc_id, list({{'s': s::BIGINT, 'e': (s + length(hit))::BIGINT, 't': '<' || cls || '>', 'cur': 0::BIGINT, 'out': '', 'n': 0::BIGINT}}
                                ORDER BY s, cls_rank, i) AS ops FROM hits GROUP BY doc_id),
     folded AS (SELECT doc_id, text, list_reduce(
          list_prepend({{'s': 0::BIGINT, 'e': 0::BIGINT, 't': '', 'cur': 0::BIGINT, 'out': '', 'n': 0::BIGINT}}, ops),
          lambda a, o: CASE WHEN o.s < a.cur THEN a ELSE
            {{'s': 0::BIGINT, 'e': 0::BIGINT, 't': '', 'cur': o.e,
             'out': a.out || substr(text, a.cur + 1, o.s - a.cur) || o.t, 'n': a.n + 1}} END) AS r
        FROM ops JOIN documents USING (doc_id))
     SELECT doc_id, r.n AS applied, sha256(r.out || substr(text, r.cur + 1)) AS text_sha FROM folded""",
)
def redact_overlapping(spark, sf_dir):
    from vigilake.operators.taxonomy import taxonomy

    classes = [{"class": c[2:], "recognizer": "regex", "pattern": p} for c, p in _OVERLAPPING.items()]
    hits = classify.with_hits(documents(spark, sf_dir), "text", [taxonomy("x", classes)], "response")
    ops = F.transform(
        "hits",
        lambda h: F.struct(
            h["start"].alias("start"), F.lit("all").alias("policy_id"), h["ord"].alias("ord"), h["end"].alias("end"),
            h["text"].alias("text"), F.concat(F.lit("<"), h["cls"], F.lit(">")).alias("template"),
        ),
    )
    done = hits.where(F.size("hits") > 0).select("doc_id", F.inline(F.array(redact_spans(F.col("text"), ops, "response"))))
    return done.select("doc_id", F.size("applied").alias("applied"), F.sha2("text", 256).alias("text_sha"))


@CATALOG.query(
    "audit_only_counterfactuals",
    f"""{_DECISIONS_SQL} SELECT policy_id, would_have_blocked, count(*) AS decisions FROM fired
        WHERE enforcement_mode = 'audit_only' GROUP BY ALL""",
)
def audit_only_counterfactuals(spark, sf_dir):
    rows = decision_rows(doc_evaluation(spark, sf_dir), ["doc_id"]).where("enforcement_mode = 'audit_only'")
    return rows.groupBy("policy_id", "would_have_blocked").agg(F.count("*").alias("decisions"))


_ELIGIBLE = "\nUNION ALL\n".join(
    f"SELECT doc_id, '{p.policy_id}' AS policy_id, {p.on_classifier_error == 'fail_closed'} AS closed FROM flags "
    f"WHERE source = 'src3' AND ({'TRUE' if p.destination == 'any' else f'''dest = '{p.destination}' '''})"
    for p in DOC_POLICIES.policies
)


@CATALOG.query(
    "classifier_error",
    f"""{_DECISIONS_SQL}, eligible AS ({_ELIGIBLE})
       SELECT doc_id, policy_id, CASE WHEN closed THEN 'blocked' ELSE 'allowed' END AS verdict,
              'error' AS enforcement_mode, closed AS would_have_blocked, 'classifier_timeout' AS error_reason,
              'blocked' AS final_verdict, 'No card numbers.' AS block_message FROM eligible
       UNION ALL
       SELECT doc_id, policy_id, verdict, enforcement_mode, would_have_blocked, NULL, {_VERDICT_SQL},
              CASE WHEN worst = 3 THEN 'E-mail addresses stay inside.' END
       FROM flags LEFT JOIN fired USING (doc_id) JOIN finals USING (doc_id) WHERE source <> 'src3' AND policy_id IS NOT NULL
       UNION ALL
       SELECT doc_id, NULL, 'allowed', 'enforced', NULL, NULL, 'allowed', NULL FROM flags
       WHERE source <> 'src3' AND doc_id NOT IN (SELECT doc_id FROM fired)""",
)
def classifier_error(spark, sf_dir):
    done = doc_evaluation(spark, sf_dir, doc_error())
    rows = done.select(
        "doc_id",
        F.col("evaluation.final_verdict").alias("final_verdict"),
        F.col("evaluation.block_user_message").alias("block_message"),
        F.inline("evaluation.decisions"),
    )
    return rows.select(
        "doc_id", "policy_id", "verdict", "enforcement_mode", "would_have_blocked", "error_reason", "final_verdict",
        "block_message",
    )


@CATALOG.query(
    "classifier_error_without_rules",
    """SELECT doc_id, NULL AS policy_id, 'allowed' AS verdict,
              CASE WHEN source = 'src3' THEN 'error' ELSE 'enforced' END AS enforcement_mode,
              CASE WHEN source = 'src3' THEN false END AS would_have_blocked,
              CASE WHEN source = 'src3' THEN 'classifier_timeout' END AS error_reason FROM documents""",
)
def classifier_error_without_rules(spark, sf_dir):
    done = evaluate(
        doc_hits(spark, sf_dir), policies.PolicySet((), policies.EMPTY_SET), text="text", hits="hits",
        direction="response", clock=CLOCK, key="doc_id", error=doc_error(),
    )
    rows = decision_rows(done, ["doc_id"])
    return rows.select("doc_id", "policy_id", "verdict", "enforcement_mode", "would_have_blocked", "error_reason")


@CATALOG.query(
    "alert_records",
    f"""{_DECISIONS_SQL} SELECT doc_id, policy_id,
         'alert_2025-03-04_05-06-07_' || substr(sha256(doc_id::VARCHAR || '|' || policy_id || '|fixed'), 1, 24) AS alert,
         'pending' AS delivery_status, NULL::VARCHAR AS delivered_at
       FROM fired WHERE verdict = 'alerted' AND enforcement_mode = 'enforced'""",
)
def alert_records(spark, sf_dir):
    rows = decision_rows(doc_evaluation(spark, sf_dir), ["doc_id"]).where("alert_id is not null")
    return rows.select(
        "doc_id", "policy_id", F.col("alert_id.id").alias("alert"), "alert_id.delivery_status", "alert_id.delivered_at"
    )


# --- exchanges ---------------------------------------------------------------


def talk(spark, sf_dir, **options):
    return evaluate_exchanges(exchanges(spark, sf_dir), [TOPIC], TALK_POLICIES, CLOCK, **options)


@CATALOG.query(
    "exchange_verdicts",
    f"""WITH {TALK_SQL} SELECT exchange_id, prompt_verdict, response_verdict, verdict, block_message,
          sha256(final_prompt) AS prompt_sha, sha256(final_response) AS response_sha FROM talk""",
)
def exchange_verdicts(spark, sf_dir):
    return talk(spark, sf_dir).select(
        "exchange_id",
        F.col("prompt_eval.final_verdict").alias("prompt_verdict"),
        F.col("response_eval.final_verdict").alias("response_verdict"),
        "verdict",
        "block_message",
        F.sha2("final_prompt", 256).alias("prompt_sha"),
        F.sha2("final_response", 256).alias("response_sha"),
    )


@CATALOG.query(
    "exchange_passthrough",
    f"""WITH {TALK_SQL} SELECT exchange_id, verdict, sha256(prompt) AS prompt_sha,
          sha256(final_response) AS response_sha FROM talk""",
)
def exchange_passthrough(spark, sf_dir):
    return talk(spark, sf_dir, mode=PASSTHROUGH).select(
        "exchange_id", "verdict", F.sha2("final_prompt", 256).alias("prompt_sha"),
        F.sha2("final_response", 256).alias("response_sha"),
    )


_ALONE = """SELECT conv_id * 1000 + turn AS exchange_id, CASE WHEN role = 'assistant' THEN 'response' ELSE 'prompt' END
            AS direction, text FROM conversations"""


@CATALOG.query(
    "single_phase_checks",
    f"""WITH alone AS ({_ALONE}), counted AS (
         SELECT *, {words_sql('text', 'topic:german')} AS g, {words_sql('text', 'topic:link')} AS l,
                {words_sql('text', 'topic:motion')} AS m FROM alone)
       SELECT exchange_id, direction,
              CASE direction WHEN 'prompt' THEN
                CASE WHEN g > 0 THEN 'blocked' WHEN l > 0 THEN 'redacted' ELSE 'allowed' END
              ELSE CASE WHEN m > 0 AND l > 0 THEN 'blocked' WHEN g > 0 THEN 'alerted' WHEN m > 0 THEN 'redacted'
                        ELSE 'allowed' END END AS verdict,
              CASE direction WHEN 'prompt' THEN sha256(text) ELSE sha256('Extension response check') END AS prompt_sha
       FROM counted""",
)
def single_phase_checks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn")
    records = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("exchange_id"),
        F.when(F.col("role") == "assistant", "response").otherwise("prompt").alias("direction"),
        "text",
    )
    done = evaluate_single_phase(records, [TOPIC], TALK_POLICIES, CLOCK)
    return done.select("exchange_id", "direction", "verdict", F.sha2("final_prompt", 256).alias("prompt_sha"))


@CATALOG.query(
    "single_phase_receipts",
    f"""SELECT 'rcp_2025-03-04T05-06-07_' || substr(sha256((conv_id || '/' || turn)::VARCHAR), 1, 24) AS receipt_id, 'OK' AS status,
          CASE WHEN role = 'assistant' THEN 'Extension response check' ELSE text END AS prompt,
          sha256(CASE WHEN role <> 'assistant' THEN '' WHEN m > 0 AND l = 0 AND g = 0 THEN {masked_words_sql("text", "topic:motion", "#")} ELSE text END) AS response_sha
        FROM (SELECT *, {words_sql('text', 'topic:german')} AS g, {words_sql('text', 'topic:link')} AS l, {words_sql('text', 'topic:motion')} AS m FROM conversations)""",
)
def single_phase_receipts(spark, sf_dir):
    """Every lone phase leaves a receipt, which verifies; a response's holds a note in place of the prompt."""
    turns = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    who = F.struct(F.lit("u").alias("user_id"), *[none.alias(n) for n in ("user_role", "department", "auth_method")])
    what = F.struct(F.lit("t").alias("tool_id"), F.lit("m").alias("model_id"), *[none.alias(n) for n in ("tool_version", "model_vendor", "endpoint")])
    records = turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("exchange_id"),
        F.when(F.col("role") == "assistant", "response").otherwise("prompt").alias("direction"), "text", who.alias("actor"), what.alias("tool"),
    )
    made = verify(build_receipts(evaluate_single_phase(records, [TOPIC], TALK_POLICIES, CLOCK), CLOCK.now))
    r = F.col("receipt")
    return made.select(r["receipt_id"].alias("receipt_id"), "status", r["prompt"]["text"].alias("prompt"), F.sha2(r["response"]["text"], 256).alias("response_sha"))


@CATALOG.query(
    "dry_run",
    f"""WITH {TALK_SQL} SELECT exchange_id, 'prompt' AS phase, prompt_verdict AS final_verdict FROM talk
        UNION ALL
        SELECT exchange_id, 'response', CASE WHEN rm > 0 AND rl > 0 THEN 'blocked' WHEN rg > 0 THEN 'alerted'
               WHEN rm > 0 THEN 'redacted' ELSE 'allowed' END FROM talk WHERE response IS NOT NULL""",
)
def dry_run_query(spark, sf_dir):
    return dry_run(exchanges(spark, sf_dir), [TOPIC], TALK_POLICIES, CLOCK).select("exchange_id", "phase", "final_verdict")


# --- policy documents: every part is taken as a policy file ------------------


def policy_files(spark, sf_dir):
    """Part rows as JSON policies; sizes and types make some of them wrong in known ways."""
    part = table(spark, sf_dir, "part", "p_partkey")
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "block").when(size % 3 == 1, "redact").otherwise("alert")
    name = F.regexp_replace(F.lower(F.concat_ws("_", "p_name", "p_brand")), "[^a-z0-9]+", F.when(size == 7, "-").otherwise("_"))
    classes = F.array(F.lit("pii:card"), F.when(size == 11, F.lit("card")).otherwise(F.lit("pii:ip")))
    doc = F.struct(
        F.when(size == 13, "2.0").otherwise("1.0").alias("schema_version"),
        name.alias("policy_id"),
        F.lit("1").alias("policy_version"),
        F.struct(
            F.when(size == 17, "both").otherwise("prompt").alias("direction"),
            F.lit("any").alias("destination"),
            F.struct(
                F.when(size != 19, classes).alias("any_of"),
                F.when(size == 23, classes).alias("all_of"),
            ).alias("classes"),
        ).alias("match"),
        kind.alias("verdict"),
        F.when((kind == "block") & (size != 27), F.struct(F.lit("no").alias("user_message"))).alias("block_config"),
        F.when(
            kind == "redact", F.struct(F.when(size == 28, "[{id}]").otherwise("[{class}]").alias("redact_with"))
        ).alias("redact_config"),
        F.when(kind == "alert", F.struct(F.when(size == 29, "/hook").alias("webhook"))).alias("alert_config"),
        F.when(size == 31, F.lit("x")).alias("priority"),
    )
    return part.select(
        F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".yaml")).alias("file"), F.to_json(doc).alias("body")
    )


_POLICY_ID_SQL = """regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9]+', CASE WHEN p_size = 7 THEN '-' ELSE '_' END, 'g')"""
_POLICY_ERRORS_SQL = """SELECT lpad(p_partkey::VARCHAR, 9, '0') || '.yaml' AS file, message FROM (
    SELECT p_partkey, unnest([x FOR x IN [
      CASE WHEN p_size = 31 THEN 'unknown field priority' END,
      CASE WHEN p_size = 13 THEN 'schema_version: must be one of 1.0' END,
      CASE WHEN p_size = 7 THEN 'policy_id: must be snake_case, 3 to 128 characters, starting with a letter' END,
      CASE WHEN p_size = 17 THEN 'match.direction: must be one of prompt, response' END,
      CASE WHEN p_size = 19 OR p_size = 23 THEN 'match.classes: exactly one of any_of and all_of' END,
      CASE WHEN p_size = 11 THEN 'match.classes: classes are written namespace:name' END,
      CASE WHEN p_size = 27 THEN 'block_config: required by the verdict' END,
      CASE WHEN p_size = 28 THEN 'redact_config.redact_with: only {class} is replaced' END,
      CASE WHEN p_size = 29 THEN 'alert_config.webhook: must be an http(s) URL' END] IF x IS NOT NULL]) AS message
    FROM part)"""


@CATALOG.query("policy_validation", _POLICY_ERRORS_SQL)
def policy_validation(spark, sf_dir):
    return policies.validation_errors(policy_files(spark, sf_dir))


_DUPLICATES_SQL = f"""SELECT file, 'duplicate policy_id ' || id || ' of ' || first AS message FROM (
    SELECT *, min(file) OVER (PARTITION BY id) AS first FROM (
      SELECT lpad(p_partkey::VARCHAR, 9, '0') || '.yaml' AS file, {_POLICY_ID_SQL} AS id FROM part WHERE {{}}))
    WHERE file > first"""


@CATALOG.query("policy_duplicates", _DUPLICATES_SQL.format("TRUE"))
def policy_duplicates(spark, sf_dir):
    return policies.duplicate_ids(policy_files(spark, sf_dir))


@CATALOG.query(
    "policy_load_errors",
    f"""{_POLICY_ERRORS_SQL} UNION ALL
        {_DUPLICATES_SQL.format('p_size NOT IN (7, 11, 13, 17, 19, 23, 27, 28, 29, 31)')}""",
)
def policy_load_errors(spark, sf_dir):
    return policies.load_errors(policy_files(spark, sf_dir))


# --- taxonomies: every part is taken as a taxonomy file -----------------------

_PATTERNS = {
    5: (r"a*", "pattern can match the empty string"), 6: (r"(open", "invalid regex"), 7: (r"(?P<d>\\d)(?P=d)", "back-references by name and conditions are not supported"),
    8: (r"(?P<y>\\d{4})-\\d\\Z", None), 9: (r"\\b", "pattern can match the empty string"), 10: (r"[z-a]", "invalid regex"), 11: (r"(a)?(?(1)b|c)", "back-references by name and conditions are not supported"),
}


def taxonomy_files(spark, sf_dir):
    """Part rows as JSON taxonomies of two classes; sizes make some of them wrong in known ways."""
    size, lit = F.col("p_size"), F.lit
    pattern = lit('"x\\\\d+"')
    for k, (text, _) in _PATTERNS.items():
        pattern = F.when(size == k, lit(f'"{text}"')).otherwise(pattern)
    pattern = F.when(size == 12, lit("5")).when(size == 13, lit("null")).otherwise(pattern)
    kind = F.when(size == 14, "guess").otherwise("regex")
    first = F.concat(lit('{"class": "c", "recognizer": "'), kind, lit('", "pattern": '), pattern, lit("}"))
    first = F.when(size == 15, lit("7")).otherwise(first)
    words = F.when(size == 16, "[]").when(size == 17, '"one"').otherwise('["one", "two.x"]')
    second = F.concat(lit('{"class": "w", "recognizer": "keyword_list", "pattern": '), words, lit("}"))
    classes = F.when(size == 18, "[]").otherwise(F.concat(lit("["), first, lit(", "), second, lit("]")))
    named = F.when(size == 19, '"a:b"').when(size == 20, '""').otherwise('"ns"')
    whole = F.concat(lit('{"namespace": '), named, lit(', "classes": '), classes, lit("}"))
    body = F.when(size == 21, "[1]").when(size == 22, '{"namespace": "ns"}').otherwise(whole)
    return table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), lit(".json")).alias("file"), body.alias("body"))


_TAXONOMY_WRONG = [
    *[(k, 0, message) for k, (_, message) in _PATTERNS.items() if message],
    (12, 0, "a regex pattern is a string"), (13, 0, "class, recognizer and pattern are all required"), (14, 0, "recognizer is none of regex, keyword_list, spacy_ner"),
    (15, 0, "class entries must be mappings"), (16, 1, "a keyword pattern is a non-empty list"), (17, 1, "a keyword pattern is a non-empty list"),
    (18, None, "no classes declared"), (19, None, "a namespace is non-empty and holds no '':''"), (20, None, "a namespace is non-empty and holds no '':''"),
    (21, None, "''namespace'' and ''classes'' are required at the top"), (22, None, "''namespace'' and ''classes'' are required at the top"),
]
_WRONG_SQL = ", ".join(f"({k}, {'NULL::INT' if at is None else at}, '{message}')" for k, at, message in _TAXONOMY_WRONG)


@CATALOG.query(
    "taxonomy_violations",
    f"SELECT p_partkey || '.json' AS file, position, message FROM part JOIN (VALUES {_WRONG_SQL}) AS wrong(size, position, message) ON size = p_size",
)
def taxonomy_violations(spark, sf_dir):
    return check_taxonomies(taxonomy_files(spark, sf_dir))


@CATALOG.query(
    "policy_set_versions",
    """SELECT o_custkey AS directory, count(*) AS n_files, substr(sha256(string_agg(
         o_orderkey::VARCHAR || '.yaml:' || sha256(o_orderpriority || o_totalprice::DECIMAL(18,2)::VARCHAR), chr(10)
         ORDER BY o_orderkey::VARCHAR || '.yaml')), 1, 12) AS policy_set_version FROM orders GROUP BY o_custkey""",
)
def policy_set_versions(spark, sf_dir):
    """Every customer's orders as one directory of files."""
    orders = table(spark, sf_dir, "orders")
    files = orders.select(
        F.col("o_custkey").alias("directory"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".yaml")).alias("file"),
        F.concat("o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("content"),
    )
    return policies.set_versions(files)


# --- sanitizer ---------------------------------------------------------------

_SANITIZER = {"net": [IP], "id": [CARD, r"\b[0-9a-f]{10}\b"], "mail": [EMAIL], "shout": [r"\b[A-Z]{6,}\b"]}
_RULES = [
    sanitize.Rule("hide_ids", "redact", "id"),
    sanitize.Rule("hide_net", "redact", "net", mask_token="<ip>"),
    sanitize.Rule("stop_mail", "block", "mail", block_message="Mail is blocked."),
    sanitize.Rule("note_net", "allow", "net"),
]


def sanitized(spark, sf_dir):
    return sanitize.sanitize(documents(spark, sf_dir), "text", _SANITIZER, _RULES)


@CATALOG.query(
    "sanitize",
    f"""WITH steps AS (SELECT doc_id, text, regexp_matches(text, '(?i){EMAIL}') AS b,
          regexp_matches(text, '(?i){CARD}') AS h1, regexp_replace(text, '(?i){CARD}', '[REDACTED_HIDE_IDS]', 'g') AS t1
        FROM documents),
      two AS (SELECT *, regexp_matches(t1, '(?i)\\b[0-9a-f]{{10}}\\b') AS h2,
          regexp_replace(t1, '(?i)\\b[0-9a-f]{{10}}\\b', '[REDACTED_HIDE_IDS]', 'g') AS t2 FROM steps),
      three AS (SELECT *, regexp_matches(t2, '(?i){IP}') AS h3, regexp_replace(t2, '(?i){IP}', '<ip>', 'g') AS t3 FROM two)
      SELECT doc_id, CASE WHEN b THEN 'block' WHEN h1 OR h2 OR h3 THEN 'redact' ELSE 'allow' END AS verdict,
             CASE WHEN b THEN sha256('Mail is blocked.') ELSE sha256(t3) END AS processed_sha,
             CASE WHEN b THEN 'stop_mail' WHEN NOT (h1 OR h2 OR h3) THEN 'None'
                  ELSE concat_ws(',', CASE WHEN h1 OR h2 THEN 'hide_ids' END, CASE WHEN h3 THEN 'hide_net' END) END AS rules
      FROM three""",
)
def sanitize_query(spark, sf_dir):
    return sanitized(spark, sf_dir).select(
        "doc_id", "verdict", F.sha2("processed", 256).alias("processed_sha"), F.array_join("matched_rules", ",").alias("rules")
    )


_LABELLED_SQL = """'Order ' || o_orderkey || ' born on ' || strftime(o_orderdate, '%Y-%m-%d') || ', DOB: '
    || strftime(o_orderdate, '%m/%d/%y') || '; due ' || strftime(o_orderdate, '%Y-%m-%d')"""


@CATALOG.query(
    "mask_labelled_dates",
    """SELECT o_orderkey, 'Order ' || o_orderkey || ' born on [redacted], DOB: [redacted]; due '
              || strftime(o_orderdate, '%Y-%m-%d') AS masked FROM orders""",
)
def mask_labelled_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(
        F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" born on "), day, F.lit(", DOB: "),
        F.date_format("o_orderdate", "MM/dd/yy"), F.lit("; due "), day,
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", sanitize.mask_labelled(text).alias("masked"))
