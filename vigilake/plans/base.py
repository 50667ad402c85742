"""Config and tables the queries share, and SQL pieces that say the same in DuckDB."""

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.spread import spread
from vigilake.operators.evaluate import OUTCOME, RANK, Clock
from vigilake.operators.policies import Policy, PolicySet
from vigilake.operators.taxonomy import taxonomy
from vigilake.session import checkpoint_dir, configure

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries, each with the SQL it must agree with where SQL can say it."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(configure(spark), sf_dir)

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return fn

        return register


NOW = datetime.datetime(2025, 3, 4, 5, 6, 7, 89)
CLOCK = Clock(NOW, run_id="fixed")
NOW_ISO = "2025-03-04T05:06:07.000089Z"


def table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A test table; with ``keys`` spread over the cores if its files are too few."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, *keys) if keys else df


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of a table that queries read as they would find it stored: written once per session and test tables."""
    key = spark.sparkContext.applicationId, str(sf_dir), name
    if key not in _STORED:
        path = f"{checkpoint_dir(spark).rstrip('/')}/vigilake/{name}-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = path
    return _STORED[key]


# --- documents: numbers and addresses ---------------------------------------

CARD, EMAIL, IP = r"\b\d{16}\b", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
PII = taxonomy(
    "pii",
    [
        {"class": "card", "recognizer": "regex", "pattern": CARD},
        {"class": "email", "recognizer": "regex", "pattern": EMAIL},
        {"class": "ip", "recognizer": "regex", "pattern": IP},
    ],
)
PII_PATTERNS = {"pii:card": CARD, "pii:email": EMAIL, "pii:ip": IP}
DOC_POLICIES = PolicySet(
    (
        Policy("block_mail", "1", "response", "external_vendor", "any_of", ("pii:email",), "block",
               user_message="E-mail addresses stay inside."),
        Policy("both_alert", "2", "response", "external_vendor", "all_of", ("pii:card", "pii:ip"), "alert"),
        Policy("mask_numbers", "1", "response", "any", "any_of", ("pii:card", "pii:ip"), "redact",
               redact_with="[{class}]"),
        Policy("narrow_mask", "1", "response", "any", "any_of", ("pii:email", "pii:card"), "redact",
               redact_with="<card>", classes_to_redact=("pii:card",)),
        Policy("trial_card_block", "3", "response", "any", "any_of", ("pii:card",), "block",
               user_message="No card numbers.", audit_only=True, on_classifier_error="fail_closed"),
        Policy("watch_ip", "1", "response", "internal", "any_of", ("pii:ip",), "alert",
               webhook="https://alerts.example.org/hook"),
    ),
    "d0c5e7d0c5e7",
)
DOC_DESTINATION_SQL = "CASE WHEN lang = 'de' THEN 'internal' ELSE 'external_vendor' END"


def doc_destination():
    return F.when(F.col("lang") == "de", "internal").otherwise("external_vendor")


def doc_error():
    return F.when(F.col("source") == "src3", "classifier_timeout")


def hits_sql(source: str = "documents", key: str = "doc_id", text: str = "text", patterns=None) -> str:
    """CTE body with one row per hit: key, class, place in class order, span and text."""
    parts = []
    for rank, (cls, pattern) in enumerate((patterns or PII_PATTERNS).items()):
        parts.append(
            f"""SELECT {key}, '{cls}' AS cls, {rank} AS cls_rank, i,
                  list_sum(list_transform(g[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, m[i] AS hit
                FROM (SELECT {key}, g, m, unnest(range(1, len(m) + 1)) AS i
                      FROM (SELECT {key}, regexp_extract_all({text}, '(?i){pattern}') AS m,
                                   string_split_regex({text}, '(?i){pattern}') AS g FROM {source}))"""
        )
    return "\nUNION ALL\n".join(parts)


FLAGS_SQL = f"""flags AS (
    SELECT *, {DOC_DESTINATION_SQL} AS dest,
           len(regexp_extract_all(text, '(?i){CARD}')) AS n_card,
           len(regexp_extract_all(text, '(?i){EMAIL}')) AS n_email,
           len(regexp_extract_all(text, '(?i){IP}')) AS n_ip
    FROM documents)"""


def decisions_sql(policies, flags: str, key: str, counts: dict[str, str], direction: str) -> str:
    """SELECTs of fired rules and of the stand-in for rows where none fired, by cases per rule."""
    fired = []
    for p in policies:
        if p.direction != direction:
            continue
        seen = [f"{counts[c]} > 0" for c in p.classes]
        fires = (" OR " if p.match_mode == "any_of" else " AND ").join(seen)
        where = "TRUE" if p.destination == "any" else f"dest = '{p.destination}'"
        matched = ", ".join(f"CASE WHEN {s} THEN '{c}' END" for s, c in zip(seen, p.classes))
        mode = "audit_only" if p.audit_only else "enforced"
        would = ("true" if p.verdict == "block" else "false") if p.audit_only else "NULL::BOOLEAN"
        fired.append(
            f"""SELECT {key}, '{p.policy_id}' AS policy_id, '{OUTCOME[p.verdict]}' AS verdict,
                  '{mode}' AS enforcement_mode, concat_ws(',', {matched}) AS matched, {would} AS would_have_blocked,
                  {RANK[OUTCOME[p.verdict]] if not p.audit_only else 'NULL'} AS rnk
                FROM {flags} WHERE {where} AND ({fires})"""
        )
    return "\nUNION ALL\n".join(fired)


# --- conversations: exchanges of a user turn and the answer to it ------------

WORDS = {
    "topic:motion": ["tion", "ha", "es"],
    "topic:link": ["with", "from", "que"],
    "topic:german": ["und", "die"],
}
TOPIC = taxonomy(
    "topic",
    [{"class": c.split(":")[1], "recognizer": "keyword_list", "pattern": w} for c, w in WORDS.items()],
)
TALK_POLICIES = PolicySet(
    (
        Policy("p_block_german", "1", "prompt", "any", "any_of", ("topic:german",), "block",
               user_message="This assistant is not cleared for that."),
        Policy("p_mask_link", "1", "prompt", "external_vendor", "any_of", ("topic:link",), "redact",
               redact_with="[{class}]"),
        Policy("r_alert_german", "1", "response", "any", "any_of", ("topic:german",), "alert"),
        Policy("r_block_both", "1", "response", "any", "all_of", ("topic:motion", "topic:link"), "block",
               user_message="The answer was withheld."),
        Policy("r_mask_motion", "1", "response", "any", "any_of", ("topic:motion",), "redact",
               redact_with="#"),
    ),
    "7a1c7a1c7a1c",
)


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user turn, with the assistant's answer where the next turn is one.

    An equal join on (conversation, turn): unique keys, so no conversation is hot.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    pairs = asked.join(answers, ["conv_id", "turn"], "left")
    return pairs.withColumns(
        {
            "exchange_id": F.col("conv_id") * 1000 + F.col("turn"),
            "actor": F.struct(
                F.concat(F.lit("user"), F.col("conv_id")).alias("user_id"),
                F.lit("analyst").alias("user_role"),
                F.lit(None).cast("string").alias("department"),
                F.lit(None).cast("string").alias("auth_method"),
            ),
            "tool": F.struct(
                F.lit("desk").alias("tool_id"),
                F.lit(None).cast("string").alias("tool_version"),
                F.concat(F.lit("model-"), F.col("turn") % 4).alias("model_id"),
                F.lit(None).cast("string").alias("model_vendor"),
                F.lit(None).cast("string").alias("endpoint"),
            ),
        }
    )


EXCHANGES_SQL = """exchanges AS (
    SELECT a.conv_id, a.turn, a.conv_id * 1000 + a.turn AS exchange_id, a.text AS prompt, b.text AS response
    FROM conversations a LEFT JOIN conversations b
      ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
    WHERE a.role = 'user')"""


def words_sql(text: str, cls: str) -> str:
    """How often a keyword class occurs: whole words, whatever their case."""
    listed = ", ".join(f"'{w}'" for w in WORDS[cls])
    return f"len(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({listed})))"


def masked_words_sql(text: str, cls: str, mask: str) -> str:
    """Keywords replaced. The pattern takes the separators along, so a second pass gets the neighbours."""
    sep = r"[^\p{L}\p{N}_]"
    pattern = f"(^|{sep})(?:{'|'.join(WORDS[cls])})({sep}|$)"
    once = f"regexp_replace({text}, '(?i){pattern}', '\\1{mask}\\2', 'g')"
    return f"regexp_replace({once}, '(?i){pattern}', '\\1{mask}\\2', 'g')"


# Each phase's outcome per exchange, by cases.
TALK_SQL = f"""{EXCHANGES_SQL},
counted AS (
    SELECT *, {words_sql('prompt', 'topic:german')} AS pg, {words_sql('prompt', 'topic:link')} AS pl,
           {words_sql('response', 'topic:german')} AS rg, {words_sql('response', 'topic:link')} AS rl,
           {words_sql('response', 'topic:motion')} AS rm, {words_sql('prompt', 'topic:motion')} AS pm
    FROM exchanges),
phases AS (
    SELECT *, CASE WHEN pg > 0 THEN 'blocked' WHEN pl > 0 THEN 'redacted' ELSE 'allowed' END AS prompt_verdict,
           CASE WHEN pg > 0 OR response IS NULL THEN NULL WHEN rm > 0 AND rl > 0 THEN 'blocked'
                WHEN rg > 0 THEN 'alerted' WHEN rm > 0 THEN 'redacted' ELSE 'allowed' END AS response_verdict
    FROM counted),
talk AS (
    SELECT *,
           CASE WHEN prompt_verdict = 'blocked' OR response_verdict = 'blocked' THEN 'blocked'
                WHEN prompt_verdict = 'redacted' OR response_verdict = 'redacted' THEN 'redacted'
                ELSE 'allowed' END AS verdict,
           CASE WHEN prompt_verdict = 'blocked' THEN 'This assistant is not cleared for that.'
                WHEN response_verdict = 'blocked' THEN 'The answer was withheld.' END AS block_message,
           CASE WHEN prompt_verdict = 'redacted' THEN {masked_words_sql('prompt', 'topic:link', '[topic:link]')}
                ELSE prompt END AS final_prompt,
           CASE WHEN prompt_verdict = 'blocked' OR response IS NULL THEN ''
                WHEN response_verdict = 'redacted' THEN {masked_words_sql('response', 'topic:motion', '#')}
                ELSE response END AS final_response
    FROM phases)"""
