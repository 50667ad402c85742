"""Receipts: building, hashing, verifying."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake import schemas
from vigilake.functions.canonical import json_of, lower_controls, with_blanked
from vigilake.functions.once import with_once
from vigilake.functions.text import prefixed_sha256
from vigilake.operators.classify import data_classes
from vigilake.operators.evaluate import iso_utc

# Fixed value: the receipt format this package writes.
SCHEMA_VERSION = "1.1"
DAYS_PER_YEAR = 365


def receipt_id(ts: Column, key: Column, digits: int = 24) -> Column:
    """Id with a second's resolution and a hash suffix, stable over reruns.

    Six hex digits are the format's minimum. A batch may put all its receipts into one
    second, so the suffix has 96 bits: two of 10^12 receipts share one with a chance below 10^-5.
    """
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")
    return F.concat(F.lit("rcp_"), stamp, F.lit("_"), F.substring(F.sha2(key.cast("string"), 256), 1, digits))


def _texts(text: str, text_hash: str, **extra: Column) -> Column:
    fields = {
        "text": F.col(text),
        "text_hash": F.col(text_hash),
        "text_length_chars": F.char_length(text).cast("bigint"),
        **extra,
    }
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def _named(value: Column | None, sql_type: str) -> Column:
    return F.lit(None).cast(sql_type) if value is None else value


def _sorted_decisions(decisions: Column) -> Column:
    names = [
        "alert_id", "enforcement_mode", "error_reason", "evaluated_at", "matched_classes", "policy_id",
        "policy_set_version", "policy_version", "redactions_applied", "verdict", "would_have_blocked",
    ]

    def one(d):
        alert = F.when(
            d["alert_id"].isNotNull(),
            F.struct(*[d["alert_id"][n].alias(n) for n in ("delivered_at", "delivery_status", "id")]),
        )
        redactions = F.transform(
            d["redactions_applied"], lambda r: F.struct(*[r[n].alias(n) for n in ("after_hash", "before_hash", "location")])
        )
        special = {"alert_id": alert, "redactions_applied": redactions}
        return F.struct(*[special.get(n, d[n]).alias(n) for n in names])

    return F.transform(decisions, one).cast(f"array<{schemas.SORTED_DECISION}>")


def build_receipts(
    evaluated: DataFrame,
    now: Column,
    *,
    key: str = "exchange_id",
    actor: Column | None = None,
    tool: Column | None = None,
    context_references: Column | None = None,
    downstream_actions: Column | None = None,
    external_trace_uri: Column | None = None,
    tokens_used: Column | None = None,
    latency_ms: Column | None = None,
    legal_hold: Column | None = None,
    signature: Column | None = None,
    retention_policy: str = "default_seven_year",
    retention_years: int = 7,
    retention_days: int | None = None,
    captured_by: str = "vigilake",
    capture_method: str = "http_proxy_intercept",
    hash_prefix: str = "sha256:",
) -> DataFrame:
    """One receipt per evaluated exchange: ``receipt`` (struct), ``raw`` (JSON) and ``day``.

    Reads the columns evaluate_exchanges() adds. ``actor`` and ``tool`` default to
    the columns of that name. Narrow: no shuffle.
    """
    days = DAYS_PER_YEAR * retention_years if retention_days is None else retention_days
    until = now + F.make_dt_interval(F.lit(days))
    who = F.col("actor") if actor is None else actor
    what = F.col("tool") if tool is None else tool

    def pick(value, sql_type):
        names = [part.split(":")[0] for part in sql_type[len("struct<") : -1].split(",")]
        return F.struct(*[value[n].cast("string").alias(n) for n in names])

    none = F.array()
    touched = F.transform(
        data_classes(F.col("all_hits")),
        lambda c: F.struct(*[c[n].alias(n) for n in ("class", "in_prompt", "in_response", "instances")]),
    )
    references = none if context_references is None else F.coalesce(context_references, none)
    actions = none if downstream_actions is None else F.coalesce(downstream_actions, none)
    base = with_once(
        evaluated,
        {
            "__touched": touched,
            "__decisions": _sorted_decisions(F.col("decisions")),
            "__prompt_hash": prefixed_sha256(F.col("final_prompt"), hash_prefix),
            "__response_hash": prefixed_sha256(F.col("final_response"), hash_prefix),
        },
    )

    parts = {
        "actor": pick(who, schemas.ACTOR),
        "data_classes_touched": F.col("__touched"),
        "downstream_actions": actions.cast(f"array<{schemas.ACTION}>"),
        "evidence": F.struct(
            F.lit(capture_method).alias("capture_method"),
            F.lit(captured_by).alias("captured_by"),
            F.lit("").alias("receipt_hash"),
            _named(signature, "string").alias("signature"),
        ),
        "external_trace_uri": _named(external_trace_uri, "string"),
        "policy_decisions": F.col("__decisions"),
        "prompt": _texts(
            "final_prompt", "__prompt_hash", context_references=references.cast(f"array<{schemas.REFERENCE}>")
        ),
        "receipt_id": receipt_id(now, F.col(key)),
        "response": _texts(
            "final_response",
            "__response_hash",
            tokens_used=_named(tokens_used, "bigint"),
            latency_ms=_named(latency_ms, "bigint"),
        ),
        "retention": F.struct(
            iso_utc(until, "+00:00").alias("deletable_after"),
            (F.lit(False) if legal_hold is None else legal_hold).alias("legal_hold"),
            F.date_format(until, "yyyy-MM-dd").alias("retain_until"),
            F.lit(retention_policy).alias("retention_policy"),
        ),
        "schema_version": F.lit(SCHEMA_VERSION),
        "timestamp": iso_utc(now, "Z"),
        "tool": pick(what, schemas.TOOL),
    }

    # The hash covers the receipt with an empty hash field; it is then put in its place in the text.
    opened = F.struct(*[value.alias(name) for name, value in parts.items()])
    optional = [
        (json_of(F.struct(opened[name].alias(name))), F.to_json(F.struct(opened[name].alias(name))))
        for name in ("actor", "tool")
    ]
    written = with_once(
        base,
        {
            "__json": json_of(opened),
            "__full": F.array(*[_inner(full) for full, _ in optional]),
            "__short": F.array(*[_inner(short) for _, short in optional]),
        },
    )
    # Members of actor and tool that are unset are left out; all other nulls are kept.
    trimmed = F.col("__json")
    for i in range(len(optional)):
        trimmed = F.replace(trimmed, F.col("__full")[i], F.col("__short")[i])
    unsigned = with_once(with_once(written, {"__open": trimmed}), {"__open": lower_controls(F.col("__open"))})
    signed = with_once(unsigned, {"__hash": prefixed_sha256(F.col("__open"), hash_prefix)})
    blank, filled = F.lit('"receipt_hash":""'), F.concat(F.lit('"receipt_hash":"'), F.col("__hash"), F.lit('"'))
    return signed.select(
        key,
        opened.withField("evidence.receipt_hash", F.col("__hash")).cast(schemas.RECEIPT).alias("receipt"),
        F.replace(F.col("__open"), blank, filled).alias("raw"),
        F.to_date(now).alias("day"),
    )


def _inner(member: Column) -> Column:
    """Text of a one-member object without its braces."""
    return F.substring(member, 2, F.char_length(member) - 2)


def verify(receipts: DataFrame, raw: str = "raw", hash_prefix: str = "sha256:") -> DataFrame:
    """Recompute every receipt's hash from its raw text.

    Adds status (OK / FAIL), stored, recomputed and error; unreadable receipts are
    FAIL rows. Works on the text, not on a typed struct, since undeclared members
    are part of the hash.
    """
    same = F.coalesce(F.col("__stored") == F.col("recomputed"), F.lit(False))
    return (
        with_blanked(receipts, raw)
        .withColumn("recomputed", prefixed_sha256(F.col("__text"), hash_prefix))
        .withColumn("status", F.when(same, "OK").otherwise("FAIL"))
        .withColumn("error", F.when(F.col(raw).isNull(), F.lit("Missing")).otherwise(F.col("__error")))
        .withColumnRenamed("__stored", "stored")
        .drop("__text", "__error")
    )


def verify_summary(verified: DataFrame, allow_empty: bool = False) -> DataFrame:
    """One row: receipts, failures, and PASS or FAIL. No receipts at all is a FAIL unless allowed."""
    failed = F.coalesce(F.sum((F.col("status") == "FAIL").cast("bigint")), F.lit(0))
    counted = verified.agg(F.count("*").alias("receipts"), failed.alias("failures"))
    empty = F.lit(False) if allow_empty else F.col("receipts") == 0
    return counted.withColumn("result", F.when((F.col("failures") > 0) | empty, "FAIL").otherwise("PASS"))


def compact_receipts(
    df: DataFrame,
    *,
    verdict: str = "verdict",
    matched_rules: str = "matched_rules",
    device_owner: Column,
    now: Column,
    hash_prefix: str = "",
) -> DataFrame:
    """Small receipt of a sanitizer run, hashed the same way but without a hash prefix."""

    def body(hash_value):
        return F.struct(
            F.struct(
                device_owner.alias("device_owner"),
                hash_value.alias("receipt_hash"),
                F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            ).alias("evidence"),
            F.col(matched_rules).alias("matched_rules"),
            F.col(verdict).alias("verdict"),
        )

    written = with_once(df, {"__json": json_of(body(F.lit("")))})
    opened = with_once(written, {"__open": lower_controls(F.col("__json"))}).drop("__json")
    signed = opened.withColumn("receipt_hash", prefixed_sha256(F.col("__open"), hash_prefix))
    filled = F.concat(F.lit('"receipt_hash":"'), F.col("receipt_hash"), F.lit('"'))
    return signed.withColumn("raw", F.replace(F.col("__open"), F.lit('"receipt_hash":""'), filled)).drop("__open")


def verify_compact(receipts: DataFrame, raw: str = "raw") -> DataFrame:
    """verify() for compact receipts, whose stored hash has no prefix."""
    return verify(receipts, raw, hash_prefix="")
