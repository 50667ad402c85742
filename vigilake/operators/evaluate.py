"""Policy evaluation of one phase: hits and a text in, decisions and a verdict out.

The rules are folded into the plan as one literal array and evaluated in the
row, so a phase is a narrow stage with no join and no shuffle.
"""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.once import with_fields_once, with_once
from vigilake.functions.text import fold_append, prefixed_sha256
from vigilake.operators.policies import Policy, PolicySet

REDACTION = "struct<location:string,before_hash:string,after_hash:string>"
ALERT = "struct<id:string,delivery_status:string,delivered_at:string>"
DECISION = (
    "struct<policy_id:string,policy_version:string,policy_set_version:string,evaluated_at:string,"
    "verdict:string,enforcement_mode:string,matched_classes:array<string>,would_have_blocked:boolean,"
    f"redactions_applied:array<{REDACTION}>,error_reason:string,alert_id:{ALERT}>"
)
EVALUATION = (
    f"struct<decisions:array<{DECISION}>,final_verdict:string,mutated_text:string,"
    "block_user_message:string,policy_set_version:string>"
)
RULE = (
    "struct<policy_id:string,policy_version:string,destination:string,match_mode:string,classes:array<string>,"
    "outcome:string,rank:int,user_message:string,template:string,to_redact:array<string>,audit_only:boolean,"
    "fail_closed:boolean>"
)
OP = "struct<start:int,policy_id:string,ord:int,end:int,text:string,template:string>"

# How a rule's verdict reads in a receipt, and which verdict wins.
OUTCOME = {"block": "blocked", "redact": "redacted", "alert": "alerted"}
RANK = {"allowed": 0, "redacted": 1, "alerted": 2, "blocked": 3}

# Fixed value: shown when a fail-closed rule without a message of its own blocks.
FAIL_CLOSED_MESSAGE = "Request blocked: classifier unavailable and policy is fail-closed."


@dataclass(frozen=True)
class Clock:
    """When the evaluation counts as made, and what keeps alert ids stable over reruns."""

    moment: datetime | Column
    run_id: str = "run"

    @property
    def now(self) -> Column:
        return self.moment if isinstance(self.moment, Column) else F.lit(self.moment)

    @property
    def iso(self) -> Column:
        """ISO-8601 with Z; microseconds only where there are any."""
        return iso_utc(self.now, "Z")


def iso_utc(ts: Column, suffix: str) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit(suffix))


def _rule(p: Policy) -> Column:
    def texts(values):
        return F.lit(None) if values is None else F.array(*map(F.lit, values))

    return F.struct(
        F.lit(p.policy_id).alias("policy_id"),
        F.lit(p.policy_version).alias("policy_version"),
        F.lit(p.destination).alias("destination"),
        F.lit(p.match_mode).alias("match_mode"),
        texts(p.classes).alias("classes"),
        F.lit(OUTCOME[p.verdict]).alias("outcome"),
        F.lit(RANK[OUTCOME[p.verdict]]).alias("rank"),
        F.lit(p.user_message).alias("user_message"),
        F.lit(p.redact_with).alias("template"),
        texts(p.classes_to_redact).alias("to_redact"),
        F.lit(p.audit_only).alias("audit_only"),
        F.lit(p.on_classifier_error == "fail_closed").alias("fail_closed"),
    ).cast(RULE)


def _rules(policy_set: PolicySet, direction: str) -> Column:
    """Rules of one direction, sorted by id, as a foldable array."""
    chosen = sorted((p for p in policy_set.policies if p.direction == direction), key=lambda p: p.policy_id)
    return F.array(*map(_rule, chosen)).cast(f"array<{RULE}>")


def redact_spans(text: Column, ops: Column, location: Column | str, merge_overlaps: bool = False) -> Column:
    """Splice templates over spans, left to right.

    ``ops`` is an array of OP. An operation that starts before the end of the
    last applied one is skipped whole, so the tail of a partly covered span stays
    in clear; ``merge_overlaps`` extends the applied span over it instead.
    Gives struct(text, applied): ``applied`` holds (policy_id, redaction).
    """
    kept_type = "array<struct<from:int,start:int,end:int,policy_id:string,text:string,template:string>>"
    none = F.array().cast(kept_type)

    def step(cursor, op):
        taken = F.struct(
            cursor.alias("from"),
            op["start"].alias("start"),
            op["end"].alias("end"),
            op["policy_id"].alias("policy_id"),
            op["text"].alias("text"),
            op["template"].alias("template"),
        )
        covered = F.greatest(cursor, op["end"]) if merge_overlaps else cursor
        skipped = op["start"] < cursor
        return F.when(skipped, covered).otherwise(op["end"]), F.when(skipped, none).otherwise(F.array(taken))

    def finish(blocks):
        kept = F.flatten(blocks["out"])
        pieces = F.transform(
            kept,
            lambda k: F.concat(F.substring(text, k["from"] + 1, k["start"] - k["from"]), k["template"]),
        )
        tail = F.substring(text, F.element_at(blocks, F.lit(-1))["state"] + 1, F.char_length(text))
        where = location if isinstance(location, Column) else F.lit(location)
        applied = F.transform(
            kept,
            lambda k: F.struct(
                k["policy_id"].alias("policy_id"),
                F.struct(
                    where.alias("location"),
                    prefixed_sha256(k["text"]).alias("before_hash"),
                    prefixed_sha256(k["template"]).alias("after_hash"),
                ).alias("redaction"),
            ),
        )
        return F.struct(F.concat(F.array_join(pieces, ""), tail).alias("text"), applied.alias("applied"))

    # A one-element transform names the folded blocks, so that they are computed once.
    folded = fold_append(F.array_sort(ops), F.lit(0), kept_type, step)
    return F.element_at(F.transform(F.array(folded), finish), 1)


def _redact_ops(fired: Column, hits: Column) -> Column:
    """One operation per hit of a class that an enforced redact rule covers."""

    def of_rule(rule):
        # Without a narrowed list the matched classes are redacted; only hit classes can match a hit.
        wanted = F.coalesce(rule["to_redact"], rule["classes"])
        covered = F.filter(hits, lambda h: F.array_contains(wanted, h["cls"]))
        return F.transform(
            covered,
            lambda h: F.struct(
                h["start"].alias("start"),
                rule["policy_id"].alias("policy_id"),
                h["ord"].alias("ord"),
                h["end"].alias("end"),
                h["text"].alias("text"),
                F.replace(rule["template"], F.lit("{class}"), h["cls"]).alias("template"),
            ),
        )

    redacting = F.filter(fired, lambda r: (r["outcome"] == "redacted") & ~r["audit_only"])
    return F.flatten(F.transform(redacting, of_rule)).cast(f"array<{OP}>")


def _null(sql_type: str) -> Column:
    return F.lit(None).cast(sql_type)


def _empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def evaluate(
    df: DataFrame,
    policy_set: PolicySet,
    *,
    text: str,
    hits: str,
    direction: str,
    clock: Clock,
    key: str,
    destination: Column | str = "external_vendor",
    error: Column | None = None,
    out: str = "evaluation",
    merge_overlaps: bool = False,
) -> DataFrame:
    """Add the evaluation of one phase as a struct column.

    ``hits`` may hold hits of both phases; only those of ``direction`` count.
    ``error`` is the classifier's failure reason per row, NULL where it ran.
    A NULL text gives a NULL evaluation: that phase did not take place.
    """
    where = destination if isinstance(destination, Column) else F.lit(destination)
    error = F.lit(None).cast("string") if error is None else error
    version = F.lit(policy_set.version)
    iso = clock.iso
    rules = _rules(policy_set, direction)
    mine = F.filter(F.col(hits), lambda h: h["location"] == direction)

    # Step 1: hits of this phase and the rules that apply at this destination.
    step1 = with_once(
        df,
        {
            "__hits": mine,
            "__eligible": F.filter(rules, lambda r: (r["destination"] == "any") | (r["destination"] == where)),
            "__error": error,
        },
    )
    classes = F.array_distinct(F.transform("__hits", lambda h: h["cls"]))
    step2 = with_once(step1, {"__classes": classes})

    def fires(rule):
        return F.when(rule["match_mode"] == "any_of", F.arrays_overlap(rule["classes"], "__classes")).otherwise(
            F.size(F.array_except(rule["classes"], F.col("__classes"))) == 0
        )

    fired = F.when(F.col("__error").isNotNull(), F.col("__eligible")).otherwise(F.filter("__eligible", fires))
    step3 = with_once(step2, {"__fired": fired})

    failed = F.col("__error").isNotNull()
    enforced = F.filter("__fired", lambda r: ~r["audit_only"])
    worst = F.coalesce(F.array_max(F.transform(enforced, lambda r: r["rank"])), F.lit(0))
    closed = F.exists("__fired", lambda r: r["fail_closed"])
    rank = F.when(failed, F.when(closed, F.lit(RANK["blocked"])).otherwise(F.lit(0))).otherwise(worst)
    names = F.array(*[F.lit(v) for v, _ in sorted(RANK.items(), key=lambda kv: kv[1])])
    step4 = with_once(step3, {"__verdict": F.get(names, rank)})

    spliced_type = f"struct<__clean:string,__applied:array<struct<policy_id:string,redaction:{REDACTION}>>>"
    spliced = F.when(
        (F.col("__verdict") == "redacted") & ~failed,
        redact_spans(F.col(text), _redact_ops(F.col("__fired"), F.col("__hits")), direction, merge_overlaps),
    )
    step5 = with_fields_once(step4, spliced.cast(spliced_type))

    def alert(rule):
        suffix = F.substring(
            F.sha2(F.concat_ws("|", F.col(key).cast("string"), rule["policy_id"], F.lit(clock.run_id)), 256), 1, 24
        )
        stamp = F.date_format(clock.now, "yyyy-MM-dd_HH-mm-ss")
        record = F.struct(
            F.concat(F.lit("alert_"), stamp, F.lit("_"), suffix).alias("id"),
            F.lit("pending").alias("delivery_status"),
            _null("string").alias("delivered_at"),
        ).cast(ALERT)
        return F.when((rule["outcome"] == "alerted") & ~rule["audit_only"], record)

    def normal(rule):
        matched = F.when(
            rule["match_mode"] == "any_of",
            F.filter(rule["classes"], lambda c: F.array_contains(F.col("__classes"), c)),
        ).otherwise(rule["classes"])
        own = F.filter(F.col("__applied"), lambda a: a["policy_id"] == rule["policy_id"])
        applied = F.when(
            (rule["outcome"] == "redacted") & ~rule["audit_only"], F.transform(own, lambda a: a["redaction"])
        )
        return F.struct(
            rule["policy_id"].alias("policy_id"),
            rule["policy_version"].alias("policy_version"),
            version.alias("policy_set_version"),
            iso.alias("evaluated_at"),
            rule["outcome"].alias("verdict"),
            F.when(rule["audit_only"], F.lit("audit_only")).otherwise(F.lit("enforced")).alias("enforcement_mode"),
            matched.alias("matched_classes"),
            F.when(rule["audit_only"], rule["outcome"] == "blocked").alias("would_have_blocked"),
            F.coalesce(applied, _empty(REDACTION)).alias("redactions_applied"),
            _null("string").alias("error_reason"),
            alert(rule).alias("alert_id"),
        ).cast(DECISION)

    def on_error(rule):
        return F.struct(
            rule["policy_id"].alias("policy_id"),
            rule["policy_version"].alias("policy_version"),
            version.alias("policy_set_version"),
            iso.alias("evaluated_at"),
            F.when(rule["fail_closed"], F.lit("blocked")).otherwise(F.lit("allowed")).alias("verdict"),
            F.lit("error").alias("enforcement_mode"),
            _empty("string").alias("matched_classes"),
            rule["fail_closed"].alias("would_have_blocked"),
            _empty(REDACTION).alias("redactions_applied"),
            F.col("__error").alias("error_reason"),
            _null(ALERT).alias("alert_id"),
        ).cast(DECISION)

    # Used when no rule has anything to say; it carries the error if there was one.
    synthetic = F.struct(
        _null("string").alias("policy_id"),
        _null("string").alias("policy_version"),
        version.alias("policy_set_version"),
        iso.alias("evaluated_at"),
        F.lit("allowed").alias("verdict"),
        F.when(failed, F.lit("error")).otherwise(F.lit("enforced")).alias("enforcement_mode"),
        _empty("string").alias("matched_classes"),
        F.when(failed, F.lit(False)).alias("would_have_blocked"),
        _empty(REDACTION).alias("redactions_applied"),
        F.col("__error").alias("error_reason"),
        _null(ALERT).alias("alert_id"),
    ).cast(DECISION)

    decisions = (
        F.when(F.size("__fired") == 0, F.array(synthetic))
        .when(failed, F.transform("__fired", on_error))
        .otherwise(F.transform("__fired", normal))
    )
    blocked = F.col("__verdict") == "blocked"
    # Rules are sorted by id, so the first match is the alphabetically first one.
    blocking = F.filter("__fired", lambda r: (r["outcome"] == "blocked") & ~r["audit_only"])
    closing = F.filter("__fired", lambda r: r["fail_closed"] & r["user_message"].isNotNull())
    message = F.when(
        failed, F.coalesce(F.get(closing, F.lit(0))["user_message"], F.lit(FAIL_CLOSED_MESSAGE))
    ).otherwise(F.get(blocking, F.lit(0))["user_message"])
    fields = {
        f"__{out}_decisions": decisions.cast(f"array<{DECISION}>"),
        f"__{out}_verdict": F.col("__verdict"),
        f"__{out}_text": F.when(~blocked, F.coalesce("__clean", text)),
        f"__{out}_message": F.when(blocked, message),
    }
    done = with_once(step5, fields)
    parts = [F.col(c).alias(n) for c, n in zip(fields, ("decisions", "final_verdict", "mutated_text", "block_user_message"))]
    result = F.struct(*parts, version.alias("policy_set_version")).cast(EVALUATION)
    return done.withColumn(out, F.when(F.col(text).isNotNull(), result)).drop(
        "__hits", "__eligible", "__error", "__classes", "__fired", "__verdict", "__clean", "__applied", *fields
    )


def decision_rows(df: DataFrame, keys: list[str], evaluation: str = "evaluation") -> DataFrame:
    """One row per decision."""
    return df.select(*keys, F.inline(F.col(f"{evaluation}.decisions")))
