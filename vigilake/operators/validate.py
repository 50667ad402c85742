"""Receipt schema validation on raw JSON, every violation listed and sorted by path."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import variant as V
from vigilake.functions.once import with_once

# The receipt format, as (path, types, required, extra rule).
_HASH = r"^sha256:[0-9a-f]{64}$"
_ID = r"^rcp_\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}_[0-9a-f]{6,}$"
_VERDICTS = ("allowed", "blocked", "redacted", "alerted")
_MODES = ("enforced", "audit_only", "error")
_REASONS = ("classifier_timeout", "classifier_exception", "taxonomy_load_error", "policy_eval_exception")
_DELIVERY = ("pending", "delivered", "failed")

S, N, I, B, O, A = "STRING", "VOID", "INTEGER", "BOOLEAN", "OBJECT", "ARRAY"

TOP = (
    ("schema_version", (S,), True, ("1.1",)),
    ("receipt_id", (S,), True, _ID),
    ("timestamp", (S,), True, None),
    ("external_trace_uri", (S, N), False, None),
    ("actor", (O,), True, None),
    ("actor.user_id", (S,), True, None),
    ("actor.user_role", (S,), False, None),
    ("actor.department", (S,), False, None),
    ("actor.auth_method", (S,), False, None),
    ("tool", (O,), True, None),
    ("tool.tool_id", (S,), True, None),
    ("tool.model_id", (S,), True, None),
    ("tool.tool_version", (S,), False, None),
    ("tool.model_vendor", (S,), False, None),
    ("tool.endpoint", (S,), False, None),
    ("prompt", (O,), True, None),
    ("prompt.text", (S,), True, None),
    ("prompt.text_hash", (S,), True, _HASH),
    ("prompt.text_length_chars", (I,), True, 0),
    ("prompt.context_references", (A,), False, None),
    ("response", (O,), True, None),
    ("response.text", (S,), True, None),
    ("response.text_hash", (S,), True, _HASH),
    ("response.text_length_chars", (I,), True, 0),
    ("response.tokens_used", (I, N), False, None),
    ("response.latency_ms", (I, N), False, None),
    ("data_classes_touched", (A,), True, None),
    ("downstream_actions", (A,), True, None),
    ("policy_decisions", (A,), True, None),
    ("evidence", (O,), True, None),
    ("evidence.receipt_hash", (S,), True, _HASH),
    ("evidence.captured_by", (S,), True, None),
    ("evidence.capture_method", (S,), True, None),
    ("evidence.signature", (S, N), False, None),
    ("retention", (O,), True, None),
    ("retention.retain_until", (S,), True, None),
    ("retention.retention_policy", (S,), True, None),
    ("retention.deletable_after", (S,), False, None),
    ("retention.legal_hold", (B,), False, None),
)
ITEMS = {
    "prompt.context_references": (
        ("type", (S,), False, None),
        ("resource_id", (S,), False, None),
        ("fields_accessed", (A,), False, S),
        ("access_method", (S,), False, None),
    ),
    "data_classes_touched": (
        ("class", (S,), True, None),
        ("instances", (I,), True, 0),
        ("in_prompt", (B,), False, None),
        ("in_response", (B,), False, None),
    ),
    "downstream_actions": (
        ("action_id", (S,), True, None),
        ("type", (S,), True, None),
        ("target_path", (S,), False, None),
        ("target_size_bytes", (I,), False, 0),
        ("content_hash", (S,), False, None),
        ("diff_from_response", (B,), False, None),
        ("timestamp", (S,), True, None),
    ),
    "policy_decisions": (
        ("policy_id", (S, N), True, None),
        ("policy_version", (S, N), True, None),
        ("policy_set_version", (S,), True, None),
        ("evaluated_at", (S,), True, None),
        ("verdict", (S,), True, _VERDICTS),
        ("enforcement_mode", (S,), True, _MODES),
        ("matched_classes", (A,), True, S),
        ("would_have_blocked", (B, N), True, None),
        ("redactions_applied", (A,), True, None),
        ("error_reason", (S, N), True, _REASONS),
        ("alert_id", (O, N), True, None),
        ("alert_id.id", (S,), True, None),
        ("alert_id.delivery_status", (S,), True, _DELIVERY),
        ("alert_id.delivered_at", (S, N), False, None),
    ),
}
REDACTION = (
    ("location", (S,), True, ("prompt", "response")),
    ("before_hash", (S,), True, None),
    ("after_hash", (S,), True, None),
)
TOP_NAMES = tuple(path for path, *_ in TOP if "." not in path)


def _type_of(value: Column) -> Column:
    """JSON type word; whole numbers are INTEGER whatever their width or written form."""
    word = V.kind(value)
    number = word.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    whole = F.when(number, F.try_variant_get(value, "$", "double") % 1 == 0)
    return F.when(number, F.when(whole, F.lit(I)).otherwise(F.lit("NUMBER"))).otherwise(word)


def _field(doc: Column, rule, prefix: Column | str = "") -> Column:
    """Violation text of one field, or NULL."""
    path, types, required, extra = rule
    value = V.at(doc, f"$.{path}")
    found = _type_of(value)
    where = F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit(path))
    parent = path.rpartition(".")[0]
    # A field inside a missing or wrong parent is not reported on its own.
    applies = V.is_object(V.at(doc, f"$.{parent}")) if parent else F.lit(True)

    def told(rule_text):
        return F.concat(where, F.lit(f": {rule_text}"))

    checked = F.when(value.isNull(), told("required") if required else F.lit(None)).when(
        ~found.isin(*types), told("must be " + " or ".join("null" if t == N else t.lower() for t in types))
    )
    text = F.try_variant_get(value, "$", "string")
    if isinstance(extra, tuple):
        checked = checked.when((found == S) & ~text.isin(*extra), told("must be one of " + ", ".join(extra)))
    elif extra == 0:
        checked = checked.when((found == I) & (F.try_variant_get(value, "$", "double") < 0), told("must not be negative"))
    elif extra == S:
        strings = F.forall(V.list_at(value, "$"), lambda e: F.coalesce(V.kind(e) == S, F.lit(False)))
        checked = checked.when((found == A) & ~strings, told("must hold strings only"))
    elif extra:
        checked = checked.when((found == S) & ~text.rlike(extra), told("has the wrong format"))
    return F.when(applies, checked)


def _items(doc: Column, path: str, rules) -> Column:
    def one(item, i):
        place = F.concat(F.lit(f"{path}["), F.lpad(i.cast("string"), 6, "0"), F.lit("]."))
        whole = F.when(~V.is_object(item), F.concat(F.rtrim(place, F.lit(".")), F.lit(": must be object")))
        found = F.array(whole, *[F.when(V.is_object(item), _field(item, r, place)) for r in rules])
        if path != "policy_decisions":
            return found

        def redaction(entry, j):
            inner = F.concat(place, F.lit("redactions_applied["), F.lpad(j.cast("string"), 6, "0"), F.lit("]."))
            return F.array(*[_field(entry, r, inner) for r in REDACTION])

        nested = F.flatten(F.transform(V.list_at(item, "$.redactions_applied"), redaction))
        return F.concat(found, nested)

    return F.flatten(F.transform(V.list_at(doc, f"$.{path}"), one))


def with_violations(receipts: DataFrame, raw: str = "raw", out: str = "violations") -> DataFrame:
    """Add the array of violations of each raw receipt, sorted by path; empty when it is valid."""
    parsed = with_once(receipts, {"__doc": V.parse_strict(F.col(raw))})
    doc = F.col("__doc")
    unknown = F.array_except(F.map_keys(V.fields_of(doc)), F.array(*map(F.lit, TOP_NAMES)))
    extras = F.transform(unknown, lambda k: F.concat(k, F.lit(": unknown field")))
    fields = F.array(*[_field(doc, rule) for rule in TOP])
    found = F.concat(fields, extras, *[_items(doc, path, rules) for path, rules in ITEMS.items()])
    listed = F.array_sort(F.filter(found, lambda v: v.isNotNull()))
    # A tool that is no JSON object at all has one violation.
    return with_once(parsed, {out: F.when(V.is_object(doc), listed).otherwise(F.array(F.lit("receipt: must be object")))}).drop(
        "__doc"
    )


def invalid(receipts: DataFrame, raw: str = "raw") -> DataFrame:
    """Receipts with at least one violation."""
    return with_violations(receipts, raw).where(F.size("violations") > 0)
