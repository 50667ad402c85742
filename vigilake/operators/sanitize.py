"""Ordered rule sanitizer and the label-keeping mask."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.once import with_fields_once, with_once
from vigilake.functions.text import REGEX_FLAGS

# Rule order, and the texts used when a rule has none of its own.
ORDER = {"block": 0, "redact": 1, "allow": 2}
DEFAULT_BLOCK_MESSAGE = "Prompt blocked by local security policy."
NO_RULE = "None"

# Fixed value: a labelled date of birth; the label and its separator are kept.
LABELLED_DATE = (
    r"(?i)\b(DOB|date of birth|born(?:\s+on)?)([:\s,]+)"
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})"
)
LABELLED_MASK = "$1$2[redacted]"


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    match_class: str
    block_message: str | None = None
    mask_token: str | None = None


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def sanitize(df: DataFrame, text: str, patterns: dict[str, list[str]], rules: list[Rule]) -> DataFrame:
    """Add verdict, processed and matched_rules.

    Block rules come first and the first that matches ends the run: its message
    replaces the text and it is the only rule listed. Redactions are applied one
    after the other, each on the text the previous one left.
    """
    ordered = sorted(rules, key=lambda r: ORDER.get(r.action, ORDER["allow"]))
    blocks = [r for r in ordered if r.action == "block"]
    others = [r for r in ordered if r.action != "block"]

    def matches(value: Column, rule: Rule) -> Column:
        found = [value.rlike(REGEX_FLAGS + p) for p in patterns.get(rule.match_class, [])]
        return F.coalesce(F.greatest(*found) if len(found) > 1 else found[0], F.lit(False)) if found else F.lit(False)

    hit = F.lit(None).cast("struct<__rule:string,__message:string>")
    for rule in reversed(blocks):
        told = F.struct(F.lit(rule.id).alias("__rule"), F.lit(rule.block_message or DEFAULT_BLOCK_MESSAGE).alias("__message"))
        hit = F.when(matches(F.col(text), rule), told).otherwise(hit)
    state = with_fields_once(df, hit.cast("struct<__rule:string,__message:string>"))
    state = state.withColumns({"__text": F.col(text), "__seen": F.array().cast("array<string>")})
    open_ = F.col("__rule").isNull()
    for rule in others:
        for pattern in patterns.get(rule.match_class, []):
            java = REGEX_FLAGS + pattern
            found = open_ & F.col("__text").rlike(java)
            seen = F.when(found, F.array_union("__seen", F.array(F.lit(rule.id)))).otherwise(F.col("__seen"))
            changed = F.col("__text")
            if rule.action == "redact":
                mask = rule.mask_token or f"[REDACTED_{rule.id.upper()}]"
                changed = F.when(found, F.regexp_replace("__text", java, _literal(mask))).otherwise(F.col("__text"))
            state = with_once(state, {"__next": changed, "__then": seen}).drop("__text", "__seen")
            state = state.withColumnsRenamed({"__next": "__text", "__then": "__seen"})
    redacting = F.array(*[F.lit(r.id) for r in others if r.action == "redact"]).cast("array<string>")
    return state.withColumns(
        {
            "verdict": F.when(~open_, "block").when(F.arrays_overlap("__seen", redacting), "redact").otherwise("allow"),
            "processed": F.coalesce("__message", "__text"),
            "matched_rules": F.when(~open_, F.array("__rule"))
            .when(F.size("__seen") > 0, F.col("__seen"))
            .otherwise(F.array(F.lit(NO_RULE))),
        }
    ).drop("__rule", "__message", "__text", "__seen")


def mask_labelled(text: Column, pattern: str = LABELLED_DATE, replacement: str = LABELLED_MASK) -> Column:
    """Mask the value behind a label and keep the label."""
    return F.regexp_replace(text, pattern, replacement)
