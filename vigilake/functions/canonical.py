"""Canonical JSON: sorted keys, no spaces, raw Unicode, lower-case control escapes."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vigilake.functions import variant as V
from vigilake.functions.once import with_once

_CONTROLS = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def lower_controls(text: Column) -> Column:
    """Spark writes control escapes with upper-case hex digits; the canonical form has lower-case ones."""
    fixed = text
    for code in _CONTROLS:
        # An escape counts only behind an even number of backslashes.
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(text.rlike(r"\\u00(?:0[BEF]|1[A-F])"), fixed).otherwise(text)


def json_of(value: Column) -> Column:
    """JSON of a struct with its nulls; canonical after lower_controls() if its fields are in key order."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def _bones(bare: Column) -> Column:
    """Escape-free JSON text without whitespace and without the contents of its strings.

    Equal in length for two texts of the same value, so text behind the value shows.
    """
    return F.regexp_replace(F.regexp_replace(bare, '"[^"]*"', '""'), r"\s+", "")


_CHECK = StructType([StructField(name, StringType()) for name in ("stored", "canonical", "error")])


@F.pandas_udf(_CHECK)
def _blanked_in_python(texts: pd.Series) -> pd.DataFrame:
    """Exact canonical form for the rare texts the native path does not cover."""
    rows = []
    for text in texts:
        stored = canonical = error = None
        if text is not None:
            try:
                receipt = json.loads(text)
                stored = receipt["evidence"]["receipt_hash"]
                receipt["evidence"]["receipt_hash"] = ""
                canonical = json.dumps(receipt, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                canonical.encode("utf-8")
                stored = stored if isinstance(stored, str) else json.dumps(stored)
            except Exception as exc:  # any unreadable receipt is a failed one, never a lost one
                stored, canonical, error = None, None, type(exc).__name__
        rows.append((stored, canonical, error))
    return pd.DataFrame(rows, columns=["stored", "canonical", "error"])


def with_blanked(df: DataFrame, raw: str) -> DataFrame:
    """Add the canonical text of receipts with their hash blanked: __stored, __text, __error.

    Native for receipts as they are normally written. The exceptions go to Python:
    fractional or huge numbers, negative zero, astral characters in keys, surrogate
    escapes, a hash member in more than one place, and text that is not one value.
    """
    text = F.col(raw)
    parsed = with_once(df, {"__doc": F.try_parse_json(text), "__bare": F.regexp_replace(text, r"(?s)\\.", "_")})
    written = with_once(
        parsed, {"__json": F.to_json("__doc"), "__hash": V.string_at(F.col("__doc"), "$.evidence.receipt_hash")}
    ).drop("__doc")
    ready = with_once(
        written,
        {
            "__canonical": lower_controls(F.col("__json")),
            "__bones": _bones(F.col("__bare")),
            "__size": F.length(_bones(F.regexp_replace("__json", r"(?s)\\.", "_"))),
        },
    ).drop("__json")
    member = F.lit('"receipt_hash":')
    native = F.coalesce(
        (F.length("__bones") == F.col("__size"))
        & ~F.col("__bones").rlike(r"\d[.eE]|\d{19}|-0|NaN|Infinity")
        & ~text.rlike(r"\\u[dD][89a-fA-F]")
        & ~F.col("__bare").rlike(r'"[^"]*[\x{10000}-\x{10FFFF}][^"]*"\s*:')
        & (F.size(F.split("__canonical", '"receipt_hash":')) == 2)
        & F.col("__hash").rlike(r'^[^"\\\x00-\x1f]*$'),
        F.lit(False),
    )
    quoted = F.concat(member, F.lit('"'), "__hash", F.lit('"'))
    sorted_out = with_once(
        ready,
        {
            "__native": F.when(native, F.replace("__canonical", quoted, F.concat(member, F.lit('""')))),
            "__rest": F.when(~native, text),
        },
    ).drop("__bare", "__canonical", "__bones", "__size")
    # Rows of the native path send a NULL to Python.
    checked = sorted_out.withColumn("__python", _blanked_in_python("__rest"))
    return checked.withColumns(
        {
            "__stored": F.when(F.col("__native").isNotNull(), F.col("__hash")).otherwise(F.col("__python.stored")),
            "__text": F.coalesce("__native", "__python.canonical"),
            "__error": F.col("__python.error"),
        }
    ).drop("__hash", "__native", "__rest", "__python")
