"""Typed access to JSON of unknown shape held as VARIANT."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_strict(raw: Column) -> Column:
    """VARIANT of a whole JSON text, NULL when anything follows the first value.

    The parser stops after one value, so the text is wrapped into an array whose
    second element is a hash of the text: it is only found there when the text
    was exactly one value.
    """
    mark = F.xxhash64(raw)
    pair = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), mark.cast("string"), F.lit("]")))
    return F.when(F.try_variant_get(pair, "$[1]", "bigint") == mark, F.try_variant_get(pair, "$[0]", "variant"))


def kind(value: Column) -> Column:
    """Leading type word: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID, ... or NULL if absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def string_at(value: Column, path: str) -> Column:
    """String at ``path`` only if it is a JSON string there."""
    return F.when(F.schema_of_variant(at(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def text_at(value: Column, path: str) -> Column:
    """String at ``path``; other scalars are rendered as text."""
    return F.try_variant_get(value, path, "string")


def list_at(value: Column, path: str) -> Column:
    """Array at ``path``, empty when missing, null or of another type."""
    return F.coalesce(
        F.try_variant_get(value, path, "array<variant>"),
        F.array().cast("array<variant>"),
    )


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def fields_of(value: Column, path: str = "$") -> Column:
    """Object at ``path`` as map<string, variant>; empty when it is no object."""
    return F.coalesce(
        F.try_variant_get(value, path, "map<string,variant>"),
        F.create_map().cast("map<string,variant>"),
    )


def with_field(fields: Column, key: str, value: Column) -> Column:
    """Map with ``key`` set to the VARIANT ``value``."""
    kept = F.filter(F.map_entries(fields), lambda e: e["key"] != key)
    added = F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))
    return F.map_from_entries(F.concat(kept, added))


def scalar(value: Column) -> Column:
    return value.cast("variant")


def obj(**fields: Column) -> Column:
    """VARIANT object with the given members."""
    return F.to_variant_object(F.struct(*[c.alias(k) for k, c in fields.items()]))
