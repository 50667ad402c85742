"""Evaluate costly columns exactly once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that the optimizer must not copy into later expressions.

    Plain projections get merged: a filter on a derived column is pushed below
    it, and a column used inside a lambda is inlined there, which would run the
    regexes behind it again for every use. A one-row ``inline`` stops that, while
    filters on the other columns still reach the scan.

    The added columns must not be structs: use :func:`with_fields_once` for those.
    """
    return _through_inline(df, F.struct(*[c.alias(name) for name, c in columns.items()]), list(columns))


def with_fields_once(df: DataFrame, value: Column) -> DataFrame:
    """Add the fields of one costly struct as columns, evaluated exactly once."""
    return _through_inline(df, value, [])


def _through_inline(df: DataFrame, row: Column, replaced: list[str]) -> DataFrame:
    # Nested-field pruning fails on structs that pass through a chain of generators
    # (INTERNAL_ERROR_ATTRIBUTE_NOT_FOUND in Spark 4.1), so structs go through inside an array.
    kept = [f for f in df.schema.fields if f.name not in replaced]
    structs = {f.name for f in kept if isinstance(f.dataType, StructType)}
    if not structs and len(kept) == len(df.columns):
        return df.select("*", F.inline(F.array(row)))
    passed = [F.array(F.col(f"`{f.name}`")).alias(f.name) if f.name in structs else F.col(f"`{f.name}`") for f in kept]
    made = df.select(*passed, F.inline(F.array(row)))
    if not structs:
        return made
    return made.select(*[F.element_at(f"`{c}`", 1).alias(c) if c in structs else F.col(f"`{c}`") for c in made.columns])
