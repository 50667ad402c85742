"""Text helpers whose offsets are Unicode code points, as Spark's own are."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Case-insensitive and Unicode-aware, the meaning the taxonomies are written for.
REGEX_FLAGS = "(?iuU)"

# Whitespace as the Python language strips it: the Unicode property plus 1C-1F.
_WHITE = r"[\s\x{1c}-\x{1f}]"

SPAN = "struct<start:int,end:int,text:string>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_WHITE}+|{_WHITE}+\z", "")


def truthy(text: Column) -> Column:
    """NULL for an empty string, so that coalesce() falls through it."""
    return F.nullif(text, F.lit(""))


def prefixed_sha256(text: Column, prefix: str = "sha256:") -> Column:
    digest = F.sha2(text, 256)
    return F.concat(F.lit(prefix), digest) if prefix else digest


def fold_append(items: Column, zero: Column, out_type: str, step) -> Column:
    """Fold ``items`` with a state and collect what each step gives, as array<struct<state, out>> of blocks.

    ``step(state, item)`` returns (state, array of new elements). Appending to one array
    copies it each time, so the fold runs in blocks of about the square root of the
    items, and only blocks are appended to each other.
    """
    empty = F.array().cast(out_type)

    def inner(acc, item):
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def in_blocks(items):
        width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
        count = F.ceil(F.size(items) / width).cast("int")

        def outer(blocks, i):
            begin = F.struct(F.element_at(blocks, F.lit(-1))["state"].alias("state"), empty.alias("out"))
            return F.concat(blocks, F.array(F.aggregate(F.slice(items, i * width + 1, width), begin, inner)))

        start = F.array(F.struct(zero.alias("state"), empty.alias("out")))
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(numbers, start, outer)

    # A one-element transform names the items: the expression behind them is computed once.
    return F.element_at(F.transform(F.array(items), in_blocks), 1)


def spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of ``pattern`` with code-point offsets.

    Matches and the text between them come from two regex passes; one fold over
    their lengths turns them into offsets. Texts without a match pay for a
    single ``rlike``.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # split() yields one piece more than there are matches; zip_with pads the tail with NULL.
    pairs = F.zip_with(between, found, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")))

    def step(position, pair):
        begin = position + pair["gap"]
        end = begin + F.char_length(pair["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("text"))
        return end, F.array(span)

    matched = F.filter(pairs, lambda pair: pair["hit"].isNotNull())
    return F.when(
        text.rlike(pattern),
        F.flatten(fold_append(matched, F.lit(0), f"array<{SPAN}>", step)["out"]),
    ).otherwise(F.array().cast(f"array<{SPAN}>"))
