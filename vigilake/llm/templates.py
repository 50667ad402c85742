"""Benchmark decontamination that also catches re-parameterised questions.

Texts are canonicalised to templates: numbers, names and units become typed
placeholders. Windows of template tokens are hashed and joined with those of the
benchmark; where a window meets, the values behind the placeholders must map
consistently, one value of the item always to one value of the document.
"""

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import staged, table

# Tokens of a window; shorter items are one window of all they have, if that is enough to be telling.
WIDTH = 8
SHORTEST = 5
# Part of an item's windows that must be found consistently in a document.
COVERED = 0.6
# Benchmark windows that are sent to every task; more are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000

NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"

# Common unit words and signs.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres "
    "gallon gallons s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "eur usd gbp euro euros dollar dollars cent cents percent degrees degree kmh mph hz khz mhz ghz kb mb gb tb w kw v".split()
)
SIGNS = frozenset("$€£¥%°")
STOPS = frozenset(".!?\n")

NEAR = 40

# Words with inner apostrophes or hyphens, numbers with their separators, unit signs and sentence ends.
TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d(?:[\d.,]*\d)?|[$€£¥%°.!?\n]")
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())


# Kinds of words, as bits: ends a sentence; is a placeholder wherever it stands; may be a name; begins with a letter.
STOP, SLOT, CAPITAL, LETTER = 1, 2, 4, 8
# Words whose codes are kept per task; beyond that the store starts afresh with the next text.
KEPT_WORDS = 500_000


class Words(dict):
    """Codes of the words met so far, with the hash of each one's template token and its kind."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self):
        self.clear()
        self.hashes, self.kinds = array("Q"), array("B")

    def __missing__(self, word: str) -> int:
        token, first = word.lower(), word[0]
        if first.isalpha():
            kind = LETTER
            if token in NUMBER_WORDS:
                token, kind = NUMBER, LETTER | SLOT
            else:
                if first.isupper() and not word.isupper():
                    kind |= CAPITAL
                if token in UNITS:
                    token, kind = UNIT, kind | SLOT
        elif word in SIGNS:
            token, kind = UNIT, SLOT
        elif word in STOPS:
            kind = STOP
        else:
            token, kind = NUMBER, SLOT
        code = self[word] = len(self.kinds)
        self.hashes.append(xxhash.xxh64_intdigest(token))
        self.kinds.append(kind)
        return code


NAME_HASH = np.uint64(xxhash.xxh64_intdigest(NAME))


@dataclass
class Template:
    """A text's template: a hash for each token, which of them are placeholders, and the words behind them."""

    hashes: np.ndarray
    slots: np.ndarray
    found: list[str]
    places: np.ndarray

    def values(self, begin: int, width: int) -> list[str]:
        """The words behind the placeholders of a window, lower-cased."""
        at = begin + np.flatnonzero(self.slots[begin : begin + width])
        return [self.found[i].lower() for i in self.places[at]]


def template(text: str, words: Words) -> Template:
    """The template of a text.

    A capitalised word inside a sentence is a name. A sentence's first word is one only
    if the same word is a name within NEAR tokens: what a passage becomes must not
    depend on text far from it.
    """
    if len(words) > KEPT_WORDS:
        words.forget()
    found = TOKEN.findall(text)
    if not found:
        return Template(np.zeros(0, np.uint64), np.zeros(0, bool), [], np.zeros(0, np.int64))
    codes = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    # Views, not kept: the stores grow with the next text.
    kinds, hashed = np.frombuffer(words.kinds, np.uint8)[codes], np.frombuffer(words.hashes, np.uint64)[codes]
    capital = kinds & CAPITAL != 0
    name = capital.copy()
    name[:1] = False
    name[1:] &= kinds[:-1] & LETTER != 0
    # Word and place in one number: neighbours in its order are the nearest places of the same word.
    where = codes * (len(found) + NEAR + 1) + np.arange(len(found))
    named, first = np.sort(where[name]), np.flatnonzero(capital & ~name)
    if len(named) and len(first):
        at = np.searchsorted(named, where[first])
        after = named[np.minimum(at, len(named) - 1)] - where[first]
        before = where[first] - named[np.maximum(at - 1, 0)]
        name[first] = ((after >= 0) & (after <= NEAR)) | ((before >= 0) & (before <= NEAR))
    places = np.flatnonzero(kinds & STOP == 0)
    hashes = np.where(name, NAME_HASH, hashed)
    return Template(hashes[places], (name | (kinds & SLOT != 0))[places], found, places)


def window_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` tokens, from the tokens' own hashes."""
    if len(hashed) < width:
        return np.zeros(0, np.uint64)
    size, out = len(hashed) - width + 1, np.zeros(len(hashed) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[j : j + size]
            out ^= out >> np.uint64(29)
    return out


def is_slot(token: str) -> bool:
    return token in (NUMBER, NAME, UNIT)


@dataclass
class Leaks:
    """Settings of a search; see :func:`matches`."""

    width: int = WIDTH
    shortest: int = SHORTEST
    covered: float = COVERED


BENCH = "width int, hash bigint, item_id bigint, place int, slots array<string>"
FOUND = "width int, hash bigint, __row bigint, place int, slots array<string>"


def _windows_of(ids, texts, widths, keep, words: Words) -> pd.DataFrame:
    """Rows (width, hash, id, place, slots) of the windows that ``keep`` accepts."""
    rows = []
    for key, text in zip(ids, texts, strict=True):
        made = template(text or "", words)
        for width in widths(len(made.hashes)):
            hashes = window_hashes(made.hashes, width)
            at = keep(width, hashes)
            rows.extend((width, h, key, i, made.values(i, width)) for i, h in zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True))
    return pd.DataFrame(rows, columns=["width", "hash", "id", "place", "slots"])


def benchmark_windows(benchmark: DataFrame, settings: Leaks = Leaks(), item: str = "item_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Template windows of every item. An item of fewer tokens than a window is one window of its own width.

    Items with fewer than ``shortest`` tokens say too little to be looked for and have no window.
    """

    def cut(batches):
        def widths(n):
            return [settings.width] if n >= settings.width else [n] if n >= settings.shortest else []

        words = Words()
        for batch in batches:
            made = _windows_of(batch["item_id"], batch["text"], widths, lambda _, h: np.arange(len(h)), words)
            yield made.rename(columns={"id": "item_id"})

    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(cut, BENCH)


def matches(docs: DataFrame, bench: DataFrame, key: str, text: str, settings: Leaks = Leaks(), limit: int = BROADCAST_WINDOWS) -> DataFrame:  # noqa: B008
    """(key, item_id, covered): documents with the part of each item's windows that they hold consistently.

    ``bench`` must be written (see staged()). Its distinct hashes are counted first: up
    to ``limit`` they go to the tasks, which send on only windows that meet one; beyond
    it every window is sent to the join. Results are the same.
    """
    spark = docs.sparkSession
    distinct = bench.select("width", "hash").distinct()
    small = distinct.limit(limit + 1).count() <= limit
    by_width: dict[int, np.ndarray] = {}
    if small:
        for row in distinct.groupBy("width").agg(F.sort_array(F.collect_list("hash")).alias("h")).collect():
            by_width[row.width] = np.array(row.h, np.int64)
        lengths = sorted(by_width)
    else:
        lengths = [r.width for r in distinct.select("width").distinct().collect()]
    sent = spark.sparkContext.broadcast(by_width)

    def cut(batches):
        words = Words()
        table_of = sent.value

        def keep(width, hashes):
            if not small:
                return np.arange(len(hashes))
            wanted = table_of[width]
            place = np.searchsorted(wanted, hashes.view(np.int64))
            return np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == hashes.view(np.int64))

        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                made = _windows_of(part["__row"], part["text"], lambda n: [w for w in lengths if w <= n], keep, words)
                yield made.rename(columns={"id": "__row"})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__row"), F.col(text).cast("string").alias("text"))
    found = rows.mapInPandas(cut, FOUND)
    items = bench.groupBy("item_id").agg(F.count("*").alias("windows"))
    right = bench.select("width", "hash", "item_id", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = found.join(right, ["width", "hash"])
    # Windows of one passage have the same distance between places; one that the item repeats may meet at several.
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    along = met.withColumns({"shift": F.col("place") - F.col("item_place"), "pairs": pairs})
    # An item is short, so what one document shares with one item on one shift is bounded by the item.
    passages = along.groupBy("__row", "item_id", "shift").agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    sides = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    consistent = passages.where(sides)
    # Insertions shift the rest of a passage: its pieces count together.
    held = consistent.groupBy("__row", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"))
    part = F.col("held") / F.col("windows")
    return held.join(items, "item_id").select("__row", "item_id", part.alias("covered")).where(F.col("covered") >= settings.covered)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents, one row per document and item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = staged(benchmark_windows(table(spark, sf_dir, "benchmark")), "benchmark-windows")
    found = matches(docs.where(F.col("doc_id").isNotNull()), bench, "doc_id", "text")
    return found.select(F.col("__row").alias("doc_id"), "item_id", F.round("covered", 6).alias("covered"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", settings: Leaks = Leaks()) -> DataFrame:  # noqa: B008
    """Rows of ``docs`` that hold no benchmark item; a NULL key does not protect a text."""
    columns = docs.columns
    # Rows are told apart by key and text, so a repeated key does not spread a verdict.
    row = F.xxhash64(F.col(key), F.col(text))
    bench = staged(benchmark_windows(benchmark, settings), "benchmark-windows")
    leaks = staged(matches(docs.select(row.alias("__row"), F.col(text)), bench, "__row", text, settings).select("__row").distinct(), "leaks")
    named = docs.withColumn("__row", row)
    return named.join(leaks, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents with benchmark passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))
