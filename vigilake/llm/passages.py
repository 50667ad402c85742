"""Repeated passages across documents by runs of shingles.

Every near-duplicate passage shares a run of ``longest`` five-word shingles: an edit
inside costs four shingles or more on one side. Hashes of shorter runs are winnowed
(the least of some neighbours stays), so that each shared run of that length leaves a
seed in both texts. Texts with equal seeds meet in shards of packed seeds, dealt by hash, an
interval join makes regions of them, and those are compared shingle by shingle.

A seed is joined to the first one of its group, so a passage in very many documents
costs one row for each. Where a text that is no near-duplicate comes first it takes the
seeds, so around shared seeds whole passages are hashed too: those groups are of equal
passages only. Seeds that no verified span holds after that are compared to all earlier ones
of their group, so an edited copy is found whatever comes before it. Equal texts are one
class, joined to by its copies.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import packed, small, staged, table, trim, unpacked

MIX = np.uint64(0x9E3779B97F4A7C15)
# Shingles of a slice that is sent to a comparison.
SLICE = 64


@dataclass(frozen=True)
class Passages:
    """What counts as a repeated passage."""

    words: int = 50
    shingle: int = 5
    similarity: float = 0.8
    pick: int = 7

    @property
    def room(self) -> int:
        return self.words - self.shingle + 1

    @property
    def longest(self) -> int:
        """Shingles of a run that every passage of the wanted length and similarity shares with its source.

        An edit that leaves k words more or fewer leaves room - k - shingle + 1 shared of
        room + shingle - 1 shingles, with more edits alike; the longest run is the shortest
        where they cut evenly.
        """
        shared = math.ceil(self.similarity * (self.room + self.shingle - 1) - 1e-9)
        edits = max(1, (self.room - shared) // (self.shingle - 1))
        return max(1, math.ceil(shared / (edits + 1)))

    @property
    def run(self) -> int:
        return max(1, self.longest - self.pick + 1)


DEFAULT = Passages()


def shingle_hashes(data: bytes | None, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` lower-cased words, in order."""
    words = (data or b"").lower().split()
    if len(words) < width:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = len(words) - width + 1
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = (out ^ (out >> np.uint64(31))) * MIX + hashed[j : j + size]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def centres(order: np.ndarray, doc: np.ndarray, room: int) -> np.ndarray:
    """Places that are the minimum of some run of ``room`` neighbours within one document.

    ``order`` is unique and ascending in (hash, place), its low bits the place. These
    are the Cartesian-tree nodes with at least ``room`` places below them.
    """
    n = len(order)
    if n < room:
        return np.zeros(0, np.int64)
    padded = np.full(-(-n // room) * room, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = order
    blocks = padded.reshape(-1, room)
    prefix = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - room + 1
    lowest = np.minimum(suffix[:starts], prefix[room - 1 : room - 1 + starts])
    lowest = lowest[doc[:starts] == doc[room - 1 : room - 1 + starts]]
    place = (lowest & np.uint64((1 << 24) - 1)).astype(np.int64)
    return place[np.flatnonzero(np.diff(place, prepend=-1))] if len(place) else place


def compact_windows(order: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows with room for ``room`` places.

    A stack builds the Cartesian tree of each document's centres from left to right: an
    entry is popped by the first smaller one to its right, and stands on the nearest
    smaller one to its left. Those are the window's bounds, since the nearest smaller
    place of a centre is itself a centre.
    """
    at = centres(order, doc, room)
    left, right = begin[at].copy(), end[at].copy()
    places, values, docs = at.tolist(), order[at].tolist(), doc[at].tolist()
    stack: list[int] = []
    for i, value in enumerate(values):
        if stack and docs[stack[-1]] != docs[i]:
            stack.clear()
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return left, at, right


STEP = 0xD6E8FEB86659FD93
BACK = pow(STEP, -1, 1 << 64)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` neighbours."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers, back = np.full(n, STEP, np.uint64), np.full(n - width + 1, BACK, np.uint64)
        powers[0] = back[0] = 1
        powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
        out = (sums[width:] - sums[:-width]) * back
        out ^= out >> np.uint64(31)
        out *= MIX
        return out ^ (out >> np.uint64(29))


def seeds(hashes: np.ndarray, settings: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the runs that are the least of some ``pick`` neighbours; of equal ones the last."""
    runs = run_hashes(hashes, settings.run)
    size = len(runs) - settings.pick + 1
    if len(hashes) < settings.room or size < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = runs[:size].copy(), np.arange(size)
    for j in range(1, settings.pick):
        lower = runs[j : j + size] <= least
        least[lower] = runs[j : j + size][lower]
        at[lower] = np.flatnonzero(lower) + j
    places = np.unique(at)
    return places, runs[places].view(np.int64)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _staged(df: DataFrame, name: str) -> DataFrame:
    """staged(), after which Spark removes the shuffle files of the write: nothing reads them again."""
    conf = df.sparkSession.conf
    was = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return staged(df, name)
    finally:
        if was is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, was)


# Hashes of texts that are sorted together in one part, and text bytes whose hashes make a shard.
PART = 1 << 20
SHARD_BYTES = 16 << 20
DEALT = "shard bigint, met boolean, entries binary"
# (name, kind, numbers) of what an entry holds: a text is its key for order and its class number.
ENTRY = (("key", "<u8", 1), ("text", "<i8", 2), ("place", "<u4", 1), ("many", "?", 1))


def _pack(entries: dict[str, np.ndarray], which) -> bytes:
    """Chosen entries column by column, so that numbers of a kind are compressed together."""
    return packed(np.frombuffer(b"".join(entries[name][which].astype(kind).tobytes() for name, kind, _ in ENTRY), np.uint8), "u1")


def _unpack(cells: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {name: [np.zeros((0, n) if n > 1 else 0, kind)] for name, kind, n in ENTRY}
    for cell in cells:
        raw, at = unpacked(cell, "u1"), 0
        size = len(raw) // sum(np.dtype(kind).itemsize * n for _, kind, n in ENTRY)
        for name, kind, n in ENTRY:
            to = at + size * n * np.dtype(kind).itemsize
            out[name].append(raw[at:to].view(kind).reshape((size, n) if n > 1 else size))
            at = to
    return {name: np.concatenate(values) for name, values in out.items()}


def _part(some: list[tuple]) -> pd.DataFrame:
    """The hashes of some texts, dealt into shards by key.

    A key of several of these texts is met already: its entries are not looked up, and only
    the first one goes to the shard. So no shard gets more than one text of a part for a key.
    """
    cls, doc = (np.array([text[i] for text in some], np.int64) for i in (0, 1))
    shards = int(some[0][2])
    once = np.lexsort((doc, cls))
    once = once[np.concatenate([np.ones(1, bool), np.diff(cls[once]) != 0])]
    once = once[np.lexsort((cls[once], doc[once]))]
    who = np.repeat(np.arange(len(once)), [len(some[i][3]) for i in once])
    key = np.concatenate([some[i][4].view(np.uint64) for i in once]) * MIX
    # Texts come in order, places in each of them too, and the sort is stable.
    order = np.argsort(key, kind="stable")
    key, who = key[order], who[order]
    text = np.stack([doc[once], cls[once]], axis=1)[who]
    place = np.concatenate([some[i][3] for i in once])[order]
    head = np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], len(key))
    many = np.repeat(who[begin] != who[end - 1], end - begin)
    entries = {"key": key, "text": text, "place": place, "many": many}
    sent = np.flatnonzero(head | ~many)
    shard = ((key[sent] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(shard)) + 1, [len(sent)]])
    rows = [(int(shard[i]), False, _pack(entries, sent[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    if many.any():
        rows.append((int(cls[0] % shards), True, _pack(entries, many)))
    return pd.DataFrame(rows, columns=["shard", "met", "entries"])


def _dealt(found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """DEALT rows of (cls, doc, shards, places, keys) of texts."""
    some, size = [], 0
    for text in found:
        if len(text[3]):
            some.append(text)
            size += len(text[3])
        if size >= PART:
            yield _part(some)
            some, size = [], 0
    if some:
        yield _part(some)


MET = "kind int, key bigint, cls bigint, place bigint, a bigint, a_place bigint"
LINKED, OPEN, FIRST = 0, 1, 2


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """MET rows of a shard: entries whose key several text classes have.

    LINKED ones name the first entry (a, a_place) with their key. OPEN ones met within their
    part and find theirs by key among the FIRST ones.
    """
    local = _unpack(list(rows["entries"][rows["met"]]))
    own = _unpack(list(rows["entries"][~rows["met"]]))
    order = np.argsort(own["key"], kind="stable")
    own = {name: column[order] for name, column in own.items()}
    twin = own["key"][1:] == own["key"][:-1]
    held = own["many"].copy()
    held[1:] |= twin
    held[:-1] |= twin
    own = {name: column[held] for name, column in own.items()}
    # Copies of a text give the same entries; the one with the smallest key for order stays.
    order = np.lexsort((own["text"][:, 0], own["many"], own["place"], own["text"][:, 1], own["key"]))
    key, text, place, many = (own[name][order] for name, _, _ in ENTRY)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:, 1] != text[:-1, 1]) | (place[1:] != place[:-1]) | (many[1:] != many[:-1])
    key, text, place, many = key[new], text[new], place[new], many[new]
    order = np.lexsort((place, text[:, 1], text[:, 0], key))
    key, cls, place, many = key[order], text[order, 1], place[order], many[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(head)
    first = begin[np.cumsum(head) - 1]
    shared, any_many = np.zeros(len(key), bool), np.zeros(len(begin), bool)
    if len(key):
        any_many = np.logical_or.reduceat(many, begin)
        shared = np.repeat(np.logical_or.reduceat(many | (cls != cls[first]), begin), np.diff(np.append(begin, len(key))))
    one, named = np.flatnonzero(shared & ~many), begin[any_many]
    size = len(local["key"])
    kinds = ((LINKED, len(one)), (OPEN, size), (FIRST, len(named)))
    none = {kind: np.zeros(n, np.int64) for kind, n in kinds}
    columns = (
        ("kind", [np.full(n, kind, np.int32) for kind, n in kinds]),
        ("key", [none[LINKED], local["key"].view(np.int64), key[named].view(np.int64)]),
        ("cls", [cls[one], local["text"][:, 1], none[FIRST]]),
        ("place", [place[one].astype(np.int64), local["place"].astype(np.int64), none[FIRST]]),
        ("a", [cls[first[one]], none[OPEN], cls[named]]),
        ("a_place", [place[first[one]].astype(np.int64), none[OPEN], place[named].astype(np.int64)]),
    )
    return pd.DataFrame({name: np.concatenate(column) for name, column in columns})


def _seeds(texts: DataFrame, settings: Passages) -> DataFrame:
    """DEALT: the seeds of every text (cls, doc, data, shards)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for batch in small(batches, "data"):
                for cls, doc, shards, data in zip(batch["cls"], batch["doc"], batch["shards"], batch["data"], strict=True):
                    yield cls, doc, shards, *seeds(shingle_hashes(data, settings.shingle), settings)

        yield from _dealt(found())

    return texts.mapInPandas(cut, DEALT)


def _whole(texts: DataFrame, lists: DataFrame, settings: Passages) -> DataFrame:
    """DEALT: runs of a whole passage's length all of whose seeds other texts have as well (``lists``: _Met.lists).

    Whatever run two texts share, they share all of its seeds. Groups are of equal passages; edited ones meet in behind().
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for batch in small(batches, "data"):
                for cls, doc, shards, data, known in zip(batch["cls"], batch["doc"], batch["shards"], batch["data"], batch["places"], strict=True):
                    hashes = shingle_hashes(data, settings.shingle)
                    places, _ = seeds(hashes, settings)
                    runs = run_hashes(hashes, settings.room)
                    alone = np.setdiff1d(places, np.asarray(known))
                    # A seed depends on up to pick - 1 neighbours on each side, so only those well inside count.
                    begin = np.arange(len(runs))
                    first = np.searchsorted(alone, begin + settings.pick - 1)
                    after = np.searchsorted(alone, begin + settings.room - settings.run - settings.pick + 1, side="right")
                    at = begin[first >= after]
                    yield cls, doc, shards, at, runs[at]

        yield from _dealt(found())

    known = lists.select("cls", "doc", F.array_distinct(F.col("seeds.place")).alias("places"))
    return texts.join(known, "cls").mapInPandas(cut, DEALT)


NO_KEY = (1 << 63) - 1


def _texts_columns(text: str) -> tuple[Column, Column]:
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return F.xxhash64(data).alias("cls"), data.alias("data")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(*_texts_columns(text))


def _entries(met: DataFrame) -> DataFrame:
    """(cls, place, a, a_place) of all that met, with the first of their group."""
    firsts = met.where(F.col("kind") == FIRST).select("key", "a", "a_place")
    opened = met.where(F.col("kind") == OPEN).select("key", "cls", "place").join(firsts, "key")
    return met.where(F.col("kind") == LINKED).select("cls", "place", "a", "a_place").union(opened.select("cls", "place", "a", "a_place"))


@dataclass(frozen=True)
class _Met:
    """What the seeds of all texts give: the texts with their number of shards, the entries of seeds that met, and those by class (cls, doc, seeds)."""

    texts: DataFrame
    entries: DataFrame
    lists: DataFrame


def _met(docs: DataFrame, classes: DataFrame, text: str, settings: Passages, key: str) -> _Met:
    """Seeds are packed and dealt into shards by key, once; those alone with their key go no further."""
    shards = 1 + (classes.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES
    texts = docs.select(*_texts_columns(text), F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("doc"), F.lit(shards).cast("bigint").alias("shards"))
    met = _staged(_seeds(texts, settings).groupBy("shard").applyInPandas(_meet, MET), "seeds")
    entries = _staged(_entries(met), "seeds-by-first")
    lists = entries.groupBy("cls").agg(F.collect_list(F.struct("place", "a", "a_place")).alias("seeds"))
    return _Met(texts, entries, _staged(lists.join(classes.select("cls", "doc"), "cls"), "shared-seeds"))


def candidates(docs: DataFrame, classes: DataFrame, text: str, settings: Passages = DEFAULT, key: str = "doc_id", met: _Met | None = None) -> DataFrame:
    """(b, lo, hi, a, a_lo, a_hi): regions of text class ``b`` around what it shares with ``a``, the first with a seed.

    ``a`` comes before ``b`` in the order of keys, then of class numbers; behind() looks at those between.
    """
    met = met or _met(docs, classes, text, settings, key)
    # Passages are hashed at every place, seeds at some.
    denser = met.texts.drop("doc").withColumn("shards", F.col("shards") * 2)
    whole = _staged(_whole(denser, met.lists, settings).groupBy("shard").applyInPandas(_meet, MET), "whole-passages")

    def links(entries: DataFrame, before: int) -> DataFrame:
        slack = settings.shingle if before else 0
        return entries.where("cls <> a").select(
            F.col("cls").alias("b"), "a", F.greatest(F.lit(0), F.col("place") - before).alias("lo"), (F.col("place") + settings.room - 1).alias("hi"),
            F.greatest(F.lit(0), F.col("a_place") - before - slack).alias("a_lo"), (F.col("a_place") + settings.room - 1 + slack).alias("a_hi"),
        )

    # A passage of the wanted length around a seed reaches so far to its left; to its right, a passage's length covers it.
    return _regions(links(met.entries, settings.room - settings.run).union(links(_entries(whole), 0)))


def _regions(found: DataFrame) -> DataFrame:
    """Interval join along b: links to the same text that overlap in b form a region."""
    along = Window.partitionBy("a", "b").orderBy("lo", "hi", "a_lo")
    reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int"))
    numbered = opened.withColumn("region", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    regions = numbered.groupBy("a", "b", "region").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("a_lo").alias("a_lo"), F.max("a_hi").alias("a_hi"))
    return regions.drop("region")


LINKS = "b bigint, a bigint, lo bigint, hi bigint, a_lo bigint, a_hi bigint"
# Comparisons of a group that are one part of it, and bytes of a seed with its surroundings.
COMPARED = 1 << 26
AROUND = 512


def _compared(group: list[tuple], settings: Passages) -> Iterator[tuple]:
    """LINKS rows of a group's (doc, cls, open, place, lo, hashes), in order: each open seed to the earlier texts it is similar to, until a span holds it.

    Open rows hold the surroundings of a seed from ``lo`` on, others those of one seed or of seeds that overlap.
    Equal ones are compared to once, as those of the first text that has them.
    """
    known: set[bytes] = set()
    earlier: dict[int, int] = {}
    holders, hashes = [], []
    for _, cls, is_open, _, lo, around in group:
        # Texts are in order, so all surroundings numbered so far are of earlier ones.
        earlier.setdefault(cls, len(holders))
        if not is_open and around not in known:
            known.add(around)
            holders.append((cls, lo))
            hashes.append(np.frombuffer(around, np.uint32))
    if not hashes:
        return
    value = np.concatenate(hashes)
    number = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
    order = np.lexsort((number, value))
    value, number = value[order], number[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (number[1:] != number[:-1])
    value, number = value[new], number[new]
    told: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
    for _, cls, is_open, place, lo, around in group:
        b = np.frombuffer(around, np.uint32)
        if not is_open or not earlier[cls] or len(b) < settings.room:
            continue
        wanted, which = np.unique(b, return_inverse=True)
        first, after = np.searchsorted(value, wanted), np.searchsorted(value, wanted, side="right")
        size = after - first
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        before = number[at] < earlier[cls]
        for i in _likely(wanted, which, number[at][before], np.repeat(np.arange(len(wanted)), size)[before], earlier[cls], settings):
            a, a_lo = holders[i]
            if (around, i) not in told:
                told[around, i] = similar_spans(b, hashes[i], settings)
            if told[around, i]:
                yield cls, a, lo, lo + len(b) - 1, a_lo, a_lo + len(hashes[i]) - 1
            if any(lo + x <= place and place + settings.run - 1 <= lo + y for x, y in told[around, i]):
                break


def _likely(wanted: np.ndarray, which: np.ndarray, number: np.ndarray, of: np.ndarray, size: int, settings: Passages) -> list[int]:
    """Numbers of the texts that can have a span similar to one of a stretch, most shared first.

    ``wanted[which]`` are the stretch's shingles; text ``number[k]`` of ``size`` has ``wanted[of[k]]``. What similar_spans() gives has
    shared ends a passage's length apart, and holds a passage's length of which a large enough part is shared,
    by places or by different shingles; a text without that is left out.
    """
    room, most = settings.room, settings.similarity
    shared = np.bincount(number, minlength=size)
    if len(wanted) == len(which) and shared.max(initial=0) < most * room - 1e-6:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(which, room)
    held = np.zeros((len(windows), len(wanted)), np.float32)
    held[np.arange(len(windows))[:, None], windows] = 1
    different = held.sum(axis=1)
    rows = np.flatnonzero(shared >= most * different.min() - 1e-6)
    if not len(rows):
        return []
    at = np.full(size, -1)
    at[rows] = np.arange(len(rows))
    some = at[number] >= 0
    have = np.zeros((len(rows), len(wanted)), np.float32)
    have[at[number[some]], of[some]] = 1
    places = have[:, which]
    reach = len(which) - places[:, ::-1].argmax(axis=1) - places.argmax(axis=1)
    rich = have @ held.T >= most * different - 1e-3
    sums = np.cumsum(np.pad(places, ((0, 0), (1, 0))), axis=1)
    dense = ((sums[:, room:] - sums[:, :-room]) >= most * room - 1e-6).any(axis=1)
    keep = np.zeros(len(rows), bool)
    for k in np.flatnonzero((rich.any(axis=1) | dense) & (reach >= room)).tolist():
        # Windows of a stretch overlap, so they make one span, from a shared end to another.
        starts, there = np.flatnonzero(rich[k]), np.flatnonzero(places[k])
        if len(starts):
            ends = there[(there >= starts[0]) & (there < starts[-1] + room)]
            keep[k] = ends[-1] - ends[0] + 1 >= room
        if not keep[k] and dense[k]:
            i, j = _densest(places[k] > 0, settings)
            own = np.unique(which[i : j + 1])
            keep[k] = max(i, len(which) - 1 - j) >= room or (j - i + 1 >= room and have[k][own].sum() >= most * len(own) - 1e-3)
    rows = rows[keep]
    return rows[np.argsort(-shared[rows], kind="stable")].tolist()


def _around(seeds_of: list[tuple], hashes: np.ndarray, settings: Passages) -> Iterator[tuple]:
    """(group, open, place, lo, hashes) of a text's (group, place, open): each open seed, and for all what may be compared to."""
    left, room, slack = settings.room - settings.run, settings.room, settings.shingle
    begun = end = None
    ordered = sorted(set(seeds_of))
    for i, (group, place, is_open) in enumerate(ordered):
        if is_open:
            yield group, True, place, max(0, place - left), hashes[max(0, place - left) : place + room].tobytes()
        # Equal seeds that overlap repeat one another's surroundings.
        begun, end = place if begun is None else begun, place
        following = ordered[i + 1] if i + 1 < len(ordered) else None
        if not following or following[0] != group or following[1] - end > settings.run:
            lo = max(0, begun - left - slack)
            yield group, False, begun, lo, hashes[lo : end + room + slack].tobytes()
            begun = None


def behind(docs: DataFrame, classes: DataFrame, met: _Met, spans: DataFrame, text: str, settings: Passages = DEFAULT, key: str = "doc_id") -> DataFrame:
    """Regions, as candidates() gives them, of seeds that no one of ``spans`` holds: with all earlier texts of their group.

    A seed that a span holds is known to repeat an earlier text. Groups meet with the hashes around their
    seeds; a large one is cut into parts, each with some of its open seeds and all that they are compared to.
    """
    held = lambda s: F.exists("spans", lambda x: (x["first"] <= s["place"]) & (s["place"] + (settings.run + settings.shingle - 2) <= x["last"]))
    known = met.lists.join(spans, "cls", "left")
    left_open = known.select("cls", F.explode(F.filter("seeds", lambda s: (s["a"] != F.col("cls")) & ~F.coalesce(held(s), F.lit(False)))).alias("s"))
    opened = _staged(left_open.select("cls", "s.place", "s.a", "s.a_place").distinct(), "open-seeds")
    # The first one of a group is compared to already.
    counts = opened.groupBy("a", "a_place").agg(F.count("*").alias("opened"))
    rows = met.entries.where("cls <> a or place <> a_place").join(counts, ["a", "a_place"])
    rows = _staged(rows.join(opened.withColumn("open", F.lit(True)), ["cls", "place", "a", "a_place"], "left"), "open-groups")
    counted = rows.groupBy("a", "a_place").agg(F.count("*").alias("size"), F.first("opened").alias("opened")).where("size > 1")
    groups = _staged(counted.select("a", "a_place", "size", F.expr(f"1 + opened * size div {COMPARED}").alias("parts")), "group-sizes")
    shards = 1 + (groups.agg(F.sum(F.col("size") * F.col("parts"))).first()[0] or 0) * AROUND // SHARD_BYTES
    seeds_of = F.collect_list(F.struct("a", "a_place", "parts", "place", F.coalesce("open", F.lit(False)).alias("open"))).alias("seeds")
    lists = _staged(rows.drop("opened").join(groups.drop("size"), ["a", "a_place"]).groupBy("cls").agg(seeds_of), "open-lists")
    # Of equal texts the one with the smallest key is enough.
    named = docs.select(*_texts_columns(text), F.col(key).cast("bigint").alias("__key")).join(lists, "cls").join(classes.select("cls", "first", "doc"), "cls")
    texts = named.where(F.col("__key").eqNullSafe(F.col("first"))).select("cls", "doc", "data", "seeds")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches, "data"):
            rows: list[tuple] = []
            for cls, doc, data, seeds_of in zip(batch["cls"], batch["doc"], batch["data"], batch["seeds"], strict=True):
                hashes = shingle_hashes(data, settings.shingle).astype(np.uint32)
                listed = [((s["a"], s["a_place"], s["parts"]), s["place"], s["open"]) for s in seeds_of]
                rows += [(*group, doc, cls, *row) for group, *row in _around(listed, hashes, settings)]
            yield pd.DataFrame(rows, columns=["a", "a_place", "parts", "doc", "cls", "open", "place", "lo", "around"])

    around = texts.mapInPandas(cut, "a bigint, a_place bigint, parts bigint, doc bigint, cls bigint, open boolean, place bigint, lo bigint, around binary")
    # What is compared to goes to every part, an open seed to one.
    own = F.pmod(F.xxhash64("cls", "place"), F.col("parts"))
    dealt = around.withColumn("part", F.explode(F.when(F.col("open"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("a", "a_place", "part"), F.lit(shards)))
    group = ["a", "a_place", "part"]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates([*group, "cls", "open", "place"]).sort_values([*group, "doc", "cls", "open", "place"])
        heads = np.flatnonzero(rows[group].ne(rows[group].shift()).any(axis=1)).tolist()
        found: list[tuple] = []
        for i, j in zip(heads, [*heads[1:], len(rows)], strict=True):
            some = rows.iloc[i:j]
            if some["open"].any():
                listed = list(zip(*(some[c].tolist() for c in ("doc", "cls", "open", "place", "lo", "around")), strict=True))
                found += _compared(listed, settings)
        trim()
        return pd.DataFrame(found, columns=["b", "a", "lo", "hi", "a_lo", "a_hi"])

    return _regions(dealt.drop("parts").groupBy("shard").applyInPandas(compare, LINKS))


def _slices(docs: DataFrame, text: str, regions: DataFrame, settings: Passages) -> DataFrame:
    """(a, slice, hashes): the shingle hashes (32 bits) of the slices of texts ``a`` that regions need."""
    wanted = regions.select("a", F.explode(F.sequence(F.expr(f"a_lo div {SLICE}"), F.expr(f"a_hi div {SLICE}"))).alias("slice"))
    # At most the slices of one text for each row.
    lists = _staged(wanted.groupBy("a").agg(F.sort_array(F.collect_set("slice")).alias("slices")), "slice-lists")
    texts = _texts(docs, text).join(lists.withColumnRenamed("a", "cls"), "cls")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches, "data"):
            rows: list[tuple] = []
            for cls, data, slices in zip(batch["cls"], batch["data"], batch["slices"], strict=True):
                hashes = shingle_hashes(data, settings.shingle).astype(np.uint32)
                rows += [(cls, s, hashes[s * SLICE : (s + 1) * SLICE].tobytes()) for s in slices]
            yield pd.DataFrame(rows, columns=["a", "slice", "hashes"])

    return texts.mapInPandas(cut, "a bigint, slice bigint, hashes binary")


def _densest(shared: np.ndarray, settings: Passages) -> tuple[int, int]:
    """(first, last) of the span with the largest surplus of shared shingles over the tolerated share of others; last is -1 without any."""
    cost = settings.similarity / (1 - settings.similarity)
    sums = np.concatenate([[0.0], np.cumsum(np.where(shared, 1.0, -cost))])
    last = int(np.argmax(sums - np.minimum.accumulate(sums))) - 1
    return int(np.argmin(sums[: last + 2])), last


def similar_spans(b: np.ndarray, a: np.ndarray, settings: Passages) -> list[tuple[int, int]]:
    """Spans (first, last) of ``b`` that are near-duplicates of a span of ``a``, both arrays of shingle hashes.

    The span with the largest surplus of shared shingles over the tolerated share of
    others is taken, compared exactly by its shingle set, and the rest searched on. All
    windows of passage length that no such span holds are compared too; those that are
    near-duplicates are merged and end with shared shingles.
    """
    order = np.argsort(a, kind="stable")
    sorted_a = a[order]
    where = np.minimum(np.searchsorted(sorted_a, b), max(0, len(a) - 1))
    shared = sorted_a[where] == b if len(a) else np.zeros(len(b), bool)
    found, todo = [], [(0, len(b) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo + 1 < settings.room:
            continue
        first, last = _densest(shared[lo : hi + 1], settings)
        if last < 0:
            continue
        i, j = lo + first, lo + last
        if j - i + 1 >= settings.room and _jaccard(b[i : j + 1], a, order[where[i : j + 1]], shared[i : j + 1], settings) >= settings.similarity:
            found.append((i, j))
        todo += [(lo, i - 1), (j + 1, hi)]
    # Spans end with shared shingles, so only a window with one that no span holds adds anything.
    fresh = shared.copy()
    for i, j in found:
        fresh[i : j + 1] = False
    held = np.concatenate([[0], np.cumsum(fresh)])
    hits = _promising(b, shared, settings) if held[-1] else []
    hits = [at for at in hits if held[at + settings.room] > held[at]]
    # Where no shingle comes twice, places tell all windows at once.
    once = len(hits) > 1 and (sorted_a[1:] != sorted_a[:-1]).all() and len(np.unique(b)) == len(b)
    similar = _window_similarities(order[where], shared, hits, settings) if once else None
    for k, at in enumerate(hits):
        window = slice(at, at + settings.room)
        if (similar[k] if once else _jaccard(b[window], a, order[where[window]], shared[window], settings)) >= settings.similarity:
            found.append((at, at + settings.room - 1))
    merged: list[list[int]] = []
    for i, j in sorted(found):
        if merged and i <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], j)
        else:
            merged.append([i, j])
    spans = []
    for i, j in merged:
        held = i + np.flatnonzero(shared[i : j + 1])
        if held[-1] - held[0] + 1 >= settings.room:
            spans.append((int(held[0]), int(held[-1])))
    return spans


def _promising(b: np.ndarray, shared: np.ndarray, settings: Passages) -> list[int]:
    """Begins of windows of passage length in which the part of different shingles that are shared is large enough."""
    if len(b) < settings.room:
        return []
    # A place counts for a window if its shingle has not been in it before.
    order = np.argsort(b, kind="stable")
    before = np.full(len(b), -1)
    same = b[order[1:]] == b[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    starts = np.arange(len(b) - settings.room + 1)
    out = []
    for at in range(0, len(starts), 65_536):
        some = starts[at : at + 65_536]
        stop = some[-1] + settings.room
        new = np.lib.stride_tricks.sliding_window_view(before[some[0] : stop], settings.room) < some[:, None]
        both = new & np.lib.stride_tricks.sliding_window_view(shared[some[0] : stop], settings.room)
        out += some[both.sum(axis=1) >= settings.similarity * new.sum(axis=1)].tolist()
    return out


def _jaccard(span: np.ndarray, a: np.ndarray, places: np.ndarray, shared: np.ndarray, settings: Passages) -> float:
    """Similarity of a span to the best of two stretches of ``a``: around the median place of what they share, and around the median shift."""
    slack = len(span) // 4 + settings.shingle
    at, held = np.flatnonzero(shared), places[shared]
    if not len(held):
        return 0.0
    own = np.unique(span)
    middle, shift = int(np.sort(held)[len(held) // 2]), int(np.sort(held - at)[len(held) // 2])
    best, seen = 0.0, None
    for near in (held[np.abs(held - middle) <= len(span) + slack], held[np.abs(held - at - shift) <= slack]):
        stretch = int(near.min()), int(near.max()) + 1
        if stretch == seen:
            continue
        seen = stretch
        other = np.unique(a[slice(*stretch)])
        common = int((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum())
        best = max(best, common / (len(own) + len(other) - common))
    return best


def _window_similarities(places: np.ndarray, shared: np.ndarray, starts: list[int], settings: Passages) -> np.ndarray:
    """_jaccard() of the windows of passage length at ``starts``, for texts in which no shingle comes twice."""
    room, far, out = settings.room, 1 << 40, []
    slack, rows = room // 4 + settings.shingle, np.arange(room)
    for i in range(0, len(starts), 4096):
        at = np.asarray(starts[i : i + 4096])
        held = np.lib.stride_tricks.sliding_window_view(places, room)[at]
        both = np.lib.stride_tricks.sliding_window_view(shared, room)[at]
        half = (np.arange(len(at)), both.sum(axis=1) // 2)
        middle = np.sort(np.where(both, held, far), axis=1)[half][:, None]
        shift = np.sort(np.where(both, held - rows, far), axis=1)[half][:, None]
        best = np.zeros(len(at))
        for near in (both & (np.abs(held - middle) <= room + slack), both & (np.abs(held - rows - shift) <= slack)):
            low, high = np.where(near, held, far).min(axis=1), np.where(near, held, -1).max(axis=1)
            common = (both & (held >= low[:, None]) & (held <= high[:, None])).sum(axis=1)
            best = np.maximum(best, common / (room + high - low + 1 - common))
        out.append(best)
    return np.concatenate(out)


SPANS = "array<struct<first:bigint,last:bigint,a:bigint>>"


def verified(docs: DataFrame, text: str, regions: DataFrame, settings: Passages = DEFAULT) -> DataFrame:
    """(cls, spans): for every text class with candidates, its spans of words that repeat an earlier text."""
    regions = _staged(regions, "regions")
    slices = _staged(_slices(docs, text, regions, settings).distinct(), "slices")
    numbered = regions.withColumn("slice", F.explode(F.sequence(F.expr(f"a_lo div {SLICE}"), F.expr(f"a_hi div {SLICE}"))))
    # A text meets only first windows, one per window of its own, so these lists are bounded by the text.
    pieces = numbered.join(slices, ["a", "slice"]).groupBy("b", "a", "lo", "hi", "a_lo", "a_hi").agg(F.sort_array(F.collect_list(F.struct("slice", "hashes"))).alias("parts"))
    merged = pieces.select("b", F.struct("a", "lo", "hi", "a_lo", "a_hi", F.col("parts.hashes").alias("parts")).alias("region"))
    lists = _staged(merged.groupBy("b").agg(F.collect_list("region").alias("regions")), "region-lists")
    texts = _texts(docs, text).join(lists.withColumnRenamed("b", "cls"), "cls")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches, "data"):
            rows = []
            for cls, data, regions_of in zip(batch["cls"], batch["data"], batch["regions"], strict=True):
                own = shingle_hashes(data, settings.shingle).astype(np.uint32)
                spans = set()
                for r in regions_of:
                    theirs = np.frombuffer(b"".join(bytes(p) for p in r["parts"]), np.uint32)
                    theirs = theirs[r["a_lo"] - r["a_lo"] // SLICE * SLICE :][: r["a_hi"] - r["a_lo"] + 1]
                    lo = r["lo"]
                    spans.update((lo + i, lo + j + settings.shingle - 1, r["a"]) for i, j in similar_spans(own[lo : r["hi"] + 1], theirs, settings))
                if spans:
                    rows.append((cls, [dict(zip(("first", "last", "a"), map(int, s), strict=True)) for s in sorted(spans)]))
            yield pd.DataFrame(rows, columns=["cls", "spans"])

    return texts.mapInPandas(compare, f"cls bigint, spans {SPANS}")


def text_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(cls, first, bytes, doc): each different text, its smallest key as it is and for order (NULL last), and its length."""
    cls, data = _texts_columns(text)
    rows = docs.select(F.col(key).cast("bigint").alias("first"), cls, F.octet_length(data).alias("bytes"))
    found = rows.groupBy("cls").agg(F.min("first").alias("first"), F.max("bytes").alias("bytes"))
    return _staged(found.withColumn("doc", F.coalesce("first", F.lit(NO_KEY))), "text-classes")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Passages = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(classes, spans): text_classes() and the verified spans of each class, both written."""
    classes = text_classes(docs, key, text)
    met = _met(docs, classes, text, settings, key)

    def spans_in(regions: DataFrame) -> DataFrame:
        # Equal rows give equal spans.
        return _staged(verified(docs, text, regions, settings).groupBy("cls").agg(F.first("spans").alias("spans")), "spans")

    spans = spans_in(candidates(docs, classes, text, settings, key, met))
    more = spans_in(behind(docs, classes, met, spans, text, settings, key))
    both = spans.union(more).groupBy("cls").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cls": batch["cls"], "spans": [_joined([(s["a"], s["first"], s["last"]) for s in spans], settings) for spans in batch["spans"]]})

    return classes, _staged(both.mapInPandas(joined, f"cls bigint, spans {SPANS}"), "all-spans")


def _joined(spans: list[tuple[int, int, int]], settings: Passages) -> list[dict]:
    """Spans (a, first, last) of a text, those of the same other text that overlap by a shingle as one."""
    out: list[list[int]] = []
    for a, first, last in sorted(spans):
        if out and out[-1][0] == a and first <= out[-1][2] - settings.shingle + 1:
            out[-1][2] = max(out[-1][2], last)
        else:
            out.append([a, first, last])
    return [{"first": first, "last": last, "a": a} for first, last, a in sorted((first, last, a) for a, first, last in out)]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def op7_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Repeated passages: (doc_id, first_word, last_word) repeats a passage of the earlier document source_id.

    A copy of a whole text of at least the passage length is one row that names the
    first document with that text; the first one's own repeats are rows of its own.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes, spans = repeated(docs)
    own = spans.select("cls", F.inline("spans")).join(classes.select(F.col("cls").alias("a"), F.col("first").alias("source_id")), "a")
    named = own.select("cls", F.col("first").alias("first_word"), F.col("last").alias("last_word"), "source_id").join(classes.select("cls", F.col("first").alias("doc_id")), "cls")
    # A count by pattern takes several times as long, and here every text is counted.
    counted = F.pandas_udf(lambda texts: texts.map(lambda data: len(data.split())), "bigint")
    rows = docs.select("doc_id", *_texts_columns("text")).select("doc_id", "cls", counted("data").alias("words")).where(F.col("words") >= DEFAULT.words)
    copies = rows.join(classes.select("cls", F.col("first").alias("source_id")), "cls").where("doc_id <> source_id")
    return named.select("doc_id", "source_id", "first_word", "last_word").union(copies.select("doc_id", "source_id", F.lit(0).cast("bigint"), F.col("words") - 1))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Passages = DEFAULT) -> DataFrame:
    """``docs`` without the passages that repeat an earlier document; what is left blank goes.

    The first document with a passage keeps it. Of equal texts of at least the passage
    length the row with the smallest key stays (without keys: all of them). A column
    ``n_chars`` follows the text.
    """
    columns = docs.columns
    classes, spans = repeated(docs, key, text, settings)
    marked = docs.withColumn("__cls", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    found = marked.join(classes.select(F.col("cls").alias("__cls"), F.col("first").alias("__first")), "__cls").join(spans.select(F.col("cls").alias("__cls"), F.col("spans").alias("__spans")), "__cls", "left")
    # Last comes what costs most: only the words of copies are counted.
    copy = F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col(key).cast("bigint")) & (word_count(text) >= settings.words)

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_words(t, [(x["first"], x["last"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype="object")

    kept = found.where(~copy).withColumn("__new", F.when(F.col("__spans").isNull(), F.col(text)).otherwise(without(F.col(text), F.col("__spans"))))
    kept = kept.where(F.col("__spans").isNull() | F.coalesce(F.col("__new").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    made = {text: F.col("__new"), "n_chars": F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.char_length("__new")) if "n_chars" in columns else None}
    return kept.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(f"`{c}`") for c in columns])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without words first..last (counted from 0) of each span, and without the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    gone = np.zeros(max(last for _, last in spans) + 2, bool)
    for first, last in spans:
        gone[first : last + 1] = True
    out, number, at = [], 0, 0
    for word in data.split():
        begin = data.index(word, at)
        end = begin + len(word)
        if number < len(gone) and gone[number]:
            out.append(data[at:begin] if not (number and gone[number - 1]) else b"")
        else:
            out.append(data[begin:end] if number and number - 1 < len(gone) and gone[number - 1] else data[at:end])
        at, number = end, number + 1
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: passages that repeat an earlier document are cut out."""
    return remove(docs)
