"""Removal of every byte that lies in a string of 200 bytes occurring more than once.

Suffixes that share their first 200 bytes must meet in one shard to be sorted together. Each
window of 200 bytes is therefore owned by the smallest hash among its 32-byte substrings, its
anchor: equal windows have equal anchors. Neighbouring windows with one anchor are
one super-window, so every window is in exactly one of them.

- Equal super-windows are counted before anything else; of each one stays.
- An anchor with one super-window that occurs once has no partner: nothing repeats there.
- The super-windows of all other anchors are dealt into shards by anchor, and a suffix array by
  induced sorting with its permuted common prefixes (``suffixes.py``) says which windows repeat.
- An anchor with very many different super-windows is no shard: its super-windows are cut again by
  longer anchors, and at last by whole windows, so no task gets a whole hot anchor.

What leaves each branch are the runs of windows that do not repeat; all others are removed.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.spread import salted_lookup
from vigilake.llm.common import staged, table
from vigilake.llm.suffixes import repeated

LENGTH = 200
# Bytes of the anchors that hot ones are cut by, one after the other; windows themselves come last.
ANCHORS = (32, 128, 184)
# Text bytes worked on at a time; a longer text is cut into overlapping parts, which
# changes its super-windows but not their windows or anchors.
BLOCK = 1 << 20
# Bytes sorted in one suffix array, and different super-windows of an anchor that may be sorted together.
SHARD_BYTES = 4 << 20
HOT_ANCHOR = 2000
# Rows that one join key may have before its rows are dealt over several parts.
SPLIT_ROWS = 2000

_PLACE = np.uint64((1 << 21) - 1)
_TABLE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_ODD = [np.uint64(x | 1) for x in np.random.default_rng(12).integers(1 << 62, (1 << 63) - 1, 24, np.int64).tolist()]


def _anchors(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from every place on."""
    h, size, k = _TABLE[raw], 1, 0
    while size < width:
        step = min(size, width - size)  # the last two halves may overlap
        h = h[:-step] * _ODD[k] + h[step:]
        h ^= h >> np.uint64(31)
        size, k = size + step, k + 1
    h = h * _ODD[-1]
    return h ^ (h >> np.uint64(29))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from every place on."""
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[: len(v) - (width - step)], v[width - step :]) if width > step else v


def super_windows(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, anchor: int = ANCHORS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, windows, anchor hash) of the super-windows of texts behind one another.

    Text i is ``raw[bounds[i]:bounds[i + 1]]``; windows never cross a bound. ``raw`` holds at most 2^21 bytes.
    """
    usable = np.maximum(np.diff(bounds) - length + 1, 0)
    if not usable.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    hashes = _anchors(raw, anchor)
    owner = _least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), length - anchor + 1) & _PLACE
    new = np.empty(len(owner), bool)
    new[0] = True
    np.not_equal(owner[1:], owner[:-1], out=new[1:])
    begins = bounds[:-1][usable > 0]
    new[begins] = True
    inside = np.zeros(len(owner) + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + usable[usable > 0], -1)
    heads = np.flatnonzero(new & (np.cumsum(inside[:-1]) > 0))
    part = np.searchsorted(bounds, heads, side="right") - 1
    following = np.append(heads[1:], len(raw))
    count = np.minimum(following, bounds[part] + usable[part]) - heads
    return part, heads - bounds[part], count, hashes[owner[heads].astype(np.int64)]


def _placed(docs: DataFrame, text: str) -> DataFrame:
    """(rid, data): every text under the place it has in the order in which the table is read."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("data"))


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Parts of texts, as (rid, start, n) and bytes, together of at most about ``BLOCK`` bytes."""
    names, parts, held = [], [], 0
    for batch in batches:
        for rid, start, n, value in zip(*(batch.column(c).to_pylist() for c in ("rid", "start", "n")), batch.column("data"), strict=True):
            data = value.as_buffer()
            for at in range(0, max(data.size - length + 1, 0), BLOCK):
                part = data.slice(at, min(BLOCK + length - 1, data.size - at)).to_pybytes()
                if parts and held + len(part) > BLOCK:
                    yield names, parts
                    names, parts, held = [], [], 0
                names.append((rid, start + at, n))
                parts.append(part)
                held += len(part)
    if parts:
        yield names, parts


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _counted(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, key, rid, start, windows, n) of every different super-window of (rid, start, n, data): one place and all occurrences."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, parts in _blocks(batches, length):
            joint = b"".join(parts)
            bounds = np.append(0, np.cumsum([len(p) for p in parts]))
            part, start, count, anchors = super_windows(np.frombuffer(joint, np.uint8), bounds, length, anchor)
            if not len(part):
                continue
            low = bounds[part] + start
            keys = [xxhash.xxh3_64_intdigest(joint[a:b]) for a, b in zip(low.tolist(), (low + count + length - 1).tolist(), strict=True)]
            rid, offset, n = np.array(names, np.int64)[part].T
            arrays = [_signed(anchors), _signed(keys), rid, offset + start, count, n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["anchor", "key", "rid", "start", "windows", "n"])

    rows = texts.mapInArrow(find, "anchor bigint, key bigint, rid bigint, start bigint, windows bigint, n bigint")
    # Text and place go together in one decimal, which has a fixed width and is aggregated in place.
    place = F.col("rid").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("start")
    found = rows.select("anchor", "key", place.cast("decimal(38,0)").alias("place"), "windows", "n")
    found = found.groupBy("anchor", "key").agg(F.min("place").alias("place"), F.min("windows").alias("windows"), F.sum("n").alias("n"))
    rid = F.expr("place div 4294967296").cast("bigint")
    return found.select("anchor", "key", rid.alias("rid"), (F.col("place") - rid.cast("decimal(38,0)") * (1 << 32)).cast("bigint").alias("start"), "windows", "n")


def single_runs(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT_ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(rid, start, windows): runs of windows that occur nowhere else; ``rid`` as in ``_placed``."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    texts, runs = _placed(docs, text).select("rid", zero.alias("start"), one.alias("n"), "data"), []
    for anchor in ANCHORS:
        counted = staged(_counted(texts, length, anchor), f"super-windows-{anchor}")
        by_anchor = counted.groupBy("anchor").agg(
            F.count("*").alias("kinds"), F.sum("n").alias("total"), F.min("rid").alias("rid"), F.min("start").alias("start"), F.min("windows").alias("windows")
        )
        runs.append(by_anchor.where("total = 1").select("rid", "start", "windows"))
        shared = by_anchor.where("kinds > 1").select("anchor", "kinds")
        met = staged(salted_lookup(counted, shared, "anchor", "inner", "key", SPLIT_ROWS), f"shared-anchors-{anchor}")
        total = met.where(F.col("kinds") <= hot).agg(F.sum(F.col("windows") + length)).first()[0] or 0
        pieces = staged(_pieces(texts, met, length, hot), f"pieces-{anchor}")
        runs.append(_sorted(pieces.where(~F.col("hot")), max(1, -(-total // shard_bytes)), length, shard_bytes))
        texts = pieces.where("hot").select("rid", "start", "n", F.col("piece").alias("data"))
        if texts.isEmpty():
            break
    else:
        # Windows one by one: no window is its own partner, so counting is enough.
        runs.append(_counted(texts, length, length).where("n = 1").select("rid", "start", "windows"))
    return reduce(DataFrame.union, runs)


def _pieces(texts: DataFrame, met: DataFrame, length: int, hot: int) -> DataFrame:
    """(anchor, rid, start, n, piece, hot): the bytes of super-windows, cut from the texts that they are in."""
    # A list is as long as its own text.
    wanted = met.groupBy("rid").agg(F.collect_list(F.struct("anchor", "start", "windows", "n", (F.col("kinds") > hot).alias("hot"))).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, pieces, low = batch.column("data")[i].as_buffer(), batch.column("pieces")[i].values, batch.column("start")[i].as_py()
                start = pieces.field("start").to_numpy()
                pieces = pieces.filter(pa.array((start >= low) & (start < low + data.size - length + 1)))
                start, count = (pieces.field(c).to_numpy() for c in ("start", "windows"))
                kept = [data.slice(a - low, m + length - 1).to_pybytes() for a, m in zip(start.tolist(), count.tolist(), strict=True)]
                rid = pa.array(np.full(len(kept), batch.column("rid")[i].as_py(), np.int64))
                arrays = [pieces.field("anchor"), rid, pieces.field("start"), pieces.field("n"), pa.array(kept, pa.binary()), pieces.field("hot")]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "rid", "start", "n", "piece", "hot"])

    near = texts.select("rid", "start", "data").join(wanted, "rid")
    return near.mapInArrow(cut, "anchor bigint, rid bigint, start bigint, n bigint, piece binary, hot boolean")


def _sorted(pieces: DataFrame, shards: int, length: int, shard_bytes: int) -> DataFrame:
    """Runs of single windows, from a suffix array over the pieces of each shard; an anchor is in one shard."""

    def sort(shard: pa.Table) -> pa.Table:
        order = np.lexsort([shard.column(c).to_numpy() for c in ("start", "rid", "anchor")])
        anchor, rid, start, n = (shard.column(c).to_numpy()[order] for c in ("anchor", "rid", "start", "n"))
        found, column = [], shard.column("piece")
        sizes = np.cumsum(np.array([len(x.as_buffer()) for x in column])[order])
        low = 0
        while low < len(order):  # whole anchors, of about the wanted size
            high = int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + shard_bytes, side="right"))
            high = min(max(high, low + 1), len(order))
            while high < len(order) and anchor[high] == anchor[high - 1]:
                high += 1
            parts = [column[int(i)].as_py() for i in order[low:high]]
            found.append(_runs(parts, rid[low:high], start[low:high], n[low:high] == 1, repeated(parts, length), length))
            low = high
        rid, start, count = (np.concatenate([f[k] for f in found]) for k in range(3))
        return pa.table({"rid": rid, "start": start, "windows": count})

    dealt = pieces.select("anchor", "rid", "start", "n", "piece", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(sort, "rid bigint, start bigint, windows bigint")


def _runs(parts, rid, start, once, found, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, start, windows) of the runs of windows in pieces that occur once and were not found again."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.append(0, np.cumsum(sizes + 1)[:-1])
    usable = np.zeros(len(found) + 1, np.int64)
    np.add.at(usable, begins[once], 1)
    np.add.at(usable, (begins + sizes - length + 1)[once], -1)
    single = (np.cumsum(usable[:-1]) > 0) & ~found
    edges = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]])))
    low, high = edges[::2], edges[1::2]
    piece = np.searchsorted(begins, low, side="right") - 1
    return rid[piece], start[piece] + low - begins[piece], high - low


def removed_spans(runs: list[tuple[int, int]], n_bytes: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal spans of bytes in windows outside ``runs`` (start, windows), which do not overlap."""
    spans, at, windows = [], 0, n_bytes - length + 1
    for start, count in [*sorted(runs), (windows, 0)]:
        if start > at:
            if spans and at <= spans[-1][1]:
                spans[-1] = spans[-1][0], start + length - 1
            else:
                spans.append((at, start + length - 1))
        at = max(at, start + count)
    return spans


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, write_first: bool = True, **sizes) -> DataFrame:
    """``docs`` without ``text``, with __n_bytes, __n_removed, __n_spans, __kept (binary) and __kept_sha256.

    Strings are judged on the texts as they come in. A NULL text is empty; a text shorter than ``length`` stays
    whole, and so do empty tables; every one of several equal longer texts goes whole. Columns of ``docs`` are
    carried through; those with the five names above are replaced. ``write_first=False``
    saves a copy of a table that is read from files and so always comes in the same order. ``__kept``
    is NULL where the whole text stays.
    """
    names = ["__n_bytes", "__n_removed", "__n_spans", "__kept", "__kept_sha256"]
    docs = staged(docs, "repeats-input") if write_first else docs
    runs = single_runs(docs, text, length, **sizes)
    # A list is as long as its own text.
    free = runs.groupBy("rid").agg(F.sum("windows").alias("free"), F.collect_list(F.struct("start", "windows")).alias("runs"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *names)]
    data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    size = F.octet_length(data).cast("bigint")
    about = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*others).alias("row"), size.alias("size"), F.sha2(data, 256).alias("sha"))
    windows = F.greatest(F.col("size") - (length - 1), F.lit(0))
    partly = (F.col("free") > 0) & (F.col("free") < windows)
    joined = about.join(free, "rid", "left").withColumn("free", F.coalesce("free", F.lit(0).cast("bigint")))
    joined = staged(joined.withColumn("runs", F.when(partly, F.col("runs"))), "free-windows")

    whole = joined.where(F.col("runs").isNull())
    gone = windows > F.col("free")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    simple = whole.select(
        "row.*", F.col("size").alias("__n_bytes"), F.when(gone, F.col("size")).otherwise(0).alias("__n_removed"),
        gone.cast("bigint").alias("__n_spans"), F.when(gone, F.lit(b"")).alias("__kept"), F.when(gone, empty).otherwise(F.col("sha")).alias("__kept_sha256"),
    )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, found = batch.column("data")[i].as_buffer(), batch.column("runs")[i].values
                spans = removed_spans(list(zip(*(found.field(c).to_pylist() for c in ("start", "windows")), strict=True)), data.size, length)
                bounds = [0, *(x for span in spans for x in span), data.size]
                kept = b"".join(data.slice(a, b - a).to_pybytes() for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                values = [pa.array([data.size]), pa.array([data.size - len(kept)]), pa.array([len(spans)]), pa.array([kept], pa.binary()), pa.array([hashlib.sha256(kept).hexdigest()])]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), *values], names=["row", *names])

    some = joined.where(F.col("runs").isNotNull()).select("rid", "row", "runs").join(_placed(docs, text), "rid")
    row = some.schema["row"].dataType.simpleString()
    cut = some.mapInArrow(rest, f"row {row}, __n_bytes bigint, __n_removed bigint, __n_spans bigint, __kept binary, __kept_sha256 string")
    return simple.union(cut.select("row.*", *names))


def op11_exact_repeats(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs, write_first=False)
    return found.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
