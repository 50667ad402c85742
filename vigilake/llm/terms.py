"""A sparse document-term matrix in shards, over one dictionary for the whole corpus.

Every task packs the documents it reads into shards of bounded size. A shard is a
matrix in compressed sparse rows: one row per document, one column per word, the word's
occurrences as values. Its columns are first numbered by the shard's own words; each
shard sends every word once to the dictionary, however often it occurs there, and gets the
global numbers back. The dictionary is built in buckets by a hash of the word, as many as the
text asks for. No word is a hot key: it comes at most once from each shard.
"""

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import packed, staged, unpacked

# Text bytes of a shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
# Text bytes for each bucket of the dictionary.
BUCKET_BYTES = 16 << 20
# Bytes split into words at a time: bounds a task's memory for very long texts.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Vocabulary(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end at white space."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        yield data[at:end]
        at = end


def row_of(data: bytes, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(columns, counts) of a document's words; words are what ASCII white space separates."""
    found = []
    for chunk in chunks(data):
        words = chunk.split()
        ids = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
        found.append(np.unique(ids, return_counts=True))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    columns, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    counts = np.zeros(len(columns), np.int64)
    np.add.at(counts, place, np.concatenate([n for _, n in found]))
    return columns, counts


BLOCKS = "array<struct<bucket: int, places: binary, words: array<binary>>>"
_BLOCK = pa.struct([("bucket", pa.int32()), ("places", pa.binary()), ("words", pa.list_(pa.binary()))])


def by_bucket(words: list[bytes], buckets: int, salt: bytes = b"") -> list[tuple[int, np.ndarray, list[bytes]]]:
    """(bucket, places in ``words``, words) of every bucket that has any."""
    start = zlib.crc32(salt)
    hashes = np.fromiter((zlib.crc32(w, start) for w in words), np.int64, len(words)) % buckets
    order = np.argsort(hashes, kind="stable")
    bounds = np.searchsorted(hashes[order], np.arange(buckets + 1))
    return [(k, order[a:b], [words[i] for i in order[a:b]]) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]


def bucket_count(docs: DataFrame, text: str, bucket_bytes: int) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("binary")))).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def term_matrix(
    docs: DataFrame, text: str = "text", measure: Callable[[bytes], list[int]] | None = None, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(matrix, dictionary) of the words of ``docs``.

    matrix: shard, labels (one struct per row: all columns of ``docs`` but ``text``), indptr,
    indices (global term ids), counts, measures; the arrays are packed integers of 32, 64,
    32 and 64 bits (``common.unpacked``). dictionary: word (binary), term_id. ``measure`` may give each text
    more numbers. A NULL or empty text is a row without entries; an empty table gives
    no shard. Repeated rows stay rows.
    """
    buckets = bucket_count(docs, text, bucket_bytes)
    kept = [c for c in docs.columns if c != text]
    wanted = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("label"), F.col(f"`{text}`").cast("binary").alias("data"))
    label = wanted.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rows, labels, measures, held = Vocabulary(), [], [], [], 0

        def shard():
            sizes = np.cumsum([0] + [len(c) for c, _ in rows])
            none = [np.empty(0, np.int32)]
            joint = pa.concat_arrays(labels)
            blocks = [{"bucket": k, "places": packed(places, "<i4"), "words": words} for k, places, words in by_bucket(list(vocabulary), buckets)]
            columns = {
                "labels": pa.ListArray.from_arrays(pa.array([0, len(joint)], pa.int32()), joint),
                "indptr": pa.array([packed(sizes, "<i4")], pa.binary()),
                "indices": pa.array([packed(np.concatenate(none + [c for c, _ in rows]), "<i4")], pa.binary()),
                "counts": pa.array([packed(np.concatenate(none + [n for _, n in rows]), "<i4")], pa.binary()),
                "measures": pa.array([packed(np.array(measures), "<i8")], pa.binary()),
                "blocks": pa.array([blocks], pa.list_(_BLOCK)),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            first = 0
            for i, value in enumerate(batch.column("data")):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                if rows and held + len(data) > shard_bytes:
                    labels.append(batch.column("label").slice(first, i - first))
                    yield shard()
                    vocabulary, rows, labels, measures, held, first = Vocabulary(), [], [], [], 0, i
                rows.append(row_of(data, vocabulary))
                measures.append(measure(data) if measure else [])
                held += len(data)
            labels.append(batch.column("label").slice(first))
        if rows:
            yield shard()

    schema = f"labels array<{label}>, indptr binary, indices binary, counts binary, measures binary"
    shards = wanted.mapInArrow(pack, f"{schema}, blocks {BLOCKS}").select(F.monotonically_increasing_id().alias("shard"), "*")
    shards = staged(shards, "term-shards")
    blocks = shards.select("shard", F.inline("blocks"))

    def numbers(rows: pa.Table) -> tuple[pa.Table, pa.DictionaryArray]:
        rows = rows.sort_by("shard")  # the same numbers whenever this runs
        return rows, pa.concat_arrays([x.values for x in rows.column("words")]).dictionary_encode()

    def number(rows: pa.Table) -> pa.Table:
        rows, encoded = numbers(rows)
        ids = encoded.indices.to_numpy().astype(np.int64) * buckets + rows.column("bucket")[0].as_py()
        sizes = np.cumsum([len(x) for x in rows.column("words")])[:-1]
        return pa.table({"shard": rows.column("shard"), "places": rows.column("places"), "ids": pa.array([packed(x, "<i8") for x in np.split(ids, sizes)], pa.binary())})

    def listed(rows: pa.Table) -> pa.Table:
        rows, encoded = numbers(rows)
        ids = np.arange(len(encoded.dictionary)) * buckets + rows.column("bucket")[0].as_py()
        return pa.table({"word": encoded.dictionary, "term_id": ids})

    dictionary = blocks.groupBy("bucket").applyInArrow(listed, "word binary, term_id bigint")
    given = blocks.groupBy("bucket").applyInArrow(number, "shard bigint, places binary, ids binary")
    # A shard's own list of words is as long as the shard, not as the corpus.
    given = given.groupBy("shard").agg(F.collect_list(F.struct("places", "ids")).alias("given"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                local = unpacked(row.column("indices")[0].as_buffer(), "<i4")
                known = row.column("given")[0]
                terms = np.empty(int(local.max(initial=-1)) + 1, "<i8")
                for block in known.values if known.is_valid else ():
                    terms[unpacked(block["places"].as_buffer(), "<i4")] = unpacked(block["ids"].as_buffer(), "<i8")
                columns = {c: row.column(c) for c in ("shard", "labels", "indptr", "indices", "counts", "measures")}
                columns["indices"] = pa.array([packed(terms[local], "<i8")], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    encoded = shards.drop("blocks").join(given, "shard", "left")
    return encoded.mapInArrow(encode, f"shard bigint, {schema}"), dictionary


def row_stats(matrix: DataFrame, total: str = "__words", distinct: str = "__distinct", measures: tuple[str, ...] = ()) -> DataFrame:
    """One row per matrix row: its label's fields, the sum of its counts, how many are not zero, and its measures."""
    label = matrix.schema["labels"].dataType.elementType

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                indptr = unpacked(batch.column("indptr")[i].as_buffer(), "<i4").astype(np.int64)
                counts = unpacked(batch.column("counts")[i].as_buffer(), "<i4")
                before = np.append(0, np.cumsum(counts, dtype=np.int64))
                columns = {"label": batch.column("labels")[i].values, total: before[indptr[1:]] - before[indptr[:-1]], distinct: np.diff(indptr)}
                more = unpacked(batch.column("measures")[i].as_buffer(), "<i8").reshape(len(indptr) - 1, -1)
                yield pa.RecordBatch.from_pydict(columns | {c: more[:, k] for k, c in enumerate(measures)})

    names = [total, distinct, *measures]
    rows = matrix.mapInArrow(stats, ", ".join([f"label {label.simpleString()}", *[f"{c} bigint" for c in names]]))
    return rows.select("label.*", *names)
