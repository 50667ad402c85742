"""SimHash near-duplicates through an inverted index over fingerprint bytes.

Two fingerprints of eight bytes that differ in at most two bits agree in at least
six byte positions. Every distinct fingerprint is posted under sets of positional
bytes chosen so that any six agreeing positions contain one whole set. Pairs that
meet in a posting list are tallied by the positional bytes they share; those with
the guaranteed minimum are verified bit by bit. A list too long to pair up is
resolved exactly by one-bit neighbours instead: fingerprints within two bits share
such a neighbour, and a neighbour has at most 65 fingerprints.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import components, staged, table

BYTES = 8
SEED = 42
# Lists longer than this take the one-bit-neighbour way; the result is the same.
LIST_LIMIT = 64
# Shingles hashed at a time: bounds a task's memory for very long texts.
CHUNK = 65_536


def position_sets(differing: int = 2) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which avoids any ``differing`` positions.

    Greedy cover: each set leaves out one position more than may differ, and sets are
    added until every choice of differing positions is left out by one of them.
    """
    open_ = set(combinations(range(BYTES), differing))
    chosen = []
    while open_:
        left_out = max(combinations(range(BYTES), differing + 1), key=lambda c: len(open_ & set(combinations(c, differing))))
        open_ -= set(combinations(left_out, differing))
        chosen.append(tuple(p for p in range(BYTES) if p not in left_out))
    return chosen


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """64-bit fingerprint of a text's word shingles; 0 without words."""
    words = (data or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        shingles, count = iter([b" ".join(words)]), 1
    else:
        shingles, count = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), len(words) - width + 1
    hashed, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, count, CHUNK):
        size = min(CHUNK, count - at)
        h = np.fromiter((hashed(next(shingles), SEED) for _ in range(size)), ">u8", size)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > count).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the signed 64-bit fingerprint of every whole text; a NULL text counts as empty."""

    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signed(fingerprint(t)) for t in texts], dtype="int64")

    return docs.withColumn(out, hashed(F.col(text).cast("binary")))


def shared_bytes(xor: Column) -> Column:
    """How many positional bytes two fingerprints share, from their XOR."""
    return sum(((F.shiftrightunsigned(xor, 8 * p).bitwiseAND(255)) == 0).cast("int") for p in range(BYTES))


def links(distinct: DataFrame, max_bits: int = 2, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(u, v) edges that connect all fingerprints ``fp`` within ``max_bits`` (1 or 2) of each other."""
    sets = position_sets(max_bits)
    masks = [signed(sum(255 << (8 * p) for p in chosen)) for chosen in sets]
    keys = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])
    postings = distinct.select("fp", F.inline(keys))
    sizes = staged(postings.groupBy("slot", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "posting-sizes")
    short, long = sizes.where(F.col("n") <= list_limit), sizes.where(F.col("n") > list_limit)

    listed = staged(postings.join(short, ["slot", "bytes"]).select("slot", "bytes", "fp"), "postings")
    other = listed.withColumnRenamed("fp", "fp2")
    met = listed.join(other, ["slot", "bytes"]).where("fp < fp2")
    xor = F.col("fp").bitwiseXOR(F.col("fp2"))
    tallied = met.withColumn("shared", shared_bytes(xor)).where(F.col("shared") >= BYTES - max_bits)
    verified = tallied.where(F.bit_count(xor) <= max_bits).select(F.col("fp").alias("u"), F.col("fp2").alias("v"))

    crowded = postings.join(long, ["slot", "bytes"]).select("fp").distinct()
    return verified.union(_neighbour_links(crowded, max_bits)).distinct()


def _neighbour_links(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Exact links of fingerprints in crowded lists: hook those that share a one-bit neighbour."""
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)]
    near = crowded.select("fp", F.explode(F.array(*flips)).alias("near"))
    # At most 65 different fingerprints have the same neighbour, so the set is bounded.
    groups = near.groupBy("near").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if max_bits == 1:  # the neighbour must be a fingerprint itself
        groups = groups.where(F.array_contains("fps", F.col("near")))
        hub = F.col("near")
    else:
        hub = F.array_min("fps")
    return groups.select(hub.alias("u"), F.explode("fps").alias("v")).where("u <> v")


def classes(fps: DataFrame, key: str, max_bits: int = 2, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(fp, component_id): the smallest ``key`` among all rows whose fingerprints are linked.

    ``fps`` has (key, fp) and must be cheap to read twice. Rows with equal
    fingerprints are one class; NULL keys never name a component that has another key.
    """
    # Key order is that of the type; a row without key counts only where no row has one.
    per_fp = staged(fps.groupBy("fp").agg(F.min(key).alias("smallest")), "fingerprints")
    linked = components(links(per_fp.select("fp"), max_bits, list_limit))
    rooted = per_fp.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = staged(rooted, "rooted")
    named = staged(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "components")
    return staged(rooted.join(named, "root").select("fp", "component_id"), "classes")


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fps = staged(fingerprints(docs).select("doc_id", "fp"), "doc-fingerprints")
    found = fps.join(classes(fps, "doc_id"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 2) -> DataFrame:
    """Keep one row of each group of near-duplicates: smallest key, then smallest text digest.

    Rows without a key stay only where their group has no key at all. Of rows that
    repeat key and text one stays; NULL and empty texts count as the same text.
    """
    columns = docs.columns
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    name = F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("~")), digest)
    order = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), name.alias("name"))
    fps = staged(fingerprints(docs.select(order.alias("order"), F.col(text)), text).select("order", "fp"), "dedup-fingerprints")
    # Key and text give the fingerprint, so a name stands for one group.
    kept = staged(classes(fps, "order", max_bits).select(F.col("component_id.name").alias("__name")).distinct(), "kept")
    others = [F.col(f"`{c}`").cast("string") for c in columns if c not in (key, text)]
    rank = F.row_number().over(Window.partitionBy("__name").orderBy(*(others or ["__name"])))
    survivors = docs.withColumn("__name", name).join(kept, "__name").withColumn("__rank", rank)
    return survivors.where("__rank = 1").select(*[F.col(f"`{c}`") for c in columns])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group of near-duplicates stays."""
    return dedup(docs)
