"""What several operators share: written intermediates, graph components, hashing of ids."""

import ctypes
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage without depending on any executor, evaluates ``df`` once, and
    gives the optimizer exact sizes, so that it broadcasts what is small and can
    split skewed partitions of what is not.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/vigilake-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(key: Column, parts: int) -> Column:
    """crc32 of an id's decimal text, modulo ``parts``; NULL for a NULL id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint); root is the smallest node reachable.

    Alternating large-star and small-star: each round every node hooks its larger,
    then its smaller neighbours to its smallest one, until nothing changes. Minima
    are aggregated before each shuffle and joined from written tables, where the
    optimizer can split a hub; only a count and a checksum reach the driver.
    ``limit`` ends a run that does not converge with an error, never with a wrong answer.
    """
    down = staged(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _state(down)
    for _ in range(limit):
        if seen[0] == 0:
            break
        both = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "hooked")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = staged(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = _state(down)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not stable after {limit} rounds")
    leaves = down.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def numbered(df: DataFrame, out: str, name: str) -> DataFrame:
    """``df`` written once, with dense numbers from 0 in column ``out``.

    Only one row per written partition takes part in the running sum that makes them dense.
    """
    first = df.select("*", F.monotonically_increasing_id().alias("__at"))
    marked = staged(first, name).withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    # One row per partition of the table: small whatever the table's size.
    return marked.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def int_bytes(values) -> bytes:
    """A numpy array as little-endian 32-bit integers, the form in which shards hold long arrays."""
    return values.astype("<i4").tobytes()


def packed(values, kind: str) -> bytes:
    """A numpy array as a Zstandard frame of little-endian numbers of ``kind``, to be written and shuffled."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpacked(cell, kind: str):
    """The array of a cell that packed() made."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), kind)


def small(batches, column: str, size: int = 4 << 20):
    """Frames cut into parts of about ``size`` bytes of ``column``; memory that is free goes back between them.

    A Python worker serves one stage after the other and otherwise keeps the most it ever held.
    """
    for batch in batches:
        ends, at = np.cumsum([len(x) for x in batch[column]]), 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.iloc[at:to]
            at = to
            trim()


def trim() -> None:
    """Hand free memory back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
