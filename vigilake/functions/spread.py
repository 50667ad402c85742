"""Keep work spread over the cluster: input parallelism, hot keys, ordered scans."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys with more rows than this are split into parts of about as many rows.
HOT_ROWS = 100_000
# Rows without a key match nothing and are dealt over so many salts.
NO_KEY_SALTS = 65_536


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only where the scan gives fewer partitions than twice the cores.

    Text work is bound by CPU, and a small input may sit in one row group. Inputs
    of many files keep their scan partitions and are not shuffled.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def prefix_sum(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    out: str,
    value: Column | None = None,
    base: DataFrame | None = None,
    many_totals: bool = False,
) -> DataFrame:
    """Running sum of ``value`` (default: 1, a row number) per ``keys`` in ``order``.

    ``bucket`` must not decrease along ``order``. A NULL key is a key of its own and a NULL
    bucket comes first, so no row is lost. A window over the keys alone would put a hot key's rows into one task; here every task sorts one bucket,
    and only the bucket totals, aggregated before the shuffle, are summed per key.
    ``base`` may give the same rows at an earlier, cheaper stage for the totals.
    ``many_totals``: there are about as many totals as rows, so they are sorted and merged; from the size
    of files whose rows are made in the plan the optimizer would take them for few and send all to the driver.
    """
    value = F.lit(1) if value is None else value
    columns = {"__bucket": bucket, "__value": value.cast("bigint")}
    marked = df.withColumns(columns)
    totals = (df if base is None else base).withColumns(columns).groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    by = [*keys, "__bucket"]
    right = offsets.select(*[F.col(c).alias(f"__of_{c}") for c in by], "__offset")
    right = right.hint("merge") if many_totals else right
    local = marked.join(right, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]).drop(*[f"__of_{c}" for c in by])
    return local.withColumn(out, F.col("__offset") + F.sum("__value").over(within)).drop(
        "__bucket", "__value", "__offset"
    )


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """(hash, parts) of every key with more than ``min_rows`` rows; parts grow with the key's rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("__hot")).count()
    parts = F.ceil(F.col("count") / min_rows).cast("int").alias("__parts")
    return counts.where(F.col("count") > min_rows).select("__hot", parts)


def salted_lookup(
    left: DataFrame, right: DataFrame, key: str, how: str, spread_by: str, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Join a possibly skewed ``left`` to ``right`` (one row per ``key``), inner or left.

    Rows of hot keys are split into parts by a hash of ``spread_by``, rows without a key
    likewise; only the matching ``right`` rows are copied per part. The optimizer decides
    how the table of hot keys is joined: it has one row per ``min_rows`` rows at most.
    """
    hot = hot_keys(left, key, min_rows)

    def flagged(df):
        return df.join(hot, F.xxhash64(key) == F.col("__hot"), "left")

    parts = F.when(F.col(key).isNull(), F.lit(NO_KEY_SALTS)).otherwise(F.coalesce("__parts", F.lit(1)))
    salt = F.pmod(F.xxhash64(spread_by), parts).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    salted = flagged(left).withColumn("__salt", salt).drop("__hot", "__parts")
    copied = flagged(right).withColumn("__salt", F.explode(copies)).drop("__hot", "__parts")
    return salted.join(copied, [key, "__salt"], how).drop("__salt")


def as_of_lookup(left: DataFrame, right: DataFrame, key: str, time: str, bucket, value: str) -> DataFrame:
    """Rows of ``left`` with the ``value`` that the last ``right`` row of their key had before their time.

    Rows without one are left out. ``bucket(time)`` must not decrease with time. Rows of a key are
    ordered within their bucket only; what earlier buckets end with is carried over per
    (key, bucket), of which there are as many as buckets at most, so a key in very many rows is many tasks.
    """
    marked = left.withColumns({"__value": F.lit(None), "__known": F.lit(0), "__bucket": bucket(F.col(time))})
    known = right.where(F.col(value).isNotNull()).select(key, time, F.col(value).alias("__value"), F.lit(1).alias("__known"), bucket(F.col(time)).alias("__bucket"))
    marked = marked.withColumn("__value", F.col("__value").cast(known.schema["__value"].dataType))
    # Of equal times the asking row comes first: only what was known before counts.
    until = Window.partitionBy(key, "__bucket").orderBy(time, "__known").rowsBetween(Window.unboundedPreceding, 0)
    within = marked.unionByName(known, allowMissingColumns=True).withColumn("__last", F.last("__value", ignorenulls=True).over(until))
    ends = known.groupBy(key, "__bucket").agg(F.max_by("__value", time).alias("__end"))
    asked = marked.select(key, "__bucket").distinct().withColumn("__end", F.lit(None).cast(known.schema["__value"].dataType))
    ends = asked.union(ends).groupBy(key, "__bucket").agg(F.first("__end", ignorenulls=True).alias("__end"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "__bucket", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    found = within.where("__known = 0").join(carried, [key, "__bucket"]).withColumn(value, F.coalesce("__last", "__carried"))
    return found.where(F.col(value).isNotNull()).select(*left.columns, value)
