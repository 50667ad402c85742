"""Whole-file sources: receipts, run dumps, task registries, texts to evaluate."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import schemas
from vigilake.functions.spread import spread


def _name_pattern(glob: str) -> str:
    """Regex of the file names that a glob of ``*``, ``?``, ``[...]`` and ``{a,b}`` takes."""
    special = {"*": ".*", "?": ".", "{": "(?:", "}": ")", "[": "[", "]": "]"}
    depth, out = 0, ""
    for c in glob:
        depth += {"{": 1, "}": -1}.get(c, 0)
        out += "|" if c == "," and depth else special.get(c) or (c if c.isalnum() or c == "-" else "\\" + c)
    return f"^(?:{out})$"


def unpacked(spark: SparkSession, path: str | list[str], glob: str, recursive: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """(file, content, columns of ``extra``) of packed files, by the rules for loose ones: no empty and no hidden files, and where
    folders below are not looked into, only those named ``key=value``."""
    paths = [path] if isinstance(path, str) else path
    stored = spark.read.schema(", ".join(("path string, content binary", *extra))).parquet(*paths)
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "/")
    more = stored.columns[2:]
    rows = spread(stored.select(folder.alias("folder"), "path", "content", *more))
    name = F.element_at(F.split("path", "/"), -1)
    shown = ~F.col("path").rlike("(^|/)[._]") & (F.length("content") > 0)
    near = F.lit(True) if recursive else F.col("path").rlike("^([^/]*=[^/]*/)*[^/]*$")
    found = rows.where(shown & near & name.rlike(_name_pattern(glob)))
    return found.select(F.concat("folder", "path").alias("file"), "content", *more)


def _whole(spark: SparkSession, path: str | list[str], glob: str, recursive: bool, packed: bool) -> DataFrame:
    """(file, value) of whole text files."""
    if packed:
        return unpacked(spark, path, glob, recursive).select("file", F.col("content").cast("string").alias("value"))
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


def receipt_files(spark: SparkSession, path: str | list[str], glob: str = "*.json", packed: bool = False) -> DataFrame:
    """Receipt tree: (path, raw), one row per file at any depth whose name fits ``glob``, readable or not."""
    files = _whole(spark, path, glob, True, packed)
    return files.select(F.col("file").alias("path"), F.col("value").alias("raw"))


def receipt_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Receipts stored one per line, the compact form of a receipt tree."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def receipt_table(spark: SparkSession, path: str) -> DataFrame:
    """Stored receipts (receipt, raw, day, held; ``status`` where they were verified on their way in), for reports."""
    stored = spark.read.parquet(path)
    extra = [c for c in ("path", "status") if c in stored.columns]
    # The table is listed once; casts of day and held keep its partitions prunable.
    return stored.select(F.col("receipt").cast(schemas.RECEIPT).alias("receipt"), "raw", *extra, F.col("day").cast("date").alias("day"), F.col("held").cast("boolean").alias("held"))


def with_receipt(raw_receipts: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the declared ``receipt`` struct and ``day``; unreadable receipts get NULLs."""
    typed = raw_receipts.withColumn("receipt", F.from_json(raw, schemas.RECEIPT))
    return typed.withColumn("day", F.to_date(F.substring("receipt.timestamp", 1, 10)))


def run_dumps(spark: SparkSession, path: str | list[str], glob: str = "*.json", packed: bool = False) -> DataFrame:
    """External run dumps: each file is one JSON array of runs; (file, pos, run fields).

    A file that is not such an array stops the job with its name: no run is lost silently.
    """
    # A dump is one JSON value, which no JSON reader can split; its records spread from the explode on.
    files = _whole(spark, path, glob, False, packed)
    runs = F.from_json("value", f"array<{schemas.RUN}>")
    failed = F.raise_error(F.concat(F.lit("not a run dump: "), F.col("file")))
    runs = F.coalesce(runs, failed.cast(f"array<{schemas.RUN}>"))
    exploded = files.select("file", F.posexplode(runs).alias("pos", "run"))
    return exploded.select("file", F.col("pos").cast("bigint").alias("pos"), "run.*")


def registry_tasks(spark: SparkSession, root: str, glob: str = "*.json", packed: bool = False) -> DataFrame:
    """Task files under ``root/<project>/``: (project, file, raw)."""
    files = _whole(spark, root, glob, True, packed)
    parts = F.split("file", "/")
    return files.select(
        F.try_element_at(parts, F.lit(-2)).alias("project"),
        F.try_element_at(parts, F.lit(-1)).alias("file"),
        F.col("value").alias("raw"),
    )


def text_files(spark: SparkSession, path: str | list[str], phase: str = "prompt", packed: bool = False) -> DataFrame:
    """Whole text files as exchanges of one phase, for a dry run."""
    files = _whole(spark, path, "*", False, packed)
    return files.select(F.col("file").alias("exchange_id"), F.col("value").alias(phase))


def policy_files(spark: SparkSession, path: str, glob: str = "*.{yaml,yml}", packed: bool = False) -> DataFrame:
    """(directory, file, content) of the policy files of ``path`` and of every directory below it.

    Each directory is a set of its own, as if it were loaded alone: its files in the order of their names,
    without those of directories below. Spark reads no files of zero bytes, nor names that start with a
    dot or an underscore: such a file is no row here, where load_policies() would refuse its directory.
    """
    if packed:
        found = unpacked(spark, path, glob, True)
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        found = found.select(F.col("path").alias("file"), "content")
    name = F.element_at(F.split("file", "/"), -1)
    directory = F.regexp_replace("file", "/[^/]*$", "")
    return found.select(directory.alias("directory"), name.alias("file"), "content")
