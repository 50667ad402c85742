"""Line-oriented logs with exact line numbers, read in splits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import variant as V
from vigilake.functions.spread import prefix_sum
from vigilake.functions.text import strip
from vigilake.operators.trace import hook_fields
from vigilake.sources.files import unpacked


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False, packed: bool = False) -> DataFrame:
    """(file, line_no, line), line numbers from 0 in file order; ``packed`` reads what write_packed_lines() wrote.

    Files are split as usual. Inside a split rows come in file order, so a split
    is numbered locally and shifted by the line counts of the splits before it:
    no file has to fit one task.
    """
    if packed:
        return _packed_lines(spark, path, glob or "*", recursive)
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__at"),
        F.col("value").alias("line"),
    )
    numbered = prefix_sum(lines, ["file"], F.col("__split"), ["__at"], "__n")
    return numbered.select("file", (F.col("__n") - 1).alias("line_no"), "line")


def _packed_lines(spark: SparkSession, path: str | list[str], glob: str, recursive: bool) -> DataFrame:
    """Lines of packed segments. Only segments are numbered, each by its count of lines; a file is as many rows as segments."""
    stored = unpacked(spark, path, glob, recursive, ("at bigint",))
    cut = F.split(F.col("content").cast("string"), "\r\n|\r|\n")
    # What follows the last line end is no line unless there is something.
    held = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    segments = stored.select("file", "at", held.alias("held"))
    placed = prefix_sum(segments, ["file"], F.col("at"), ["at"], "__end", F.size("held"))
    lines = placed.select("file", (F.col("__end") - F.size("held")).alias("__begin"), F.posexplode("held").alias("__pos", "line"))
    return lines.select("file", (F.col("__begin") + F.col("__pos")).alias("line_no"), "line")


def json_objects(lines: DataFrame) -> DataFrame:
    """Lines that hold one JSON object, as VARIANT ``doc``; blank, broken and other lines are skipped."""
    docs = lines.select("file", "line_no", V.parse_strict(strip(F.col("line"))).alias("doc"))
    return docs.where(V.is_object(F.col("doc")))


def hooks(lines: DataFrame) -> DataFrame:
    """Hook events of JSON lines, ready for trace.translate()."""
    docs = json_objects(lines)
    columns = hook_fields(F.col("doc"))
    return docs.select("file", "line_no", *[c.alias(name) for name, c in columns.items()])


def nodes(lines: DataFrame) -> DataFrame:
    """Trace nodes of JSON lines; ``has_provenance`` tells an absent member from a null one."""
    doc = F.col("doc")
    texts = ("timestamp", "node_id", "parent_id", "type", "name", "provenance")
    return json_objects(lines).select(
        "file",
        "line_no",
        *[V.text_at(doc, f"$.{n}").alias(n) for n in texts],
        F.to_json(V.at(doc, "$.inputs")).alias("inputs"),
        F.to_json(V.at(doc, "$.outputs")).alias("outputs"),
        F.transform(V.list_at(doc, "$.audit_flags"), lambda f: V.text_at(f, "$")).alias("audit_flags"),
        F.map_contains_key(V.fields_of(doc), "provenance").alias("has_provenance"),
    )


def session_nodes(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """Nodes of all sessions under ``root/<host>/<session>/``, with host and session_id."""
    read = nodes(read_lines(spark, root, glob, recursive=True))
    parts = F.split("file", "/")
    return read.withColumns(
        {"host": F.try_element_at(parts, F.lit(-3)), "session_id": F.try_element_at(parts, F.lit(-2))}
    )
