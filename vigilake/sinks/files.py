"""Sinks. The commit protocol keeps readers from seeing partial files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators import reports
from vigilake.operators.reports import held

RECEIPT_PARTITIONS = ("day", "held")


def by_day(rows: DataFrame) -> DataFrame:
    """Rows brought together by day before they are written.

    Else every task writes a file for each of its days, and files grow with days times tasks. A busy day
    is split by its size into several tasks, and days of few rows share one.
    """
    return rows.hint("rebalance", F.col("day"))


def write_receipts(built: DataFrame, path: str, mode: str = "append") -> None:
    """Canonical receipt lines, one directory per day."""
    by_day(built.select("day", F.col("raw").alias("value"))).write.mode(mode).partitionBy("day").text(path)


def write_receipt_table(built: DataFrame, path: str, mode: str = "append") -> None:
    """Typed receipts with their raw text as Parquet for reports, partitioned by day and legal hold.

    Both partition columns answer the pruning questions without a look into the receipts.
    """
    by_day(built.select("receipt", "raw", "day", held().alias("held"))).write.mode(mode).partitionBy(*RECEIPT_PARTITIONS).parquet(path)


# A reader holds up to 4,096 rows of a row group at once; rows here are whole files, so groups are small.
PACKED_GROUP = {"parquet.block.size": 1 << 20}


def write_packed(small: DataFrame, path: str, mode: str = "append") -> None:
    """Many small files (``path`` below the folder, ``content``) packed into a few: a row each, in Parquet.

    A file of its own costs a store several calls when it is written, listed and read, however small it is.
    The sources of whole files read a packed folder with ``packed=True``.
    """
    small.select("path", F.col("content").cast("binary").alias("content")).write.options(**PACKED_GROUP).mode(mode).parquet(path)


# Lines of a packed log that share a row lie in one range of so many places.
SEGMENT = 16_384


def write_packed_lines(lines: DataFrame, path: str, order: tuple[str, ...], mode: str = "append") -> None:
    """Many logs (``path`` below the folder, ``value``) packed: a row for each segment of a log, in Parquet.

    Lines follow each other by ``order``; its first column is a place, and each range of SEGMENT places is a
    segment, so a log of any length is many rows. read_lines() takes such a folder with ``packed=True``.
    """
    at = F.floor(F.col(order[0]) / SEGMENT).alias("at")
    line = F.struct(*order, F.coalesce("value", F.lit("")).alias("value"))
    segments = lines.groupBy("path", at).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    content = F.concat(F.array_join(F.col("lines.value"), "\n"), F.lit("\n")).cast("binary")
    segments.select("path", content.alias("content"), "at").write.options(**PACKED_GROUP).mode(mode).parquet(path)


def write_nodes(nodes: DataFrame, path: str, mode: str = "append", by: tuple[str, ...] = ()) -> None:
    """Trace nodes as JSON lines with their nulls; inputs and outputs as JSON, not as text.

    ``by`` names columns that become folders, such as host and session.
    """
    members = F.struct(
        "timestamp", "node_id", "parent_id", "type", "name",
        F.try_parse_json("inputs").alias("inputs"), F.try_parse_json("outputs").alias("outputs"),
        "provenance", "audit_flags",
    )
    line = F.to_json(members, {"ignoreNullFields": "false"})
    nodes.select(*by, line.alias("value")).write.mode(mode).partitionBy(*by).text(path)


def write_node_table(nodes: DataFrame, path: str, mode: str = "append") -> None:
    """Trace nodes as Parquet, the form in which filters, parents, edges and traps read them."""
    nodes.write.mode(mode).parquet(path)


def write_trap_events(events: DataFrame, path: str, mode: str = "append") -> None:
    members = F.struct("trap_id", "on", "action", "node_id", "node_type", "node_name", "audit_flags")
    events.select(F.to_json(members, {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_siem(receipts: DataFrame, path: str, mode: str = "append") -> None:
    """One line per receipt: the index fields, with the receipt hash."""
    rows = reports.siem_rows(receipts)
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.select(line.alias("value")).write.mode(mode).text(path)
