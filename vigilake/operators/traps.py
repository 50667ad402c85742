"""Traps: rules that fire on flagged trace nodes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import schemas
from vigilake.operators.trace import CIRCULAR, CRITICAL, LOW

# Triggers and the node flag each one watches for.
TRIGGERS = {
    "ON_ERROR": CRITICAL,
    "ON_RETRY": CIRCULAR,
    "ON_CONFIDENCE_LOW": LOW,
    "ON_STATE_DRIFT": "FLAG_STATE_DRIFT",
}
ACTIONS = ("ACTION_HALT", "ACTION_SOCRATIC", "ACTION_BRANCH")
HALT = "ACTION_HALT"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.TRAP)


def add(traps: DataFrame, project: str, on: str, action: str, limit: int | None = None, threshold: float | None = None):
    """The table with one more trap of the project, numbered after those it has."""
    if on not in TRIGGERS:
        raise ValueError(f"a trigger is one of {tuple(TRIGGERS)}, got {on!r}")
    if action not in ACTIONS:
        raise ValueError(f"an action is one of {ACTIONS}, got {action!r}")
    mine = traps.where(F.col("project") == project).agg(F.count("*").alias("n"))
    row = mine.select(
        F.lit(project).alias("project"),
        F.concat(F.lit("TRAP-"), (F.col("n") + 1).cast("string")).alias("id"),
        F.lit(on).alias("on"),
        F.lit(action).alias("action"),
        F.lit(limit).cast("int").alias("limit"),
        F.lit(threshold).cast("double").alias("threshold"),
        F.lit("active").alias("status"),
    )
    return traps.unionByName(row)


def of_project(traps: DataFrame, project: str) -> DataFrame:
    return traps.where(F.col("project") == project)


def clear(traps: DataFrame, project: str) -> DataFrame:
    return traps.where(F.col("project") != project)


def active(traps: DataFrame) -> DataFrame:
    """Active traps with the flag they watch; unknown triggers never fire."""
    flags = F.create_map(*[F.lit(x) for pair in TRIGGERS.items() for x in pair])
    watched = traps.where(F.col("status") == "active").withColumn("flag", F.try_element_at(flags, F.col("on")))
    return watched.where(F.col("flag").isNotNull())


def match(nodes: DataFrame, traps: DataFrame) -> DataFrame:
    """One event per node and active trap whose flag the node carries.

    The optimizer sees the size of the trap table: small ones are broadcast, and of
    others the few hot flags are split when the join runs.
    """
    watched = active(traps).select(F.col("id").alias("trap_id"), "on", "action", "flag")
    # A repeated flag on a node still is one event per trap.
    flagged = nodes.withColumn("flag", F.explode(F.array_distinct("audit_flags")))
    return flagged.join(watched, "flag").select(
        "trap_id", "on", "action", "node_id", F.col("type").alias("node_type"), F.col("name").alias("node_name"), "audit_flags"
    )


def summary(events: DataFrame, traps: DataFrame) -> DataFrame:
    """One row: active traps, matches, and whether a halting trap fired."""
    rows = events.select(F.lit(0).alias("trap"), F.lit(1).alias("event"), (F.col("action") == HALT).alias("halt")).unionByName(
        traps.where(F.col("status") == "active").select(F.lit(1).alias("trap"), F.lit(0).alias("event"), F.lit(False).alias("halt"))
    )

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0))

    return rows.agg(
        total("trap").alias("traps"),
        total("event").alias("matches"),
        F.coalesce(F.bool_or("halt"), F.lit(False)).alias("halted"),
    )
