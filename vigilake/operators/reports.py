"""Questions asked of stored receipts. All read the declared ``receipt`` struct."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def register(receipts: DataFrame, name: str = "receipts") -> DataFrame:
    """Make the receipts' fields queryable by SQL under ``name``."""
    view = receipts.select("receipt.*", *[c for c in ("day", "path", "raw") if c in receipts.columns])
    view.createOrReplaceTempView(name)
    return view


def sql(spark: SparkSession, query: str) -> DataFrame:
    """Ad-hoc SQL over registered receipts: the whole of Spark SQL."""
    return spark.sql(query)


def count(receipts: DataFrame) -> DataFrame:
    return receipts.agg(F.count("*").alias("receipts"))


def volume_by_day(receipts: DataFrame) -> DataFrame:
    day = F.substring("receipt.timestamp", 1, 10)
    return receipts.groupBy(day.alias("day")).agg(F.count("*").alias("receipts")).orderBy(F.desc("day"))


def by_class(receipts: DataFrame) -> DataFrame:
    """How many class entries receipts hold per class (entries, not instances)."""
    classes = receipts.select(F.explode("receipt.data_classes_touched.class").alias("class"))
    return classes.groupBy("class").agg(F.count("*").alias("receipts")).orderBy(F.desc("receipts"), "class")


def by_verdict(receipts: DataFrame) -> DataFrame:
    verdicts = receipts.select(F.explode("receipt.policy_decisions.verdict").alias("verdict"))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("decisions")).orderBy(F.desc("decisions"), "verdict")


def touching(receipts: DataFrame, *prefixes: str) -> DataFrame:
    """One row per receipt and class starting with one of ``prefixes``, by time."""
    wanted = F.filter(
        "receipt.data_classes_touched.class", lambda c: reduce(or_, [c.startswith(p) for p in prefixes])
    )
    # The fields are picked before the classes become rows, so a stored table gives only these.
    rows = receipts.select(
        F.col("receipt.receipt_id").alias("receipt_id"),
        F.col("receipt.timestamp").alias("timestamp"),
        F.col("receipt.tool.model_id").alias("model_id"),
        wanted.alias("wanted"),
        F.col("receipt.policy_decisions.verdict").alias("verdicts"),
        F.col("receipt.prompt.text").alias("prompt_text"),
    )
    listed = rows.select("receipt_id", "timestamp", "model_id", F.explode("wanted").alias("class"), "verdicts", "prompt_text")
    return listed.orderBy("timestamp", "receipt_id")


def having_class(receipts: DataFrame, prefix: str, after: str | None = None) -> DataFrame:
    """Receipts with any class starting with ``prefix``, optionally only after a timestamp."""
    has = F.exists("receipt.data_classes_touched", lambda c: c["class"].startswith(prefix))
    found = receipts.where(has)
    return found if after is None else found.where(F.col("receipt.timestamp") > after)


def enforced_blocks(receipts: DataFrame, since: str | None = None) -> DataFrame:
    """Receipts with at least one enforced block, with the blocking policies."""
    blocking = F.filter(
        "receipt.policy_decisions", lambda d: (d["verdict"] == "blocked") & (d["enforcement_mode"] == "enforced")
    )
    blocks = F.transform(
        blocking, lambda d: F.struct(d["policy_id"].alias("policy_id"), d["matched_classes"].alias("matched_classes"))
    )
    chosen = receipts if since is None else receipts.where(F.col("receipt.timestamp") >= since)
    return chosen.select(
        F.col("receipt.receipt_id").alias("receipt_id"),
        F.col("receipt.timestamp").alias("timestamp"),
        F.col("receipt.actor.user_id").alias("actor"),
        F.col("receipt.prompt.text").alias("prompt"),
        blocks.alias("blocks"),
    ).where(F.size("blocks") > 0)


def held() -> Column:
    """Whether a receipt is on legal hold, from the receipt itself."""
    return F.coalesce(F.col("receipt.retention.legal_hold"), F.lit(False))


def _held(receipts: DataFrame) -> Column:
    """The same from the table's partitions, where it has them."""
    return F.col("held") if "held" in receipts.columns else held()


def prune_candidates(receipts: DataFrame, today: Column) -> DataFrame:
    """Receipts past retain_until and not on legal hold. A listing: nothing is deleted."""
    due = F.col("receipt.retention.retain_until") < F.date_format(today, "yyyy-MM-dd")
    extra = [c for c in ("path",) if c in receipts.columns]
    return receipts.where(due & ~_held(receipts)).select(
        F.col("receipt.receipt_id").alias("receipt_id"),
        F.col("receipt.retention.retain_until").alias("retain_until"),
        *extra,
    )


def older_than(receipts: DataFrame, today: Column, days: int) -> DataFrame:
    """Receipts of days more than ``days`` back, to be pruned by age; legal holds stay.

    Selects on ``day``, so a table partitioned by day reads only the old partitions.
    """
    return receipts.where((F.col("day") < F.date_sub(today, days)) & ~_held(receipts))


def emptied_days(receipts: DataFrame, today: Column, days: int) -> DataFrame:
    """Days that hold nothing once older_than() is pruned, so their partitions can be dropped.

    A table partitioned by day and hold answers from its partitions and row counts; no receipt is read.
    """
    aged = F.col("day") < F.date_sub(today, days)
    held = F.max(_held(receipts).cast("int")).alias("held")
    return receipts.where(aged).groupBy("day").agg(F.count("*").alias("receipts"), held).where("held = 0").drop("held")


def mentioning_resource(receipts: DataFrame, resource_id: str) -> DataFrame:
    return receipts.where(F.exists("receipt.prompt.context_references", lambda r: r["resource_id"] == resource_id))


def mentioning_resource_anywhere(receipts: DataFrame, resource_id: str, raw: str = "raw") -> DataFrame:
    """Like a text search for the compact member ``"resource_id":"<id>"`` in the raw receipt."""
    return receipts.where(F.col(raw).contains(f'"resource_id":"{resource_id}"'))


def records_packet(verified: DataFrame) -> DataFrame:
    """Fields for a public-records review, with the outcome of the integrity check.

    ``verified`` comes from receipts.verify() on a table that also has ``receipt``.
    """
    r = F.col("receipt")
    return verified.select(
        *[r[n].alias(n) for n in ("receipt_id", "timestamp", "schema_version", "actor", "tool", "policy_decisions")],
        r["data_classes_touched"].alias("data_classes_touched"),
        r["prompt"]["text"].alias("prompt_text"),
        r["response"]["text"].alias("response_text"),
        r["evidence"]["receipt_hash"].alias("receipt_hash"),
        r["retention"].alias("retention"),
        F.col("status").alias("integrity"),
    )


def retention_listing(receipts: DataFrame) -> DataFrame:
    return receipts.select(
        F.col("receipt.receipt_id").alias("receipt_id"),
        F.col("receipt.retention.retain_until").alias("retain_until"),
        F.col("receipt.retention.legal_hold").alias("legal_hold"),
    )


def siem_rows(receipts: DataFrame) -> DataFrame:
    """Suggested index fields; the receipt hash stays with the row."""
    r = F.col("receipt")
    return receipts.select(
        r["receipt_id"].alias("receipt_id"),
        r["timestamp"].alias("timestamp"),
        r["actor"]["user_id"].alias("user_id"),
        r["tool"]["tool_id"].alias("tool_id"),
        r["tool"]["model_id"].alias("model_id"),
        r["policy_decisions"]["verdict"].alias("verdicts"),
        r["policy_decisions"]["policy_id"].alias("policy_ids"),
        r["data_classes_touched"]["class"].alias("classes"),
        r["evidence"]["receipt_hash"].alias("receipt_hash"),
    )


def siem_projection(raw_lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse raw receipt lines and project id, actor and verdicts, keeping the parsed receipt."""
    doc = F.try_parse_json(raw)
    decisions = F.try_variant_get(doc, "$.policy_decisions", "array<variant>")
    return raw_lines.select(
        F.try_variant_get(doc, "$.receipt_id", "string").alias("receipt_id"),
        F.try_variant_get(doc, "$.actor.user_id", "string").alias("actor"),
        F.transform(decisions, lambda d: F.try_variant_get(d, "$.verdict", "string")).alias("verdicts"),
        F.to_json(doc).alias("receipt"),
    )
