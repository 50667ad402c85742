"""Task registry: snapshot and substring search over whole task files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions import variant as V


def snapshot(tasks: DataFrame, project: str) -> DataFrame:
    """Readable tasks of a project in file-name order; ``tasks`` has project, file and raw."""
    doc = V.parse_strict(F.col("raw"))
    return (
        tasks.where(F.col("project") == project)
        .select("project", "file", F.to_json(doc).alias("task"))
        .where("task is not null")
        .orderBy("file")
    )


def search(tasks: DataFrame, query: str, raw: str = "raw") -> DataFrame:
    """Tasks whose text holds ``query``, upper and lower case alike; unreadable ones come back as {}."""
    found = tasks.where(F.contains(F.lower(raw), F.lit(query.lower())))
    return found.withColumn("task", F.coalesce(F.to_json(V.parse_strict(F.col(raw))), F.lit("{}")))
