"""Intermediates that several steps read: written once to the shared folder."""

import uuid

from pyspark.sql import DataFrame

from vigilake.session import checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: evaluated once, exact in size, and independent of any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vigilake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
