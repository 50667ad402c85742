"""Session settings every job of the package relies on."""

import tempfile

from pyspark.sql import SparkSession

# Needed for right results, so they are set on any session handed in.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON with a repeated key keeps the last one, as JSON readers commonly do.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # State variables, timers and TTL of keyed streams need this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Speed and skew settings for sessions the package builds itself.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    # Plans here hold thousands of expressions; call sites per expression slow building them down.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to an existing session."""
    for key, value in RESULT_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "vigilake", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_CONF, **RESULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster. Only a local session without one gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fresh = tempfile.mkdtemp(prefix="vigilake-ckpt-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh
