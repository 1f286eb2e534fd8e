"""Session settings, durable intermediate results and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table (in rows) that is ever broadcast after counting it.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app: str = "isoqt", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (AQE, UTC, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site capture makes every Column operation about ten times slower to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a local session may fall back."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-isoqt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Write a (small) intermediate result to the checkpoint folder and read it from there.

    The copy is on shared storage, so it outlives any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, partition_by=()) -> DataFrame:
    """Write a large intermediate table once, as Parquet in the shared folder, and read it back.

    For tables that many reports scan: unlike a checkpoint the copy keeps column pruning and
    filter pushdown.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    # The written types: partition folders alone would turn the text '01' into the number 1.
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def small_side(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Settle ``df``, count it, and mark it for broadcast only if it is small enough.

    Beyond the limit the plain table is returned and the join shuffles (with AQE skew handling).
    """
    settled = settle(df)
    return F.broadcast(settled) if settled.count() <= limit else settled
