"""Helpers of the training-data operators: shared tables, safe column names, text windows."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts (ASCII only), as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine that names none gets its own."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="spark-llm-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


#: Open scratch scopes: the paths and names of the tables each has written; a table without a name is a path alone.
_SCOPES: list[list[tuple[str, str | None]]] = []


def written(df: DataFrame, *sort: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, pruning stays."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append((path, None))
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like ``written``, in as many buckets of ``key`` as a shuffle has partitions: later joins on ``key`` move only their other side.

    ``df`` should come from a shuffle on ``key``, so that every bucket is one file. The table is in the catalog until its scope ends.
    """
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if _SCOPES:
        _SCOPES[-1].append((path, name))
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    return spark.table(name)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those made by ``kept_table``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path, name in _SCOPES.pop():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def kept_table(df: DataFrame) -> DataFrame:
    """Like ``written``, for the result of a ``scratch`` scope."""
    held = _SCOPES.pop()
    try:
        return written(df)
    finally:
        _SCOPES.append(held)


#: Rows of two numbers each that a join may broadcast (some 40 MB); longer tables are shuffled.
SMALL = 500_000


def small_or_shuffled(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` (a written table of few narrow columns) marked for broadcast if it is proven to have ``limit`` rows at most."""
    return F.broadcast(df) if df.count() <= limit else df


#: Bytes that Spark may estimate for a table which it broadcasts by itself, in ``slim_broadcasts``.
SLIM = 1 << 20


@contextmanager
def slim_broadcasts(spark: SparkSession):
    """Queries run inside broadcast, unmarked, only tables of at most ``SLIM`` estimated bytes; lower limits of the session stay.

    A job of very many joins may hold several broadcasts at a time in the driver, each as rows, hash table and blocks. Up to the
    session's limit these would grow with the data. The settings are the session's, so queries of other threads have them meanwhile.
    """
    spark_limit, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (spark_limit, adaptive)}
    least = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if before[adaptive] is not None and not before[adaptive].startswith("-"):
        spark.conf.set(adaptive, str(min(SLIM, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[adaptive]))))
    spark.conf.set(spark_limit, str(min(SLIM, least)))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def words_of(text: Column) -> Column:
    """Array of the words of ``text``: maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with the value computed once: a lambda variable instead of a copied expression."""
    return F.get(F.transform(F.array(value), body), 0)


def where_whole(df: DataFrame, condition: Column) -> DataFrame:
    """Filter that stays where it is: pushed below, a condition of long expressions would be computed once more."""
    return df.withColumn("__nth", F.monotonically_increasing_id()).where(condition & (F.col("__nth") >= 0)).drop("__nth")


def window_hashes(words: Column) -> Column:
    """Hash of every window of eight words, in place order; empty for fewer words.

    Three rounds of pairing (distance one, two, four) cost less than hashing a slice for every place.
    """
    pair = lambda h, k: F.zip_with(F.slice(h, 1, F.size(h) - k), F.slice(h, k + 1, F.size(h) - k), lambda a, b: F.xxhash64(a, b))
    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(pair(h, 1), lambda h2: let(pair(h2, 2), lambda h4: pair(h4, 4))))
    return F.when(F.size(words) >= 8, hashed).otherwise(F.array().cast("array<bigint>"))
