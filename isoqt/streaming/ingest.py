"""Resumable ingestion of record files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from isoqt.sources.tables import first_existing, route_errors


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Files appearing in a folder, a bounded number per batch."""
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path))


def dedup_stream(df: DataFrame, keys=("ecg_id",)) -> DataFrame:
    """First row per key, whatever its age: archives arrive in any order, so no watermark drops late rows.

    Every key is kept as state; ``ingest_stream`` with ``keys`` needs none and asks its sinks instead.
    """
    return df.dropDuplicates(list(keys))


def unseen(batch: DataFrame, batch_id: int, keys, folders) -> DataFrame:
    """One row per key of a batch, without the keys that earlier batches wrote to ``folders``.

    Only the key columns of the sinks are read; null keys are equal to each other.
    """
    spark, rows = batch.sparkSession, batch.dropDuplicates(list(keys))
    for folder in folders:
        try:
            first_existing(spark, f"{folder}/batch_id=*/*.parquet")
        except FileNotFoundError:
            continue
        done = spark.read.parquet(folder).filter(F.col("batch_id") < batch_id).select(*[F.col(k).alias(f"__done_{k}") for k in keys]).distinct()
        rows = rows.join(done, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__done_{k}")) for k in keys]), "left_anti")
    return rows


def ingest_stream(rows: DataFrame, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None,
                  reason=None, errors: str | None = None, once: bool = True, keys=None, metrics: str | None = None) -> StreamingQuery:
    """Process every arriving row exactly once across restarts.

    The checkpoint remembers the files done. Each batch writes to its own folder, replacing what
    an interrupted attempt left there, so a retried batch leaves no duplicates. Rows with a
    ``reason`` go to ``errors`` as (ecg_id, error). With ``keys`` (columns of the rows and of all sinks) a key that an
    earlier batch wrote is left out. ``metrics`` gets one row per batch: rows seen and failed, for runs of any length.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        if keys:
            batch = unseen(batch, batch_id, keys, [sink, errors] if errors else [sink])
        if reason is None and metrics is None:
            out = process(batch) if process else batch
            out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
            return
        batch.persist()  # several sinks read it; lost blocks are computed again
        try:
            rows = process(batch) if process else batch
            if metrics:
                failed = F.count_if(reason.isNotNull()) if reason is not None else F.lit(0).cast("bigint")
                rows.agg(F.count(F.lit(1)).alias("seen"), failed.alias("failed")).write.mode("overwrite").parquet(f"{metrics}/batch_id={batch_id}")
            if reason is None:
                rows.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
                return
            out, bad = route_errors(rows, reason)
            out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
            bad.write.mode("overwrite").parquet(f"{errors}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = (rows.observe("ingest", F.count(F.lit(1)).alias("seen"),
                           F.count(F.when(reason.isNotNull(), 1) if reason is not None else F.lit(None)).alias("failed"))
              .writeStream.foreachBatch(save).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Seen, processed, failed and rate of the last batches, which a running query remembers; ``metrics`` keeps all."""
    out = []
    for p in query.recentProgress:
        metrics = p.observedMetrics.get("ingest") if p.observedMetrics else None
        seen = metrics["seen"] if metrics is not None else p.numInputRows
        failed = metrics["failed"] if metrics is not None else 0
        out.append({"batch_id": p.batchId, "seen": seen, "processed": seen - failed, "failed": failed,
                    "rows_per_second": p.processedRowsPerSecond})
    return out


class ProgressLog(StreamingQueryListener):
    """Keeps running totals of all batches; add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.seen = self.failed = self.batches = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get("ingest")
        if metrics is not None:
            self.seen += metrics["seen"]
            self.failed += metrics["failed"]
            self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
