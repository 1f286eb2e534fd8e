"""Contiguous shards of equal bytes: global prefix sums from the totals of range partitions.

Rows are ordered by ``doc_id`` (nulls first), then checksum and size, so ties and repeated rows have a fixed place up
to equal rows. Only (doc_id, size, checksum) moves. Each range partition reports its bytes and rows; the running sums of
those few totals are the partitions' offsets, and a row's place follows inside its partition. A row belongs to the shard
in whose share of the total its middle byte falls, so shards are contiguous and differ from the mean by at most one row.

Defined cases: a null text has 8 bytes and the checksum of the empty text; a null doc_id sorts first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoqt.llm.common import written

OVERHEAD = 8
ORDER = ("doc_id", "text_crc32", "size")


def place(docs: DataFrame, shards: int = 24, partitions: int | None = None) -> DataFrame:
    """Doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32")))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()), *ORDER)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("part").collect()  # one row a partition
    offsets, total, count = [], 0, 0
    for t in totals:
        offsets.append((t["part"], total, count))
        total, count = total + t["bytes"], count + t["rows"]
    starts = spark.createDataFrame(offsets, "part int, bytes_before long, rows_before long")
    inside = Window.partitionBy("part").orderBy(*ORDER)
    placed = (ranged.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).alias("nth"))
              .join(F.broadcast(starts), "part")  # as many rows as partitions
              .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
              .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"int(middle2 * cast({shards} as decimal(38,0)) div {2 * max(total, 1)})")))
              .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("nth") - 1).alias("index")))
    placed = written(placed)
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return (placed.join(F.broadcast(first), "shard")  # one row a shard
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
