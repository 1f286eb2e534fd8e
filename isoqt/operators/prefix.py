"""Running totals inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoqt.operators.quantiles import join_groups
from isoqt.session import written


def running_total(df: DataFrame, by, order: str, amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the earlier rows (by ``order``) of the group, 0 for the first.

    The rows are dealt into ranges of (group, order). A range's sums for its groups are few rows; their running sums are
    the offsets that a range adds to what it counts itself, so the rows of one huge group spread over many tasks.
    """
    by = list(by)
    ranged = written(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.unboundedPreceding, -1
    sums = ranged.groupBy("__part", *by).agg(F.sum(amount).alias("__sum"))
    offsets = sums.select("__part", *by, F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(*earlier)), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy("__part", *by).orderBy(order).rowsBetween(*earlier)), F.lit(0))
    return (join_groups(ranged.withColumn("__within", within), offsets, ["__part", *by], "inner")
            .withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__before", "__within"))
