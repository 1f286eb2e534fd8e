"""Ranks and running indexes over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoqt.operators.moments import pair_corr
from isoqt.operators.prefix import running_total
from isoqt.operators.quantiles import join_groups
from isoqt.session import written


def running_index(df: DataFrame, by, order: str, name: str = "trace_index", width: int = 1 << 16) -> DataFrame:
    """0-based index of each row in its group by an integer ``order`` column.

    Rows are numbered within ranges of ``width`` order values and the ranges are stacked, so the
    rows of one huge group spread over many tasks.
    """
    by = list(by)
    ranged = df.withColumn("__range", F.floor(F.col(order) / F.lit(width)))
    counts = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order)) - 1
    return (join_groups(ranged.withColumn("__within", within), offsets, [*by, "__range"], "inner")
            .withColumn(name, (F.col("__before") + F.col("__within")).cast("bigint"))
            .drop("__range", "__before", "__within"))


def average_ranks(df: DataFrame, value: str, by=(), weight: str | None = None) -> DataFrame:
    """Average rank (ties share) of every distinct value of a group: by..., value, rank."""
    by = list(by)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    return running_total(counts, by, value, "n", "base").select(*by, value, (F.col("base") + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, by=(), min_n: int = 10) -> DataFrame:
    """Spearman rho per group: Pearson r of average ranks.

    One scan counts equal pairs into weighted rows, which are written once; all else works on them. The two joins
    are on (group, value), so a hot group spreads by value; AQE splits a value that is still too large.
    """
    by = list(by)
    pairs = written(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
                    .groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("w")))
    rank_x = average_ranks(pairs, x, by, "w").withColumnRenamed("rank", "rank_x")
    rank_y = average_ranks(pairs, y, by, "w").withColumnRenamed("rank", "rank_y")
    ranked = join_groups(join_groups(pairs, rank_x, [*by, x], "inner"), rank_y, [*by, y], "inner")
    w, rx, ry = F.col("w").cast("double"), F.col("rank_x"), F.col("rank_y")
    total = ranked.groupBy(*by).agg(
        F.sum("w").alias("s__n"), F.sum(w * rx).alias("s__x"), F.sum(w * ry).alias("s__y"),
        F.sum(w * rx * rx).alias("s__xx"), F.sum(w * ry * ry).alias("s__yy"),
        F.sum(w * rx * ry).alias("s__xy"))
    return total.select(*by, F.col("s__n").cast("bigint").alias("n"), pair_corr("s", min_n).alias("rho"))
