"""Reports over many strata from one scan.

The data is grouped once by the finest combination of its labels (a few hundred cells of counts
and sums). Every stratum, also overlapping ones, is then a sum of cells, so no row is copied per
stratum and the cost does not grow with the number of strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make_cells(df: DataFrame, keys: dict[str, Column], aggregates: list[Column]) -> DataFrame:
    """One row per combination of ``keys``; the aggregates must add up (counts, sums) or be
    named ``min_*`` / ``max_*``."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*aggregates)


def add_up(cells: DataFrame, by, keys) -> DataFrame:
    """Sum cells into coarser groups."""
    values = [c for c in cells.columns if c not in set(keys) | set(by)]
    merge = {"min_": F.min, "max_": F.max}
    return cells.groupBy(*by).agg(*[merge.get(c[:4], F.sum)(c).alias(c) for c in values])


def stratify(df: DataFrame, keys: dict[str, Column], strata: list[tuple[str, Column]],
             aggregates: list[Column]) -> DataFrame:
    """kind, label and the added-up aggregates for every stratum that holds rows.

    ``strata`` pairs a kind with a label expression over the key columns; rows with a null label
    are outside. One kind may appear several times, with overlapping labels.
    """
    cells = make_cells(df, keys, aggregates)
    options = F.array(*[F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"))
                        for kind, label in strata])
    member = F.explode(F.filter(options, lambda s: s["label"].isNotNull()))
    rows = cells.withColumn("__s", member).withColumns({"kind": F.col("__s.kind"), "label": F.col("__s.label")})
    return add_up(rows.drop("__s"), ["kind", "label"], keys)


def with_enough(df: DataFrame, least, n: str = "n") -> DataFrame:
    """Every group stays; ``enough`` says whether it holds at least ``least`` rows (a number or a column)."""
    return df.withColumn("enough", F.col(n) >= least)


def label_if(flag: str, label: str) -> Column:
    """The label where a boolean key holds, else null (outside)."""
    return F.when(F.col(flag), label)


def share(a, b) -> Column:
    """100*a/b, null where b is 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(100.0 * a, b)


def share0(a, b) -> Column:
    """100*a/b, 0 where b is 0."""
    return F.coalesce(share(a, b), F.lit(0.0))


def or_inf(a, b) -> Column:
    """a/b, infinite where b is not positive."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.when(b > 0, F.try_divide(a.cast("double"), b)).otherwise(F.lit(float("inf")))


def mean_of(total: str, n: str) -> Column:
    return F.try_divide(F.col(total), F.col(n))


def value_sums(c, name: str, shift: float = 0.0) -> list[Column]:
    """Count, sum and sum of squares of a value, for means and deviations of added-up groups."""
    v = (F.col(c) if isinstance(c, str) else c) - F.lit(float(shift))
    return [F.count(v).alias(f"{name}__c"), F.sum(v).alias(f"{name}__s"), F.sum(v * v).alias(f"{name}__ss")]


def value_mean(name: str, shift: float = 0.0) -> Column:
    return F.try_divide(F.col(f"{name}__s"), F.col(f"{name}__c")) + F.lit(float(shift))


def value_std(name: str, sample: bool = True) -> Column:
    n, s, ss = F.col(f"{name}__c").cast("double"), F.col(f"{name}__s"), F.col(f"{name}__ss")
    centred = F.greatest(ss - F.try_divide(s * s, n), F.lit(0.0))
    return F.sqrt(F.try_divide(centred, F.when(n > 1, n - 1) if sample else n))
