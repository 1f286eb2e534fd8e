"""Mergeable sums from which means, deviations and correlations follow.

A report scans the data once into *cells* (one row per finest group) of counts and sums; every
coarser group, held-out set and parameter grid is then computed from those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.functions.formulas import FORMULAS, col

# Shifts near the typical value keep the sums of squares well conditioned.
SHIFT_QTC, SHIFT_HR = 400.0, 75.0


def pair_sums(y, x, tag: str, where: Column | None = None, shift_y: float = SHIFT_QTC,
              shift_x: float = SHIFT_HR) -> list[Column]:
    """Six sums of the pairs where both values are known (and ``where`` holds)."""
    use = col(y).isNotNull() & col(x).isNotNull()
    if where is not None:
        use = use & where
    dy = F.when(use, col(y) - F.lit(shift_y))
    dx = F.when(use, col(x) - F.lit(shift_x))
    return [
        F.count(dy).alias(f"{tag}__n"),
        F.sum(dx).alias(f"{tag}__x"), F.sum(dy).alias(f"{tag}__y"),
        F.sum(dx * dx).alias(f"{tag}__xx"), F.sum(dy * dy).alias(f"{tag}__yy"),
        F.sum(dx * dy).alias(f"{tag}__xy"),
    ]


def pair_names(tag: str) -> list[str]:
    return [f"{tag}__{s}" for s in ("n", "x", "y", "xx", "yy", "xy")]


def merged(names) -> list[Column]:
    """Aggregates that add up cell columns."""
    return [F.sum(n).alias(n) for n in names]


def pair_n(tag: str) -> Column:
    return F.coalesce(F.col(f"{tag}__n"), F.lit(0)).cast("bigint")


def pair_corr(tag: str, min_n: int = 2) -> Column:
    """Pearson r from the sums; null below ``min_n`` pairs or without spread."""
    n, x, y, xx, yy, xy = [F.col(c).cast("double") for c in pair_names(tag)]
    sxx, syy, sxy = n * xx - x * x, n * yy - y * y, n * xy - x * y
    return F.when((n >= min_n) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx) / F.sqrt(syy))


def pair_mean_y(tag: str, shift: float = SHIFT_QTC) -> Column:
    return F.try_divide(F.col(f"{tag}__y"), F.col(f"{tag}__n")) + F.lit(shift)


def pair_std_y(tag: str, sample: bool = False) -> Column:
    n, y, yy = F.col(f"{tag}__n").cast("double"), F.col(f"{tag}__y"), F.col(f"{tag}__yy")
    centred = F.greatest(yy - F.try_divide(y * y, n), F.lit(0.0))
    return F.sqrt(F.try_divide(centred, F.when(n > 1, n - 1) if sample else n))


def hr_corr(df: DataFrame, formulas=FORMULAS, by=(), min_n: int = 10, hr: str = "hr_bpm") -> DataFrame:
    """n, r and |r| of each correction against heart rate: one row per group and formula."""
    by = list(by)
    sums = [c for f in formulas for c in pair_sums(f"qtc_{f}", hr, f)]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    rows = F.array(*[F.struct(F.lit(f).alias("formula"), pair_n(f).alias("n"),
                              pair_corr(f, min_n).alias("r")) for f in formulas])
    return (wide.select(*by, "n_rows", F.explode(rows).alias("m"))
            .select(*by, "n_rows", "m.*").withColumn("abs_r", F.abs("r")))
