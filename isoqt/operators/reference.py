"""Data-driven reference standards: polynomial fits and percentile cut-offs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.functions.formulas import col
from isoqt.operators.quantiles import percentiles
from isoqt.session import small_side

# RR is scaled to about [-1, 1] before powers are summed; keeps degree 6 well conditioned.
CENTER, SCALE = 0.85, 0.5
SHIFT_QT = 400.0


def _horner(coefficients: str, degree: int, x: Column) -> Column:
    z = (x - F.lit(CENTER)) / F.lit(SCALE)
    out = F.col(coefficients)[degree]
    for i in range(degree - 1, -1, -1):
        out = out * z + F.col(coefficients)[i]
    return out


def poly_fit(df: DataFrame, degree: int, by=(), x: str = "rr_s", y: str = "qt_ms") -> DataFrame:
    """Least-squares polynomial per group: by..., n, mean_y, coefficients (of scaled x), at_one.

    One scan sums the powers (2*degree+1 of x, degree+1 with y); only those sums, one row per
    group, reach Python, where the normal equations are solved.
    """
    by = list(by)
    z = (F.col(x) - F.lit(CENTER)) / F.lit(SCALE)
    dy = F.col(y) - F.lit(SHIFT_QT)
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, z.alias("z"), dy.alias("dy"))
    power = [F.lit(1.0)]
    for _ in range(2 * degree):
        power.append(power[-1] * F.col("z"))
    sums = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(p) for p in power]).alias("sx"),
        F.array(*[F.sum(p * F.col("dy")) for p in power[:degree + 1]]).alias("sy"))
    one = (1.0 - CENTER) / SCALE

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = []
            for sx, sy in zip(pdf["sx"], pdf["sy"]):
                normal = np.array([[sx[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
                fit = np.linalg.lstsq(normal, np.asarray(sy, dtype=float), rcond=None)[0]
                fit[0] += SHIFT_QT
                fits.append(fit.tolist())
            out = pdf[[*by, "n"]].copy()
            out["mean_y"] = [sy[0] / sx[0] + SHIFT_QT for sx, sy in zip(pdf["sx"], pdf["sy"])]
            out["coefficients"] = fits
            out["at_one"] = [float(np.polynomial.polynomial.polyval(one, f)) for f in fits]
            yield out

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in sums.schema if f.name in by)
    return sums.mapInPandas(
        solve, f"{keys}n bigint, mean_y double, coefficients array<double>, at_one double")


def attach(df: DataFrame, groups: DataFrame, by, how: str = "left") -> DataFrame:
    """Join per-group results back to rows; broadcast only after their size was counted.

    Without groups the result is one aggregated row, which becomes literals.
    """
    by = list(by)
    if not by:
        row = groups.first()
        return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in groups.schema})
    side = small_side(groups)
    renamed = side.select(*[F.col(k).alias(f"__{k}") for k in by], *[c for c in side.columns if c not in by])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
    return df.join(renamed, cond, how).drop(*[f"__{k}" for k in by])


def poly_reference(df: DataFrame, degree: int = 2, center: str = "rr1", by=()) -> DataFrame:
    """Add qt_expected_ms and qtc_reference_ms = QT - p(RR) + p(1), or + mean(QT) for 'mean'."""
    fits = poly_fit(df, degree, by).select(*by, "coefficients", "at_one", "mean_y")
    joined = attach(df, fits, by)
    expected = _horner("coefficients", degree, F.col("rr_s"))
    level = F.col("at_one") if center == "rr1" else F.col("mean_y")
    return joined.withColumns({
        "qt_expected_ms": expected, "qtc_reference_ms": F.col("qt_ms") - expected + level,
    }).drop("coefficients", "at_one", "mean_y")


def stored_or_fitted_reference(df: DataFrame, degree: int = 6, by=("dataset",), stored: str = "qtc_reference_ms",
                               enough: int = 100) -> DataFrame:
    """``qtc_reference``: the stored column in groups with more than ``enough`` stored values, the
    mean-centred fit elsewhere."""
    if stored not in df.columns:
        return poly_reference(df, degree, "mean", by).withColumnRenamed("qtc_reference_ms", "qtc_reference")
    base = df.withColumnRenamed(stored, "__stored")
    fitted = poly_reference(base, degree, "mean", by)
    counts = df.groupBy(*by).agg((F.count(stored) > enough).alias("__use"))
    both = attach(fitted, counts, by)
    chosen = F.when(F.col("__use"), F.col("__stored")).otherwise(F.col("qtc_reference_ms"))
    return both.withColumn("qtc_reference", chosen).drop("__use", "qtc_reference_ms").withColumnRenamed(
        "__stored", stored)


def residual_reference(df: DataFrame, by=("dataset", "sex"), degree: int = 3, min_n: int = 100,
                       percentile: float = 0.975, name: str = "prolonged_residual") -> DataFrame:
    """True where the residual of QT on RR reaches the group's percentile; false elsewhere."""
    by = list(by)
    fits = poly_fit(df, degree, by).select(*by, F.col("n").alias("fit_n"), "coefficients")
    rows = attach(df, fits, by)
    usable = (F.col("fit_n") >= min_n) & F.col("sex").isNotNull()
    rows = rows.withColumn("residual", F.when(usable, F.col("qt_ms") - _horner(
        "coefficients", degree, F.col("rr_s")))).drop("coefficients", "fit_n")
    cuts = percentiles(rows, {"residual_cut": ("residual", percentile)}, by)
    joined = attach(rows, cuts, by)
    flag = F.coalesce(F.col("residual") >= F.col("residual_cut"), F.lit(False))
    return joined.withColumn(name, flag).drop("residual", "residual_cut")


def join_cutoffs(df: DataFrame, cuts: DataFrame, by) -> DataFrame:
    """Attach per-group cut-offs to the rows of the group."""
    return attach(df, cuts, by)


def hr_bin_cutoffs(df: DataFrame, by=("dataset", "sex"), width: int = 5, min_n: int = 50,
                   percentile: float = 0.975) -> DataFrame:
    """QT percentile per group and heart-rate bin of ``width`` bpm holding at least ``min_n``."""
    keys = [*by, "hr_bin"]
    binned = with_hr_bin(df, width).filter(F.col("sex").isNotNull())
    counts = binned.groupBy(*keys).agg(F.count("qt_ms").alias("bin_n")).filter(F.col("bin_n") >= min_n)
    cuts = percentiles(binned, {"qt_cut": ("qt_ms", percentile)}, keys)
    return counts.join(cuts, keys)


def with_hr_bin(df: DataFrame, width: int = 5) -> DataFrame:
    return df.withColumn("hr_bin", F.floor(F.col("hr_bpm") / F.lit(float(width))).cast("bigint") * width)


def hr_bin_reference(df: DataFrame, by=("dataset", "sex"), width: int = 5, min_n: int = 50,
                     percentile: float = 0.975, name: str = "prolonged_hr_bin") -> DataFrame:
    """True where QT reaches the percentile of its heart-rate bin; false in small bins."""
    cuts = hr_bin_cutoffs(df, by, width, min_n, percentile).drop("bin_n")
    joined = join_cutoffs(with_hr_bin(df, width), cuts, [*by, "hr_bin"])
    flag = F.coalesce(F.col("qt_ms") >= F.col("qt_cut"), F.lit(False))
    return joined.withColumn(name, flag).drop("qt_cut", "hr_bin")


def trend(df: DataFrame, y, x="hr_bpm", by=()) -> DataFrame:
    """Least-squares line of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(col(y), col(x)).alias("slope"),
                               F.regr_intercept(col(y), col(x)).alias("intercept"))
