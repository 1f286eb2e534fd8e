"""Run and preparation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.functions.formulas import FORMULAS
from isoqt.operators.moments import pair_corr, pair_n, pair_sums
from isoqt.operators.quantiles import join_groups, percentiles
from isoqt.plans.cells import share0, stratify
from isoqt.plans.strata import per_formula_rows


def run_summary(df: DataFrame, ok="is_usable") -> DataFrame:
    """Processed, usable and failed rows and the success percentage."""
    wide = df.agg(F.count(F.lit(1)).alias("n_processed"), F.count_if(ok).alias("n_usable"))
    return wide.select("n_processed", "n_usable", (F.col("n_processed") - F.col("n_usable")).alias("n_failed"),
                       F.round(share0("n_usable", "n_processed"), 2).alias("success_rate_pct"))


def interval_statistics(df: DataFrame, cols) -> DataFrame:
    """Mean, sample std and median of the intervals, 2 decimals."""
    cols = [c for c in cols if c in df.columns]
    wide = df.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}_std") for c in cols])
    both = join_groups(wide, percentiles(df, {f"{c}_median": (c, 0.5) for c in cols}), [])
    rows = F.array(*[F.struct(F.lit(c).alias("interval"), *[F.round(F.col(f"{c}_{s}"), 2).alias(s) for s in ("mean", "std", "median")]) for c in cols])
    return both.select(F.explode(rows).alias("m")).select("m.*")


def prep_report(df: DataFrame, formulas=FORMULAS, min_n: int = 11) -> DataFrame:
    """r of each correction with rate, overall and by superclass, 4 decimals."""
    wide = stratify(df, {"s": F.col("superclass")}, [("superclass", F.col("s")), ("overall", F.lit("OVERALL"))],
                    [c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)])
    return per_formula_rows(wide, formulas, {"n": pair_n, "r": lambda f: F.round(pair_corr(f, min_n), 4)}, ["kind", "label"])


def demographics(df: DataFrame) -> DataFrame:
    """Mean and std of age and completeness of age and sex."""
    return df.agg(F.round(F.avg("age"), 1).alias("age_mean"), F.round(F.stddev_samp("age"), 1).alias("age_std"),
                  F.round(100.0 * F.count("age") / F.count(F.lit(1)), 1).alias("age_completeness"),
                  F.round(100.0 * F.count("sex") / F.count(F.lit(1)), 1).alias("sex_completeness"),
                  F.count_if(F.col("sex") == 0).alias("n_male"), F.count_if(F.col("sex") == 1).alias("n_female"))
