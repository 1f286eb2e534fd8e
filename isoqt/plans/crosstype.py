"""Rate independence per dataset and per dataset type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.operators.moments import pair_corr, pair_n, pair_sums
from isoqt.operators.reference import attach
from isoqt.plans.cells import add_up
from isoqt.plans.strata import per_formula_rows

FORMULAS = ("inverse_rr", "bazett", "fridericia")


def with_type(df: DataFrame, types: DataFrame) -> DataFrame:
    """Attach the type of each dataset (a counted dimension table); unlisted ones are UNKNOWN."""
    joined = attach(df, types.select("dataset", "dataset_type"), ["dataset"])
    return joined.withColumn("dataset_type", F.coalesce("dataset_type", F.lit("UNKNOWN")))


def cross_type(df: DataFrame, types: DataFrame, formulas=FORMULAS) -> DataFrame:
    """n, r and |r| per dataset and per type; the type is joined to the per-dataset sums."""
    cells = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), *[c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)])
    typed = with_type(cells, types)
    groups = F.array(F.struct(F.lit("dataset").alias("kind"), F.col("dataset").alias("label")),
                     F.struct(F.lit("type").alias("kind"), F.when(F.col("dataset_type") != "UNKNOWN", F.col("dataset_type")).alias("label")))
    rows = typed.withColumn("g", F.explode(groups)).withColumns({"kind": F.col("g.kind"), "label": F.col("g.label")}).drop("g")
    both = add_up(rows.filter(F.col("label").isNotNull()), ["kind", "label"], ["dataset", "dataset_type"])
    out = per_formula_rows(both, formulas, {"n": pair_n, "r": pair_corr}, ["kind", "label"])
    return out.withColumn("abs_r", F.abs("r"))


def cross_type_verdict(report: DataFrame, coefficients: DataFrame | None = None, target_r: float = 0.05, max_dk: float = 10, max_dc: float = 20) -> DataFrame:
    """Screening against clinical r, the external arbiter, coefficient stability and the verdict.

    ``coefficients`` holds (domain, k, c) rows of formulas found per domain; without both domains
    stability counts as given.
    """
    def r(kind, c="r"):
        return F.max(F.when((F.col("kind") == "type") & (F.col("label") == kind) & (F.col("formula") == "inverse_rr"), F.col(c)))
    wide = report.agg(r("SCREENING").alias("r_screening"), r("CLINICAL").alias("r_clinical"), r("EXTERNAL").alias("r_external"))
    wide = wide.withColumns({"delta_r": F.abs(F.col("r_screening") - F.col("r_clinical")),
                             "max_abs_r": F.greatest(F.abs("r_screening"), F.abs("r_clinical"))})
    if coefficients is None:
        wide = wide.withColumns({n: F.lit(None).cast("double") for n in ("delta_k", "delta_c")})
    else:
        def v(domain, c):
            return F.max(F.when(F.col("domain") == domain, F.col(c)))
        delta = coefficients.agg(F.abs(v("screening", "k") - v("clinical", "k")).alias("delta_k"), F.abs(v("screening", "c") - v("clinical", "c")).alias("delta_c"))
        wide = wide.withColumn("__one", F.lit(1)).join(delta.withColumn("__one", F.lit(1)), "__one").drop("__one")
    stable = F.coalesce(F.col("delta_k") < max_dk, F.lit(True)) & F.coalesce(F.col("delta_c") < max_dc, F.lit(True))
    return wide.withColumns({"passes_r_threshold": F.coalesce(F.col("max_abs_r") < target_r, F.lit(False)), "coefficients_stable": stable})
