"""Manuscript tables over rows prepared with ``prepare`` (constant -125, inclusive calls)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.functions.classify import manuscript_age_group, manuscript_hr_zone, prolonged, qtc_threshold
from isoqt.functions.formulas import FORMULAS, all_qtc
from isoqt.operators.bootstrap import bootstrap_r, bootstrap_weighted_r
from isoqt.operators.confusion import confusion_counts, confusion_metrics, per_formula
from isoqt.operators.moments import pair_corr, pair_sums
from isoqt.operators.reference import attach, hr_bin_reference, residual_reference, stored_or_fitted_reference
from isoqt.operators.schema import top_n
from isoqt.plans.cells import add_up, share, share0
from isoqt.plans.strata import per_formula_rows


def prepare(df: DataFrame, degree: int = 6, preset: str = "c125") -> DataFrame:
    """Corrections, threshold, inclusive calls and the per-dataset polynomial reference."""
    rows = stored_or_fitted_reference(all_qtc(df, preset), degree)
    calls = {f"pred_{f}": prolonged(f"qtc_{f}", inclusive=True) for f in FORMULAS}
    return rows.withColumns({"threshold": qtc_threshold("sex"), **calls, "truth": prolonged("qtc_reference", inclusive=True)})


# ---- weighted |r| -------------------------------------------------------------------------
def dataset_cells(df: DataFrame, formulas=FORMULAS, by=("dataset",)) -> DataFrame:
    """Sums for r and confusion counts of every formula per dataset: the base of most tables."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("truth")).alias("n_normal"),
                               *[c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)],
                               *[c for f in formulas for c in confusion_counts("truth", f"pred_{f}", f"{f}_")])


def weighted_r(cells: DataFrame, formulas=FORMULAS, min_n: int = 10) -> DataFrame:
    """|r| weighted by dataset size; datasets without an r add no weight."""
    rows = per_formula_rows(cells, formulas, {"abs_r": lambda f: F.abs(pair_corr(f, min_n))}, ["n_rows"])
    return rows.filter(F.col("abs_r").isNotNull()).groupBy("formula").agg(
        (F.sum(F.col("abs_r") * F.col("n_rows")) / F.sum("n_rows")).alias("weighted_r"))


def population_weighted_r(df: DataFrame, formulas=FORMULAS, min_n: int = 10) -> DataFrame:
    """Population-weighted |r(QTc, HR)| per formula over the datasets."""
    cells = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), *[c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)])
    return weighted_r(cells, formulas, min_n)


def table2(df: DataFrame, formulas=FORMULAS, replicates: int = 0) -> DataFrame:
    """Weighted |r|, false-positive rate on reference normals, rank and ratio to the base formula."""
    rows = per_formula_rows(dataset_cells(df, formulas), formulas, {
        "abs_r": lambda f: F.abs(pair_corr(f, 10)), "fp": lambda f: F.col(f"{f}_fp")}, ["n_rows", "n_normal"])
    weight = F.when(F.col("abs_r").isNotNull(), F.col("n_rows"))
    out = rows.groupBy("formula").agg(
        F.round(F.sum(F.col("abs_r") * weight) / F.sum(weight), 3).alias("weighted_r"),
        F.round(share0(F.sum("fp"), F.sum("n_normal")), 2).alias("fp_rate_pct"))
    if replicates:
        ci = bootstrap_weighted_r(df, formulas, replicates=replicates)
        out = out.join(ci.select("formula", *[F.round(c, 3).alias(c) for c in ("ci_low", "ci_high")]), "formula")
    return top_n(out, "weighted_r")


def _strata_cells(df: DataFrame, formulas) -> DataFrame:
    return df.withColumns({"zone": manuscript_hr_zone(), "age_group": manuscript_age_group()}).groupBy("dataset", "zone", "age_group").agg(
        F.count(F.lit(1)).alias("n_rows"), *[c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)],
        *[c for f in formulas for c in confusion_counts("truth", f"pred_{f}", f"{f}_")])


def table3(df: DataFrame, formulas=FORMULAS, min_n: int = 30, min_corr: int = 10) -> DataFrame:
    """Size-weighted |r| per rate zone and age group; small dataset-strata are skipped, an
    undefined r still counts in the size."""
    member = F.explode(F.array_compact(F.array(F.concat(F.lit("HR "), F.col("zone")), F.concat(F.lit("Age "), F.col("age_group")))))
    cells = add_up(_strata_cells(df, formulas).withColumn("stratum", member), ["dataset", "stratum"], ["zone", "age_group"])
    kept = cells.filter(F.col("n_rows") >= min_n)
    out = kept.groupBy("stratum").agg(F.sum("n_rows").alias("n"), *[
        F.round(F.sum(F.coalesce(F.abs(pair_corr(f, min_corr)), F.lit(0.0)) * F.col("n_rows")) / F.sum("n_rows"), 3).alias(f"abs_r_{f}") for f in formulas])
    return out.withColumn("improvement", F.when(F.col("abs_r_inverse_rr") > 0, F.col("abs_r_bazett") / F.col("abs_r_inverse_rr")))


def table4(df: DataFrame, formulas=FORMULAS, min_n: int = 10) -> DataFrame:
    """False-positive, false-negative and misclassified share by age group, rate zone and formula."""
    cells = add_up(_strata_cells(df, formulas), ["age_group", "zone"], ["dataset"]).filter(
        F.col("age_group").isNotNull() & F.col("zone").isNotNull() & (F.col("n_rows") >= min_n))
    return per_formula_rows(cells, formulas, {
        "fp_pct": lambda f: F.round(share(f"{f}_fp", "n_rows"), 2), "fn_pct": lambda f: F.round(share(f"{f}_fn", "n_rows"), 2),
        "mc_pct": lambda f: F.round(share(F.col(f"{f}_fp") + F.col(f"{f}_fn"), "n_rows"), 2)}, ["age_group", "zone", "n_rows"]).withColumnRenamed("n_rows", "n")


def table4_pivot(report: DataFrame, formula: str) -> DataFrame:
    """Misclassified share of one formula, age groups by rate zones."""
    return report.filter(F.col("formula") == formula).groupBy("age_group").pivot("zone", ["Bradycardia", "Normal", "Tachycardia"]).agg(F.first("mc_pct"))


def table5(df: DataFrame, formulas=FORMULAS, replicates: int = 0, key: str = "ecg_id") -> DataFrame:
    """One external dataset: |r|, confusion, rates and rank."""
    cells = df.agg(F.count(F.lit(1)).alias("n_rows"), *[c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)],
                   *[c for f in formulas for c in confusion_counts("truth", f"pred_{f}", f"{f}_")])
    r = per_formula_rows(cells, formulas, {"abs_r": lambda f: F.round(F.abs(pair_corr(f, 10)), 3)}, ["n_rows"])
    m = confusion_metrics(per_formula(cells, formulas), None)
    out = r.join(m.select("formula", F.round(100 * F.col("sensitivity"), 1).alias("sensitivity_pct"), F.round(100 * F.col("specificity"), 1).alias("specificity_pct"),
                          "fp", "fn", F.round(100 * F.col("fpr"), 1).alias("fp_rate_pct")), "formula")
    if replicates:
        ci = bootstrap_r(df, formulas, (), key, replicates)
        out = out.join(ci.select("formula", *[F.round(c, 3).alias(c) for c in ("ci_low", "ci_high")]), "formula")
    return top_n(out, "abs_r")


def table6(df: DataFrame, formulas=FORMULAS, near: float = 10.0) -> DataFrame:
    """False positives and negatives by distance from the threshold."""
    spread = df.agg(*[F.stddev_pop(f"qtc_{f}").alias(f"sd_{f}") for f in formulas])
    rows = attach(df, spread, ())
    aggs = []
    for f in formulas:
        fp, fn = ~F.col("truth") & F.col(f"pred_{f}"), F.col("truth") & ~F.col(f"pred_{f}")
        gap = F.abs(F.col(f"qtc_{f}") - F.col("threshold"))
        for word, miss in (("fp", fp), ("fn", fn)):
            aggs += [F.count_if(miss & (gap <= near)).alias(f"{f}_{word}_near"), F.count_if(miss & (gap > near)).alias(f"{f}_{word}_far"),
                     F.count_if(miss & (gap > F.col(f"sd_{f}"))).alias(f"{f}_{word}_1sd"), F.count_if(miss).alias(f"{f}_{word}_total")]
    names = [f"{w}_{x}" for w in ("fp", "fn") for x in ("near", "far", "1sd", "total")]
    out = per_formula_rows(rows.agg(*aggs), formulas, {x: (lambda f, x=x: F.col(f"{f}_{x}")) for x in names}, [])
    return out.withColumn("significant", F.col("fp_far") + F.col("fn_far"))


def table8(df: DataFrame, formulas=FORMULAS) -> DataFrame:
    """False-positive rate and sensitivity per dataset, reference standard and formula."""
    rows = residual_reference(hr_bin_reference(df))
    truths = {"Polynomial": "truth", "HR-Bin Percentile": "prolonged_hr_bin", "QT-RR Residuals": "prolonged_residual"}
    wide = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("size"), *[
        c for i, t in enumerate(truths.values()) for f in formulas for c in confusion_counts(t, f"pred_{f}", f"t{i}_{f}_")])
    parts = F.array(*[F.struct(F.lit(name).alias("reference"), F.lit(f).alias("formula"), *[F.col(f"t{i}_{f}_{x}").alias(x) for x in ("tp", "fp", "tn", "fn")])
                      for i, name in enumerate(truths) for f in formulas])
    long = wide.select("dataset", "size", F.explode(parts).alias("m")).select("dataset", "size", "m.*")
    return confusion_metrics(long, None).select("dataset", "reference", "formula", "size", F.round(100 * F.col("fpr"), 1).alias("fp_pct"),
                                                F.round(100 * F.col("sensitivity"), 1).alias("sensitivity_pct"))


def table8_weighted(report: DataFrame) -> DataFrame:
    """Size-weighted means of the reference comparison over datasets with a known rate."""
    known = report.filter(F.col("fp_pct").isNotNull())
    return known.groupBy("reference", "formula").agg(
        (F.sum(F.col("fp_pct") * F.col("size")) / F.sum("size")).alias("fp_pct"), (F.sum(F.col("sensitivity_pct") * F.col("size")) / F.sum("size")).alias("sensitivity_pct"))


def headline(df: DataFrame) -> DataFrame:
    """Key figures: weighted |r| and ratios, false positives, reduction, number needed to screen,
    accuracy of both formulas."""
    names = ("inverse_rr", "bazett", "fridericia")
    cells = dataset_cells(df, names)
    weighted = []
    for f in names:
        a = F.abs(pair_corr(f, 10))
        weighted.append((F.sum(a * F.col("n_rows")) / F.sum(F.when(a.isNotNull(), F.col("n_rows")))).alias(f"r_{f}"))
    counts = [F.sum(c).alias(c) for c in ("n_rows", "n_normal", *[f"{f}_{x}" for f in ("inverse_rr", "bazett") for x in ("tp", "fp", "tn", "fn")])]
    both = cells.agg(*weighted, *counts)
    for f in ("inverse_rr", "bazett"):
        both = confusion_metrics(both, None, f"{f}_")
    gain = F.col("bazett_fp") - F.col("inverse_rr_fp")
    return both.select(
        F.col("n_rows").alias("n"), *[f"r_{f}" for f in names], F.try_divide("r_bazett", "r_inverse_rr").alias("r_improvement"),
        F.try_divide("r_fridericia", "r_bazett").alias("fridericia_vs_bazett"), F.col("bazett_fp").alias("fp_bazett"), F.col("inverse_rr_fp").alias("fp_inverse_rr"),
        share("bazett_fp", "n_normal").alias("fp_pct_bazett"), share("inverse_rr_fp", "n_normal").alias("fp_pct_inverse_rr"),
        F.try_divide(F.col("bazett_fp").cast("double"), "inverse_rr_fp").alias("fp_reduction"), F.when(gain > 0, F.col("n_rows") / gain).alias("nnt"),
        *[F.col(f"{f}_{m}").alias(f"{m}_{f}") for f in ("inverse_rr", "bazett") for m in ("sensitivity", "specificity", "ppv", "npv", "accuracy")])


def per_dataset(df: DataFrame) -> DataFrame:
    """Size, |r| of three formulas and false-positive rate of two per dataset."""
    names = ("inverse_rr", "bazett", "fridericia")
    cells = dataset_cells(df, names)
    return cells.select("dataset", F.col("n_rows").alias("n"), *[F.round(F.abs(pair_corr(f, 10)), 4).alias(f"abs_r_{f}") for f in names],
                        *[F.round(share0(f"{f}_fp", "n_normal"), 2).alias(f"fp_pct_{f}") for f in ("inverse_rr", "bazett")])
