"""Reclassification, gold-standard and cascade reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoqt.fixed_values import AGE_RANGES, HR_RANGES
from isoqt.functions.classify import categorize, classify3, prolonged
from isoqt.functions.formulas import FORMULAS
from isoqt.operators.confusion import (confusion_counts, confusion_metrics, matrix_counts, matrix_totals,
                                       per_formula, ratio)
from isoqt.operators.moments import pair_corr, pair_sums
from isoqt.plans.cells import add_up, or_inf, share0, stratify, with_enough
from isoqt.plans.strata import sex_label


def with_classes(df: DataFrame, formulas=FORMULAS) -> DataFrame:
    """Add the 3-level class of each correction."""
    return df.withColumns({f"class_{f}": classify3(f"qtc_{f}") for f in formulas})


def reclass_by(df: DataFrame, a="class_bazett", b="class_inverse_rr", min_n: int = 100) -> DataFrame:
    """Reclassification matrix by rate, sex and age category; ``enough``: at least ``min_n`` rows."""
    keys = {"hr_category": categorize("hr_bpm", HR_RANGES), "sex_label": sex_label(), "age_category": categorize("age", AGE_RANGES)}
    known = {k: F.when(F.col(k) != "unknown", F.col(k)) for k in ("hr_category", "age_category")}
    strata = [("hr", known["hr_category"]), ("sex", F.col("sex_label")), ("age", known["age_category"])]
    wide = stratify(df, keys, strata, [F.count(F.lit(1)).alias("n"), *matrix_counts(a, b)])
    return matrix_totals(with_enough(wide, min_n))


def impact_columns(df: DataFrame) -> DataFrame:
    """False positives avoided, potential misses, net and ratio from a matrix."""
    avoided = F.col("prolonged_to_normal") + F.col("prolonged_to_borderline")
    missed = F.col("normal_to_prolonged") + F.col("borderline_to_prolonged")
    return df.withColumns({"fp_avoided": avoided, "potential_missed": missed, "net_benefit": avoided - missed,
                           "ratio_avoided_missed": or_inf(avoided, missed)})


def impact_cells(df: DataFrame, by=("dataset",)) -> DataFrame:
    """Per dataset: matrix, prolonged counts and sums for r of the NORM rows given."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"), *matrix_counts("class_bazett", "class_inverse_rr"),
        F.count_if(F.col("class_bazett") == "prolonged").alias("prolonged_bazett"),
        F.count_if(F.col("class_inverse_rr") == "prolonged").alias("prolonged_inverse_rr"),
        *pair_sums("qtc_bazett", "hr_bpm", "bazett"), *pair_sums("qtc_inverse_rr", "hr_bpm", "inverse_rr"))


IMPACT_FIELDS = ["n_records", "r_bazett", "r_inverse_rr", "prolonged_bazett", "prolonged_inverse_rr", "fp_avoided",
                 "potential_missed", "net_benefit", "ratio_avoided_missed"]


def impact(df: DataFrame, by=("dataset",)) -> DataFrame:
    """One clinical-impact row per dataset."""
    wide = impact_cells(df, by).withColumns({"r_bazett": pair_corr("bazett"), "r_inverse_rr": pair_corr("inverse_rr")})
    return impact_columns(wide).select(*by, *IMPACT_FIELDS)


def cascade_counts(df: DataFrame, reference: str = "qtc_reference_ms", by=()) -> DataFrame:
    """Counts of triage level by truth (strict comparison; a missing QTc is not prolonged)."""
    t, b, k = (prolonged(c) for c in (reference, "qtc_bazett", "qtc_inverse_rr"))
    level = {"green": ~b, "yellow": b & ~k, "red": b & k}
    cells = [F.count_if(on & truth).alias(f"{name}_{word}") for name, on in level.items()
             for word, truth in (("prolonged", t), ("normal", ~t))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *cells, *confusion_counts(t, b, "base_"), *confusion_counts(t, k, "new_"))


def cascade(df: DataFrame, reference: str = "qtc_reference_ms", by=()) -> DataFrame:
    """Cascade strategy: level counts, shares, purity and the metrics of four strategies."""
    return cascade_columns(cascade_counts(df, reference, by))


def cascade_columns(counts: DataFrame) -> DataFrame:
    c = F.col
    wide = counts.withColumns({lv: c(f"{lv}_prolonged") + c(f"{lv}_normal") for lv in ("green", "yellow", "red")})
    # RED alone as positive, and RED or YELLOW as positive
    wide = wide.withColumns({
        "red_tp": c("red_prolonged"), "red_fp": c("red_normal"), "red_fn": c("green_prolonged") + c("yellow_prolonged"),
        "red_tn": c("green_normal") + c("yellow_normal"),
        "any_tp": c("red_prolonged") + c("yellow_prolonged"), "any_fp": c("red_normal") + c("yellow_normal"),
        "any_fn": c("green_prolonged"), "any_tn": c("green_normal")})
    positive = c("base_tp") + c("base_fp")
    wide = wide.withColumns({
        **{f"pct_{lv}": share0(lv, "n") for lv in ("green", "yellow", "red")},
        **{f"purity_{lv}": share0(f"{lv}_prolonged", lv) for lv in ("green", "yellow", "red")},
        "referral_reduction": positive - c("red"),
        "referral_reduction_pct": F.coalesce(100.0 * (1 - F.try_divide(c("red").cast("double"), positive)), F.lit(0.0)),
        "workload_reduction_pct": F.coalesce(100.0 * (1 - F.try_divide((c("red") + c("yellow")).cast("double"), positive)), F.lit(0.0))})
    for tag in ("base_", "new_", "red_", "any_"):
        wide = confusion_metrics(wide, 0.0, tag)
    return wide


def rollup_totals(df: DataFrame, reference: str = "qtc_reference_ms") -> DataFrame:
    """Impact and triage counts per dataset and in total, rates recomputed from the sums.

    The total adds up the per-dataset rows; the data is scanned once.
    """
    t, b, k = (prolonged(c) for c in (reference, "qtc_bazett", "qtc_inverse_rr"))
    level = {"green": ~b, "yellow": b & ~k, "red": b & k}
    counts = df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_records"), *matrix_counts("class_bazett", "class_inverse_rr"),
        *[F.count_if(on & truth).alias(f"{name}_{word}") for name, on in level.items()
          for word, truth in (("prolonged", t), ("normal", ~t))], *confusion_counts(t, b, "base_"))
    labels = F.explode(F.array(F.col("dataset"), F.lit("TOTAL")))
    both = add_up(counts.withColumn("scope", labels), ["scope"], ["dataset"])
    out = impact_columns(both)
    out = out.withColumns({lv: F.col(f"{lv}_prolonged") + F.col(f"{lv}_normal") for lv in level})
    return out.select("scope", "n_records", "fp_avoided", "potential_missed", "net_benefit", "ratio_avoided_missed", *level,
                      *[share0(lv, "n_records").alias(f"pct_{lv}") for lv in level],
                      *[share0(f"{lv}_prolonged", lv).alias(f"purity_{lv}") for lv in level],
                      ratio("base_tp", F.col("base_tp") + F.col("base_fn")).alias("base_sensitivity"),
                      ratio("base_tn", F.col("base_tn") + F.col("base_fp")).alias("base_specificity"),
                      ratio("base_tp", F.col("base_tp") + F.col("base_fp")).alias("base_ppv"))


def gold_standard(df: DataFrame, reference: str = "qtc_reference_ms", formulas=FORMULAS) -> DataFrame:
    """Each formula's 'prolonged' class against that of a continuous reference."""
    return gold_standard_binary(df.withColumn("__truth", classify3(reference) == "prolonged"), "__truth", formulas)


# Names a binary long-QT diagnosis may have, first present wins (fixed values).
DIAGNOSIS_FLAGS = ["prolonged_qt", "label_prolonged_qt", "has_prolonged_qt", "snomed_prolonged_qt", "diagnosis_prolonged_qt"]


def gold_standard_binary(df: DataFrame, truth: str | None = None, formulas=FORMULAS) -> DataFrame:
    """Each formula's 'prolonged' class against a binary diagnosis column."""
    truth = truth or next((c for c in DIAGNOSIS_FLAGS if c in df.columns), None)
    if truth is None:
        raise ValueError(f"none of {DIAGNOSIS_FLAGS} present")
    flag = F.coalesce(F.col(truth).cast("boolean"), F.lit(False))
    wide = df.agg(*[c for f in formulas for c in confusion_counts(flag, classify3(f"qtc_{f}") == "prolonged", f"{f}_")])
    return confusion_metrics(per_formula(wide, formulas))


def rank_by_metrics(metrics: DataFrame, names=("sensitivity", "specificity", "f1", "youden_j", "mcc")) -> DataFrame:
    """Formulas ranked by each metric, values to 4 decimals (one row per formula and metric)."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names])
    long = metrics.select("formula", F.explode(rows).alias("m")).select("formula", "m.*")
    order = Window.partitionBy("metric").orderBy(F.desc("v"))
    return long.select("metric", "formula", F.rank().over(order).cast("bigint").alias("rank"), F.round("v", 4).alias("value"))


