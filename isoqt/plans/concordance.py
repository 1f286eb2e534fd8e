"""Agreement of predictions with recorded diagnoses (enriched rows with a boolean truth)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.fixed_values import AGE_BINS, HR_BINS_WIDE, SEVERITY_BINS
from isoqt.functions.classify import bucketize
from isoqt.operators.confusion import confusion_counts, confusion_metrics, per_formula
from isoqt.plans.cells import share, share0, stratify, with_enough

LEVELS = ["GREEN", "YELLOW", "RED"]


def triage_on_truth(truth: str = "has_dx") -> list:
    return [F.count_if(F.col(truth)).alias("n_true"),
            *[F.count_if(F.col(truth) & (F.col("triage") == t)).alias(f"true_{t.lower()}") for t in LEVELS]]


def concordance_overall(df: DataFrame, truth: str = "has_dx", formulas=("bazett", "inverse_rr", "fridericia")) -> DataFrame:
    """Metrics of each formula against the diagnosis."""
    wide = df.agg(*[c for f in formulas for c in confusion_counts(truth, f"pred_{f}", f"{f}_")])
    out = confusion_metrics(per_formula(wide, formulas))
    return out.select("formula", "total", (F.col("tp") + F.col("fn")).alias("n_true"), (F.col("tp") + F.col("fp")).alias("n_pred"),
                      "tp", "tn", "fp", "fn", "sensitivity", "specificity", "ppv", "npv", "f1", "accuracy")


def triage_capture(df: DataFrame, truth: str = "has_dx") -> DataFrame:
    """Triage levels of the true cases and the share caught (YELLOW or RED)."""
    wide = df.agg(*triage_on_truth(truth))
    return wide.select("n_true", *[F.col(f"true_{t.lower()}") for t in LEVELS],
                       *[share0(f"true_{t.lower()}", "n_true").alias(f"{t.lower()}_pct") for t in LEVELS],
                       share0(F.col("true_yellow") + F.col("true_red"), "n_true").alias("captured_pct"))


def concordance_by(df: DataFrame, truth: str = "has_dx", formulas=("bazett", "inverse_rr"), min_true: int = 10) -> DataFrame:
    """Metrics and capture by dataset, rate and age group holding at least ``min_true`` true cases."""
    keys = {"ds": F.col("dataset"), "hr_group": bucketize("hr_bpm", HR_BINS_WIDE), "age_group": bucketize("age", AGE_BINS)}
    strata = [("dataset", F.col("ds")), ("hr", F.col("hr_group")), ("age", F.col("age_group"))]
    aggs = [*triage_on_truth(truth), *[c for f in formulas for c in confusion_counts(truth, f"pred_{f}", f"{f}_")]]
    wide = stratify(df, keys, strata, aggs).filter(F.col("n_true") >= min_true)
    wide = wide.withColumns({"captured_pct": share0(F.col("true_yellow") + F.col("true_red"), "n_true"), "missed_pct": share0("true_green", "n_true")})
    keep = ["kind", "label", "n_true", "captured_pct", "missed_pct"]
    return confusion_metrics(per_formula(wide, formulas, keep)).select(
        *keep, "formula", "tp", "tn", "fp", "fn", "sensitivity", "specificity", "ppv", "npv", "f1", "accuracy")


def triage_safety(df: DataFrame, truth: str = "has_dx", min_n: int = 5) -> DataFrame:
    """True cases overall and by rate group: triage shares, captured and missed."""
    true = df.filter(F.col(truth))
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("triage") == t).alias(t.lower()) for t in LEVELS]]
    wide = stratify(true, {"g": bucketize("hr_bpm", HR_BINS_WIDE)}, [("hr", F.col("g")), ("overall", F.lit("OVERALL"))], aggs)
    captured = share(F.col("yellow") + F.col("red"), "n")
    return with_enough(wide, min_n).select(
        "kind", "label", "n", "enough", *[c for t in LEVELS for c in (F.col(t.lower()), share(t.lower(), "n").alias(f"{t.lower()}_pct"))],
        captured.alias("captured_pct"), (100.0 - captured).alias("missed_pct"))


def missed_profile(df: DataFrame, truth: str = "has_dx") -> DataFrame:
    """Size, mean rate, QTc and age of the true cases triaged GREEN."""
    return df.filter(F.col(truth) & (F.col("triage") == "GREEN")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("hr_bpm").alias("mean_hr"), F.avg("qtc_bazett").alias("mean_qtc_bazett"),
        F.avg("qtc_inverse_rr").alias("mean_qtc_inverse_rr"), F.avg("age").alias("mean_age"))


def severity_report(df: DataFrame, truth: str = "has_dx", min_n: int = 50) -> DataFrame:
    """Prevalence, triage shares and capture by distance of the new QTc from the threshold."""
    rows = df.withColumn("severity", bucketize(F.col("qtc_inverse_rr") - F.col("threshold"), SEVERITY_BINS))
    wide = rows.filter(F.col("severity").isNotNull()).groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), *triage_on_truth(truth), *[F.count_if(F.col("triage") == t).alias(t.lower()) for t in LEVELS])
    return with_enough(wide, min_n).select(
        "severity", "n", "enough", "n_true", share("n_true", "n").alias("prevalence"), *[share(t.lower(), "n").alias(f"{t.lower()}_pct") for t in LEVELS],
        share(F.col("true_yellow") + F.col("true_red"), "n_true").alias("true_captured_pct"))
