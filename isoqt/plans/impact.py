"""Number needed to treat, triage, cost and scenario reports on enriched NORM rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.fixed_values import AGE_BINS_COUNTED, COSTS_EUR, HR_BINS_COUNTED, SCENARIO_SIZES
from isoqt.functions.classify import bucketize
from isoqt.plans.cells import or_inf, share, share0, stratify, with_enough

FORMULAS = ("bazett", "inverse_rr", "fridericia")


def nnt_aggregates() -> list:
    b, k = F.col("pred_bazett"), F.col("pred_inverse_rr")
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(f"pred_{f}").alias(f"fp_{f}") for f in FORMULAS],
            F.count_if(b & ~k).alias("scenario_a"), F.count_if(~b & k).alias("scenario_b"),
            *[F.count_if(F.col("triage") == t).alias(t.lower()) for t in ("GREEN", "YELLOW", "RED")]]


def nnt_columns(df: DataFrame, keep=()) -> DataFrame:
    """NNT block from the counts."""
    avoided = F.col("fp_bazett") - F.col("fp_inverse_rr")
    return df.select(*keep, "n", *[f"fp_{f}" for f in FORMULAS], avoided.alias("fp_avoided"), share0(avoided, "fp_bazett").alias("fp_avoided_pct"),
                     *[share0(f"fp_{f}", "n").alias(f"fp_rate_{f}") for f in FORMULAS], "scenario_a", "scenario_b",
                     F.coalesce(F.try_divide(avoided.cast("double"), "n"), F.lit(0.0)).alias("arr"), or_inf("n", avoided).alias("nnt"),
                     or_inf("scenario_a", "scenario_b").alias("benefit_harm_ratio"))


def nnt(df: DataFrame, by=()) -> DataFrame:
    """False positives, avoided ones, NNT and benefit to harm."""
    return nnt_columns(df.groupBy(*by).agg(*nnt_aggregates()), by)


def nnt_by(df: DataFrame, min_n: int = 100, hr_bins=HR_BINS_COUNTED, age_bins=AGE_BINS_COUNTED) -> DataFrame:
    """NNT by rate, age and dataset."""
    keys = {"h": bucketize("hr_bpm", hr_bins), "a": bucketize("age", age_bins), "d": F.col("dataset")}
    wide = stratify(df, keys, [("hr", F.col("h")), ("age", F.col("a")), ("dataset", F.col("d"))], nnt_aggregates())
    return nnt_columns(with_enough(wide, min_n), ["kind", "label", "enough"])


def best_stratum(report: DataFrame) -> DataFrame:
    """Stratum of enough rows with the smallest NNT of each kind (an infinite one counts as 9999)."""
    key = F.when(F.col("nnt") < float("inf"), F.col("nnt")).otherwise(9999.0)
    return report.filter(F.col("kind").isin("hr", "age") & F.col("enough")).groupBy("kind").agg(
        F.min_by(F.struct("label", "nnt"), F.struct(F.round(key, 9), "label")).alias("b")).select("kind", "b.label", "b.nnt")


def triage_nnt(df: DataFrame) -> DataFrame:
    """Triage levels and the number to triage to avoid one urgent referral."""
    wide = df.agg(*nnt_aggregates())
    positive = F.col("yellow") + F.col("red")
    return wide.select("n", "green", "yellow", "red", *[share(c, "n").alias(f"{c}_pct") for c in ("green", "yellow", "red")],
                       positive.alias("base_positive"), F.col("yellow").alias("urgent_avoided"), share0("yellow", positive).alias("urgent_reduction_pct"),
                       or_inf("n", "yellow").alias("nnt_avoid_urgent"))


def cost_effectiveness(df: DataFrame, costs=COSTS_EUR) -> DataFrame:
    """Cost of three strategies: base only, new only and triage."""
    workup, referral = F.lit(float(costs["false_positive_workup"])), F.lit(float(costs["cardiology_referral"]))
    wide = df.agg(*nnt_aggregates())
    base = F.col("fp_bazett") * workup
    totals = {"bazett": (base, F.col("fp_bazett")), "inverse_rr": (F.col("fp_inverse_rr") * workup, F.col("fp_inverse_rr")),
              "triage": (F.col("yellow") * referral + F.col("red") * workup, F.col("red"))}
    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), t.alias("total_cost"), F.coalesce(F.try_divide(t, "n"), F.lit(0.0)).alias("cost_per_patient"),
                              w.alias("n_workups"), (base - t).alias("savings"), share0(base - t, base).alias("savings_pct")) for s, (t, w) in totals.items()])
    return wide.select(F.explode(rows).alias("m")).select("m.*")


def scenarios(df: DataFrame, sizes=SCENARIO_SIZES, costs=COSTS_EUR, athletes_max_age: float = 35, min_n: int = 100) -> DataFrame:
    """False positives expected in three settings, cut to whole patients.

    Sports uses the rates of the young when there are enough of them.
    """
    young = F.col("age") < athletes_max_age
    wide = df.agg(*nnt_aggregates(), F.count_if(young).alias("n_young"), F.count_if(young & F.col("pred_bazett")).alias("young_b"),
                  F.count_if(young & F.col("pred_inverse_rr")).alias("young_k"))
    enough = F.col("n_young") >= min_n

    def plain(fp, size):
        return (F.col(fp) * F.coalesce(F.try_divide(F.lit(float(size)), "n"), F.lit(0.0))).cast("bigint")

    def sports(young_fp, fp):
        rate = F.when(enough, F.try_divide(F.col(young_fp).cast("double"), "n_young")).otherwise(share0(fp, "n") / 100.0)
        return (F.lit(float(sizes["sports"])) * rate).cast("bigint")

    counts = {"preoperative": (plain("fp_bazett", sizes["preoperative"]), plain("fp_inverse_rr", sizes["preoperative"])),
              "sports": (sports("young_b", "fp_bazett"), sports("young_k", "fp_inverse_rr")),
              "drug_monitoring": (plain("fp_bazett", sizes["drug_monitoring"]), plain("fp_inverse_rr", sizes["drug_monitoring"]))}
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(sizes[s]).cast("bigint").alias("n_patients"), b.alias("fp_bazett"), k.alias("fp_inverse_rr"))
                     for s, (b, k) in counts.items()])
    out = wide.select(F.explode(rows).alias("m")).select("m.*")
    return out.withColumn("fp_avoided", F.col("fp_bazett") - F.col("fp_inverse_rr")).withColumn(
        "cost_saved", F.col("fp_avoided") * F.lit(float(costs["false_positive_workup"])))
