"""Rate-extreme reports on enriched rows: discordance, populations, triage, adaptive thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoqt.fixed_values import POPULATION_LIMITS
from isoqt.functions.classify import classify_margin, confidence, prolonged, qtc_hybrid, triage4
from isoqt.functions.formulas import improvement
from isoqt.operators.moments import pair_corr, pair_sums
from isoqt.operators.quantiles import percentiles
from isoqt.operators.reference import attach
from isoqt.plans.cells import add_up, label_if, or_inf, share, share0, stratify, value_mean, value_std, value_sums, with_enough


def call(f: str) -> Column:
    """Strict call above the sex threshold; null without a QTc or sex."""
    return prolonged(f"qtc_{f}", unknown=None, on_null=None)


def zone_triage() -> Column:
    """GREEN if the base is normal, YELLOW if only it is prolonged; anything else, also a missing
    class, is RED."""
    b, k = call("bazett"), call("inverse_rr")
    return F.when(F.coalesce(~b, F.lit(False)), "GREEN").when(F.coalesce(b & ~k, F.lit(False)), "YELLOW").otherwise("RED")


# ---- discordance --------------------------------------------------------------------------
SCENARIOS = ["A_FP_saved", "B_FN_risk", "C_borderline_resolved", "D_downgraded"]


def scenario_flags() -> dict[str, Column]:
    b, k = call("bazett"), call("inverse_rr")
    cb, ck = classify_margin("qtc_bazett"), classify_margin("qtc_inverse_rr")
    flags = [b & ~k, ~b & k, (cb == "borderline") & (ck == "normal"), (cb == "prolonged") & (ck == "borderline")]
    return {n: F.coalesce(f, F.lit(False)) for n, f in zip(SCENARIOS, flags)}


def discordance(df: DataFrame) -> DataFrame:
    """Size, rate, age and NORM share of each (overlapping) discordance scenario."""
    aggs = [F.count(F.lit(1)).alias("n"), *value_sums("hr_bpm", "hr", 75), F.min("hr_bpm").alias("min_hr"), F.max("hr_bpm").alias("max_hr"),
            *value_sums("age", "age", 50), F.count_if(F.col("superclass") == "NORM").alias("n_norm")]
    flags = scenario_flags()
    strata = [("scenario", label_if(s, s)) for s in SCENARIOS] + [("all", F.lit("all"))]
    wide = stratify(df, flags, strata, aggs)
    total = F.max(F.when(F.col("kind") == "all", F.col("n")))

    wide = wide.withColumn("total", total.over(Window.partitionBy(F.lit(1)))).filter(F.col("kind") == "scenario")
    return wide.select(F.col("label").alias("scenario"), "n", share("n", "total").alias("pct_of_total"), value_mean("hr", 75).alias("hr_mean"),
                       value_std("hr").alias("hr_std"), "min_hr", "max_hr", value_mean("age", 50).alias("age_mean"),
                       share("n_norm", "n").alias("pct_norm"))


def discordance_distribution(df: DataFrame, c: str) -> DataFrame:
    """Rows of each scenario by a label column (superclass or rate zone)."""
    keys = {**scenario_flags(), "__value": F.col(c)}
    cells = df.groupBy(*[e.alias(k) for k, e in keys.items()]).agg(F.count(F.lit(1)).alias("n"))
    member = F.explode(F.array_compact(F.array(*[label_if(s, s) for s in SCENARIOS])))
    return (cells.withColumn("scenario", member).filter(F.col("__value").isNotNull())
            .groupBy("scenario", F.col("__value").alias(c)).agg(F.sum("n").alias("n")))


# ---- special populations ------------------------------------------------------------------
def population_flags(limits=POPULATION_LIMITS) -> dict[str, Column]:
    hr, age, norm = F.col("hr_bpm"), F.col("age"), F.col("superclass") == "NORM"
    flags = {
        "athletes_proxy": (hr < limits["athletes_max_hr"]) & (age < limits["athletes_max_age"]) & norm,
        "febrile_proxy": (hr > limits["febrile_min_hr"]) & norm,
        "elderly_bradycardic": (hr < limits["elderly_max_hr"]) & (age > limits["elderly_min_age"]),
        "young_tachycardic": (hr > limits["young_tachy_min_hr"]) & (age < limits["young_tachy_max_age"]),
        "extreme_bradycardia": hr < limits["extreme_brady_max_hr"],
        "extreme_tachycardia": hr > limits["extreme_tachy_min_hr"],
    }
    return {n: F.coalesce(f, F.lit(False)) for n, f in flags.items()}


def population_report(df: DataFrame, limits=POPULATION_LIMITS, min_n: int = 10) -> DataFrame:
    """Size, rate, |r|, bias and NORM false positives of six overlapping populations."""
    flags = population_flags(limits)
    norm = F.col("superclass") == "NORM"
    rows = df.withColumn("bias", F.col("qtc_bazett") - F.col("qtc_inverse_rr"))
    aggs = [F.count(F.lit(1)).alias("n"), *value_sums("hr_bpm", "hr", 75), *value_sums("age", "age", 50), *value_sums("bias", "bias"),
            *pair_sums("qtc_bazett", "hr_bpm", "bazett"), *pair_sums("qtc_inverse_rr", "hr_bpm", "inverse_rr"),
            F.count_if(norm).alias("n_norm"), *[F.count_if(norm & F.coalesce(call(f), F.lit(False))).alias(f"fp_{f}") for f in ("bazett", "inverse_rr")]]
    wide = stratify(rows, flags, [("population", label_if(p, p)) for p in flags], aggs)
    some, fp = F.col("n") >= min_n, (F.col("n") >= min_n) & (F.col("n_norm") > min_n)
    r = {f: F.abs(pair_corr(f, min_n + 1)) for f in ("bazett", "inverse_rr")}
    cols = {"hr_mean": value_mean("hr", 75), "hr_std": value_std("hr"), "age_mean": value_mean("age", 50), "abs_r_bazett": r["bazett"],
            "abs_r_inverse_rr": r["inverse_rr"], "improvement": improvement(r["bazett"], r["inverse_rr"]), "bias_mean": value_mean("bias"),
            "bias_std": value_std("bias")}
    out = {n: F.when(some, c) for n, c in cols.items()}
    out |= {"n_norm": F.when(fp, F.col("n_norm"))}
    out |= {f"fp_{f}": F.when(fp, F.col(f"fp_{f}")) for f in r} | {f"fp_rate_{f}": F.when(fp, share(f"fp_{f}", "n_norm")) for f in r}
    return wide.select(F.col("label").alias("population"), "n", *[c.alias(n) for n, c in out.items()])


# ---- triage -------------------------------------------------------------------------------
def triage_counts() -> list[Column]:
    level = zone_triage()
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(level == t).alias(t.lower()) for t in ("GREEN", "YELLOW", "RED")]]


def triage_columns(df: DataFrame, keep) -> DataFrame:
    levels = ["green", "yellow", "red"]
    return df.select(*keep, "n", *levels, *[share(c, "n").alias(f"{c}_pct") for c in levels],
                     (F.col("yellow") + F.col("red")).alias("base_positive"),
                     share0("yellow", F.col("yellow") + F.col("red")).alias("urgent_reduction_pct"))


def triage_by_zone(df: DataFrame, min_n: int = 10) -> DataFrame:
    """Triage levels of the NORM rows by rate zone and overall (all zones and unzoned rows)."""
    norm = df.filter(F.col("superclass") == "NORM")
    wide = stratify(norm, {"z": F.col("hr_zone")}, [("zone", F.col("z")), ("overall", F.lit("OVERALL"))], triage_counts())
    return triage_columns(with_enough(wide, min_n), [F.col("label").alias("zone"), "enough"])


def triage_by_population(df: DataFrame, limits=POPULATION_LIMITS, min_n: int = 10) -> DataFrame:
    """Triage levels of the special populations."""
    flags = population_flags(limits)
    wide = stratify(df, flags, [("population", label_if(p, p)) for p in flags], triage_counts())
    return triage_columns(with_enough(wide, min_n), [F.col("label").alias("population"), "enough"])


def nns(df: DataFrame, min_n: int = 10) -> DataFrame:
    """Number needed to screen to avoid one false positive, by rate zone and overall."""
    norm = df.filter(F.col("superclass") == "NORM")
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(call(f), F.lit(False))).alias(f"fp_{f}") for f in ("bazett", "inverse_rr")]]
    wide = stratify(norm, {"z": F.col("hr_zone")}, [("zone", F.col("z")), ("overall", F.lit("OVERALL"))], aggs)
    avoided = F.col("fp_bazett") - F.col("fp_inverse_rr")
    return with_enough(wide, min_n).select(
        F.col("label").alias("zone"), "n", "enough", "fp_bazett", "fp_inverse_rr", avoided.alias("fp_avoided"), or_inf("n", avoided).alias("nns"),
        share("fp_bazett", "n").alias("fp_rate_bazett"), share("fp_inverse_rr", "n").alias("fp_rate_inverse_rr"))


# ---- adaptive thresholds ------------------------------------------------------------------
def sex_group() -> Column:
    """male (0) or, with any other known code, female."""
    return F.when(F.col("sex") == 0, "male").when(F.col("sex").isNotNull(), "female")


def zone_thresholds(df: DataFrame, target: float = 2.0, min_zone: int = 100, min_sex: int = 50, qtc: str = "qtc_bazett") -> DataFrame:
    """QTc quantile per zone and sex that leaves about ``target`` % above it, and the rate achieved."""
    norm = df.filter((F.col("superclass") == "NORM") & F.col("hr_zone").isNotNull()).withColumn("sex_group", sex_group())
    by = ["hr_zone", "sex_group"]
    sizes = norm.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    zones = add_up(sizes.drop("sex_group"), ["hr_zone"], []).select("hr_zone", F.col("n").alias("zone_n"))
    keep = sizes.join(zones, "hr_zone").filter(F.col("sex_group").isNotNull() & (F.col("zone_n") >= min_zone) & (F.col("n") >= min_sex))
    cuts = percentiles(norm.filter(F.col("sex_group").isNotNull()), {"threshold_ms": (qtc, (100 - target) / 100)}, by)
    above = attach(norm.filter(F.col("sex_group").isNotNull()), cuts, by).groupBy(*by).agg(
        F.first("threshold_ms").alias("threshold_ms"), F.count_if(F.col(qtc) > F.col("threshold_ms")).alias("above"))
    return keep.join(above, by).select("hr_zone", "sex_group", "n", "threshold_ms", share("above", "n").alias("achieved_fp_rate"))


def percentile_thresholds(df: DataFrame, probs=(95.0, 97.5, 99.0), formulas=("bazett", "inverse_rr")) -> DataFrame:
    """Upper percentiles of the NORM rows by sex and formula with the expected share above."""
    norm = df.filter(F.col("superclass") == "NORM").withColumn("sex_group", sex_group()).filter(F.col("sex_group").isNotNull())
    wanted = {f"{f}_{i}": (f"qtc_{f}", p / 100) for f in formulas for i, p in enumerate(probs)}
    wide = percentiles(norm, wanted, ["sex_group"])
    rows = F.array(*[F.struct(F.lit(f).alias("formula"), F.lit(p).alias("percentile"), F.col(f"{f}_{i}").alias("threshold_ms"),
                              F.lit(100.0 - p).alias("expected_fp_rate")) for f in formulas for i, p in enumerate(probs)])
    return wide.select("sex_group", F.explode(rows).alias("m")).select("sex_group", "m.*")


def alternative_report(df: DataFrame, high: float = 70, medium: float = 40) -> DataFrame:
    """NORM rows: false positives of the hybrid, confidence shares and the 4-level triage."""
    norm = df.filter(F.col("superclass") == "NORM")
    rows = norm.withColumns({"hybrid": qtc_hybrid(), "confidence": confidence(),
                             "b": F.coalesce(F.col("qtc_bazett") > F.col("threshold"), F.lit(False)),
                             "k": F.coalesce(F.col("qtc_inverse_rr") > F.col("threshold"), F.lit(False))})
    rows = rows.withColumn("level", triage4("b", "k", "confidence", high))
    limits = POPULATION_LIMITS
    extreme = (F.col("hr_bpm") < limits["extreme_brady_max_hr"]) | (F.col("hr_bpm") > limits["extreme_tachy_min_hr"])
    wide = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hybrid") > F.col("threshold")).alias("fp_hybrid"), F.count_if("k").alias("fp_new"),
                    F.count_if(extreme).alias("n_extreme_hr"), F.count_if(F.col("confidence") >= high).alias("hi"),
                    F.count_if((F.col("confidence") >= medium) & (F.col("confidence") < high)).alias("mid"),
                    F.count_if(F.col("confidence") < medium).alias("lo"), F.avg("confidence").alias("mean_confidence"),
                    *[F.count_if(F.col("level") == t).alias(t.lower().replace("-", "_")) for t in ("GREEN", "GREEN-WATCH", "YELLOW", "RED")])
    return wide.select("n", share("fp_hybrid", "n").alias("fp_rate_hybrid"), share("fp_new", "n").alias("fp_rate_inverse_rr"), "n_extreme_hr",
                       share("n_extreme_hr", "n").alias("pct_extreme_hr"), share("hi", "n").alias("high_confidence_pct"),
                       share("mid", "n").alias("medium_confidence_pct"), share("lo", "n").alias("low_confidence_pct"), "mean_confidence",
                       *[c for t in ("green", "green_watch", "yellow", "red") for c in (F.col(t), share(t, "n").alias(f"{t}_pct"))])
