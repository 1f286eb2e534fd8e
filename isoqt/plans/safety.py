"""Outcomes by concordance class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.functions.tails import chi2_p
from isoqt.operators.logistic import fit_all
from isoqt.operators.quantiles import join_groups, percentiles
from isoqt.plans.cells import share, share0, with_enough

CLASSES = ["concordant_normal", "concordant_prolonged", "new_only_prolonged", "reclassified_normal"]


def outcomes_by_patient(df: DataFrame, by: str = "concordance", patient: str = "subject_id") -> DataFrame:
    """Distinct patients and their events per class; a patient may sit in several classes.

    Rows shrink to one per class and patient before the classes are counted, so a patient with
    very many records costs one row.
    """
    patients = df.filter(F.col(by) != "unknown").groupBy(by, patient).agg(
        F.count(F.lit(1)).alias("records"), F.bool_or("arrhythmia").alias("arr"), F.bool_or("deceased").alias("dead"),
        F.sum("qtc_inverse_rr").alias("k_sum"), F.count("qtc_inverse_rr").alias("k_n"), F.sum("qtc_bazett").alias("b_sum"),
        F.sum("hr_bpm").alias("h_sum"), F.count("hr_bpm").alias("h_n"))
    known = F.col(patient).isNotNull()
    wide = patients.groupBy(by).agg(
        F.sum("records").alias("n_records"), F.count_if(known).alias("n_patients"), F.count_if(known & F.col("arr")).alias("n_arrhythmia"),
        F.count_if(known & F.col("dead")).alias("n_deceased"), F.count_if(known & (F.col("arr") | F.col("dead"))).alias("n_any_event"),
        F.try_divide(F.sum("k_sum"), F.sum("k_n")).alias("mean_qtc_inverse_rr"), F.try_divide(F.sum("b_sum"), F.sum("k_n")).alias("mean_qtc_bazett"),
        F.try_divide(F.sum("h_sum"), F.sum("h_n")).alias("mean_hr"))
    return wide.withColumns({f"pct_{c}": share0(f"n_{c}", "n_patients") for c in ("arrhythmia", "deceased", "any_event")})


def outcomes_by_record(df: DataFrame, by: str = "concordance", patient: str = "subject_id", min_n: int = 10) -> DataFrame:
    """Records, distinct patients and events per class; ``enough``: at least ``min_n`` records."""
    any_, severe, dead = F.col("any_arrhythmia"), F.col("severe_arrhythmia"), F.col("deceased")
    event = severe | dead
    patients = df.filter(F.col(by) != "unknown").groupBy(by, patient).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(any_).alias("a"), F.count_if(severe).alias("s"), F.count_if(dead).alias("d"), F.count_if(event).alias("e"),
        F.count_if(F.col("hr_bpm") >= 100).alias("t"), *[F.sum(c).alias(f"{c}_s") for c in ("hr_bpm", "age", "qtc_inverse_rr", "qtc_bazett")],
        *[F.count(c).alias(f"{c}_n") for c in ("hr_bpm", "age", "qtc_inverse_rr", "qtc_bazett")])
    sums = {"n_records": "n", "n_any_arrhythmia": "a", "n_severe_arrhythmia": "s", "n_deceased": "d", "n_any_severe_event": "e"}
    wide = patients.groupBy(by).agg(
        *[F.sum(c).alias(name) for name, c in sums.items()], F.count(patient).alias("n_patients"), F.sum("t").alias("n_tachy"),
        *[F.try_divide(F.sum(f"{c}_s"), F.sum(f"{c}_n")).alias(f"mean_{c}") for c in ("hr_bpm", "age", "qtc_inverse_rr", "qtc_bazett")])
    return with_enough(wide, min_n, "n_records").select(
        by, "n_records", "enough", "n_patients", *[c for c in sums if c != "n_records"], *[share(c, "n_records").alias(c.replace("n_", "pct_", 1)) for c in sums if c != "n_records"],
        F.col("mean_hr_bpm").alias("mean_hr"), "mean_age", share("n_tachy", "n_records").alias("pct_tachycardia"), "mean_qtc_inverse_rr", "mean_qtc_bazett")


def outcome_summary(report: DataFrame, by: str = "concordance") -> DataFrame:
    """Short table of the record-level outcomes, to 2 decimals."""
    return report.select(by, "n_records", "n_patients", "n_severe_arrhythmia", "n_deceased",
                         *[F.round(c, 2).alias(c) for c in ("mean_hr", "mean_qtc_inverse_rr", "mean_qtc_bazett")])


def safety(report: DataFrame, policy: str = "record", by: str = "concordance", p_value: bool = True) -> DataFrame:
    """Event rate of the reclassified against the concordant normal: difference, relative risk,
    Yates-corrected chi-square of the 2x2 table, p and verdict.

    Policy 'patient' counts patients (SAFE up to 0, ACCEPTABLE below 2 points, else CONCERN);
    'record' counts records (SAFE below 1, ACCEPTABLE below 2, else NEEDS_REVIEW).
    """
    n, e = ("n_patients", "n_any_event") if policy == "patient" else ("n_records", "n_any_severe_event")

    def at(c, group):
        return F.max(F.when(F.col(by) == group, F.col(c)))

    wide = report.agg(at(n, "reclassified_normal").alias("n_reclassified"), at(e, "reclassified_normal").alias("events_reclassified"),
                      at(n, "concordant_normal").alias("n_normal"), at(e, "concordant_normal").alias("events_normal"),
                      at("mean_hr", "reclassified_normal").alias("hr_re"), at("mean_hr", "concordant_normal").alias("hr_cn"))
    a, b = F.col("events_reclassified").cast("double"), (F.col("n_reclassified") - F.col("events_reclassified")).cast("double")
    c, d = F.col("events_normal").cast("double"), (F.col("n_normal") - F.col("events_normal")).cast("double")
    total = a + b + c + d
    # The correction moves each cell by at most its distance from the expected count.
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - total / 2)
    chi2 = F.try_divide(total * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))
    rate_re, rate_cn = share("events_reclassified", "n_reclassified"), share("events_normal", "n_normal")
    diff = rate_re - rate_cn
    if policy == "patient":
        verdict = F.when(diff <= 0, "SAFE").when(diff < 2.0, "ACCEPTABLE").when(diff.isNotNull(), "CONCERN")
    else:
        verdict = F.when(diff < 1.0, "SAFE").when(diff < 2.0, "ACCEPTABLE").when(diff.isNotNull(), "NEEDS_REVIEW")
    out = wide.select("n_reclassified", "events_reclassified", "n_normal", "events_normal", rate_re.alias("reclassified_event_rate"),
                      rate_cn.alias("normal_event_rate"), diff.alias("rate_difference"), F.try_divide(rate_re, rate_cn).alias("relative_risk"),
                      chi2.alias("chi2"), (F.col("hr_re") - F.col("hr_cn")).alias("hr_difference"), verdict.alias("verdict"))
    return out.withColumn("p_value", chi2_p("chi2")) if p_value else out


def class_profile(df: DataFrame, by: str = "concordance", min_n: int = 10) -> DataFrame:
    """Rate and QT profile of each concordance class."""
    rows = df.filter(F.col(by) != "unknown")
    wide = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("hr_bpm").alias("hr_mean"), F.stddev_samp("hr_bpm").alias("hr_std"),
        F.count_if(F.col("hr_bpm") >= 100).alias("fast"), F.count_if(F.col("hr_bpm") < 60).alias("slow"),
        F.avg("qtc_inverse_rr").alias("qtc_inverse_rr_mean"), F.avg("qtc_bazett").alias("qtc_bazett_mean"), F.avg("qt_ms").alias("qt_mean")).transform(with_enough, min_n)
    joined = join_groups(wide, percentiles(rows, {"hr_median": ("hr_bpm", 0.5)}, [by]), [by])
    return joined.select(by, "n", "enough", "hr_mean", "hr_std", "hr_median", share("fast", "n").alias("pct_tachycardia"), share("slow", "n").alias("pct_bradycardia"),
                         "qtc_inverse_rr_mean", "qtc_bazett_mean", "qt_mean")


def class_comparison(profile: DataFrame, by: str = "concordance") -> DataFrame:
    """Reclassified minus concordant normal: rate and share of tachycardia, and whether the
    reclassified look like rate artefacts."""
    def at(c, group):
        return F.max(F.when(F.col(by) == group, F.col(c)))
    hr = at("hr_mean", "reclassified_normal") - at("hr_mean", "concordant_normal")
    fast = at("pct_tachycardia", "reclassified_normal") - at("pct_tachycardia", "concordant_normal")
    return profile.filter("enough").agg(hr.alias("hr_difference"), fast.alias("tachycardia_difference")).withColumn(
        "faster", (F.col("hr_difference") > 5) | (F.col("tachycardia_difference") > 10))


# ---- outcome table with adjusted odds -----------------------------------------------------
OUTCOMES = ["ventricular_arrhythmia", "cardiac_arrest", "mortality_30d", "mortality_90d", "mortality_inhospital"]


def outcome_rates(df: DataFrame, outcomes=OUTCOMES, by: str = "concordance") -> DataFrame:
    """Outcome rates of concordant normal and reclassified rows and their unadjusted ratio."""
    cn, re = F.col(by) == "concordant_normal", F.col(by) == "reclassified_normal"
    wide = df.agg(F.count_if(cn).alias("n_cn"), F.count_if(re).alias("n_re"), *[F.count_if(cn & F.col(o)).alias(f"cn_{o}") for o in outcomes],
                  *[F.count_if(re & F.col(o)).alias(f"re_{o}") for o in outcomes])
    rows = F.array(*[F.struct(F.lit(o).alias("outcome"), F.try_divide(F.col(f"cn_{o}").cast("double"), "n_cn").alias("normal_rate"),
                              F.try_divide(F.col(f"re_{o}").cast("double"), "n_re").alias("reclassified_rate")) for o in outcomes])
    out = wide.select(F.explode(rows).alias("m")).select("m.*")
    return out.withColumn("unadjusted_rr", F.try_divide("reclassified_rate", "normal_rate"))


COVARIATES = ["is_reclassified", "age", "sex", "hr_bpm"]


def odds_fits(df: DataFrame, outcomes=OUTCOMES, by: str = "concordance") -> DataFrame:
    """Logistic fits of every outcome on reclassification, age, sex and rate, over concordant normal and reclassified rows."""
    rows = df.filter(F.col(by).isin("concordant_normal", "reclassified_normal")).withColumn("is_reclassified", (F.col(by) == "reclassified_normal").cast("double"))
    return fit_all(rows, outcomes, COVARIATES)


def adjusted_odds(df: DataFrame, outcomes=OUTCOMES, by: str = "concordance", min_n: int = 100, level_z: float = 1.959963984540054) -> DataFrame:
    """Logistic odds ratio of being reclassified, adjusted for age, sex and rate, with CI and p.

    ``enough`` says whether an outcome has ``min_n`` known rows; smaller ones are computed all the same. Without events,
    without non-events or with collinear covariates the ratio is null and ``converged`` false.
    """
    beta, se = F.get("beta", F.lit(1)), F.get("se", F.lit(1))
    return odds_fits(df, outcomes, by).select(
        "outcome", "n", (F.col("n") >= min_n).alias("enough"), "converged", "steps", F.exp(beta).alias("odds_ratio"), F.exp(beta - level_z * se).alias("ci_low"),
        F.exp(beta + level_z * se).alias("ci_high"), chi2_p((beta / se) * (beta / se)).alias("p_value"))


def table7(df: DataFrame, outcomes=OUTCOMES, by: str = "concordance") -> DataFrame:
    """Outcome rates with unadjusted ratios and adjusted odds ratios."""
    return outcome_rates(df, outcomes, by).join(adjusted_odds(df, outcomes, by), "outcome")
