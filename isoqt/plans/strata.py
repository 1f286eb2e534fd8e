"""Stratified correlation, bias and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.fixed_values import (AGE_BINS, AGE_VALIDATION_BINS, HR_BINS, HR_STRATA, HR_VALIDATION_BINS, HR_ZONES)
from isoqt.functions.classify import bucketize, prolonged, triage
from isoqt.functions.formulas import FORMULAS, improvement
from isoqt.functions.tails import corr_p
from isoqt.operators.confusion import ratio
from isoqt.operators.moments import pair_corr, pair_mean_y, pair_n, pair_std_y, pair_sums
from isoqt.operators.quantiles import join_groups, percentiles
from isoqt.plans.cells import label_if, or_inf, share, stratify, value_mean, value_std, value_sums, with_enough


def sex_label(sex="sex") -> Column:
    return F.when(F.col(sex) == 0, "Male").when(F.col(sex) == 1, "Female")


def per_formula_rows(df: DataFrame, formulas, fields, keep) -> DataFrame:
    """One row per formula; ``fields`` maps a name to a function of the formula."""
    rows = F.array(*[F.struct(F.lit(f).alias("formula"), *[fn(f).alias(n) for n, fn in fields.items()])
                     for f in formulas])
    return df.select(*keep, F.explode(rows).alias("m")).select(*keep, "m.*")


# ---- mean, std and r per stratum ----------------------------------------------------------
def stratified_metrics(df: DataFrame, formulas=FORMULAS, min_n: int = 10) -> DataFrame:
    """Mean, population std and r against rate of each correction by rate bin, sex, age and class."""
    keys = {"hr_bin": bucketize("hr_bpm", HR_VALIDATION_BINS), "sex_label": sex_label(),
            "age_bin": bucketize("age", AGE_VALIDATION_BINS), "dx": F.col("superclass")}
    strata = [("hr", F.col("hr_bin")), ("sex", F.col("sex_label")), ("age", F.col("age_bin")), ("superclass", F.col("dx"))]
    sums = [c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)]
    wide = stratify(df, keys, strata, sums)
    out = per_formula_rows(wide, formulas, {
        "n": pair_n, "mean": pair_mean_y, "std": pair_std_y, "r": lambda f: pair_corr(f, min_n)}, ["kind", "label"])
    return with_enough(out, min_n)


# ---- subgroups ----------------------------------------------------------------------------
def subgroup_aggregates(formulas=FORMULAS, reference: str | None = "qtc_reference_ms") -> list[Column]:
    """Counts and sums behind the subgroup metrics (strict comparison, unknown sex gives null)."""
    norm = F.upper("superclass") == "NORM"
    b, k = (prolonged(f"qtc_{f}", unknown=None, on_null=None) for f in ("bazett", "inverse_rr"))
    level = triage(b, k)
    valid = F.col("hr_bpm").isNotNull() & F.col("qtc_bazett").isNotNull() & F.col("qtc_inverse_rr").isNotNull()
    out = [F.count(F.lit(1)).alias("n"), F.count_if(norm).alias("n_norm"), F.count_if(norm & b.isNotNull()).alias("n_class"),
           F.count_if(norm & b).alias("fp_bazett"), F.count_if(norm & b.isNotNull() & k).alias("fp_inverse_rr")]
    out += [F.count_if(norm & (level == t)).alias(f"triage_{t.lower()}") for t in ("GREEN", "YELLOW", "RED")]
    out += [c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f, valid)]
    if reference:
        truth = prolonged(reference, unknown=None, on_null=None)
        ok = truth.isNotNull() & b.isNotNull() & k.isNotNull()
        for f, p in (("bazett", b), ("inverse_rr", k)):
            out += [F.count_if(ok & truth & p).alias(f"gs_{f}_tp"), F.count_if(ok & ~truth & p).alias(f"gs_{f}_fp"),
                    F.count_if(ok & ~truth & ~p).alias(f"gs_{f}_tn"), F.count_if(ok & truth & ~p).alias(f"gs_{f}_fn")]
    return out


def subgroup_columns(df: DataFrame, keep, formulas=FORMULAS, min_n: int = 100, min_sub: int = 10, p_value: bool = False) -> DataFrame:
    """Metrics of each subgroup, with ``p_value`` also the two-sided p of each correlation; small groups keep only n."""
    big = F.col("n") >= min_n
    cols = {}
    for f in formulas:
        cols[f"abs_r_{f}"] = F.when(big & (pair_n(f) > min_sub), F.abs(pair_corr(f)))
        if p_value:
            cols[f"p_{f}"] = corr_p(cols[f"abs_r_{f}"], pair_n(f))
    cols["improvement_corr"] = F.when(big, improvement(F.abs(pair_corr("bazett", min_sub + 1)),
                                                       F.abs(pair_corr("inverse_rr", min_sub + 1))))
    cols["n_norm"] = F.when(big, F.col("n_norm"))
    fp = big & (F.col("n_norm") > min_sub) & (F.col("n_class") > 0)
    for f in ("bazett", "inverse_rr"):
        cols[f"fp_{f}"] = F.when(fp, F.col(f"fp_{f}"))
        cols[f"fp_rate_{f}"] = F.when(fp, share(f"fp_{f}", "n_class"))
    cols["improvement_fp"] = F.when(fp, or_inf("fp_bazett", "fp_inverse_rr"))
    for t in ("green", "yellow", "red"):
        cols[f"triage_{t}"] = F.when(fp, F.col(f"triage_{t}"))
        cols[f"triage_{t}_pct"] = F.when(fp, share(f"triage_{t}", "n_class"))
    if "gs_bazett_tp" in df.columns:
        for f in ("bazett", "inverse_rr"):
            tp, fp_, tn, fn = (F.col(f"gs_{f}_{x}") for x in ("tp", "fp", "tn", "fn"))
            ok = big & (tp + fp_ + tn + fn > min_sub)
            sens, ppv = ratio(tp, tp + fn, None), ratio(tp, tp + fp_, None)
            for x, c in {"tp": tp, "fp": fp_, "tn": tn, "fn": fn, "sensitivity": sens, "specificity": ratio(tn, tn + fp_, None),
                         "ppv": ppv, "npv": ratio(tn, tn + fn, None),
                         "f1": F.try_divide(2 * sens * ppv, sens + ppv)}.items():
                cols[f"gs_{f}_{x}"] = F.when(ok, c)
    return df.select(*keep, "n", *[c.alias(n) for n, c in cols.items()])


def subgroup_metrics(df: DataFrame, by, formulas=FORMULAS, reference: str | None = "qtc_reference_ms", p_value: bool = False) -> DataFrame:
    """Subgroup metrics for one grouping."""
    return subgroup_columns(df.groupBy(*by).agg(*subgroup_aggregates(formulas, reference)), list(by), formulas, p_value=p_value)


def subgroup_report(df: DataFrame, formulas=FORMULAS, reference: str | None = "qtc_reference_ms", p_value: bool = False) -> DataFrame:
    """Subgroup metrics by age, sex, rate, dataset, rate x sex, rate x age and overall."""
    keys = {"age_group": bucketize("age", AGE_BINS), "sex_label": sex_label(), "hr_group": bucketize("hr_bpm", HR_BINS),
            "ds": F.col("dataset")}
    age, sex, hr = F.col("age_group"), F.col("sex_label"), F.col("hr_group")
    strata = [("Age", age), ("Sex", sex), ("Heart Rate", hr), ("Dataset", F.col("ds")),
              ("HR × Sex", F.concat(hr, F.lit(" × "), sex)), ("HR × Age", F.concat(hr, F.lit(" × "), age)),
              ("Overall", F.lit("All datasets"))]
    return subgroup_columns(stratify(df, keys, strata, subgroup_aggregates(formulas, reference)), ["kind", "label"], formulas, p_value=p_value)


def misleading(report: DataFrame) -> DataFrame:
    """Subgroups where the new formula has the larger |r| but the smaller false-positive rate."""
    return report.filter((F.col("abs_r_inverse_rr") > F.col("abs_r_bazett"))
                         & (F.col("fp_rate_bazett") > F.col("fp_rate_inverse_rr")))


# ---- rate zones ---------------------------------------------------------------------------
def hr_zone_report(df: DataFrame, min_zone: int = 100, min_sub: int = 10) -> DataFrame:
    """Size, rate, r of three formulas and NORM false positives per fine rate zone."""
    names = ["bazett", "inverse_rr", "fridericia"]
    valid = F.lit(True)
    for f in names:
        valid = valid & F.col(f"qtc_{f}").isNotNull()
    norm = F.col("superclass") == "NORM"
    flag = {f: prolonged(f"qtc_{f}", unknown=None, on_null=False) for f in ("bazett", "inverse_rr")}
    wide = df.groupBy("hr_zone").agg(
        F.count(F.lit(1)).alias("n"), *value_sums("hr_bpm", "hr", 75), *[c for f in names for c in pair_sums(f"qtc_{f}", "hr_bpm", f, valid)],
        F.count_if(norm).alias("n_norm"), *[F.count_if(norm & flag[f]).alias(f"fp_{f}") for f in flag],
    ).filter(F.col("hr_zone").isNotNull()).transform(with_enough, min_zone)
    some = F.col("n_norm") > min_sub
    r = {f: pair_corr(f, min_sub + 1) for f in names}
    return wide.select(
        "hr_zone", "n", "enough", value_mean("hr", 75).alias("hr_mean"), value_std("hr").alias("hr_std"),
        *[r[f].alias(f"r_{f}") for f in names], improvement(F.abs(r["bazett"]), F.abs(r["inverse_rr"])).alias("improvement"),
        "n_norm", *[F.when(some, F.col(f"fp_{f}")).alias(f"fp_{f}") for f in flag],
        *[F.when(some, share(f"fp_{f}", "n_norm")).alias(f"fp_rate_{f}") for f in flag],
        F.when(some, or_inf("fp_bazett", "fp_inverse_rr")).alias("fp_reduction"))


def bias_report(df: DataFrame, min_zone: int = 100) -> DataFrame:
    """Base minus new formula per rate zone: mean, sample std, percentiles and shares."""
    rows = df.withColumn("bias", F.col("qtc_bazett") - F.col("qtc_inverse_rr")).filter(F.col("hr_zone").isNotNull())
    wide = rows.groupBy("hr_zone").agg(
        F.count(F.lit(1)).alias("n"), F.avg("hr_bpm").alias("hr_mean"), F.count("bias").alias("m"), F.avg("bias").alias("bias_mean"),
        F.stddev_samp("bias").alias("bias_std"), F.count_if(F.abs("bias") > 20).alias("gt20"), F.count_if(F.abs("bias") > 40).alias("gt40"),
        F.count_if(F.col("bias") > 0).alias("over"), F.count_if(F.col("bias") < 0).alias("under")).transform(with_enough, min_zone)
    cuts = percentiles(rows, {"bias_median": ("bias", 0.5), "bias_p5": ("bias", 0.05), "bias_p95": ("bias", 0.95)}, ["hr_zone"])
    return join_groups(wide, cuts, ["hr_zone"]).select(
        "hr_zone", "n", "enough", "hr_mean", "bias_mean", "bias_std", "bias_median", "bias_p5", "bias_p95",
        share("gt20", "m").alias("pct_bias_gt_20ms"), share("gt40", "m").alias("pct_bias_gt_40ms"),
        share("over", "m").alias("pct_overcorrection"), share("under", "m").alias("pct_undercorrection"))


def bias_hr_corr(df: DataFrame) -> DataFrame:
    """Correlation of the bias (base minus new) with heart rate."""
    rows = df.withColumn("bias", F.col("qtc_bazett") - F.col("qtc_inverse_rr"))
    return rows.agg(*pair_sums("bias", "hr_bpm", "b", shift_y=0.0)).select(pair_n("b").alias("n"), pair_corr("b").alias("r_bias_hr"))


# ---- strata of five formulas --------------------------------------------------------------
def hr_stratum(hr="hr_bpm") -> Column:
    return F.coalesce(bucketize(hr, HR_STRATA), F.lit("Unknown"))


def stratum_profile(df: DataFrame, formulas=FORMULAS, min_n: int = 50) -> DataFrame:
    """r and its two-sided p, mean, population std, percentiles and share at or above 450/470/500 per stratum and formula."""
    rows = df.withColumn("hr_stratum", bucketize("hr_bpm", HR_STRATA)).filter(F.col("hr_stratum").isNotNull())
    sums = [c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)]
    above = [F.count_if(F.col(f"qtc_{f}") >= t).alias(f"{f}_ge_{t}") for f in formulas for t in (450, 470, 500)]
    wide = rows.groupBy("hr_stratum").agg(F.count(F.lit(1)).alias("n_rows"), F.min("hr_bpm").alias("hr_min"), F.max("hr_bpm").alias("hr_max"),
                                          *sums, *above).transform(with_enough, min_n, "n_rows")
    wanted = {f"{f}_{name}": (f"qtc_{f}", p) for f in formulas for name, p in (("median", 0.5), ("p5", 0.05), ("p95", 0.95))}
    joined = join_groups(wide, percentiles(rows, wanted, ["hr_stratum"]), ["hr_stratum"])
    fields = {"n": pair_n, "r": pair_corr, "p": lambda f: corr_p(pair_corr(f), pair_n(f)), "mean": pair_mean_y, "std": pair_std_y}
    fields |= {x: (lambda f, x=x: F.col(f"{f}_{x}")) for x in ("median", "p5", "p95")}
    fields |= {f"pct_ge_{t}": (lambda f, t=t: share(f"{f}_ge_{t}", pair_n(f))) for t in (450, 470, 500)}
    return per_formula_rows(joined, formulas, fields, ["hr_stratum", "n_rows", "enough", "hr_min", "hr_max"])


def two_way_counts(limit: float = 450, a="qtc_bazett", b="qtc_inverse_rr", tag: str = "") -> list[Column]:
    """Counts of both normal, both prolonged and one-sided calls at a fixed limit (inclusive)."""
    x, y = F.col(a) >= limit, F.col(b) >= limit
    return [F.count_if(~x & ~y).alias(f"{tag}both_normal"), F.count_if(x & y).alias(f"{tag}both_prolonged"),
            F.count_if(~x & y).alias(f"{tag}new_only"), F.count_if(x & ~y).alias(f"{tag}base_only")]


def stratum_concordance(df: DataFrame, limit: float = 450, min_n: int = 50) -> DataFrame:
    """Agreement of the base and the new formula per rate stratum."""
    rows = df.withColumn("hr_stratum", bucketize("hr_bpm", HR_STRATA)).filter(F.col("hr_stratum").isNotNull())
    wide = rows.groupBy("hr_stratum").agg(F.count(F.lit(1)).alias("n"), *two_way_counts(limit)).transform(with_enough, min_n)
    parts = ["both_normal", "both_prolonged", "new_only", "base_only"]
    return wide.select("hr_stratum", "n", "enough", *parts, *[share(p, "n").alias(f"pct_{p}") for p in parts],
                       share(F.col("both_normal") + F.col("both_prolonged"), "n").alias("concordance_rate"),
                       share(F.col("both_prolonged") + F.col("new_only"), "n").alias("new_prolongation_rate"),
                       share(F.col("both_prolonged") + F.col("base_only"), "n").alias("base_prolongation_rate"))


def extreme_cases(df: DataFrame, low: float = 45, high: float = 130, min_n: int = 20) -> DataFrame:
    """Size, |r|, mean and share above 450 of both formulas in the extreme tails."""
    keys = {"is_low": F.col("hr_bpm") < low, "is_high": F.col("hr_bpm") > high}
    strata = [("tail", label_if("is_low", f"HR_below_{low}")), ("tail", label_if("is_high", f"HR_above_{high}"))]
    names = ["inverse_rr", "bazett"]
    aggs = [F.count(F.lit(1)).alias("n"), F.min("hr_bpm").alias("min_hr"), F.max("hr_bpm").alias("max_hr")]
    aggs += [c for f in names for c in pair_sums(f"qtc_{f}", "hr_bpm", f)]
    aggs += [F.count_if(F.col(f"qtc_{f}") >= 450).alias(f"ge_{f}") for f in names]
    wide = stratify(df.filter((F.col("hr_bpm") < low) | (F.col("hr_bpm") > high)), keys, strata, aggs).transform(with_enough, min_n)
    return wide.select("label", "n", "enough", "min_hr", "max_hr", *[F.abs(pair_corr(f)).alias(f"abs_r_{f}") for f in names],
                       *[pair_mean_y(f).alias(f"mean_{f}") for f in names], *[share(f"ge_{f}", "n").alias(f"pct_ge_450_{f}") for f in names])


def extreme_verdict(profile: DataFrame, concordance: DataFrame, margin: float = 0.02, max_base_only: float = 10.0) -> DataFrame:
    """Whether the new formula holds up in slow and fast rates: |r| not worse by ``margin`` and few
    base-only calls in severe bradycardia."""
    r = profile.filter("enough").groupBy("hr_stratum").agg(F.max(F.when(F.col("formula") == "inverse_rr", F.abs("r"))).alias("new"),
                                          F.max(F.when(F.col("formula") == "bazett", F.abs("r"))).alias("base"))
    worse = F.col("new") > F.col("base") + margin
    part = r.agg((F.count_if(worse & F.col("hr_stratum").startswith("Brady")) == 0).alias("brady_ok"),
                 (F.count_if(worse & F.col("hr_stratum").startswith("Tachy")) == 0).alias("tachy_ok"))
    missed = concordance.filter("enough").agg((F.count_if((F.col("hr_stratum") == "Brady_severe") & (F.col("pct_base_only") > max_base_only)) == 0)
                             .alias("brady_fn_ok"))
    both = part.withColumn("__one", F.lit(1)).join(missed.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return both.withColumn("passes", F.col("brady_ok") & F.col("tachy_ok") & F.col("brady_fn_ok"))


# ---- demography ---------------------------------------------------------------------------
def demographic_bias(df: DataFrame, min_single: int = 100, min_cross: int = 50, min_corr: int = 20) -> DataFrame:
    """|r| of both formulas, mean age and rate by sex, age and rate group and their combinations."""
    keys = {"sex_label": sex_label(), "age_group": bucketize("age", AGE_BINS), "hr_group": bucketize("hr_bpm", HR_BINS)}
    sex, age, hr = F.col("sex_label"), F.col("age_group"), F.col("hr_group")
    strata = [("sex", sex), ("age", age), ("hr", hr), ("sex_age", F.concat(sex, F.lit("_"), age)),
              ("sex_hr", F.concat(sex, F.lit("_"), hr))]
    names = ["inverse_rr", "bazett"]
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("sex") == 0).alias("n_male"), F.min("hr_bpm").alias("min_hr"),
            F.max("hr_bpm").alias("max_hr"), *value_sums("age", "age", 50), *value_sums("hr_bpm", "hr", 75)]
    aggs += [c for f in names for c in pair_sums(f"qtc_{f}", "hr_bpm", f)]
    wide = stratify(df, keys, strata, aggs)
    enough = F.when(F.col("kind").isin("sex_age", "sex_hr"), min_cross).otherwise(min_single)
    return with_enough(wide, enough).select(
        "kind", "label", "n", "enough", *[F.abs(pair_corr(f, min_corr)).alias(f"abs_r_{f}") for f in names],
        *[pair_mean_y(f).alias(f"mean_{f}") for f in names], value_mean("age", 50).alias("mean_age"),
        value_mean("hr", 75).alias("mean_hr"), share("n_male", "n").alias("pct_male"), "min_hr", "max_hr")


def bias_range(report: DataFrame, limit: float = 0.02) -> DataFrame:
    """Spread of |r| between the groups of each kind that have enough rows and whether it exceeds ``limit``."""
    wide = report.filter("enough").groupBy("kind").agg(F.max("abs_r_inverse_rr").alias("max_abs_r"), F.min("abs_r_inverse_rr").alias("min_abs_r"),
                                      F.max_by("label", "abs_r_inverse_rr").alias("worse_group"))
    spread = F.col("max_abs_r") - F.col("min_abs_r")
    return wide.select("kind", "max_abs_r", "min_abs_r", spread.alias("range_abs_r"), (spread > limit).alias("bias_detected"), "worse_group")


def coverage(df: DataFrame) -> DataFrame:
    """Rows and known ages and sexes per dataset and overall."""
    return df.rollup("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("age").alias("n_age"), F.count("sex").alias("n_sex")).withColumn(
        "dataset", F.coalesce("dataset", F.lit("OVERALL")))


# ---- distributions ------------------------------------------------------------------------
BANDS = [("pct_below_350", None, 350), ("pct_350_400", 350, 400), ("pct_400_450", 400, 450), ("pct_450_470", 450, 470),
         ("pct_470_500", 470, 500), ("pct_above_500", 500, None)]
PERCENTS = [1, 5, 25, 50, 75, 95, 99]


def distribution(df: DataFrame, formulas=FORMULAS) -> DataFrame:
    """Mean, population std, percentiles, extremes and band shares of each correction."""
    aggs = []
    for f in formulas:
        q = F.col(f"qtc_{f}")
        aggs += [F.count(q).alias(f"{f}_n"), F.avg(q).alias(f"{f}_mean"), F.stddev_pop(q).alias(f"{f}_std"), F.min(q).alias(f"{f}_min"), F.max(q).alias(f"{f}_max")]
        for name, lo, hi in BANDS:
            inside = F.lit(True)
            inside = inside & (q >= lo) if lo is not None else inside
            inside = inside & (q < hi) if hi is not None else inside
            aggs.append((100.0 * F.avg(F.when(q.isNotNull(), inside.cast("double")))).alias(f"{f}_{name}"))
    wanted = {f"{f}_p{p}": (f"qtc_{f}", p / 100) for f in formulas for p in PERCENTS}
    joined = join_groups(df.agg(*aggs), percentiles(df, wanted), [])
    names = ["n", "mean", "std", "min", "max", *[f"p{p}" for p in PERCENTS], *[b[0] for b in BANDS]]
    return per_formula_rows(joined, formulas, {x: (lambda f, x=x: F.col(f"{f}_{x}")) for x in names}, [])


def threshold_compat(df: DataFrame, limits=(440, 450, 460, 470, 500)) -> DataFrame:
    """Share prolonged by each formula and their agreement at several fixed limits."""
    wide = df.filter(F.col("qtc_bazett").isNotNull() & F.col("qtc_inverse_rr").isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), *[c for t in limits for c in two_way_counts(t, tag=f"t{t}_")])
    rows = F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), *[F.col(f"t{t}_{x}").alias(x) for x in (
        "both_normal", "both_prolonged", "new_only", "base_only")]) for t in limits])
    m = wide.select("n", F.explode(rows).alias("m")).select("n", "m.*")
    return m.select("threshold", share(F.col("both_prolonged") + F.col("new_only"), "n").alias("new_pct_prolonged"),
                    share(F.col("both_prolonged") + F.col("base_only"), "n").alias("base_pct_prolonged"),
                    share(F.col("both_normal") + F.col("both_prolonged"), "n").alias("concordance"),
                    share("new_only", "n").alias("pct_new_only"), share("base_only", "n").alias("pct_base_only"))


def hr_scenarios(df: DataFrame, min_n: int = 100) -> DataFrame:
    """Mean of both formulas in overlapping rate ranges; ``enough``: more than ``min_n`` rows."""
    hr = F.col("hr_bpm")
    flags = {"resting": hr.between(60, 80), "bradycardia": hr < 50, "tachycardia": hr > 100, "post_exercise": hr.between(120, 150)}
    names = {"resting": "resting_hr_60_80", "bradycardia": "bradycardia_hr_below_50", "tachycardia": "tachycardia_hr_above_100",
             "post_exercise": "post_exercise_hr_120_150"}
    aggs = [F.count(F.lit(1)).alias("n"), *value_sums("qtc_inverse_rr", "new", 400), *value_sums("qtc_bazett", "base", 400)]
    wide = stratify(df, flags, [("scenario", label_if(f, names[f])) for f in flags], aggs).transform(with_enough, min_n + 1)
    return wide.select(F.col("label").alias("scenario"), "n", "enough", value_mean("new", 400).alias("new_mean"), value_mean("base", 400).alias("base_mean"),
                       (value_mean("new", 400) - value_mean("base", 400)).alias("difference"))


def category_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows per value and their percentage; the total is taken over the counted values."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return join_groups(counts, total, []).withColumn("pct", share("n", "__total")).drop("__total")
