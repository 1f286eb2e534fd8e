"""Evaluation of candidate formulas: catalog, metrics, scores, utility and plausibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoqt.fixed_values import HR_CANDIDATE_BINS, HR_VALIDATION_BINS
from isoqt.functions.classify import bucketize
from isoqt.functions.clean import clip
from isoqt.functions.equations import formula_column, formula_features, full_formula, usable_formulas
from isoqt.functions.formulas import improvement, unified_score
from isoqt.functions.tails import corr_p
from isoqt.operators.moments import pair_corr, pair_mean_y, pair_n, pair_std_y, pair_sums
from isoqt.operators.quantiles import join_groups, percentiles
from isoqt.operators.ranks import spearman
from isoqt.operators.reference import attach
from isoqt.plans.cells import add_up, share, stratify, with_enough
from isoqt.plans.strata import per_formula_rows

# Standard corrections every catalog ends with (fixed values): name, approach, equation, year.
STANDARD = [
    ("bazett", "factor", "inv(sqrt(RR))", 1920), ("fridericia", "factor", "inv(cbrt(RR))", 1920),
    ("framingham", "additive", "154 * (1 - RR)", 1992), ("hodges", "additive", "1.75 * (HR - 60)", 1983),
]


class FormulaCatalog:
    """Formulas to evaluate: user rows (deduplicated, checked, best score first) and the standards.

    A catalog is a list of equations, at most a few hundred; it is read on the driver to build
    one projection, never joined to the data.
    """

    def __init__(self, spark: SparkSession, rows: list[dict]) -> None:
        self.spark, self.rows = spark, rows

    @classmethod
    def from_df(cls, df: DataFrame, top: int | None = None, standards: bool = True) -> FormulaCatalog:
        spark = df.sparkSession
        score = F.coalesce(F.col("score"), F.lit(1.0)) if "score" in df.columns else F.lit(1.0)
        unique = df.groupBy("equation").agg(F.min_by(F.struct("name", "approach", "complexity"), "name").alias("f"), F.min(score).alias("score"))
        ordered = unique.select("f.*", "equation", "score").orderBy("score", "name")
        found = [r.asDict() for r in (ordered.limit(top) if top else ordered).collect()]
        usable = usable_formulas(spark, [(r["equation"], r["approach"]) for r in found])
        rows = [{**r, "is_standard": False} for r, ok in zip(found, usable) if ok]
        if standards:
            rows += [{"name": n, "approach": a, "equation": e, "complexity": None, "score": None, "is_standard": True} for n, a, e, _ in STANDARD]
        taken = set()
        for r in rows:  # the best of several equations with one name keeps it
            base, k = r["name"], 1
            while r["name"] in taken:
                k += 1
                r["name"] = f"{base}_{k}"
            taken.add(r["name"])
        return cls(spark, rows)

    @property
    def names(self) -> list[str]:
        return [r["name"] for r in self.rows]

    def to_df(self) -> DataFrame:
        schema = "name string, approach string, equation string, complexity bigint, score double, is_standard boolean"
        rows = [(r["name"], r["approach"], r["equation"], r["complexity"], r["score"], r["is_standard"]) for r in self.rows]
        return self.spark.createDataFrame(rows, schema).withColumn("full_formula", full_formula())

    def apply(self, df: DataFrame, stored: bool = True) -> DataFrame:
        """One ``qtc_<name>`` column per formula; a column the table already has is kept if ``stored``."""
        new = {f"qtc_{r['name']}": formula_column(r["equation"], r["approach"]) for r in self.rows
               if not (stored and f"qtc_{r['name']}" in df.columns)}
        return df.withColumns(new) if new else df


# ---- metrics ------------------------------------------------------------------------------
def evaluate_formulas(df: DataFrame, formulas, by=("dataset",), reference: str = "qtc_reference_ms", min_n: int = 10, rank: bool = False,
                      p_value: bool = False) -> DataFrame:
    """n, r, |r|, MAE, RMSE, mean, population std and CV of every formula per group, one scan.

    With ``rank`` also Spearman's rho, which needs the ranks of each formula; with ``p_value`` the two-sided p of r.
    """
    by, aggs = list(by), []
    for f in formulas:
        q = F.col(f"qtc_{f}")
        ok = q.isNotNull() & F.col(reference).isNotNull() & F.col("hr_bpm").isNotNull()
        error = F.when(ok, q - F.col(reference))
        aggs += [*pair_sums(q, "hr_bpm", f, ok), F.sum(F.abs(error)).alias(f"{f}__ae"), F.sum(error * error).alias(f"{f}__se")]
    wide = df.groupBy(*by).agg(*aggs)

    def when_enough(c):
        return lambda f: F.when(pair_n(f) >= min_n, c(f))

    out = per_formula_rows(wide, formulas, {
        "n": pair_n, "r": when_enough(pair_corr), "mae": when_enough(lambda f: F.col(f"{f}__ae") / pair_n(f)),
        "rmse": when_enough(lambda f: F.sqrt(F.col(f"{f}__se") / pair_n(f))), "mean": when_enough(pair_mean_y), "std": when_enough(pair_std_y)}, by)
    out = out.withColumns({"abs_r": F.abs("r"), "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))})
    if p_value:
        out = out.withColumn("p", corr_p("r", "n"))
    if not rank:
        return out
    values = F.array(*[F.struct(F.lit(f).alias("formula"), F.col(f"qtc_{f}").alias("q")) for f in formulas])
    known = df.filter(F.col(reference).isNotNull() & F.col("hr_bpm").isNotNull())
    long = known.select(*by, "hr_bpm", F.explode(values).alias("m")).select(*by, "hr_bpm", "m.*")
    rho = spearman(long, "q", "hr_bpm", [*by, "formula"], min_n).drop("n")
    return join_groups(out, rho, [*by, "formula"])


def cross_dataset_summary(metrics: DataFrame) -> DataFrame:
    """Weighted, mean, median, worst and best |r| per formula over its datasets."""
    known = metrics.filter(F.col("abs_r").isNotNull())
    a = F.col("abs_r")
    return known.groupBy("formula").agg(
        F.count(F.lit(1)).alias("n_datasets"), F.sum("n").alias("total_n"), (F.sum(a * F.col("n")) / F.sum("n")).alias("weighted_abs_r"), F.avg(a).alias("mean_abs_r"),
        F.percentile(a, 0.5).alias("median_abs_r"), F.max(a).alias("worst_abs_r"), F.min(a).alias("best_abs_r"), F.stddev_pop("r").alias("std_r"),
        F.stddev_pop(a).alias("std_abs_r"), F.bool_and(a < 0.05).alias("all_below_005"), F.bool_and(a < 0.10).alias("all_below_010"),
        (100.0 * F.avg((a < 0.05).cast("double"))).alias("pct_below_005"))


RANKINGS = {"weighted": "weighted_abs_r", "unweighted": "mean_abs_r", "median": "median_abs_r", "worst_case": "worst_abs_r"}


def rank_formulas(summary: DataFrame, n: int = 10, standards=tuple(s[0] for s in STANDARD)) -> DataFrame:
    """First ``n`` formulas by four summaries, and their ratio to the best standard one."""
    rows = F.array(*[F.struct(F.lit(k).alias("ranking"), F.coalesce(F.col(c), F.lit(1.0)).alias("value")) for k, c in RANKINGS.items()])
    long = summary.select("formula", F.explode(rows).alias("m")).select("formula", "m.*").withColumn("is_standard", F.col("formula").isin(*standards))
    best = long.filter("is_standard").groupBy("ranking").agg(F.min("value").alias("best_standard"))
    order = Window.partitionBy("ranking").orderBy(F.round("value", 12), "formula")
    ranked = long.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)
    return ranked.join(best, "ranking", "left").select("ranking", "rank", "formula", "value", "is_standard",
                                                       improvement("best_standard", "value", 0.0).alias("improvement_vs_best_standard"))


def evaluate_candidates(df: DataFrame, catalog: FormulaCatalog, n: int = 10, min_complexity: int = 3, max_complexity: int = 7, reference: str = "qtc_reference_ms") -> DataFrame:
    """Candidates within a complexity range: clipped QTc metrics, score (lower is better), first n."""
    chosen = [r for r in catalog.rows if not r["is_standard"] and r["complexity"] is not None and min_complexity <= r["complexity"] <= max_complexity]
    rows = df.withColumns({f"qtc_{r['name']}": clip(formula_column(r["equation"], r["approach"])) for r in chosen})
    metrics = evaluate_formulas(rows, [r["name"] for r in chosen], (), reference)
    table = catalog.to_df().select(F.col("name").alias("formula"), "approach", "equation", "complexity", "full_formula")
    scored = metrics.join(table, "formula").select(
        "approach", "complexity", "formula", "equation", "full_formula", F.round("r", 4).alias("r_vs_hr"), F.round("abs_r", 4).alias("abs_r_hr"),
        F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"))
    return scored.withColumn("score", unified_score("abs_r_hr", "complexity", max_complexity)).orderBy("score", "formula").limit(n)


def candidate_comparison(df: DataFrame, formulas, reference: str = "qtc_reference_ms") -> DataFrame:
    """Metrics of a candidate next to the standards, with r against the reference, rounded."""
    aggs = [c for f in formulas for c in pair_sums(f"qtc_{f}", reference, f"{f}_ref", F.col("hr_bpm").isNotNull(), shift_x=400.0)]
    ref = per_formula_rows(df.agg(*aggs), formulas, {"r_vs_ref": lambda f: F.round(pair_corr(f"{f}_ref", 10), 4)}, [])
    m = evaluate_formulas(df, formulas, (), reference)
    return m.select("formula", F.round("r", 4).alias("r_vs_hr"), *[F.round(c, 2).alias(c) for c in ("mae", "rmse", "mean", "std")]).join(ref, "formula")


def candidate_hr_bins(df: DataFrame, candidate: str, min_n: int = 10) -> DataFrame:
    """Mean of a candidate (and its std) and of two standards in five rate bins, 2 decimals."""
    rows = df.withColumn("bin", bucketize("hr_bpm", HR_CANDIDATE_BINS)).filter(F.col("bin").isNotNull())
    out = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f"qtc_{candidate}"), 2).alias("candidate_mean"),
                                  F.round(F.stddev_pop(f"qtc_{candidate}"), 2).alias("candidate_std"), F.round(F.avg("qtc_bazett"), 2).alias("bazett_mean"),
                                  F.round(F.avg("qtc_fridericia"), 2).alias("fridericia_mean"))
    return with_enough(out, min_n)


def candidate_by_dataset(df: DataFrame, candidate: str, min_n: int = 100, min_valid: int = 50) -> DataFrame:
    """r of a candidate and the base formula per dataset, and the improvement."""
    ok = F.col(f"qtc_{candidate}").isNotNull()
    wide = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *pair_sums(f"qtc_{candidate}", "hr_bpm", "cand"), *pair_sums("qtc_bazett", "hr_bpm", "base", ok))
    return wide.withColumn("enough", (F.col("n") >= min_n) & (pair_n("cand") >= min_valid)).select(
        "dataset", "n", "enough", F.round(pair_corr("cand"), 4).alias("r_candidate"), F.round(pair_corr("base"), 4).alias("r_bazett"),
        F.round(improvement(F.abs(pair_corr("base")), F.abs(pair_corr("cand")), 0.0001), 1).alias("improvement"))


def lodo(df: DataFrame, formulas, min_n: int = 10) -> DataFrame:
    """Leave one dataset out: |r| on the rest (total minus the held-out sums) and on the held-out."""
    cells = df.groupBy("dataset").agg(*[c for f in formulas for c in pair_sums(f"qtc_{f}", "hr_bpm", f)])
    names = [c for c in cells.columns if c != "dataset"]
    total = add_up(cells.drop("dataset"), [], []).select(*[F.col(c).alias(f"all_{c}") for c in names])
    rest = cells.withColumn("__one", F.lit(1)).join(total.withColumn("__one", F.lit(1)), "__one").select(
        "dataset", *names, *[(F.col(f"all_{c}") - F.col(c)).alias(f"rest_{c}") for c in names])
    return per_formula_rows(rest, formulas, {
        "n_rest": lambda f: pair_n(f"rest_{f}"), "abs_r_rest": lambda f: F.abs(pair_corr(f"rest_{f}", min_n)), "n_held_out": pair_n,
        "abs_r_held_out": lambda f: F.abs(pair_corr(f, min_n))}, ["dataset"]).withColumnRenamed("dataset", "held_out")


def best_approach(metrics: DataFrame) -> DataFrame:
    """Approach with the smallest |r| on the test rows."""
    return metrics.agg(F.min_by(F.struct("approach", "formula", "abs_r_hr"), F.struct("abs_r_hr", "approach", "formula")).alias("b")).select("b.*")


# ---- clinical utility ---------------------------------------------------------------------
def clinical_utility(df: DataFrame, candidate: str, base: str = "qtc_bazett", min_n: int = 100, min_bin: int = 10) -> DataFrame:
    """Reclassification of a candidate against the base formula, overall and by rate bin.

    Strict comparison with 450 (460 for female); nothing is reported below ``min_n`` valid rows.
    """
    q, b = F.col(f"qtc_{candidate}"), F.col(base)
    limit = F.when(F.coalesce(F.col("sex") == 1, F.lit(False)), 460.0).otherwise(450.0)
    was, now = b > limit, q > limit
    valid = df.filter(q.isNotNull() & b.isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(was).alias("base_prolonged"), F.count_if(now).alias("new_prolonged"),
            F.count_if(was & ~now).alias("to_normal"), F.count_if(~was & now).alias("to_prolonged")]
    wide = stratify(valid, {"h": bucketize("hr_bpm", HR_VALIDATION_BINS)}, [("hr", F.col("h")), ("overall", F.lit("OVERALL"))], aggs)
    total = F.max(F.when(F.col("kind") == "overall", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    ratio = F.when(F.col("to_prolonged") > 0, F.col("to_normal") / F.col("to_prolonged")).when(F.col("to_normal") > 0, F.lit(float("inf"))).otherwise(1.0)
    return wide.withColumn("total", total).filter((F.col("total") >= min_n) & ((F.col("kind") == "overall") | (F.col("n") >= min_bin))).select(
        "kind", "label", "n", "base_prolonged", share("base_prolonged", "n").alias("base_prolonged_pct"), "new_prolonged", share("new_prolonged", "n").alias("new_prolonged_pct"),
        "to_normal", "to_prolonged", (F.col("to_normal") - F.col("to_prolonged")).alias("net"), ratio.alias("benefit_risk_ratio"))


# ---- plausibility -------------------------------------------------------------------------
def _points(ladder, otherwise=0):
    (cond, points), *rest = ladder
    out = F.when(cond, points)
    for c, p in rest:
        out = out.when(c, p)
    return out.otherwise(otherwise)


def plausibility(df: DataFrame, formulas, min_n: int = 100, min_quartile: int = 10) -> DataFrame:
    """Range, effectiveness, percentiles, mean per rate quartile and a 0-100 score with its grade.

    Formulas are judged on the rows where they give a value.
    """
    formulas = list(formulas)
    values = F.array(*[F.struct(F.lit(f).alias("formula"), F.col(f"qtc_{f}").alias("q")) for f in formulas])
    long = df.select("hr_bpm", "qt_ms", F.explode(values).alias("m")).select("hr_bpm", "qt_ms", "m.*").filter(F.col("q").isNotNull())
    wanted = {f"hr_q{p}": ("hr_bpm", p / 100) for p in (25, 50, 75)} | {f"p{p}": ("q", p / 100) for p in (1, 5, 25, 50, 75, 95, 99)}
    cuts = percentiles(long, wanted, ["formula"])
    hr = F.col("hr_bpm")
    quartile = (F.when(hr <= F.col("hr_q25"), 1).when(hr <= F.col("hr_q50"), 2).when(hr <= F.col("hr_q75"), 3).when(hr > F.col("hr_q75"), 4))
    rows = attach(long, cuts, ["formula"]).withColumn("quartile", quartile)
    wide = rows.groupBy("formula").agg(
        F.count(F.lit(1)).alias("n"), F.min("q").alias("min"), F.max("q").alias("max"), F.count_if(F.col("q") < 250).alias("low"), F.count_if(F.col("q") > 650).alias("high"),
        *pair_sums("q", "hr_bpm", "q"), *pair_sums("qt_ms", "hr_bpm", "qt"), F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"),
        *[F.when(F.count_if(F.col("quartile") == i) > min_quartile, F.avg(F.when(F.col("quartile") == i, F.col("q")))).alias(f"mean_q{i}") for i in (1, 2, 3, 4)],
    ).filter(F.col("n") >= min_n)
    means = [F.col(f"mean_q{i}") for i in (1, 2, 3, 4)]
    known = F.size(F.array_compact(F.array(*means)))
    wide = wide.withColumns({
        "pct_in_range": 100.0 * (1 - (F.col("low") + F.col("high")) / F.col("n")), "r_qtc_hr": pair_corr("q", 10), "r_qt_hr": pair_corr("qt", 10),
        "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean")), "max_quartile_diff": F.when(known >= 2, F.greatest(*means) - F.least(*means))})
    r, diff, cv, inside = F.abs("r_qtc_hr"), F.col("max_quartile_diff"), F.col("cv"), F.col("pct_in_range")
    effectiveness = F.when(F.abs("r_qt_hr") > 0.01, 1 - r / F.abs("r_qt_hr")).otherwise(0.0)
    score = (_points([(inside >= 99, 30), (inside >= 95, 20), (inside >= 90, 10)]) + _points([(r < 0.02, 40), (r < 0.05, 30), (r < 0.10, 20), (r < 0.15, 10)])
             + _points([(diff < 5, 20), (diff < 10, 15), (diff < 20, 10)]) + _points([(cv < 0.08, 10), (cv < 0.12, 5)]))
    wide = wide.withColumns({"correction_effectiveness": effectiveness, "score": score.cast("bigint")})
    grade = F.when(F.col("score") >= 80, "Excellent").when(F.col("score") >= 60, "Good").when(F.col("score") >= 40, "Acceptable").otherwise("Poor")
    return join_groups(wide, cuts, ["formula"]).select(
        "formula", "n", "min", "max", F.col("low").alias("out_of_range_low"), F.col("high").alias("out_of_range_high"), "pct_in_range", "r_qtc_hr", "r_qt_hr",
        "correction_effectiveness", "mean", "std", "cv", *[f"p{p}" for p in (1, 5, 25, 50, 75, 95, 99)], *[f"mean_q{i}" for i in (1, 2, 3, 4)],
        "max_quartile_diff", "score", grade.alias("grade"))


def interest(catalog: DataFrame, summary: DataFrame, base: str = "bazett") -> DataFrame:
    """0-100 interest score of each candidate: improvement, generality, novelty and simplicity."""
    features = formula_features(catalog.filter(~F.col("is_standard")))
    ref = summary.filter(F.col("formula") == base).select(F.col("weighted_abs_r").alias("__base"), F.lit(1).alias("__one"))
    rows = (features.join(summary.select(F.col("formula").alias("name"), "weighted_abs_r", "mean_abs_r", "std_abs_r"), "name", "left")
            .withColumn("__one", F.lit(1)).join(ref, "__one", "left"))
    gain, r, ops = improvement("__base", "weighted_abs_r", 0.0), F.col("mean_abs_r"), F.col("n_operations")
    score = (_points([(gain > 5, 35), (gain > 3, 25), (gain > 2, 15), (gain > 1.5, 10)]) + _points([(r < 0.03, 25), (r < 0.05, 20), (r < 0.08, 15), (r < 0.10, 10)])
             + F.when(F.col("similarity").isin("Novel structure", "Direct approach (novel)"), 20).otherwise(5)
             + _points([(ops <= 2, 20), (ops <= 4, 15), (ops <= 6, 10)]) - F.when(F.col("has_log") | F.col("has_exp"), 5).otherwise(0))
    rows = rows.withColumns({"improvement": gain, "score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint"), "cv_r": F.when(r > 0, F.col("std_abs_r") / r)})
    s = F.col("score")
    grade = F.when(s >= 70, "High").when(s >= 50, "Moderate").when(s >= 30, "Low").otherwise("Minimal")
    potential = F.when(s >= 75, "tier-1").when(s >= 50, "specialty").when(s >= 30, "needs validation").otherwise("limited")
    return rows.select("name", "approach", "n_operations", "similarity", "improvement", "mean_abs_r", "cv_r", F.col("score").alias("interest_score"),
                       grade.alias("interest_grade"), potential.alias("publication_potential"))


# ---- agreement of two measuring methods ---------------------------------------------------
def method_agreement(df: DataFrame, target_r: float = 0.05, min_n: int = 100) -> DataFrame:
    """Two paired measurements (qt_a, rr_a, qt_b, rr_b): success, correlation, difference, |r| of
    both formulas per method and whether it stays below the target. Rates come from method a."""
    def corrected(m):
        qt, rr = F.col(f"qt_{m}"), F.when(F.col(f"rr_{m}") > 0, F.col(f"rr_{m}"))
        return {f"new_{m}": qt + 125.0 / rr - 158.0, f"base_{m}": qt / F.sqrt(rr)}
    rows = df.withColumns({**corrected("a"), **corrected("b"), "hr": F.lit(60.0) / F.when(F.col("rr_a") > 0, F.col("rr_a")), "diff": F.col("qt_a") - F.col("qt_b")})
    both = F.col("qt_a").isNotNull() & F.col("qt_b").isNotNull()
    d = F.when(both, F.col("diff"))
    wide = rows.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(both).alias("n_both_valid"), F.count("qt_a").alias("ok_a"), F.count("qt_b").alias("ok_b"),
                    *pair_sums("qt_a", "qt_b", "qt", both, shift_x=400.0), *pair_sums("rr_a", "rr_b", "rr", both, shift_y=0.8, shift_x=0.8),
                    F.avg(d).alias("qt_mean_diff"), F.stddev_samp(d).alias("qt_std_diff"),
                    *[c for t in ("new_a", "new_b", "base_a", "base_b") for c in pair_sums(t, "hr", t, both)])
    some = F.col("n_both_valid") >= min_n
    r = {t: F.when(some, F.abs(pair_corr(t))) for t in ("new_a", "new_b", "base_a", "base_b")}
    return wide.select("n_total", "n_both_valid", share("ok_a", "n_total").alias("success_rate_a"), share("ok_b", "n_total").alias("success_rate_b"),
                       F.when(some, pair_corr("qt")).alias("qt_correlation"), F.when(some, pair_corr("rr")).alias("rr_correlation"), F.when(some, F.col("qt_mean_diff")).alias("qt_mean_diff"),
                       F.when(some, F.col("qt_std_diff")).alias("qt_std_diff"), *[c.alias(f"abs_r_{t}") for t, c in r.items()],
                       (r["new_a"] < target_r).alias("passes_a"), (r["new_b"] < target_r).alias("passes_b"), ((r["new_a"] < target_r) & (r["new_b"] < target_r)).alias("passes_both"))


def manual_check(df: DataFrame, target_r: float = 0.05) -> DataFrame:
    """|r| and its two-sided p for both formulas on hand-annotated rows within the valid range, and the pass flag."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *pair_sums("qtc_inverse_rr", "hr_bpm", "new"), *pair_sums("qtc_bazett", "hr_bpm", "base"))
    r, b = F.abs(pair_corr("new")), F.abs(pair_corr("base"))
    return wide.select("n", r.alias("abs_r_inverse_rr"), corr_p(r, pair_n("new")).alias("p_inverse_rr"), b.alias("abs_r_bazett"), corr_p(b, pair_n("base")).alias("p_bazett"),
                       (r < target_r).alias("passes"))
