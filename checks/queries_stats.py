"""Statistics: correlations, references, quantiles, confusion, sweeps, bootstrap, sources of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (METRICS, case, counts_sql, each, ecg, metrics_list, p_sql, poly_cte, query, rsafe, strata_sql, thr, union, with_ecg)
from isoqt import fixed_values as fv
from isoqt.functions import classify as cl
from isoqt.functions import tails
from isoqt.functions.formulas import FORMULAS, all_qtc
from isoqt.operators import bootstrap, moments, ranks, reference, schema, sweep
from isoqt.operators import confusion as cf
from isoqt.operators.quantiles import percentiles
from isoqt.plans import candidates, clinical, manuscript, strata

E = with_ecg


def qtc(spark, sf_dir, preset="c158"):
    return all_qtc(ecg(spark, sf_dir), preset)


def with_ref(spark, sf_dir):
    """Corrections and a quadratic reference fitted over all rows."""
    return reference.poly_reference(qtc(spark, sf_dir), 2, "rr1")


REF = poly_cte("e", 2, "")  # CTEs ending in pf
REF_Q = "qt_ms - qt_expected + at_one"


@query("e01_hr_corr", E(each(FORMULAS, "SELECT dataset, count(*) AS n_rows, '{f}' AS formula, count(q_{f}) AS n, corr(q_{f}, hr_bpm) AS r, abs(corr(q_{f}, hr_bpm)) AS abs_r FROM e GROUP BY dataset")),
       dbl="r abs_r")
def _(spark, sf_dir):
    return moments.hr_corr(qtc(spark, sf_dir), by=["dataset"])


def _corr_by(f):
    return (f"SELECT dataset, superclass, '{f}' AS formula, count(*) AS n_rows, count(q_{f}) AS n, CASE WHEN count(q_{f}) >= 10 THEN corr(q_{f}, hr_bpm) END AS r, "
            f"CASE WHEN count(q_{f}) >= 10 THEN abs(corr(q_{f}, hr_bpm)) END AS abs_r FROM e GROUP BY dataset, superclass")


@query("e02_corr_p", E(f"SELECT *, {p_sql('r', 'n')} AS p FROM ({union(_corr_by(f) for f in FORMULAS)})"), dbl="r abs_r p")
def _(spark, sf_dir):
    out = moments.hr_corr(qtc(spark, sf_dir), by=["dataset", "superclass"])
    return out.withColumn("p", tails.corr_p("r", "n"))


_RANK = "(rank() OVER (PARTITION BY dataset ORDER BY {c}) + (count(*) OVER (PARTITION BY dataset, {c}) - 1) / 2e0)"


@query("e03_spearman", E(f"""SELECT dataset, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT dataset, {_RANK.format(c='q_bazett')} AS rx, {_RANK.format(c='hr_bpm')} AS ry
  FROM e WHERE q_bazett IS NOT NULL) GROUP BY dataset"""), dbl="rho")
def _(spark, sf_dir):
    return ranks.spearman(qtc(spark, sf_dir), "qtc_bazett", "hr_bpm", ["dataset"])


def _metric_sql(f, ref="q_fridericia", by="dataset"):
    return f"""SELECT {by}, '{f}' AS formula, count(q_{f}) AS n, corr(q_{f}, hr_bpm) AS r, avg(abs(q_{f} - {ref})) AS mae, sqrt(avg((q_{f} - {ref}) * (q_{f} - {ref}))) AS rmse,
      avg(q_{f}) AS mean, stddev_pop(q_{f}) AS std, abs(corr(q_{f}, hr_bpm)) AS abs_r, stddev_pop(q_{f}) / avg(q_{f}) AS cv FROM e GROUP BY {by}"""


_RHO = union(f"""SELECT dataset, '{f}' AS formula, corr(rx, ry) AS rho FROM (SELECT dataset, {_RANK.format(c='q_' + f)} AS rx, {_RANK.format(c='hr_bpm')} AS ry
  FROM e WHERE q_{f} IS NOT NULL) GROUP BY dataset""" for f in ("bazett", "inverse_rr"))


@query("e04_formula_metrics", E(f"SELECT *, {p_sql('r', 'n')} AS p FROM ({union(_metric_sql(f) for f in ('bazett', 'inverse_rr'))}) JOIN ({_RHO}) USING (dataset, formula)"),
       dbl="r mae rmse mean std abs_r cv rho p")
def _(spark, sf_dir):
    df = qtc(spark, sf_dir).withColumn("qtc_reference_ms", F.col("qtc_fridericia"))
    return candidates.evaluate_formulas(df, ["bazett", "inverse_rr"], rank=True, p_value=True)


SEX = "CASE sex WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END"


_STRATA = [("hr", case("hr_bpm", fv.HR_VALIDATION_BINS)), ("sex", SEX), ("age", case("age", fv.AGE_VALIDATION_BINS)), ("superclass", "superclass")]


@query("e05_stratified_metrics", E(each(FORMULAS, strata_sql(
    _STRATA, "'{f}' AS formula, count(q_{f}) AS n, avg(q_{f}) AS mean, stddev_pop(q_{f}) AS std, CASE WHEN count(q_{f}) >= 10 THEN corr(q_{f}, hr_bpm) END AS r, count(q_{f}) >= 10 AS enough"))),
       dbl="mean std r")
def _(spark, sf_dir):
    return strata.stratified_metrics(qtc(spark, sf_dir))


_M = union(f"SELECT dataset, '{f}' AS formula, count(q_{f}) AS n, corr(q_{f}, hr_bpm) AS r, abs(corr(q_{f}, hr_bpm)) AS a FROM e GROUP BY dataset" for f in FORMULAS)
SUMMARY = """SELECT formula, count(*) AS n_datasets, CAST(sum(n) AS BIGINT) AS total_n, sum(a * n) / sum(n) AS weighted_abs_r, avg(a) AS mean_abs_r, quantile_cont(a, 0.5) AS median_abs_r,
  max(a) AS worst_abs_r, min(a) AS best_abs_r, stddev_pop(r) AS std_r, stddev_pop(a) AS std_abs_r, bool_and(a < 0.05) AS all_below_005, bool_and(a < 0.1) AS all_below_010,
  100e0 * avg(CAST(a < 0.05 AS INTEGER)) AS pct_below_005 FROM m GROUP BY formula"""


def _summary(spark, sf_dir):
    return candidates.cross_dataset_summary(moments.hr_corr(qtc(spark, sf_dir), by=["dataset"]))


@query("e06_cross_dataset_summary", E(SUMMARY, more=f"m AS ({_M})"),
       dbl="weighted_abs_r mean_abs_r median_abs_r worst_abs_r best_abs_r std_r std_abs_r pct_below_005")
def _(spark, sf_dir):
    return _summary(spark, sf_dir)


WR = each(FORMULAS, "SELECT '{f}' AS formula, sum(a * n) / sum(n) AS weighted_r FROM (SELECT count(*) AS n, abs(corr(q_{f}, hr_bpm)) AS a FROM e GROUP BY dataset)")


@query("e07_population_weighted_r", E(WR, c=-125), dbl="weighted_r")
def _(spark, sf_dir):
    return manuscript.population_weighted_r(qtc(spark, sf_dir, "c125"))


_RK = union(f"SELECT '{k}' AS ranking, formula, {c} AS value FROM s" for k, c in candidates.RANKINGS.items())


@query("e08_rank_formulas", E(f"""SELECT ranking, rank, formula, value, is_standard, CASE WHEN value > 0 THEN best / value ELSE CAST('inf' AS DOUBLE) END AS improvement_vs_best_standard FROM
 (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY round(value, 12), formula) AS rank, formula <> 'inverse_rr' AS is_standard,
  min(CASE WHEN formula <> 'inverse_rr' THEN value END) OVER (PARTITION BY ranking) AS best FROM ({_RK})) WHERE rank <= 3""", more=f"m AS ({_M}), s AS ({SUMMARY})"),
       dbl="value improvement_vs_best_standard")
def _(spark, sf_dir):
    return candidates.rank_formulas(_summary(spark, sf_dir), 3)


C3 = """CASE WHEN {q} IS NULL THEN 'invalid' WHEN {q} <= CASE WHEN sex = 1 THEN 460 ELSE 450 END THEN 'normal'
 WHEN {q} <= CASE WHEN sex = 1 THEN 480 ELSE 470 END THEN 'borderline' ELSE 'prolonged' END"""
_GS = each(FORMULAS, "SELECT '{f}' AS formula, " + counts_sql("t", f"(({C3.format(q='q_{f}')}) = 'prolonged')") + " FROM g")
_GS_MORE = f"{REF}, g AS (SELECT *, ({C3.format(q='(' + REF_Q + ')')}) = 'prolonged' AS t FROM pf)"


@query("e09_rank_by_metrics", E("SELECT metric, formula, rank() OVER (PARTITION BY metric ORDER BY v DESC) AS rank, round(v, 4) AS value FROM (" + union(
    f"SELECT '{m}' AS metric, formula, {m} AS v FROM x" for m in ("sensitivity", "specificity", "f1", "youden_j", "mcc")) + ")",
    more=f"{_GS_MORE}, x AS (SELECT formula, {metrics_list()} FROM ({_GS}))"), dbl="value")
def _(spark, sf_dir):
    return clinical.rank_by_metrics(clinical.gold_standard(with_ref(spark, sf_dir)))


@query("e10_poly_reference", E(f"SELECT ecg_id, dataset, qt_expected AS qt_expected_ms, {REF_Q} AS qtc_reference_ms FROM pf", more=poly_cte("e", 2)), dbl="qt_expected_ms qtc_reference_ms")
def _(spark, sf_dir):
    return reference.poly_reference(ecg(spark, sf_dir), 2, "rr1", ["dataset"]).select("ecg_id", "dataset", "qt_expected_ms", "qtc_reference_ms")


@query("e11_poly_reference_degree6", E("SELECT ecg_id, dataset, qt_ms - qt_expected + mean_y AS qtc_reference FROM pf", more=poly_cte("e", 6)), dbl="qtc_reference")
def _(spark, sf_dir):
    return reference.stored_or_fitted_reference(ecg(spark, sf_dir), 6).select("ecg_id", "dataset", "qtc_reference")


@query("e11_stored_reference", E("""SELECT ecg_id, dataset, CASE WHEN dataset IN ('ds_a', 'ds_b') THEN q_fridericia ELSE qt_ms - qt_expected + mean_y END AS qtc_reference FROM pf""", more=poly_cte("e", 6)),
       dbl="qtc_reference")
def _(spark, sf_dir):
    df = qtc(spark, sf_dir).withColumn("qtc_reference_ms", F.when(F.col("dataset").isin("ds_a", "ds_b"), F.col("qtc_fridericia")))
    return reference.stored_or_fitted_reference(df, 6).select("ecg_id", "dataset", "qtc_reference")


RES = (poly_cte("e", 3, "dataset, sex", "rs") + ", rs2 AS (SELECT *, CASE WHEN fit_n >= 100 AND sex IS NOT NULL THEN qt_ms - qt_expected END AS res FROM rs), "
       "rc AS (SELECT dataset, sex, quantile_cont(res, 0.975) AS cut FROM rs2 GROUP BY dataset, sex)")


@query("e12_residual_reference", E("SELECT ecg_id, coalesce(res >= cut, FALSE) AS prolonged_residual FROM rs2 LEFT JOIN rc ON rc.dataset = rs2.dataset AND rc.sex IS NOT DISTINCT FROM rs2.sex", more=RES))
def _(spark, sf_dir):
    return reference.residual_reference(ecg(spark, sf_dir)).select("ecg_id", "prolonged_residual")


BINS = ("hb AS (SELECT *, CAST(floor(hr_bpm / 5e0) AS BIGINT) * 5 AS hr_bin FROM e), "
        "hc AS (SELECT dataset, sex, hr_bin, count(qt_ms) AS bin_n, quantile_cont(qt_ms, 0.975) AS qt_cut FROM hb WHERE sex IS NOT NULL GROUP BY ALL HAVING count(qt_ms) >= 50)")


@query("e13_hr_bin_reference", E("SELECT ecg_id, coalesce(qt_ms >= qt_cut, FALSE) AS prolonged_hr_bin FROM hb LEFT JOIN hc USING (dataset, sex, hr_bin)", more=BINS))
def _(spark, sf_dir):
    return reference.hr_bin_reference(ecg(spark, sf_dir)).select("ecg_id", "prolonged_hr_bin")


@query("d10_percentile_cutoffs", E("SELECT dataset, sex, hr_bin, bin_n, qt_cut FROM hc", more=BINS), dbl="qt_cut")
def _(spark, sf_dir):
    return reference.hr_bin_cutoffs(ecg(spark, sf_dir))


@query("e14_trend", E("SELECT dataset, regr_slope(q_bazett, hr_bpm) AS slope, regr_intercept(q_bazett, hr_bpm) AS intercept FROM e GROUP BY dataset"), dbl="slope intercept")
def _(spark, sf_dir):
    return reference.trend(qtc(spark, sf_dir), "qtc_bazett", by=["dataset"])


_BANDS = ", ".join("100e0 * avg(CASE WHEN q_{f} IS NOT NULL THEN CAST(" + (f"q_{{f}} >= {lo}" if lo else "TRUE") + " AND " + (f"q_{{f}} < {hi}" if hi else "TRUE") + f" AS INTEGER) END) AS {n}"
                   for n, lo, hi in strata.BANDS)
_PCT = ", ".join(f"quantile_cont(q_{{f}}, {p / 100}) AS p{p}" for p in strata.PERCENTS)


@query("e15_distribution", E(each(FORMULAS, f"SELECT '{{f}}' AS formula, count(q_{{f}}) AS n, avg(q_{{f}}) AS mean, stddev_pop(q_{{f}}) AS std, min(q_{{f}}) AS min, max(q_{{f}}) AS max, {_PCT}, {_BANDS} FROM e")),
       dbl="mean std min max " + " ".join(f"p{p}" for p in strata.PERCENTS) + " " + " ".join(b[0] for b in strata.BANDS))
def _(spark, sf_dir):
    return strata.distribution(qtc(spark, sf_dir))


_CALL = f"coalesce({{q}} >= {thr(450)}, FALSE)"


@query("e16_confusion", E(f"SELECT dataset, tp, fp, tn, fn, {metrics_list()} FROM (SELECT dataset, {counts_sql(_CALL.format(q='q_fridericia'), _CALL.format(q='q_bazett'))} FROM e GROUP BY dataset)"),
       dbl=" ".join(METRICS))
def _(spark, sf_dir):
    df = qtc(spark, sf_dir).withColumns({"t": cl.prolonged("qtc_fridericia", inclusive=True), "p": cl.prolonged("qtc_bazett", inclusive=True)})
    return cf.confusion(df, "t", "p", ["dataset"])


@query("e16_confusion_null_policy", E(f"SELECT superclass, tp, fp, tn, fn, {metrics_list(zero=None)} FROM (SELECT superclass, {counts_sql('(q_framingham > 480)', '(q_bazett > 450)')} FROM e GROUP BY superclass)"),
       dbl=" ".join(METRICS))
def _(spark, sf_dir):
    df = qtc(spark, sf_dir).withColumns({"t": F.col("qtc_framingham") > 480, "p": F.col("qtc_bazett") > 450})
    return cf.confusion(df, "t", "p", ["superclass"], None)


def quantile_check_sql():
    return E("SELECT dataset, sex, quantile_cont(qt_ms, 0.5) AS median_qt, quantile_cont(q_bazett, 0.025) AS low_bazett, quantile_cont(q_bazett, 0.975) AS high_bazett FROM e GROUP BY dataset, sex")


@query("e15_percentiles_by_group", quantile_check_sql(), dbl="median_qt low_bazett high_bazett")
def _(spark, sf_dir):
    return percentiles(qtc(spark, sf_dir), {"median_qt": ("qt_ms", 0.5), "low_bazett": ("qtc_bazett", 0.025), "high_bazett": ("qtc_bazett", 0.975)},
                       ["dataset", "sex"])


# ---- sweeps -------------------------------------------------------------------------------
_KV = "v AS (SELECT * FROM e WHERE qt_ms BETWEEN 200 AND 600 AND rr_s BETWEEN 0.4e0 AND 2e0)"
_CELLS = f"{_KV}, cells AS (" + union(f"SELECT dataset, count(qt_ms) AS n, {float(k)}e0 AS k, c.c AS c, abs(corr(qt_ms + {float(k)}e0 / rr_s + c.c, hr_bpm)) AS abs_r FROM v, "
                                     f"(SELECT unnest([{', '.join(str(x) + 'e0' for x in sweep.C_GRID)}]) AS c) c GROUP BY dataset, c.c" for k in sweep.K_GRID) + ")"
_GRID = f"{_CELLS}, grid AS (SELECT k, c, sum(round(abs_r, 12) * n) / sum(n) AS weighted_r, max(abs_r) AS worst_r FROM cells GROUP BY k, c)"


def _valid(spark, sf_dir):
    return schema.valid_range(ecg(spark, sf_dir))


@query("e31_sweep_k", E("SELECT * FROM grid", more=_GRID), dbl="weighted_r worst_r")
def _(spark, sf_dir):
    return sweep.sweep_k(_valid(spark, sf_dir))


@query("e31_sweep_by_dataset", E("SELECT * FROM cells", more=_CELLS), dbl="abs_r")
def _(spark, sf_dir):
    return sweep.sweep_by_group(_valid(spark, sf_dir))


_BEST = "arg_min({x}, (round({r}, 10), k, c))"


@query("e32_sweep_optimum", E(f"SELECT {_BEST.format(x='k', r='weighted_r')} AS k_optimal, {_BEST.format(x='c', r='weighted_r')} AS c_optimal, min(weighted_r) AS r_optimal FROM grid", more=_GRID), dbl="r_optimal")
def _(spark, sf_dir):
    return sweep.sweep_optimum(sweep.sweep_k(_valid(spark, sf_dir)))


@query("e31_sweep_fine")
def _(spark, sf_dir):
    v = _valid(spark, sf_dir)
    return sweep.sweep_fine(v, sweep.sweep_optimum(sweep.sweep_k(v)))


def _near(k, c):
    return f"arg_min(weighted_r, (abs(k - ({k})) + abs(c - ({c})), k, c))"


_DELTAS = ", ".join(f"{_near(125 + s * d, -158)} - {_near(125, -158)} AS k_{w}_{d}, {_near(125, -158 + s * d)} - {_near(125, -158)} AS c_{w}_{d}"
                    for d in (5, 10, 15, 20) for s, w in ((1, "plus"), (-1, "minus")))


@query("e32_sweep_rigidity", E(f"SELECT *, k_plus_10 > 0.01 OR k_minus_10 > 0.01 AS k_is_rigid, round(c_plus_20, 9) > 0.01 OR round(c_minus_20, 9) > 0.01 AS c_is_rigid, "
                               f"(k_plus_10 > 0.01 OR k_minus_10 > 0.01) AND (round(c_plus_20, 9) > 0.01 OR round(c_minus_20, 9) > 0.01) AS overall_rigid FROM (SELECT {_near(125, -158)} AS r_at_reference, {_DELTAS} FROM grid)", more=_GRID),
       dbl="r_at_reference " + " ".join(f"{a}_{w}_{d}" for a in "kc" for w in ("plus", "minus") for d in (5, 10, 15, 20)))
def _(spark, sf_dir):
    return sweep.sweep_rigidity(sweep.sweep_k(_valid(spark, sf_dir)))


@query("e32_sweep_optimum_by_dataset", E(f"""SELECT dataset, {_BEST.format(x='k', r='abs_r')} AS k_optimal, {_BEST.format(x='c', r='abs_r')} AS c_optimal, min(abs_r) AS r_optimal,
  arg_min(abs_r, (abs(k - 125) + abs(c + 158), k, c)) AS r_at_reference, {_BEST.format(x='k', r='abs_r')} - 125 AS delta_k, {_BEST.format(x='c', r='abs_r')} + 158 AS delta_c FROM cells GROUP BY dataset""", more=_CELLS),
       dbl="r_optimal r_at_reference")
def _(spark, sf_dir):
    return sweep.sweep_by_dataset(sweep.sweep_by_group(_valid(spark, sf_dir)))


@query("e32_sweep_verdict")
def _(spark, sf_dir):
    grid = sweep.sweep_k(_valid(spark, sf_dir))
    return sweep.sweep_verdict(sweep.sweep_optimum(grid), sweep.sweep_rigidity(grid))


@query("d09_parameter_grid", E(union(f"SELECT CAST({t} AS BIGINT) AS threshold, dataset, count(*) FILTER (WHERE q_bazett > {t}) AS n_above FROM e GROUP BY dataset" for t in range(400, 501, 20))))
def _(spark, sf_dir):
    grid = sweep.threshold_grid(qtc(spark, sf_dir), "qtc_bazett", range(400, 501, 20), ["dataset"])
    return grid.withColumn("threshold", F.col("threshold").cast("bigint"))


# ---- bootstrap ----------------------------------------------------------------------------
@query("e33_bootstrap_r")
def _(spark, sf_dir):
    return bootstrap.bootstrap_r(qtc(spark, sf_dir, "c125"))


@query("e33_bootstrap_weighted_r")
def _(spark, sf_dir):
    return bootstrap.bootstrap_weighted_r(qtc(spark, sf_dir, "c125"))


@query("e34_bootstrap_confusion")
def _(spark, sf_dir):
    return bootstrap.bootstrap_confusion(clinical.gold_standard(with_ref(spark, sf_dir)).select("formula", "tp", "fp", "tn", "fn"))
