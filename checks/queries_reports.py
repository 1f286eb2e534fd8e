"""Report queries: subgroups, zones, triage, concordance, impact, safety, manuscript tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (DIAG_SQL, HOSP_SQL, METRICS, case, counts_sql, diag, div, each, ecg, hosp, metric_sql, metrics_list, p_sql, poly_cte, query, reports, strata_sql,
                             table, thr, union, with_ecg, REPORT_SQL)
from checks.queries_rows import CONC, CONF, DX_SQL, ICD_IN_SQL, T4, contains_sql, prefix_sql
from checks.queries_stats import BINS, C3, REF, REF_Q, RES, SEX, qtc, with_ref
from isoqt import fixed_values as fv
from isoqt.functions import classify as cl
from isoqt.functions import codes
from isoqt.functions.formulas import FORMULAS
from isoqt.operators import joins, schema, sweep
from isoqt.plans import clinical, concordance, crosstype, extremes, impact, manuscript, safety, strata

E = with_ecg
INF = "CAST('inf' AS DOUBLE)"


def inf_div(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE {INF} END"


def imp(a, b, eps="0.001"):
    return f"CASE WHEN {b} > {eps} THEN {a} / {b} WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {INF} END"


def pct(a, b):
    return f"(100e0 * {a} / nullif({b}, 0))"


def pct0(a, b):
    return f"coalesce(100e0 * {a} / nullif({b}, 0), 0e0)"


# ---- subgroups ----------------------------------------------------------------------------
AGE, HR3, ZONE, STRATUM = case("age", fv.AGE_BINS), case("hr_bpm", fv.HR_BINS), case("hr_bpm", fv.HR_ZONES), case("hr_bpm", fv.HR_STRATA)
_B, _K = "(q_bazett > thr)", "(q_inverse_rr > thr)"
_SUB_STRATA = [("Age", AGE), ("Sex", SEX), ("Heart Rate", HR3), ("Dataset", "dataset"), ("HR × Sex", f"({HR3}) || ' × ' || ({SEX})"),
               ("HR × Age", f"({HR3}) || ' × ' || ({AGE})"), ("Overall", "'All datasets'")]


def _gs(f, p):
    t = f"(({REF_Q}) > thr)"
    return (f"count(*) FILTER (WHERE {t} AND {p}) AS gs_{f}_tp, count(*) FILTER (WHERE NOT {t} AND {p}) AS gs_{f}_fp, "
            f"count(*) FILTER (WHERE NOT {t} AND NOT {p}) AS gs_{f}_tn, count(*) FILTER (WHERE {t} AND NOT {p}) AS gs_{f}_fn")


_SUB_AGG = ("count(*) AS n, count(*) FILTER (WHERE superclass = 'NORM') AS n_norm, " + ", ".join(f"abs(corr(q_{f}, hr_bpm)) AS r_{f}" for f in FORMULAS) + ", count(q_bazett) AS n_valid, "
            f"count(*) FILTER (WHERE superclass = 'NORM' AND {_B} IS NOT NULL) AS n_class, count(*) FILTER (WHERE superclass = 'NORM' AND {_B}) AS fb, count(*) FILTER (WHERE superclass = 'NORM' AND {_K}) AS fk, "
            f"count(*) FILTER (WHERE superclass = 'NORM' AND NOT {_B}) AS g, count(*) FILTER (WHERE superclass = 'NORM' AND {_B} AND NOT {_K}) AS y, count(*) FILTER (WHERE superclass = 'NORM' AND {_B} AND {_K}) AS r, "
            + _gs("bazett", _B) + ", " + _gs("inverse_rr", _K))
_FP = "n >= 100 AND n_norm > 10 AND n_class > 0"


def _gs_out(f):
    tp, fp, tn, fn = (f"gs_{f}_{x}" for x in ("tp", "fp", "tn", "fn"))
    ok = f"n >= 100 AND {tp} + {fp} + {tn} + {fn} > 10"
    m = metric_sql(tp, fp, tn, fn, None)
    out = {x: f"gs_{f}_{x}" for x in ("tp", "fp", "tn", "fn")} | {x: m[x] for x in ("sensitivity", "specificity", "ppv", "npv")}
    out["f1"] = f"2 * {m['sensitivity']} * {m['ppv']} / nullif({m['sensitivity']} + {m['ppv']}, 0)"
    return ", ".join(f"CASE WHEN {ok} THEN {v} END AS gs_{f}_{k}" for k, v in out.items())


_SUB_OUT = ("n, " + ", ".join(f"CASE WHEN n >= 100 AND n_valid > 10 THEN r_{f} END AS abs_r_{f}" for f in FORMULAS) +
            f", CASE WHEN n >= 100 AND n_valid > 10 THEN {imp('r_bazett', 'r_inverse_rr')} END AS improvement_corr, CASE WHEN n >= 100 THEN n_norm END AS n_norm, "
            f"CASE WHEN {_FP} THEN fb END AS fp_bazett, CASE WHEN {_FP} THEN {pct('fb', 'n_class')} END AS fp_rate_bazett, CASE WHEN {_FP} THEN fk END AS fp_inverse_rr, CASE WHEN {_FP} THEN {pct('fk', 'n_class')} END AS fp_rate_inverse_rr, "
            f"CASE WHEN {_FP} THEN {inf_div('fb', 'fk')} END AS improvement_fp, " +
            ", ".join(f"CASE WHEN {_FP} THEN {c} END AS triage_{w}, CASE WHEN {_FP} THEN {pct(c, 'n_class')} END AS triage_{w}_pct" for c, w in (("g", "green"), ("y", "yellow"), ("r", "red"))) +
            ", " + _gs_out("bazett") + ", " + _gs_out("inverse_rr"))
_SUB_DBL = (" ".join(f"abs_r_{f}" for f in FORMULAS) + " improvement_corr fp_rate_bazett fp_rate_inverse_rr improvement_fp triage_green_pct triage_yellow_pct triage_red_pct " +
            " ".join(f"gs_{f}_{m}" for f in ("bazett", "inverse_rr") for m in ("sensitivity", "specificity", "ppv", "npv", "f1")))
_SUB_P = ", ".join(f"CASE WHEN n >= 100 AND n_valid > 10 THEN {p_sql(f'r_{f}', 'n_valid')} END AS p_{f}" for f in FORMULAS)
_SUB = f"SELECT kind, label, {_SUB_OUT} FROM ({strata_sql(_SUB_STRATA, _SUB_AGG, 'pf')})"


@query("e25_subgroup_metrics", E(f"SELECT superclass, {_SUB_OUT}, {_SUB_P} FROM (SELECT superclass, {_SUB_AGG} FROM pf GROUP BY superclass)", unknown=None, more=REF), dbl=_SUB_DBL + " " + " ".join(f"p_{f}" for f in FORMULAS))
def _(spark, sf_dir):
    return strata.subgroup_metrics(with_ref(spark, sf_dir), ["superclass"], p_value=True)


@query("e26_subgroup_report", E(_SUB, unknown=None, more=REF), dbl=_SUB_DBL)
def _(spark, sf_dir):
    return strata.subgroup_report(with_ref(spark, sf_dir))


@query("e27_misleading", E(f"SELECT kind, label, abs_r_bazett, abs_r_inverse_rr, fp_rate_bazett, fp_rate_inverse_rr FROM ({_SUB}) WHERE abs_r_inverse_rr > abs_r_bazett AND fp_rate_bazett > fp_rate_inverse_rr", unknown=None, more=REF),
       dbl="abs_r_bazett abs_r_inverse_rr fp_rate_bazett fp_rate_inverse_rr")
def _(spark, sf_dir):
    return strata.misleading(strata.subgroup_report(with_ref(spark, sf_dir))).select("kind", "label", "abs_r_bazett", "abs_r_inverse_rr", "fp_rate_bazett", "fp_rate_inverse_rr")


# ---- rate zones ---------------------------------------------------------------------------
def enriched(spark, sf_dir):
    return schema.enrich(ecg(spark, sf_dir))


ZX = f"{ZONE} AS hr_zone, q_bazett - q_inverse_rr AS bias, coalesce(q_bazett > {thr(None)}, FALSE) AS fb, coalesce(q_inverse_rr > {thr(None)}, FALSE) AS fk, q_bazett > {thr(None)} AS b, q_inverse_rr > {thr(None)} AS k"
_SOME = "n_norm > 10"


@query("e35_hr_zone_report", E(f"""SELECT hr_zone, n, enough, hr_mean, hr_std, r_bazett, r_inverse_rr, r_fridericia, {imp('abs(r_bazett)', 'abs(r_inverse_rr)')} AS improvement, n_norm,
 CASE WHEN {_SOME} THEN b1 END AS fp_bazett, CASE WHEN {_SOME} THEN k1 END AS fp_inverse_rr, CASE WHEN {_SOME} THEN {pct('b1', 'n_norm')} END AS fp_rate_bazett, CASE WHEN {_SOME} THEN {pct('k1', 'n_norm')} END AS fp_rate_inverse_rr,
 CASE WHEN {_SOME} THEN {inf_div('b1', 'k1')} END AS fp_reduction FROM (SELECT hr_zone, count(*) AS n, count(*) >= 100 AS enough, avg(hr_bpm) AS hr_mean, stddev_samp(hr_bpm) AS hr_std, corr(q_bazett, hr_bpm) AS r_bazett, corr(q_inverse_rr, hr_bpm) AS r_inverse_rr,
 corr(q_fridericia, hr_bpm) AS r_fridericia, count(*) FILTER (WHERE superclass = 'NORM') AS n_norm, count(*) FILTER (WHERE superclass = 'NORM' AND fb) AS b1, count(*) FILTER (WHERE superclass = 'NORM' AND fk) AS k1
 FROM e WHERE hr_zone IS NOT NULL GROUP BY 1)""", extra=ZX), dbl="hr_mean hr_std r_bazett r_inverse_rr r_fridericia improvement fp_rate_bazett fp_rate_inverse_rr fp_reduction")
def _(spark, sf_dir):
    return strata.hr_zone_report(enriched(spark, sf_dir))


@query("e36_bias_report", E(f"""SELECT hr_zone, count(*) AS n, count(*) >= 100 AS enough, avg(hr_bpm) AS hr_mean, avg(bias) AS bias_mean, stddev_samp(bias) AS bias_std, quantile_cont(bias, 0.5) AS bias_median, quantile_cont(bias, 0.05) AS bias_p5,
 quantile_cont(bias, 0.95) AS bias_p95, {pct('count(*) FILTER (WHERE abs(bias) > 20)', 'count(bias)')} AS pct_bias_gt_20ms, {pct('count(*) FILTER (WHERE abs(bias) > 40)', 'count(bias)')} AS pct_bias_gt_40ms,
 {pct('count(*) FILTER (WHERE bias > 0)', 'count(bias)')} AS pct_overcorrection, {pct('count(*) FILTER (WHERE bias < 0)', 'count(bias)')} AS pct_undercorrection FROM e WHERE hr_zone IS NOT NULL GROUP BY 1""", extra=ZX),
       dbl="hr_mean bias_mean bias_std bias_median bias_p5 bias_p95 pct_bias_gt_20ms pct_bias_gt_40ms pct_overcorrection pct_undercorrection")
def _(spark, sf_dir):
    return strata.bias_report(enriched(spark, sf_dir))


@query("e36_bias_hr_corr", E("SELECT count(bias) AS n, corr(bias, hr_bpm) AS r_bias_hr FROM e", extra=ZX), dbl="r_bias_hr")
def _(spark, sf_dir):
    return strata.bias_hr_corr(enriched(spark, sf_dir))


_CM = f"CASE WHEN {{q}} IS NULL OR sex IS NULL THEN NULL WHEN {{q}} > {thr(None)} THEN 'prolonged' WHEN {{q}} > {thr(None)} - 10 THEN 'borderline' ELSE 'normal' END"
_SCEN = {"A_FP_saved": "b AND NOT k", "B_FN_risk": "NOT b AND k", "C_borderline_resolved": "cb = 'borderline' AND ck = 'normal'", "D_downgraded": "cb = 'prolonged' AND ck = 'borderline'"}
_SCX = ZX + f", {_CM.format(q='q_bazett')} AS cb, {_CM.format(q='q_inverse_rr')} AS ck"


@query("e37_discordance", E(union(f"""SELECT '{s}' AS scenario, count(*) AS n, 100e0 * count(*) / (SELECT count(*) FROM e) AS pct_of_total, avg(hr_bpm) AS hr_mean, stddev_samp(hr_bpm) AS hr_std, min(hr_bpm) AS min_hr, max(hr_bpm) AS max_hr,
 avg(age) AS age_mean, {pct("count(*) FILTER (WHERE superclass = 'NORM')", 'count(*)')} AS pct_norm FROM e WHERE {w} HAVING count(*) > 0""" for s, w in _SCEN.items()), extra=_SCX), dbl="pct_of_total hr_mean hr_std min_hr max_hr age_mean pct_norm")
def _(spark, sf_dir):
    return extremes.discordance(enriched(spark, sf_dir))


@query("e37_discordance_by_superclass", E(union(f"SELECT '{s}' AS scenario, superclass, count(*) AS n FROM e WHERE {w} GROUP BY 2" for s, w in _SCEN.items()), extra=_SCX))
def _(spark, sf_dir):
    return extremes.discordance_distribution(enriched(spark, sf_dir), "superclass")


@query("e37_discordance_by_zone", E(union(f"SELECT '{s}' AS scenario, hr_zone, count(*) AS n FROM e WHERE {w} AND hr_zone IS NOT NULL GROUP BY 2" for s, w in _SCEN.items()), extra=_SCX))
def _(spark, sf_dir):
    return extremes.discordance_distribution(enriched(spark, sf_dir), "hr_zone")


POP = {"athletes_proxy": "hr_bpm < 55 AND age < 45 AND superclass = 'NORM'", "febrile_proxy": "hr_bpm > 100 AND superclass = 'NORM'", "elderly_bradycardic": "hr_bpm < 60 AND age > 70",
       "young_tachycardic": "hr_bpm > 100 AND age < 40", "extreme_bradycardia": "hr_bpm < 50", "extreme_tachycardia": "hr_bpm > 120"}
_PN = "n >= 10 AND n1 > 10"


@query("e38_population_report", E(union(f"""SELECT '{p}' AS population, n, CASE WHEN n >= 10 THEN hr_mean END AS hr_mean, CASE WHEN n >= 10 THEN hr_std END AS hr_std, CASE WHEN n >= 10 THEN age_mean END AS age_mean,
 CASE WHEN n >= 10 AND m > 10 THEN rb END AS abs_r_bazett, CASE WHEN n >= 10 AND m > 10 THEN rk END AS abs_r_inverse_rr, CASE WHEN n >= 10 AND m > 10 THEN {imp('rb', 'rk')} END AS improvement, CASE WHEN n >= 10 THEN bias_mean END AS bias_mean, CASE WHEN n >= 10 THEN bias_std END AS bias_std,
 CASE WHEN {_PN} THEN n1 END AS n_norm, CASE WHEN {_PN} THEN b1 END AS fp_bazett, CASE WHEN {_PN} THEN k1 END AS fp_inverse_rr, CASE WHEN {_PN} THEN {pct('b1', 'n1')} END AS fp_rate_bazett, CASE WHEN {_PN} THEN {pct('k1', 'n1')} END AS fp_rate_inverse_rr
 FROM (SELECT count(*) AS n, count(bias) AS m, avg(hr_bpm) AS hr_mean, stddev_samp(hr_bpm) AS hr_std, avg(age) AS age_mean, abs(corr(q_bazett, hr_bpm)) AS rb, abs(corr(q_inverse_rr, hr_bpm)) AS rk, avg(bias) AS bias_mean, stddev_samp(bias) AS bias_std,
 count(*) FILTER (WHERE superclass = 'NORM') AS n1, count(*) FILTER (WHERE superclass = 'NORM' AND fb) AS b1, count(*) FILTER (WHERE superclass = 'NORM' AND fk) AS k1 FROM e WHERE {w}) WHERE n > 0""" for p, w in POP.items()), extra=ZX),
       dbl="hr_mean hr_std age_mean abs_r_bazett abs_r_inverse_rr improvement bias_mean bias_std fp_rate_bazett fp_rate_inverse_rr")
def _(spark, sf_dir):
    return extremes.population_report(enriched(spark, sf_dir))


_TR = "CASE WHEN coalesce(NOT b, FALSE) THEN 'GREEN' WHEN coalesce(b AND NOT k, FALSE) THEN 'YELLOW' ELSE 'RED' END"
_TAGG = "count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {_TR} = '{t}') AS {t.lower()}" for t in ("GREEN", "YELLOW", "RED"))
_TOUT = "n, n >= 10 AS enough, green, yellow, red, " + ", ".join(f"{pct(c, 'n')} AS {c}_pct" for c in ("green", "yellow", "red")) + f", yellow + red AS base_positive, {pct0('yellow', '(yellow + red)')} AS urgent_reduction_pct"
_TDBL = "green_pct yellow_pct red_pct urgent_reduction_pct"


@query("e39_triage_by_zone", E(f"SELECT zone, {_TOUT} FROM (SELECT hr_zone AS zone, {_TAGG} FROM e WHERE superclass = 'NORM' AND hr_zone IS NOT NULL GROUP BY 1 UNION ALL SELECT 'OVERALL', {_TAGG} FROM e WHERE superclass = 'NORM')", extra=ZX), dbl=_TDBL)
def _(spark, sf_dir):
    return extremes.triage_by_zone(enriched(spark, sf_dir))


@query("e40_triage_by_population", E(f"SELECT population, {_TOUT} FROM (" + union(f"SELECT '{p}' AS population, {_TAGG} FROM e WHERE {w} HAVING count(*) > 0" for p, w in POP.items()) + ")", extra=ZX), dbl=_TDBL)
def _(spark, sf_dir):
    return extremes.triage_by_population(enriched(spark, sf_dir))


@query("e41_nns", E(f"""SELECT zone, n, n >= 10 AS enough, fp_bazett, fp_inverse_rr, fp_bazett - fp_inverse_rr AS fp_avoided, {inf_div('n', '(fp_bazett - fp_inverse_rr)')} AS nns, {pct('fp_bazett', 'n')} AS fp_rate_bazett, {pct('fp_inverse_rr', 'n')} AS fp_rate_inverse_rr FROM (
 SELECT hr_zone AS zone, count(*) AS n, count(*) FILTER (WHERE fb) AS fp_bazett, count(*) FILTER (WHERE fk) AS fp_inverse_rr FROM e WHERE superclass = 'NORM' AND hr_zone IS NOT NULL GROUP BY 1
 UNION ALL SELECT 'OVERALL', count(*), count(*) FILTER (WHERE fb), count(*) FILTER (WHERE fk) FROM e WHERE superclass = 'NORM')""", extra=ZX), dbl="nns fp_rate_bazett fp_rate_inverse_rr")
def _(spark, sf_dir):
    return extremes.nns(enriched(spark, sf_dir))


def norm_rows(spark, sf_dir):
    return enriched(spark, sf_dir).filter("superclass = 'NORM'")


_SLOPES = ", ".join(f"({i}, {-0.5 + i * 0.05!r}e0)" for i in range(20))


@query("e42_slope_sweep", E(f"""SELECT arg_min(slope, (fp, i)) AS optimal_slope, 100e0 * min(fp) / any_value(n) AS fp_rate_adaptive, 100e0 * any_value(fixed) / any_value(n) AS fp_rate_fixed FROM (
 SELECT s.i, s.slope, count(*) AS n, count(*) FILTER (WHERE q_bazett > thr + s.slope * (hr_bpm - 75)) AS fp, count(*) FILTER (WHERE q_bazett > thr) AS fixed FROM e, (VALUES {_SLOPES}) s(i, slope) WHERE superclass = 'NORM' GROUP BY 1, 2)"""),
       dbl="optimal_slope fp_rate_adaptive fp_rate_fixed")
def _(spark, sf_dir):
    return sweep.slope_sweep(norm_rows(spark, sf_dir))


_SG = "CASE WHEN sex = 0 THEN 'male' WHEN sex IS NOT NULL THEN 'female' END"


@query("e43_zone_thresholds", E(f"""SELECT hr_zone, sex_group, n, threshold_ms, {pct('above', 'n')} AS achieved_fp_rate FROM (SELECT hr_zone, sex_group, any_value(n) AS n, any_value(cut) AS threshold_ms, count(*) FILTER (WHERE q_bazett > cut) AS above FROM (
 SELECT *, count(*) OVER (PARTITION BY hr_zone, sex_group) AS n, count(*) OVER (PARTITION BY hr_zone) AS zn, quantile_cont(q_bazett, 0.98) OVER (PARTITION BY hr_zone, sex_group) AS cut FROM e WHERE superclass = 'NORM' AND hr_zone IS NOT NULL)
 WHERE sex_group IS NOT NULL AND zn >= 100 AND n >= 50 GROUP BY 1, 2)""", extra=f"{ZONE} AS hr_zone, {_SG} AS sex_group"), dbl="threshold_ms achieved_fp_rate")
def _(spark, sf_dir):
    return extremes.zone_thresholds(enriched(spark, sf_dir))


@query("e44_percentile_thresholds", E(union(f"SELECT sex_group, '{f}' AS formula, {p}e0 AS percentile, quantile_cont(q_{f}, {p / 100}) AS threshold_ms, {100 - p}e0 AS expected_fp_rate FROM e WHERE superclass = 'NORM' AND sex_group IS NOT NULL GROUP BY 1"
                                            for f in ("bazett", "inverse_rr") for p in (95.0, 97.5, 99.0)), extra=f"{_SG} AS sex_group"), dbl="percentile threshold_ms expected_fp_rate")
def _(spark, sf_dir):
    return extremes.percentile_thresholds(enriched(spark, sf_dir))


_SHIFTS = ", ".join(f"({s})" for s in range(-20, 21, 2))


@query("e45_adjust_sweep", E(f"""SELECT coalesce(arg_max(shift, (score, -shift)), 0) AS optimal_adjustment, any_value(cur) AS current_fp_rate, coalesce(arg_max(rate, (score, -shift)), any_value(cur)) AS optimal_fp_rate FROM (
 SELECT CASE WHEN ok THEN shift END AS shift, CASE WHEN ok THEN rate END AS rate, CASE WHEN ok THEN score END AS score, cur FROM (SELECT *, round(cur - rate - abs(shift) * 0.1e0, 12) AS score, rate > 0.5 AND cur - rate - abs(shift) * 0.1e0 > 0 AS ok FROM (
 SELECT s.shift, 100e0 * count(*) FILTER (WHERE q_inverse_rr > thr + s.shift) / count(*) AS rate, 100e0 * count(*) FILTER (WHERE q_inverse_rr > thr) / count(*) AS cur FROM e, (VALUES {_SHIFTS}) s(shift) WHERE superclass = 'NORM' GROUP BY 1)))"""),
       dbl="current_fp_rate optimal_fp_rate", big="optimal_adjustment")
def _(spark, sf_dir):
    return sweep.adjust_sweep(norm_rows(spark, sf_dir))


@query("e46_alternative_report", E(f"""SELECT count(*) AS n, {pct('count(*) FILTER (WHERE hyb > thr)', 'count(*)')} AS fp_rate_hybrid, {pct('count(*) FILTER (WHERE k)', 'count(*)')} AS fp_rate_inverse_rr, count(*) FILTER (WHERE hr_bpm < 50 OR hr_bpm > 120) AS n_extreme_hr,
 {pct('count(*) FILTER (WHERE hr_bpm < 50 OR hr_bpm > 120)', 'count(*)')} AS pct_extreme_hr, {pct('count(*) FILTER (WHERE confidence >= 70)', 'count(*)')} AS high_confidence_pct, {pct('count(*) FILTER (WHERE confidence >= 40 AND confidence < 70)', 'count(*)')} AS medium_confidence_pct,
 {pct('count(*) FILTER (WHERE confidence < 40)', 'count(*)')} AS low_confidence_pct, avg(confidence) AS mean_confidence, """ + ", ".join(
    f"count(*) FILTER (WHERE t4 = '{t}') AS {t.lower().replace('-', '_')}, {pct(f'''count(*) FILTER (WHERE t4 = '{t}')''', 'count(*)')} AS {t.lower().replace('-', '_')}_pct" for t in ("GREEN", "GREEN-WATCH", "YELLOW", "RED")) +
    f" FROM (SELECT *, {T4} AS t4 FROM e WHERE superclass = 'NORM')", extra=f"coalesce(q_bazett > thr, FALSE) AS b, coalesce(q_inverse_rr > thr, FALSE) AS k, {CONF} AS confidence, CASE WHEN hr_bpm < 50 OR hr_bpm > 120 THEN q_bazett ELSE q_inverse_rr END AS hyb"),
       dbl="fp_rate_hybrid fp_rate_inverse_rr pct_extreme_hr high_confidence_pct medium_confidence_pct low_confidence_pct mean_confidence green_pct green_watch_pct yellow_pct red_pct")
def _(spark, sf_dir):
    return extremes.alternative_report(enriched(spark, sf_dir))


# ---- reclassification ---------------------------------------------------------------------
_LV = ["normal", "borderline", "prolonged"]
CLS = ", ".join(f"{C3.format(q='q_' + f)} AS class_{f}" for f in FORMULAS)
MATRIX = ", ".join(f"count(*) FILTER (WHERE class_bazett = '{x}' AND class_inverse_rr = '{y}') AS {x}_to_{y}" for x in _LV for y in _LV)


def _cells(keep):
    return " + ".join(f"{x}_to_{y}" for i, x in enumerate(_LV) for j, y in enumerate(_LV) if keep(i, j))


MT = f"*, {_cells(lambda i, j: j > i)} AS upgraded, {_cells(lambda i, j: j < i)} AS downgraded, {_cells(lambda i, j: i == j)} AS unchanged, {_cells(lambda i, j: True)} AS total"


def classed(spark, sf_dir):
    return clinical.with_classes(qtc(spark, sf_dir))


@query("e17_reclass_matrix", E(f"SELECT {MT} FROM (SELECT dataset, {MATRIX} FROM e GROUP BY dataset)", extra=CLS))
def _(spark, sf_dir):
    from isoqt.operators.confusion import reclass_matrix
    return reclass_matrix(classed(spark, sf_dir), "class_bazett", "class_inverse_rr", ["dataset"])


def _rng(c, ranges):
    return "CASE " + " ".join(f"WHEN {c} >= {lo} AND {c} < {hi} THEN '{n}'" for n, (lo, hi) in ranges.items()) + " END"


@query("e18_reclass_by", E(f"SELECT {MT} FROM ({strata_sql([('hr', _rng('hr_bpm', fv.HR_RANGES)), ('sex', SEX), ('age', _rng('age', fv.AGE_RANGES))], f'count(*) AS n, count(*) >= 100 AS enough, {MATRIX}')})", extra=CLS))
def _(spark, sf_dir):
    return clinical.reclass_by(classed(spark, sf_dir))


_AV, _MI = "prolonged_to_normal + prolonged_to_borderline", "normal_to_prolonged + borderline_to_prolonged"


@query("e19_impact", E(f"""SELECT dataset, n_records, r_bazett, r_inverse_rr, prolonged_bazett, prolonged_inverse_rr, {_AV} AS fp_avoided, {_MI} AS potential_missed, ({_AV}) - ({_MI}) AS net_benefit, {inf_div(f'({_AV})', f'({_MI})')} AS ratio_avoided_missed
 FROM (SELECT dataset, count(*) AS n_records, corr(q_bazett, hr_bpm) AS r_bazett, corr(q_inverse_rr, hr_bpm) AS r_inverse_rr, count(*) FILTER (WHERE class_bazett = 'prolonged') AS prolonged_bazett, count(*) FILTER (WHERE class_inverse_rr = 'prolonged') AS prolonged_inverse_rr, {MATRIX} FROM e WHERE superclass = 'NORM' GROUP BY dataset)""", extra=CLS),
       dbl="r_bazett r_inverse_rr ratio_avoided_missed")
def _(spark, sf_dir):
    return clinical.impact(schema.norm_subset(classed(spark, sf_dir), "ci"))


@query("e20_category_counts", E(f"SELECT class_bazett, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER () AS pct FROM e GROUP BY 1", extra=CLS), dbl="pct")
def _(spark, sf_dir):
    return strata.category_counts(classed(spark, sf_dir), "class_bazett")


def _gs_sql(truth):
    return union(f"SELECT '{f}' AS formula, {counts_sql(truth, f'''(class_{f} = 'prolonged')''')} FROM pf" for f in FORMULAS)


@query("e21_gold_standard", E(f"SELECT formula, tp, fp, tn, fn, {metrics_list()} FROM ({_gs_sql('(' + C3.format(q='(' + REF_Q + ')') + " = 'prolonged')")})", extra=CLS, more=REF), dbl=" ".join(METRICS))
def _(spark, sf_dir):
    return clinical.gold_standard(with_ref(spark, sf_dir))


@query("e22_gold_standard_binary", E(f"SELECT formula, tp, fp, tn, fn, {metrics_list()} FROM ({_gs_sql('coalesce(ecg_id % 7 = 0, FALSE)')})", extra=CLS, more="pf AS (SELECT * FROM e)"), dbl=" ".join(METRICS))
def _(spark, sf_dir):
    return clinical.gold_standard_binary(qtc(spark, sf_dir).withColumn("label_prolonged_qt", F.expr("int(ecg_id % 7 = 0)")))


_T450 = thr(450)
_CX = f"coalesce(({REF_Q}) > {_T450}, FALSE) AS t, coalesce(q_bazett > {_T450}, FALSE) AS b, coalesce(q_inverse_rr > {_T450}, FALSE) AS k"
_LEVEL = {"green": "NOT b", "yellow": "b AND NOT k", "red": "b AND k"}
_CC = "count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {w} AND {t}) AS {lv}_{n}" for lv, w in _LEVEL.items() for n, t in (("prolonged", "t"), ("normal", "NOT t"))) + ", " + counts_sql("t", "b", "base_") + ", " + counts_sql("t", "k", "new_") + \
    ", " + counts_sql("t", "(b AND k)", "red_") + ", " + counts_sql("t", "b", "any_")
_CO = (", ".join(f"{lv}_prolonged + {lv}_normal AS {lv}" for lv in _LEVEL) + ", " + ", ".join(f"{pct0(f'({lv}_prolonged + {lv}_normal)', 'n')} AS pct_{lv}, {pct0(f'{lv}_prolonged', f'({lv}_prolonged + {lv}_normal)')} AS purity_{lv}" for lv in _LEVEL) +
       ", base_tp + base_fp - red_prolonged - red_normal AS referral_reduction, coalesce(100e0 * (1 - CAST(red_prolonged + red_normal AS DOUBLE) / nullif(base_tp + base_fp, 0)), 0e0) AS referral_reduction_pct, "
       "coalesce(100e0 * (1 - CAST(red_prolonged + red_normal + yellow_prolonged + yellow_normal AS DOUBLE) / nullif(base_tp + base_fp, 0)), 0e0) AS workload_reduction_pct")
_C4 = ("base_", "new_", "red_", "any_")


@query("e23_cascade", E(f"SELECT *, {_CO}, {', '.join(metrics_list(tag=t) for t in _C4)} FROM (SELECT dataset, {_CC} FROM c GROUP BY dataset)", more=f"{REF}, c AS (SELECT *, {_CX} FROM pf)"),
       dbl=" ".join(f"pct_{lv} purity_{lv}" for lv in _LEVEL) + " referral_reduction_pct workload_reduction_pct " + " ".join(t + m for t in _C4 for m in METRICS))
def _(spark, sf_dir):
    return clinical.cascade(with_ref(spark, sf_dir), by=["dataset"])


_RS = (f"SELECT {{s}} AS scope, count(*) AS n_records, {MATRIX}, " + ", ".join(f"count(*) FILTER (WHERE {w}) AS {lv}, count(*) FILTER (WHERE {w} AND t) AS {lv}_p" for lv, w in _LEVEL.items()) + ", " + counts_sql("t", "b") + " FROM c GROUP BY 1")
_RM = metric_sql()


@query("e24_rollup_totals", E(f"""SELECT scope, n_records, {_AV} AS fp_avoided, {_MI} AS potential_missed, ({_AV}) - ({_MI}) AS net_benefit, {inf_div(f'({_AV})', f'({_MI})')} AS ratio_avoided_missed, green, yellow, red, """ +
                              ", ".join(f"{pct0(lv, 'n_records')} AS pct_{lv}, {pct0(lv + '_p', lv)} AS purity_{lv}" for lv in _LEVEL) +
                              f", {_RM['sensitivity']} AS base_sensitivity, {_RM['specificity']} AS base_specificity, {_RM['ppv']} AS base_ppv FROM ({_RS.format(s='dataset')} UNION ALL {_RS.format(s=repr('TOTAL'))})",
                              extra=CLS, more=f"{REF}, c AS (SELECT *, {_CX} FROM pf)"),
       dbl="ratio_avoided_missed " + " ".join(f"pct_{lv} purity_{lv}" for lv in _LEVEL) + " base_sensitivity base_specificity base_ppv")
def _(spark, sf_dir):
    return clinical.rollup_totals(clinical.with_classes(with_ref(spark, sf_dir)))


# ---- concordance with diagnoses -----------------------------------------------------------
# A record counts as diagnosed by the report of the document with the record's key (modulo).
_DXC = f"rep AS ({REPORT_SQL}), dxd AS (SELECT doc_id, {DX_SQL} AS has_dx FROM rep), dx AS (SELECT e.*, coalesce(dxd.has_dx, FALSE) AS has_dx FROM e LEFT JOIN dxd ON doc_id = ecg_id % 1000)"
_DXX = (f"coalesce(q_bazett > thr, FALSE) AS pb, coalesce(q_inverse_rr > thr, FALSE) AS pk, coalesce(q_fridericia > thr, FALSE) AS pf, "
        f"CASE WHEN NOT coalesce(q_bazett > thr, FALSE) THEN 'GREEN' WHEN coalesce(q_inverse_rr > thr, FALSE) THEN 'RED' ELSE 'YELLOW' END AS triage")


def diagnosed(spark, sf_dir):
    rep = reports(spark, sf_dir)
    dx = rep.select(F.col("doc_id").alias("__doc"), codes.has_diagnosis(rep, cols=["report_0", "report_1", "report_2"]).alias("has_dx"))
    rows = enriched(spark, sf_dir).withColumn("__doc", F.col("ecg_id") % 1000)
    return rows.join(dx, "__doc", "left").withColumn("has_dx", F.coalesce("has_dx", F.lit(False))).drop("__doc")


_PF = {"bazett": "pb", "inverse_rr": "pk", "fridericia": "pf"}
_C9 = ["sensitivity", "specificity", "ppv", "npv", "f1", "accuracy"]


@query("e47_concordance_overall", E("SELECT formula, tp + fp + tn + fn AS total, tp + fn AS n_true, tp + fp AS n_pred, tp, tn, fp, fn, " + metrics_list(_C9) + " FROM (" + union(f"SELECT '{f}' AS formula, {counts_sql('has_dx', p)} FROM dx" for f, p in _PF.items()) + ")", extra=_DXX, more=_DXC), dbl=" ".join(_C9))
def _(spark, sf_dir):
    return concordance.concordance_overall(diagnosed(spark, sf_dir))


_TC = "count(*) FILTER (WHERE has_dx) AS n_true, " + ", ".join(f"count(*) FILTER (WHERE has_dx AND triage = '{t}') AS true_{t.lower()}" for t in ("GREEN", "YELLOW", "RED"))


@query("e47_triage_capture", E("SELECT *, " + ", ".join(f"{pct0(f'true_{t}', 'n_true')} AS {t}_pct" for t in ("green", "yellow", "red")) + f", {pct0('(true_yellow + true_red)', 'n_true')} AS captured_pct FROM (SELECT {_TC} FROM dx)", extra=_DXX, more=_DXC), dbl="green_pct yellow_pct red_pct captured_pct")
def _(spark, sf_dir):
    return concordance.triage_capture(diagnosed(spark, sf_dir))


HRW = case("hr_bpm", fv.HR_BINS_WIDE)


@query("e48_concordance_by", E(f"SELECT kind, label, n_true, {pct0('(true_yellow + true_red)', 'n_true')} AS captured_pct, {pct0('true_green', 'n_true')} AS missed_pct, formula, tp, tn, fp, fn, {metrics_list(_C9)} FROM (" + union(
    strata_sql([("dataset", "dataset"), ("hr", HRW), ("age", AGE)], f"'{f}' AS formula, {_TC}, {counts_sql('has_dx', _PF[f])}", "dx", "HAVING count(*) FILTER (WHERE has_dx) >= 10") for f in ("bazett", "inverse_rr")) + ")", extra=_DXX, more=_DXC), dbl="captured_pct missed_pct " + " ".join(_C9))
def _(spark, sf_dir):
    return concordance.concordance_by(diagnosed(spark, sf_dir))


@query("e49_triage_safety", E(f"SELECT kind, label, n, n >= 5 AS enough, green, {pct('green', 'n')} AS green_pct, yellow, {pct('yellow', 'n')} AS yellow_pct, red, {pct('red', 'n')} AS red_pct, {pct('(yellow + red)', 'n')} AS captured_pct, 100e0 - {pct('(yellow + red)', 'n')} AS missed_pct FROM (" + strata_sql(
    [("hr", HRW), ("overall", "'OVERALL'")], "count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE triage = '{t}') AS {t.lower()}" for t in ("GREEN", "YELLOW", "RED")), "td") + ") WHERE kind = 'overall' OR n >= 5", extra=_DXX, more=_DXC + ", td AS (SELECT * FROM dx WHERE has_dx)"),
       dbl="green_pct yellow_pct red_pct captured_pct missed_pct")
def _(spark, sf_dir):
    return concordance.triage_safety(diagnosed(spark, sf_dir))


@query("e49_missed_profile", E("SELECT count(*) AS n, avg(hr_bpm) AS mean_hr, avg(q_bazett) AS mean_qtc_bazett, avg(q_inverse_rr) AS mean_qtc_inverse_rr, avg(age) AS mean_age FROM dx WHERE has_dx AND triage = 'GREEN'", extra=_DXX, more=_DXC), dbl="mean_hr mean_qtc_bazett mean_qtc_inverse_rr mean_age")
def _(spark, sf_dir):
    return concordance.missed_profile(diagnosed(spark, sf_dir))


SEV = case("(q_inverse_rr - thr)", fv.SEVERITY_BINS)


@query("e50_severity_report", E(f"SELECT severity, n, n >= 50 AS enough, n_true, {pct('n_true', 'n')} AS prevalence, {pct('green', 'n')} AS green_pct, {pct('yellow', 'n')} AS yellow_pct, {pct('red', 'n')} AS red_pct, {pct('(true_yellow + true_red)', 'n_true')} AS true_captured_pct FROM (SELECT {SEV} AS severity, count(*) AS n, {_TC}, " +
                                ", ".join(f"count(*) FILTER (WHERE triage = '{t}') AS {t.lower()}" for t in ("GREEN", "YELLOW", "RED")) + f" FROM dx WHERE {SEV} IS NOT NULL GROUP BY 1)", extra=_DXX, more=_DXC), dbl="prevalence green_pct yellow_pct red_pct true_captured_pct")
def _(spark, sf_dir):
    return concordance.severity_report(diagnosed(spark, sf_dir))


ROC = ("roc AS (SELECT formula, threshold, tp, fp, fn, tn, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0e0) AS sensitivity, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0e0) AS specificity, "
       "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0e0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0e0) - 1 AS youden_j FROM (" +
       union(f"SELECT '{f}' AS formula, CAST(t AS BIGINT) AS threshold, {counts_sql('has_dx', f'coalesce(q_{f} > t, FALSE)')} FROM dx, range(350, 551, 5) r(t) GROUP BY t" for f in ("bazett", "inverse_rr", "fridericia")) + "))")


@query("e51_roc", E("SELECT * FROM roc", extra=_DXX, more=f"{_DXC}, {ROC}"), dbl="sensitivity specificity youden_j")
def _(spark, sf_dir):
    return sweep.roc(diagnosed(spark, sf_dir), "has_dx", ("bazett", "inverse_rr", "fridericia"))


@query("e51_roc_optimum", E("SELECT formula, threshold, sensitivity, specificity, youden_j, threshold - 450 AS delta FROM (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY round(youden_j, 12) DESC, threshold) AS rn FROM roc) WHERE rn = 1", extra=_DXX, more=f"{_DXC}, {ROC}"), dbl="sensitivity specificity youden_j")
def _(spark, sf_dir):
    return sweep.roc_optimum(sweep.roc(diagnosed(spark, sf_dir), "has_dx", ("bazett", "inverse_rr", "fridericia")))


# ---- impact -------------------------------------------------------------------------------
_NA = ("count(*) AS n, count(*) FILTER (WHERE pb) AS fp_bazett, count(*) FILTER (WHERE pk) AS fp_inverse_rr, count(*) FILTER (WHERE pf) AS fp_fridericia, count(*) FILTER (WHERE pb AND NOT pk) AS scenario_a, count(*) FILTER (WHERE NOT pb AND pk) AS scenario_b, "
       + ", ".join(f"count(*) FILTER (WHERE triage = '{t}') AS {t.lower()}" for t in ("GREEN", "YELLOW", "RED")))
_DIFF = "(fp_bazett - fp_inverse_rr)"
_NO = (f"n, fp_bazett, fp_inverse_rr, fp_fridericia, {_DIFF} AS fp_avoided, {pct0(_DIFF, 'fp_bazett')} AS fp_avoided_pct, {pct0('fp_bazett', 'n')} AS fp_rate_bazett, {pct0('fp_inverse_rr', 'n')} AS fp_rate_inverse_rr, {pct0('fp_fridericia', 'n')} AS fp_rate_fridericia, "
       f"scenario_a, scenario_b, coalesce({div(_DIFF, 'n')}, 0e0) AS arr, {inf_div('n', _DIFF)} AS nnt, {inf_div('scenario_a', 'scenario_b')} AS benefit_harm_ratio")
_ND = "fp_avoided_pct fp_rate_bazett fp_rate_inverse_rr fp_rate_fridericia arr nnt benefit_harm_ratio"
_NM = "nr AS (SELECT * FROM e WHERE superclass = 'NORM')"


@query("e52_nnt", E(f"SELECT {_NO} FROM (SELECT {_NA} FROM nr)", extra=_DXX, more=_NM), dbl=_ND)
def _(spark, sf_dir):
    return impact.nnt(norm_rows(spark, sf_dir))


_NB = f"SELECT kind, label, n >= 100 AS enough, {_NO} FROM ({strata_sql([('hr', case('hr_bpm', fv.HR_BINS_COUNTED)), ('age', case('age', fv.AGE_BINS_COUNTED)), ('dataset', 'dataset')], _NA, 'nr')})"


@query("e53_nnt_by", E(_NB, extra=_DXX, more=_NM), dbl=_ND)
def _(spark, sf_dir):
    return impact.nnt_by(norm_rows(spark, sf_dir))


@query("e53_best_stratum", E(f"SELECT kind, arg_min(label, (CASE WHEN nnt < {INF} THEN round(nnt, 9) ELSE 9999e0 END, label)) AS label, arg_min(nnt, (CASE WHEN nnt < {INF} THEN round(nnt, 9) ELSE 9999e0 END, label)) AS nnt FROM ({_NB}) WHERE enough AND kind IN ('hr', 'age') GROUP BY kind", extra=_DXX, more=_NM), dbl="nnt")
def _(spark, sf_dir):
    return impact.best_stratum(impact.nnt_by(norm_rows(spark, sf_dir)))


@query("e54_triage_nnt", E(f"SELECT n, green, yellow, red, {pct('green', 'n')} AS green_pct, {pct('yellow', 'n')} AS yellow_pct, {pct('red', 'n')} AS red_pct, yellow + red AS base_positive, yellow AS urgent_avoided, {pct0('yellow', '(yellow + red)')} AS urgent_reduction_pct, {inf_div('n', 'yellow')} AS nnt_avoid_urgent FROM (SELECT {_NA} FROM nr)", extra=_DXX, more=_NM),
       dbl="green_pct yellow_pct red_pct urgent_reduction_pct nnt_avoid_urgent")
def _(spark, sf_dir):
    return impact.triage_nnt(norm_rows(spark, sf_dir))


@query("e55_cost_effectiveness", E(f"SELECT strategy, total AS total_cost, coalesce(total / nullif(n, 0), 0e0) AS cost_per_patient, w AS n_workups, fp_bazett * 650e0 - total AS savings, {pct0('(fp_bazett * 650e0 - total)', '(fp_bazett * 650e0)')} AS savings_pct FROM (SELECT * FROM a, LATERAL (VALUES ('bazett', fp_bazett * 650e0, fp_bazett), ('inverse_rr', fp_inverse_rr * 650e0, fp_inverse_rr), ('triage', yellow * 150e0 + red * 650e0, red)) s(strategy, total, w))", extra=_DXX, more=f"{_NM}, a AS (SELECT {_NA} FROM nr)"),
       dbl="total_cost cost_per_patient savings savings_pct")
def _(spark, sf_dir):
    return impact.cost_effectiveness(norm_rows(spark, sf_dir))


def _plain(fp, size):
    return f"CAST(trunc({fp} * ({size}e0 / n)) AS BIGINT)"


@query("e56_scenarios", E(f"""SELECT scenario, CAST(n_patients AS BIGINT) AS n_patients, b AS fp_bazett, k AS fp_inverse_rr, b - k AS fp_avoided, (b - k) * 650e0 AS cost_saved FROM (SELECT * FROM a, LATERAL (VALUES ('preoperative', 1000, {_plain('fp_bazett', 1000)}, {_plain('fp_inverse_rr', 1000)}),
 ('sports', 10000, CAST(trunc(10000e0 * CASE WHEN yn >= 100 THEN CAST(yb AS DOUBLE) / yn ELSE fp_bazett / CAST(n AS DOUBLE) END) AS BIGINT), CAST(trunc(10000e0 * CASE WHEN yn >= 100 THEN CAST(yk AS DOUBLE) / yn ELSE fp_inverse_rr / CAST(n AS DOUBLE) END) AS BIGINT)),
 ('drug_monitoring', 5000, {_plain('fp_bazett', 5000)}, {_plain('fp_inverse_rr', 5000)})) s(scenario, n_patients, b, k))""", extra=_DXX, more=f"{_NM}, a AS (SELECT {_NA}, count(*) FILTER (WHERE age < 35) AS yn, count(*) FILTER (WHERE age < 35 AND pb) AS yb, count(*) FILTER (WHERE age < 35 AND pk) AS yk FROM nr)"), dbl="cost_saved")
def _(spark, sf_dir):
    return impact.scenarios(norm_rows(spark, sf_dir))


# ---- types and demography -----------------------------------------------------------------
_TYPE = "CASE dataset WHEN 'ds_a' THEN 'SCREENING' WHEN 'ds_b' THEN 'CLINICAL' WHEN 'ds_c' THEN 'MIXED' WHEN 'ds_d' THEN 'EXTERNAL' WHEN 'ds_e' THEN 'SCREENING' END"


def types(spark, sf_dir):
    """Dataset dimension derived from the records; one dataset stays without a type."""
    return (ecg(spark, sf_dir).select("dataset").distinct()
            .withColumn("dataset_type", F.expr(_TYPE)).filter("dataset_type IS NOT NULL"))


_CT = union(f"SELECT '{kind}' AS kind, {label} AS label, '{f}' AS formula, count(q_{f}) AS n, corr(q_{f}, hr_bpm) AS r, abs(corr(q_{f}, hr_bpm)) AS abs_r FROM e WHERE {label} IS NOT NULL GROUP BY 2"
            for kind, label in (("dataset", "dataset"), ("type", _TYPE)) for f in crosstype.FORMULAS)


@query("e57_cross_type", E(_CT), dbl="r abs_r")
def _(spark, sf_dir):
    return crosstype.cross_type(qtc(spark, sf_dir), types(spark, sf_dir))


def _ty(t):
    return f"max(CASE WHEN kind = 'type' AND label = '{t}' AND formula = 'inverse_rr' THEN r END)"


@query("e57_cross_type_verdict", E(f"""SELECT *, abs(r_screening - r_clinical) AS delta_r, greatest(abs(r_screening), abs(r_clinical)) AS max_abs_r, 4e0 AS delta_k, 25e0 AS delta_c, greatest(abs(r_screening), abs(r_clinical)) < 0.05 AS passes_r_threshold, FALSE AS coefficients_stable
 FROM (SELECT {_ty('SCREENING')} AS r_screening, {_ty('CLINICAL')} AS r_clinical, {_ty('EXTERNAL')} AS r_external FROM ({_CT}))"""), dbl="r_screening r_clinical r_external delta_r max_abs_r delta_k delta_c")
def _(spark, sf_dir):
    found = spark.createDataFrame([("screening", 121.0, -150.0), ("clinical", 125.0, -175.0)], "domain string, k double, c double")
    return crosstype.cross_type_verdict(crosstype.cross_type(qtc(spark, sf_dir), types(spark, sf_dir)), found)


_DB = strata_sql([("sex", SEX), ("age", AGE), ("hr", HR3), ("sex_age", f"({SEX}) || '_' || ({AGE})"), ("sex_hr", f"({SEX}) || '_' || ({HR3})")],
                 "count(*) AS n, CASE WHEN count(q_inverse_rr) >= 20 THEN abs(corr(q_inverse_rr, hr_bpm)) END AS abs_r_inverse_rr, CASE WHEN count(q_bazett) >= 20 THEN abs(corr(q_bazett, hr_bpm)) END AS abs_r_bazett, avg(q_inverse_rr) AS mean_inverse_rr, avg(q_bazett) AS mean_bazett, avg(age) AS mean_age, avg(hr_bpm) AS mean_hr, "
                 f"{pct('count(*) FILTER (WHERE sex = 0)', 'count(*)')} AS pct_male, min(hr_bpm) AS min_hr, max(hr_bpm) AS max_hr")
_DBW = f"SELECT *, n >= CASE WHEN kind IN ('sex_age', 'sex_hr') THEN 50 ELSE 100 END AS enough FROM ({_DB})"


@query("e58_demographic_bias", E(_DBW), dbl="abs_r_inverse_rr abs_r_bazett mean_inverse_rr mean_bazett mean_age mean_hr pct_male min_hr max_hr")
def _(spark, sf_dir):
    return strata.demographic_bias(qtc(spark, sf_dir))


@query("e58_bias_range", E(f"SELECT kind, max(abs_r_inverse_rr) AS max_abs_r, min(abs_r_inverse_rr) AS min_abs_r, max(abs_r_inverse_rr) - min(abs_r_inverse_rr) AS range_abs_r, max(abs_r_inverse_rr) - min(abs_r_inverse_rr) > 0.02 AS bias_detected, arg_max(label, abs_r_inverse_rr) AS worse_group FROM ({_DBW}) WHERE enough GROUP BY kind"), dbl="max_abs_r min_abs_r range_abs_r")
def _(spark, sf_dir):
    return strata.bias_range(strata.demographic_bias(qtc(spark, sf_dir)))


_SP = each(FORMULAS, f"""SELECT hr_stratum, count(*) AS n_rows, count(*) >= 50 AS enough, min(hr_bpm) AS hr_min, max(hr_bpm) AS hr_max, '{{f}}' AS formula, count(q_{{f}}) AS n, corr(q_{{f}}, hr_bpm) AS r, avg(q_{{f}}) AS mean, stddev_pop(q_{{f}}) AS std, quantile_cont(q_{{f}}, 0.5) AS median, quantile_cont(q_{{f}}, 0.05) AS p5, quantile_cont(q_{{f}}, 0.95) AS p95,
 {', '.join(f"{pct(f'count(*) FILTER (WHERE q_{{f}} >= {t})', 'count(q_{f})')} AS pct_ge_{t}" for t in (450, 470, 500))} FROM e WHERE hr_stratum IS NOT NULL GROUP BY 1""")


@query("e59_stratum_profile", E(f"SELECT *, {p_sql('r', 'n')} AS p FROM ({_SP})", extra=f"{STRATUM} AS hr_stratum"), dbl="hr_min hr_max r p mean std median p5 p95 pct_ge_450 pct_ge_470 pct_ge_500")
def _(spark, sf_dir):
    return strata.stratum_profile(qtc(spark, sf_dir))


def two_way(t=450):
    b, k = f"q_bazett >= {t}", f"q_inverse_rr >= {t}"
    return (f"count(*) FILTER (WHERE NOT {b} AND NOT {k}) AS both_normal, count(*) FILTER (WHERE {b} AND {k}) AS both_prolonged, count(*) FILTER (WHERE NOT {b} AND {k}) AS new_only, count(*) FILTER (WHERE {b} AND NOT {k}) AS base_only")


_PARTS = ["both_normal", "both_prolonged", "new_only", "base_only"]
_SC = f"SELECT *, n >= 50 AS enough, {', '.join(f'{pct(p, chr(110))} AS pct_{p}' for p in _PARTS)}, {pct('(both_normal + both_prolonged)', 'n')} AS concordance_rate, {pct('(both_prolonged + new_only)', 'n')} AS new_prolongation_rate, {pct('(both_prolonged + base_only)', 'n')} AS base_prolongation_rate FROM (SELECT hr_stratum, count(*) AS n, {two_way()} FROM e WHERE hr_stratum IS NOT NULL GROUP BY 1)"


@query("e60_stratum_concordance", E(_SC, extra=f"{STRATUM} AS hr_stratum"), dbl=" ".join(f"pct_{p}" for p in _PARTS) + " concordance_rate new_prolongation_rate base_prolongation_rate")
def _(spark, sf_dir):
    return strata.stratum_concordance(qtc(spark, sf_dir))


@query("e61_extreme_cases", E(union(f"""SELECT '{n}' AS label, count(*) AS n, count(*) >= 20 AS enough, min(hr_bpm) AS min_hr, max(hr_bpm) AS max_hr, abs(corr(q_inverse_rr, hr_bpm)) AS abs_r_inverse_rr, abs(corr(q_bazett, hr_bpm)) AS abs_r_bazett, avg(q_inverse_rr) AS mean_inverse_rr, avg(q_bazett) AS mean_bazett,
 {pct('count(*) FILTER (WHERE q_inverse_rr >= 450)', 'count(*)')} AS pct_ge_450_inverse_rr, {pct('count(*) FILTER (WHERE q_bazett >= 450)', 'count(*)')} AS pct_ge_450_bazett FROM e WHERE {w} HAVING count(*) > 0""" for n, w in (("HR_below_50", "hr_bpm < 50"), ("HR_above_120", "hr_bpm > 120")))),
       dbl="min_hr max_hr abs_r_inverse_rr abs_r_bazett mean_inverse_rr mean_bazett pct_ge_450_inverse_rr pct_ge_450_bazett")
def _(spark, sf_dir):
    return strata.extreme_cases(qtc(spark, sf_dir), 50, 120)


@query("e61_extreme_verdict", E(f"""SELECT brady_ok, tachy_ok, brady_fn_ok, brady_ok AND tachy_ok AND brady_fn_ok AS passes FROM (SELECT count(*) FILTER (WHERE k > b + 0.02 AND starts_with(hr_stratum, 'Brady')) = 0 AS brady_ok, count(*) FILTER (WHERE k > b + 0.02 AND starts_with(hr_stratum, 'Tachy')) = 0 AS tachy_ok FROM
 (SELECT hr_stratum, max(CASE WHEN formula = 'inverse_rr' THEN abs(r) END) AS k, max(CASE WHEN formula = 'bazett' THEN abs(r) END) AS b FROM ({_SP}) WHERE enough GROUP BY 1)), (SELECT count(*) FILTER (WHERE enough AND hr_stratum = 'Brady_severe' AND pct_base_only > 10) = 0 AS brady_fn_ok FROM ({_SC}))""", extra=f"{STRATUM} AS hr_stratum"))
def _(spark, sf_dir):
    df = qtc(spark, sf_dir)
    return strata.extreme_verdict(strata.stratum_profile(df), strata.stratum_concordance(df))


@query("e69_threshold_compat", E(union(f"SELECT CAST({t} AS BIGINT) AS threshold, {pct('(both_prolonged + new_only)', 'n')} AS new_pct_prolonged, {pct('(both_prolonged + base_only)', 'n')} AS base_pct_prolonged, {pct('(both_normal + both_prolonged)', 'n')} AS concordance, {pct('new_only', 'n')} AS pct_new_only, {pct('base_only', 'n')} AS pct_base_only FROM (SELECT count(*) AS n, {two_way(t)} FROM e WHERE q_bazett IS NOT NULL)"
                                       for t in (440, 450, 460, 470, 500))), dbl="new_pct_prolonged base_pct_prolonged concordance pct_new_only pct_base_only")
def _(spark, sf_dir):
    return strata.threshold_compat(qtc(spark, sf_dir))


@query("e70_hr_scenarios", E(union(f"SELECT '{n}' AS scenario, count(*) AS n, count(*) > 100 AS enough, avg(q_inverse_rr) AS new_mean, avg(q_bazett) AS base_mean, avg(q_inverse_rr) - avg(q_bazett) AS difference FROM e WHERE {w} HAVING count(*) > 0"
                                   for n, w in (("resting_hr_60_80", "hr_bpm BETWEEN 60 AND 80"), ("bradycardia_hr_below_50", "hr_bpm < 50"), ("tachycardia_hr_above_100", "hr_bpm > 100"), ("post_exercise_hr_120_150", "hr_bpm BETWEEN 120 AND 150")))), dbl="new_mean base_mean difference")
def _(spark, sf_dir):
    return strata.hr_scenarios(qtc(spark, sf_dir))


@query("e86_coverage", E("SELECT coalesce(dataset, 'OVERALL') AS dataset, count(*) AS n, count(age) AS n_age, count(sex) AS n_sex FROM e GROUP BY ROLLUP (dataset)"))
def _(spark, sf_dir):
    return strata.coverage(ecg(spark, sf_dir))


# ---- safety -------------------------------------------------------------------------------
_FX = f"q_bazett >= 450 AS b, q_inverse_rr >= 450 AS k"


def outcomes(spark, sf_dir):
    """Records with concordance class and outcome flags of their study."""
    linked = joins.link_outcomes(qtc(spark, sf_dir), diag(spark, sf_dir).drop("subject_id"))
    return linked.withColumns({
        "concordance": cl.concordance(cl.prolonged_at("qtc_bazett"), cl.prolonged_at("qtc_inverse_rr")),
        "any_arrhythmia": codes.has_code_prefix("all_diag_all", fv.ICD_ANY_ARRHYTHMIA), "severe_arrhythmia": codes.has_code_prefix("all_diag_all", fv.ICD_SEVERE_ARRHYTHMIA),
        "deceased": F.col("dod").isNotNull(), "ventricular_arrhythmia": codes.icd_contains("all_diag_all", fv.ICD_VENTRICULAR), "cardiac_arrest": codes.icd_contains("all_diag_all", fv.ICD_ARREST),
        "mortality_30d": codes.died_within("dod", "ecg_time", 30), "mortality_90d": codes.died_within("dod", "ecg_time", 90), "mortality_inhospital": F.col("dod").isNotNull()})


_OM = (f"d AS ({DIAG_SQL}), o AS (SELECT e.*, {CONC} AS concordance, all_diag_all, dod, {prefix_sql(fv.ICD_ANY_ARRHYTHMIA)} AS any_arrhythmia, {prefix_sql(fv.ICD_SEVERE_ARRHYTHMIA)} AS severe, dod IS NOT NULL AS deceased, "
       f"{contains_sql(fv.ICD_VENTRICULAR)} AS ventricular_arrhythmia, {contains_sql(fv.ICD_ARREST)} AS cardiac_arrest, coalesce(floor((epoch_us(dod) - epoch_us(ecg_time)) / 86400e6) BETWEEN 0 AND 30, FALSE) AS mortality_30d, "
       f"coalesce(floor((epoch_us(dod) - epoch_us(ecg_time)) / 86400e6) BETWEEN 0 AND 90, FALSE) AS mortality_90d, dod IS NOT NULL AS mortality_inhospital FROM e JOIN d ON study_id = ecg_id)")


def patient_rows(spark, sf_dir):
    events = hosp(spark, sf_dir).filter(codes.icd_in("icd_code", fv.ICD_EVENT_CODES))
    dead = diag(spark, sf_dir).filter("dod IS NOT NULL")
    rows = qtc(spark, sf_dir).withColumn("concordance", cl.concordance(cl.prolonged_at("qtc_bazett"), cl.prolonged_at("qtc_inverse_rr")))
    return joins.flag_membership(rows, {"arrhythmia": events, "deceased": dead})


_PA = "count(DISTINCT CASE WHEN {c} THEN subject_id END)"
_PM = (f"ev AS (SELECT DISTINCT subject_id FROM ({HOSP_SQL}) WHERE {ICD_IN_SQL}), dd AS (SELECT DISTINCT subject_id FROM ({DIAG_SQL}) WHERE dod IS NOT NULL), "
       f"p AS (SELECT *, {CONC} AS concordance, subject_id IN (SELECT subject_id FROM ev) AS ar, subject_id IN (SELECT subject_id FROM dd) AS de FROM e)")
_PB = (f"SELECT concordance, count(*) AS n_records, count(DISTINCT subject_id) AS n_patients, {_PA.format(c='ar')} AS n_arrhythmia, {_PA.format(c='de')} AS n_deceased, {_PA.format(c='ar OR de')} AS n_any_event, avg(q_inverse_rr) AS mean_qtc_inverse_rr, avg(q_bazett) AS mean_qtc_bazett, avg(hr_bpm) AS mean_hr FROM p WHERE concordance <> 'unknown' GROUP BY 1")
_PB = f"SELECT *, {pct0('n_arrhythmia', 'n_patients')} AS pct_arrhythmia, {pct0('n_deceased', 'n_patients')} AS pct_deceased, {pct0('n_any_event', 'n_patients')} AS pct_any_event FROM ({_PB})"


@query("e62_outcomes_by_patient", E(_PB, extra=_FX, more=_PM), dbl="mean_qtc_inverse_rr mean_qtc_bazett mean_hr pct_arrhythmia pct_deceased pct_any_event")
def _(spark, sf_dir):
    return safety.outcomes_by_patient(patient_rows(spark, sf_dir))


_RB = (f"SELECT concordance, n_records, n_records >= 10 AS enough, n_patients, n_any_arrhythmia, n_severe_arrhythmia, n_deceased, n_any_severe_event, {pct('n_any_arrhythmia', 'n_records')} AS pct_any_arrhythmia, {pct('n_severe_arrhythmia', 'n_records')} AS pct_severe_arrhythmia, {pct('n_deceased', 'n_records')} AS pct_deceased, {pct('n_any_severe_event', 'n_records')} AS pct_any_severe_event, "
       f"mean_hr, mean_age, {pct('tachy', 'n_records')} AS pct_tachycardia, mean_qtc_inverse_rr, mean_qtc_bazett FROM (SELECT concordance, count(*) AS n_records, count(DISTINCT subject_id) AS n_patients, count(*) FILTER (WHERE any_arrhythmia) AS n_any_arrhythmia, count(*) FILTER (WHERE severe) AS n_severe_arrhythmia, count(*) FILTER (WHERE deceased) AS n_deceased, "
       "count(*) FILTER (WHERE severe OR deceased) AS n_any_severe_event, avg(hr_bpm) AS mean_hr, avg(age) AS mean_age, count(*) FILTER (WHERE hr_bpm >= 100) AS tachy, avg(q_inverse_rr) AS mean_qtc_inverse_rr, avg(q_bazett) AS mean_qtc_bazett FROM o WHERE concordance <> 'unknown' GROUP BY 1)")


@query("e63_outcomes_by_record", E(_RB, extra=_FX, more=_OM), dbl="pct_any_arrhythmia pct_severe_arrhythmia pct_deceased pct_any_severe_event mean_hr mean_age pct_tachycardia mean_qtc_inverse_rr mean_qtc_bazett")
def _(spark, sf_dir):
    return safety.outcomes_by_record(outcomes(spark, sf_dir))


@query("e63_outcome_summary", E(f"SELECT concordance, n_records, n_patients, n_severe_arrhythmia, n_deceased, round(mean_hr, 2) AS mean_hr, round(mean_qtc_inverse_rr, 2) AS mean_qtc_inverse_rr, round(mean_qtc_bazett, 2) AS mean_qtc_bazett FROM ({_RB})", extra=_FX, more=_OM))
def _(spark, sf_dir):
    return safety.outcome_summary(safety.outcomes_by_record(outcomes(spark, sf_dir)))


def safety_sql(src, n, ev, verdict):
    def at(c, g):
        return f"max(CASE WHEN concordance = '{g}' THEN {c} END)"
    cells = "CAST(events_reclassified AS DOUBLE) AS a, CAST(n_reclassified - events_reclassified AS DOUBLE) AS b, CAST(events_normal AS DOUBLE) AS c, CAST(n_normal - events_normal AS DOUBLE) AS d"
    return (f"SELECT n_reclassified, events_reclassified, n_normal, events_normal, r1 AS reclassified_event_rate, r2 AS normal_event_rate, r1 - r2 AS rate_difference, r1 / nullif(r2, 0) AS relative_risk, (a + b + c + d) * power(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2, "
            f"hr_difference, {verdict} AS verdict FROM (SELECT *, {pct('events_reclassified', 'n_reclassified')} AS r1, {pct('events_normal', 'n_normal')} AS r2, {cells} FROM (SELECT {at(n, 'reclassified_normal')} AS n_reclassified, {at(ev, 'reclassified_normal')} AS events_reclassified, {at(n, 'concordant_normal')} AS n_normal, {at(ev, 'concordant_normal')} AS events_normal, "
            f"{at('mean_hr', 'reclassified_normal')} - {at('mean_hr', 'concordant_normal')} AS hr_difference FROM ({src})))")


_SDBL = "reclassified_event_rate normal_event_rate rate_difference relative_risk chi2 hr_difference"


@query("e64_safety_by_patient", E(safety_sql(_PB, "n_patients", "n_any_event", "CASE WHEN r1 - r2 <= 0 THEN 'SAFE' WHEN r1 - r2 < 2 THEN 'ACCEPTABLE' ELSE 'CONCERN' END"), extra=_FX, more=_PM), dbl=_SDBL)
def _(spark, sf_dir):
    return safety.safety(safety.outcomes_by_patient(patient_rows(spark, sf_dir)), "patient", p_value=False)


_RECORD_VERDICT = "CASE WHEN r1 - r2 < 1 THEN 'SAFE' WHEN r1 - r2 < 2 THEN 'ACCEPTABLE' ELSE 'NEEDS_REVIEW' END"


@query("e64_safety_by_record", E(safety_sql(_RB, "n_records", "n_any_severe_event", _RECORD_VERDICT), extra=_FX, more=_OM), dbl=_SDBL)
def _(spark, sf_dir):
    return safety.safety(safety.outcomes_by_record(outcomes(spark, sf_dir)), "record", p_value=False)


# erf(x) = exp(-x^2) * sum of x^(2k+1) / gamma(k + 3/2) at x^2 = chi2 / 2.
_CHI_P = ("CASE WHEN chi2 IS NOT NULL THEN greatest(0e0, 1e0 - list_sum(list_transform(range(0, 100 + CAST(4 * chi2 AS BIGINT)), "
          "lambda k: exp((k + 0.5e0) * ln(greatest(chi2 / 2, 1e-300)) - chi2 / 2 - lgamma(k + 1.5e0))))) END")


@query("e64_safety_p_value", E(f"SELECT *, {_CHI_P} AS p_value FROM ({safety_sql(_RB, 'n_records', 'n_any_severe_event', _RECORD_VERDICT)})", extra=_FX, more=_OM), dbl=_SDBL + " p_value")
def _(spark, sf_dir):
    return safety.safety(safety.outcomes_by_record(outcomes(spark, sf_dir)), "record")


_CP = f"SELECT concordance, count(*) AS n, count(*) >= 10 AS enough, avg(hr_bpm) AS hr_mean, stddev_samp(hr_bpm) AS hr_std, quantile_cont(hr_bpm, 0.5) AS hr_median, {pct('count(*) FILTER (WHERE hr_bpm >= 100)', 'count(*)')} AS pct_tachycardia, {pct('count(*) FILTER (WHERE hr_bpm < 60)', 'count(*)')} AS pct_bradycardia, avg(q_inverse_rr) AS qtc_inverse_rr_mean, avg(q_bazett) AS qtc_bazett_mean, avg(qt_ms) AS qt_mean FROM o WHERE concordance <> 'unknown' GROUP BY 1"


@query("e65_class_profile", E(_CP, extra=_FX, more=_OM), dbl="hr_mean hr_std hr_median pct_tachycardia pct_bradycardia qtc_inverse_rr_mean qtc_bazett_mean qt_mean")
def _(spark, sf_dir):
    return safety.class_profile(outcomes(spark, sf_dir))


def _cat(c, g):
    return f"max(CASE WHEN concordance = '{g}' THEN {c} END)"


@query("e65_class_comparison", E(f"SELECT *, hr_difference > 5 OR tachycardia_difference > 10 AS faster FROM (SELECT {_cat('hr_mean', 'reclassified_normal')} - {_cat('hr_mean', 'concordant_normal')} AS hr_difference, {_cat('pct_tachycardia', 'reclassified_normal')} - {_cat('pct_tachycardia', 'concordant_normal')} AS tachycardia_difference FROM ({_CP}))", extra=_FX, more=_OM), dbl="hr_difference tachycardia_difference")
def _(spark, sf_dir):
    return safety.class_comparison(safety.class_profile(outcomes(spark, sf_dir)))


@query("e66_outcome_rates", E("SELECT *, reclassified_rate / nullif(normal_rate, 0) AS unadjusted_rr FROM (" + union(
    f"SELECT '{o}' AS outcome, CAST(count(*) FILTER (WHERE concordance = 'concordant_normal' AND {o}) AS DOUBLE) / count(*) FILTER (WHERE concordance = 'concordant_normal') AS normal_rate, CAST(count(*) FILTER (WHERE concordance = 'reclassified_normal' AND {o}) AS DOUBLE) / count(*) FILTER (WHERE concordance = 'reclassified_normal') AS reclassified_rate FROM o"
    for o in safety.OUTCOMES) + ")", extra=_FX, more=_OM), dbl="normal_rate reclassified_rate unadjusted_rr")
def _(spark, sf_dir):
    return safety.outcome_rates(outcomes(spark, sf_dir))


@query("e66_score_equations", E(union(
    f"SELECT '{o}' AS outcome, count({o}) AS n, count(*) FILTER (WHERE {o}) AS events, TRUE AS converged, 0e0 AS score FROM o WHERE concordance IN ('concordant_normal', 'reclassified_normal') AND age IS NOT NULL AND sex IS NOT NULL AND hr_bpm IS NOT NULL"
    for o in safety.OUTCOMES), extra=_FX, more=_OM), dbl="score")
def _(spark, sf_dir):
    """The likelihood has no slope at the solution; rows and events are those of the data."""
    return safety.odds_fits(outcomes(spark, sf_dir)).select("outcome", "n", "events", "converged", F.round("score", 6).alias("score"))


@query("e66_table7_adjusted_odds")
def _(spark, sf_dir):
    return safety.table7(outcomes(spark, sf_dir))


# ---- manuscript tables --------------------------------------------------------------------
REF6 = poly_cte("e", 6)
_PRED = ", ".join(f"coalesce(q_{f} >= thr, FALSE) AS p_{f}" for f in FORMULAS)
MS = f"{REF6}, ms AS (SELECT * EXCLUDE (qt_expected, at_one, mean_y, fit_n), coalesce(qt_ms - qt_expected + mean_y >= thr, FALSE) AS truth FROM pf)"


def MSQ(body, more=""):
    return E(body, c=-125, unknown=450, extra=_PRED, more=MS + (f", {more}" if more else ""))


def prepared(spark, sf_dir):
    return manuscript.prepare(ecg(spark, sf_dir))


_W = each(FORMULAS, "SELECT '{f}' AS formula, round(sum(a * n) / sum(n), 3) AS weighted_r FROM (SELECT count(*) AS n, abs(corr(q_{f}, hr_bpm)) AS a FROM ms GROUP BY dataset)")
_FPR = each(FORMULAS, f"SELECT '{{f}}' AS formula, round({pct0('count(*) FILTER (WHERE NOT truth AND p_{f})', 'count(*) FILTER (WHERE NOT truth)')}, 2) AS fp_rate_pct FROM ms")


def vs(c):
    return f"CASE WHEN {c} < base THEN printf('%.1fx better', base / {c}) WHEN {c} > base THEN printf('%.1fx worse', {c} / base) ELSE '---' END AS vs_base"


@query("e28_table2", MSQ(f"SELECT formula, weighted_r, fp_rate_pct, row_number() OVER (ORDER BY weighted_r, formula) AS rank, {vs('weighted_r')} FROM (SELECT *, max(CASE WHEN formula = 'bazett' THEN weighted_r END) OVER () AS base FROM ({_W}) JOIN ({_FPR}) USING (formula))"), dbl="weighted_r fp_rate_pct")
def _(spark, sf_dir):
    return manuscript.table2(prepared(spark, sf_dir))


_T5 = each(FORMULAS, "SELECT count(*) AS n_rows, '{f}' AS formula, round(abs(corr(q_{f}, hr_bpm)), 3) AS abs_r, " + counts_sql("truth", "p_{f}") + " FROM ms WHERE dataset = 'ds_f'")
_T5M = metric_sql(zero=None)


@query("e29_table5", MSQ(f"SELECT n_rows, formula, abs_r, round(100 * {_T5M['sensitivity']}, 1) AS sensitivity_pct, round(100 * {_T5M['specificity']}, 1) AS specificity_pct, fp, fn, round(100 * ({_T5M['fpr']}), 1) AS fp_rate_pct, row_number() OVER (ORDER BY abs_r, formula) AS rank, {vs('abs_r')} FROM (SELECT *, max(CASE WHEN formula = 'bazett' THEN abs_r END) OVER () AS base FROM ({_T5}))"), dbl="abs_r sensitivity_pct specificity_pct fp_rate_pct")
def _(spark, sf_dir):
    return manuscript.table5(manuscript.prepare(ecg(spark, sf_dir).filter("dataset = 'ds_f'")))


@query("e29_table5_intervals")
def _(spark, sf_dir):
    return manuscript.table5(prepared(spark, sf_dir), replicates=1000)


_T8S = (RES.replace("FROM e)", "FROM ms)", 1) + ", " + BINS.replace("FROM e)", "FROM rs2)", 1) +
        ", t8 AS (SELECT hb.*, coalesce(qt_ms >= qt_cut, FALSE) AS t_bin, coalesce(res >= cut, FALSE) AS t_res FROM hb LEFT JOIN hc USING (dataset, sex, hr_bin) LEFT JOIN rc ON rc.dataset = hb.dataset AND rc.sex IS NOT DISTINCT FROM hb.sex)")
_T8 = union(f"SELECT dataset, '{name}' AS reference, '{f}' AS formula, size, round(100 * ({_T5M['fpr']}), 1) AS fp_pct, round(100 * {_T5M['sensitivity']}, 1) AS sensitivity_pct FROM (SELECT dataset, count(*) AS size, {counts_sql(t, f'p_{f}')} FROM t8 GROUP BY dataset)"
            for name, t in (("Polynomial", "truth"), ("HR-Bin Percentile", "t_bin"), ("QT-RR Residuals", "t_res")) for f in FORMULAS)


@query("e30_table8", MSQ(_T8, _T8S), dbl="fp_pct sensitivity_pct")
def _(spark, sf_dir):
    return manuscript.table8(prepared(spark, sf_dir))


@query("e30_table8_weighted", MSQ(f"SELECT reference, formula, sum(fp_pct * size) / sum(size) AS fp_pct, sum(sensitivity_pct * size) / sum(size) AS sensitivity_pct FROM ({_T8}) WHERE fp_pct IS NOT NULL GROUP BY 1, 2", _T8S), dbl="fp_pct sensitivity_pct")
def _(spark, sf_dir):
    return manuscript.table8_weighted(manuscript.table8(prepared(spark, sf_dir)))


_MZ = "CASE WHEN hr_bpm < 60 THEN 'Bradycardia' WHEN hr_bpm <= 100 THEN 'Normal' WHEN hr_bpm > 100 THEN 'Tachycardia' END"
_MA = "CASE WHEN age < 40 THEN '<40' WHEN age < 65 THEN '40-65' WHEN age >= 65 THEN '>65' END"
_T3C = union(f"SELECT {s} AS stratum, dataset, count(*) AS n, {', '.join(f'CASE WHEN count(q_{f}) >= 10 THEN abs(corr(q_{f}, hr_bpm)) END AS r_{f}' for f in FORMULAS)} FROM ms WHERE {s} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30"
             for s in (f"'HR ' || ({_MZ})", f"'Age ' || ({_MA})"))


@query("e81_table3", MSQ(f"SELECT *, CASE WHEN abs_r_inverse_rr > 0 THEN abs_r_bazett / abs_r_inverse_rr END AS improvement FROM (SELECT stratum, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'round(sum(coalesce(r_{f}, 0) * n) / sum(n), 3) AS abs_r_{f}' for f in FORMULAS)} FROM ({_T3C}) GROUP BY 1)"), dbl=" ".join(f"abs_r_{f}" for f in FORMULAS) + " improvement")
def _(spark, sf_dir):
    return manuscript.table3(prepared(spark, sf_dir))


_T4 = each(FORMULAS, f"SELECT {_MA} AS age_group, {_MZ} AS zone, count(*) AS n, '{{f}}' AS formula, round({pct('count(*) FILTER (WHERE NOT truth AND p_{f})', 'count(*)')}, 2) AS fp_pct, round({pct('count(*) FILTER (WHERE truth AND NOT p_{f})', 'count(*)')}, 2) AS fn_pct, round({pct('count(*) FILTER (WHERE truth <> p_{f})', 'count(*)')}, 2) AS mc_pct FROM ms WHERE age IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10")


@query("e82_table4", MSQ(_T4), dbl="fp_pct fn_pct mc_pct")
def _(spark, sf_dir):
    return manuscript.table4(prepared(spark, sf_dir))


@query("e82_table4_pivot", MSQ(f"SELECT age_group, " + ", ".join(f'max(CASE WHEN zone = \'{z}\' THEN mc_pct END) AS "{z}"' for z in ("Bradycardia", "Normal", "Tachycardia")) + f" FROM ({_T4}) WHERE formula = 'bazett' GROUP BY 1"), dbl="Bradycardia Normal Tachycardia")
def _(spark, sf_dir):
    return manuscript.table4_pivot(manuscript.table4(prepared(spark, sf_dir)), "bazett")


def _t6(f):
    gap, sd = f"abs(q_{f} - thr)", f"(SELECT stddev_pop(q_{f}) FROM ms)"
    parts = [f"'{f}' AS formula"]
    for w, m in (("fp", f"NOT truth AND p_{f}"), ("fn", f"truth AND NOT p_{f}")):
        parts += [f"count(*) FILTER (WHERE {m} AND {gap} <= 10) AS {w}_near", f"count(*) FILTER (WHERE {m} AND {gap} > 10) AS {w}_far", f"count(*) FILTER (WHERE {m} AND {gap} > {sd}) AS {w}_1sd", f"count(*) FILTER (WHERE {m}) AS {w}_total"]
    return f"SELECT *, fp_far + fn_far AS significant FROM (SELECT {', '.join(parts)} FROM ms)"


@query("e83_table6", MSQ(union(_t6(f) for f in FORMULAS)))
def _(spark, sf_dir):
    return manuscript.table6(prepared(spark, sf_dir))


_H3 = ("inverse_rr", "bazett", "fridericia")
_HM = {f: metric_sql(*[f"{f}_{x}" for x in ("tp", "fp", "tn", "fn")], zero=None) for f in ("inverse_rr", "bazett")}
_H5 = ("sensitivity", "specificity", "ppv", "npv", "accuracy")


@query("e84_headline", MSQ(f"""SELECT n, {', '.join(f'r_{f}' for f in _H3)}, r_bazett / r_inverse_rr AS r_improvement, r_fridericia / r_bazett AS fridericia_vs_bazett, bazett_fp AS fp_bazett, inverse_rr_fp AS fp_inverse_rr, {pct('bazett_fp', 'nn')} AS fp_pct_bazett, {pct('inverse_rr_fp', 'nn')} AS fp_pct_inverse_rr,
 CAST(bazett_fp AS DOUBLE) / nullif(inverse_rr_fp, 0) AS fp_reduction, CASE WHEN bazett_fp > inverse_rr_fp THEN CAST(n AS DOUBLE) / (bazett_fp - inverse_rr_fp) END AS nnt, {', '.join(f'{_HM[f][m]} AS {m}_{f}' for f in ('inverse_rr', 'bazett') for m in _H5)}
 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE NOT truth) AS nn, {counts_sql('truth', 'p_bazett', 'bazett_')}, {counts_sql('truth', 'p_inverse_rr', 'inverse_rr_')} FROM ms), (SELECT {', '.join(f'sum(a_{f} * n) / sum(n) AS r_{f}' for f in _H3)} FROM (SELECT count(*) AS n, {', '.join(f'abs(corr(q_{f}, hr_bpm)) AS a_{f}' for f in _H3)} FROM ms GROUP BY dataset))"""),
       dbl=" ".join(f"r_{f}" for f in _H3) + " r_improvement fridericia_vs_bazett fp_pct_bazett fp_pct_inverse_rr fp_reduction nnt " + " ".join(f"{m}_{f}" for f in ("inverse_rr", "bazett") for m in _H5))
def _(spark, sf_dir):
    return manuscript.headline(prepared(spark, sf_dir))


@query("e85_per_dataset", MSQ("SELECT dataset, count(*) AS n, " + ", ".join(f"round(abs(corr(q_{f}, hr_bpm)), 4) AS abs_r_{f}" for f in _H3) + ", " + ", ".join(
    f"round({pct0(f'count(*) FILTER (WHERE NOT truth AND p_{f})', 'count(*) FILTER (WHERE NOT truth)')}, 2) AS fp_pct_{f}" for f in ("inverse_rr", "bazett")) + " FROM ms GROUP BY dataset"), dbl=" ".join(f"abs_r_{f}" for f in _H3) + " fp_pct_inverse_rr fp_pct_bazett")
def _(spark, sf_dir):
    return manuscript.per_dataset(prepared(spark, sf_dir))
