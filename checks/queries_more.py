"""Candidates, beats, sources, sinks, streams and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.fixtures import (BEATS_SQL, CATALOG_ROWS, CATALOG_SQL, ECG_SQL, STANDARD_SQL, beats, case, catalog, ecg, p_sql, poly_cte, query, strata_sql, table, union, with_ecg)
from checks.queries_reports import imp, pct
from checks.queries_rows import part_equations
from checks.queries_stats import REF, REF_Q, SUMMARY, qtc, with_ref
from isoqt import fixed_values as fv
from isoqt.functions.classify import bucketize
from isoqt.functions.formulas import FORMULAS, estimate_qt
from isoqt.operators import beats as bt
from isoqt.operators import moments, schema
from isoqt.plans import candidates, lifecycle, summaries
from isoqt.session import ensure_checkpoint_dir
from isoqt.sources import records, tables
from isoqt.streaming import ingest

E = with_ecg


def scratch(spark, name: str) -> str:
    """A new folder for one run, in the checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---- candidates ---------------------------------------------------------------------------
CAND = ", ".join(f"{s} AS q_{n}" for n, s in CATALOG_SQL.items())
NAMES = [*CATALOG_SQL, *STANDARD_SQL]
DROP = ", ".join(f"q_{f}" for f in FORMULAS)


def cataloged(spark, sf_dir):
    cat = candidates.FormulaCatalog.from_df(catalog(spark))
    return cat, cat.apply(with_ref(spark, sf_dir).drop(*[f"qtc_{f}" for f in FORMULAS]))


_FULL = {"direct": "'QTc = ' || equation", "factor": "'QTc = QT × (' || equation || ')'", "additive": "'QTc = QT + (' || equation || ')'"}


@query("i01_formula_catalog")
def _(spark, sf_dir):
    found = part_equations(spark, sf_dir).selectExpr("concat('cand_', id) AS name", "approach", "equation", "complexity", "abs_r AS score")
    return candidates.FormulaCatalog.from_df(found, top=10).to_df()


def eval_sql(names, by, ref="q_ref", keys=True):
    key = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return union(f"SELECT {key}'{f}' AS formula, count(q_{f}) AS n, corr(q_{f}, hr_bpm) AS r, avg(abs(q_{f} - {ref})) AS mae, sqrt(avg(power(q_{f} - {ref}, 2))) AS rmse, avg(q_{f}) AS mean, stddev_pop(q_{f}) AS std, abs(corr(q_{f}, hr_bpm)) AS abs_r, stddev_pop(q_{f}) / avg(q_{f}) AS cv FROM x {grp}" for f in names)



_X = f"{REF}, x AS (SELECT *, {REF_Q} AS q_ref FROM pf)"
_EV = "r mae rmse mean std abs_r cv"


@query("d08_evaluate_formulas", E(eval_sql(NAMES, "dataset"), extra=CAND, more=_X), dbl=_EV)
def _(spark, sf_dir):
    cat, df = cataloged(spark, sf_dir)
    return candidates.evaluate_formulas(df, cat.names)


def _clip(s):
    return f"CASE WHEN ({s}) IS NOT NULL THEN greatest(200e0, least(700e0, {s})) END"


_CL = ", ".join(f"{_clip(s)} AS q_{n}" for n, s in CATALOG_SQL.items())
_CV = ", ".join("('{}', '{}', '{}', {})".format(n, a, e, c) for n, a, e, c, _ in CATALOG_ROWS)
_E75 = f"""SELECT approach, CAST(complexity AS BIGINT) AS complexity, formula, equation, CASE approach WHEN 'direct' THEN {_FULL['direct']} WHEN 'factor' THEN {_FULL['factor']} ELSE {_FULL['additive']} END AS full_formula, round(r, 4) AS r_vs_hr, round(abs_r, 4) AS abs_r_hr,
 round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(abs_r, 4) + 0.1e0 * (complexity / 7e0) AS score FROM ({eval_sql(list(CATALOG_SQL), '')}) JOIN (VALUES {_CV}) c(formula, approach, equation, complexity) USING (formula)"""


@query("e75_evaluate_candidates", E(f"{_E75} ORDER BY score, formula LIMIT 3", extra=_CL, more=_X), dbl="score")
def _(spark, sf_dir):
    cat = candidates.FormulaCatalog.from_df(catalog(spark))
    return candidates.evaluate_candidates(with_ref(spark, sf_dir), cat, 3)


@query("e75_candidate_comparison", E("SELECT formula, round(r, 4) AS r_vs_hr, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mean, 2) AS mean, round(std, 2) AS std, round(rr, 4) AS r_vs_ref FROM (" + eval_sql(["cand_1", "bazett", "fridericia", "framingham"], "") + ") JOIN (" +
                                       union(f"SELECT '{f}' AS formula, corr(q_{f}, q_ref) AS rr FROM x" for f in ("cand_1", "bazett", "fridericia", "framingham")) + ") USING (formula)", extra=CAND, more=_X))
def _(spark, sf_dir):
    _, df = cataloged(spark, sf_dir)
    return candidates.candidate_comparison(df, ["cand_1", "bazett", "fridericia", "framingham"])


@query("e76_candidate_hr_bins", E(f"SELECT {case('hr_bpm', fv.HR_CANDIDATE_BINS)} AS bin, count(*) AS n, count(*) >= 10 AS enough, round(avg(q_cand_1), 2) AS candidate_mean, round(stddev_pop(q_cand_1), 2) AS candidate_std, round(avg(q_bazett), 2) AS bazett_mean, round(avg(q_fridericia), 2) AS fridericia_mean FROM e WHERE {case('hr_bpm', fv.HR_CANDIDATE_BINS)} IS NOT NULL GROUP BY 1", extra=CAND))
def _(spark, sf_dir):
    return candidates.candidate_hr_bins(cataloged(spark, sf_dir)[1], "cand_1")


@query("e77_candidate_by_dataset", E(f"SELECT dataset, n, enough, round(rc, 4) AS r_candidate, round(rb, 4) AS r_bazett, round({imp('abs(rb)', 'abs(rc)', '0.0001')}, 1) AS improvement FROM (SELECT dataset, count(*) AS n, count(*) >= 100 AND count(q_cand_1) >= 50 AS enough, corr(q_cand_1, hr_bpm) AS rc, corr(q_bazett, hr_bpm) AS rb FROM e GROUP BY 1)", extra=CAND))
def _(spark, sf_dir):
    return candidates.candidate_by_dataset(cataloged(spark, sf_dir)[1], "cand_1")


@query("e78_lodo", E(union(f"SELECT d AS held_out, '{f}' AS formula, count(q_{f}) FILTER (WHERE dataset <> d) AS n_rest, abs(corr(q_{f}, hr_bpm) FILTER (WHERE dataset <> d)) AS abs_r_rest, count(q_{f}) FILTER (WHERE dataset = d) AS n_held_out, abs(corr(q_{f}, hr_bpm) FILTER (WHERE dataset = d)) AS abs_r_held_out FROM e, (SELECT DISTINCT dataset AS d FROM ecg) GROUP BY d" for f in FORMULAS)), dbl="abs_r_rest abs_r_held_out")
def _(spark, sf_dir):
    return candidates.lodo(qtc(spark, sf_dir), FORMULAS)


@query("e80_best_approach", E(f"SELECT arg_min(approach, (abs_r_hr, approach, formula)) AS approach, arg_min(formula, (abs_r_hr, approach, formula)) AS formula, min(abs_r_hr) AS abs_r_hr FROM ({_E75})", extra=_CL, more=_X))
def _(spark, sf_dir):
    cat = candidates.FormulaCatalog.from_df(catalog(spark))
    return candidates.best_approach(candidates.evaluate_candidates(with_ref(spark, sf_dir), cat, 10))


_VB = case("hr_bpm", fv.HR_VALIDATION_BINS)
_LIM = "CASE WHEN sex = 1 THEN 460 ELSE 450 END"
_W, _N = f"(q_bazett > {_LIM})", f"(q_inverse_rr > {_LIM})"
_UA = f"count(*) AS n, count(*) FILTER (WHERE {_W}) AS base_prolonged, count(*) FILTER (WHERE {_N}) AS new_prolonged, count(*) FILTER (WHERE {_W} AND NOT {_N}) AS to_normal, count(*) FILTER (WHERE NOT {_W} AND {_N}) AS to_prolonged"


@query("e71_clinical_utility", E(f"SELECT *, {pct('base_prolonged', 'n')} AS base_prolonged_pct, {pct('new_prolonged', 'n')} AS new_prolonged_pct, to_normal - to_prolonged AS net, CASE WHEN to_prolonged > 0 THEN CAST(to_normal AS DOUBLE) / to_prolonged WHEN to_normal > 0 THEN CAST('inf' AS DOUBLE) ELSE 1e0 END AS benefit_risk_ratio FROM (" +
                                   strata_sql([("hr", _VB), ("overall", "'OVERALL'")], _UA, "uv") + ") WHERE kind = 'overall' OR n >= 10", more="uv AS (SELECT * FROM e WHERE qt_ms IS NOT NULL)"), dbl="base_prolonged_pct new_prolonged_pct benefit_risk_ratio")
def _(spark, sf_dir):
    return candidates.clinical_utility(qtc(spark, sf_dir), "inverse_rr")


def ladder(c, steps):
    return "CASE " + " ".join(f"WHEN {c} {op} {v} THEN {p}" for op, v, p in steps) + " ELSE 0 END"


_PL = union(f"SELECT '{f}' AS formula, hr_bpm, qt_ms, q_{f} AS q FROM e WHERE q_{f} IS NOT NULL" for f in FORMULAS)
_PP = (1, 5, 25, 50, 75, 95, 99)


@query("e72_plausibility", E(f"""SELECT *, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Acceptable' ELSE 'Poor' END AS grade FROM (SELECT *, CAST({ladder('pct_in_range', [('>=', 99, 30), ('>=', 95, 20), ('>=', 90, 10)])} + {ladder('abs(r_qtc_hr)', [('<', 0.02, 40), ('<', 0.05, 30), ('<', 0.1, 20), ('<', 0.15, 10)])}
 + {ladder('max_quartile_diff', [('<', 5, 20), ('<', 10, 15), ('<', 20, 10)])} + {ladder('cv', [('<', 0.08, 10), ('<', 0.12, 5)])} AS BIGINT) AS score FROM (SELECT formula, n, min, max, out_of_range_low, out_of_range_high, 100e0 * (1 - (out_of_range_low + out_of_range_high) / CAST(n AS DOUBLE)) AS pct_in_range, r_qtc_hr, r_qt_hr,
 CASE WHEN abs(r_qt_hr) > 0.01 THEN 1 - abs(r_qtc_hr) / abs(r_qt_hr) ELSE 0e0 END AS correction_effectiveness, mean, std, std / mean AS cv, {', '.join(f'p{p}' for p in _PP)}, mean_q1, mean_q2, mean_q3, mean_q4, greatest(mean_q1, mean_q2, mean_q3, mean_q4) - least(mean_q1, mean_q2, mean_q3, mean_q4) AS max_quartile_diff
 FROM (SELECT formula, count(*) AS n, min(q) AS min, max(q) AS max, count(*) FILTER (WHERE q < 250) AS out_of_range_low, count(*) FILTER (WHERE q > 650) AS out_of_range_high, corr(q, hr_bpm) AS r_qtc_hr, corr(qt_ms, hr_bpm) AS r_qt_hr, avg(q) AS mean, stddev_pop(q) AS std, {', '.join(f'quantile_cont(q, {p / 100}) AS p{p}' for p in _PP)},
 avg(q) FILTER (WHERE k = 1) AS mean_q1, avg(q) FILTER (WHERE k = 2) AS mean_q2, avg(q) FILTER (WHERE k = 3) AS mean_q3, avg(q) FILTER (WHERE k = 4) AS mean_q4 FROM (SELECT pl.*, CASE WHEN hr_bpm <= c1 THEN 1 WHEN hr_bpm <= c2 THEN 2 WHEN hr_bpm <= c3 THEN 3 ELSE 4 END AS k FROM pl JOIN (SELECT formula, quantile_cont(hr_bpm, 0.25) AS c1, quantile_cont(hr_bpm, 0.5) AS c2, quantile_cont(hr_bpm, 0.75) AS c3 FROM pl GROUP BY 1) USING (formula)) GROUP BY 1)))""",
                               more=f"pl AS ({_PL})"), dbl="min max pct_in_range r_qtc_hr r_qt_hr correction_effectiveness mean std cv mean_q1 mean_q2 mean_q3 mean_q4 max_quartile_diff " + " ".join(f"p{p}" for p in _PP))
def _(spark, sf_dir):
    return candidates.plausibility(qtc(spark, sf_dir), FORMULAS)


_IM = union(f"SELECT '{f}' AS formula, sum(a * n) / sum(n) AS w, avg(a) AS m, stddev_pop(a) AS sd FROM (SELECT count(q_{f}) AS n, abs(corr(q_{f}, hr_bpm)) AS a FROM e GROUP BY dataset)" for f in NAMES)
_OPS = {"cand_1": 2, "cand_2": 0, "cand_3": 2, "cand_4": 0}
_SIM = {"cand_1": "Similar to Framingham/Hodges", "cand_2": "Similar to Bazett", "cand_3": "Direct approach (novel)", "cand_4": "Similar to Fridericia"}
_IV = ", ".join(f"('{n}', '{a}', {_OPS[n]}, '{_SIM[n]}')" for n, a, *_ in CATALOG_ROWS)


@query("e73_interest", E(f"""SELECT name, approach, n_operations, similarity, improvement, mean_abs_r, cv_r, interest_score, CASE WHEN interest_score >= 70 THEN 'High' WHEN interest_score >= 50 THEN 'Moderate' WHEN interest_score >= 30 THEN 'Low' ELSE 'Minimal' END AS interest_grade,
 CASE WHEN interest_score >= 75 THEN 'tier-1' WHEN interest_score >= 50 THEN 'specialty' WHEN interest_score >= 30 THEN 'needs validation' ELSE 'limited' END AS publication_potential FROM (SELECT *, greatest(0, least(100, {ladder('improvement', [('>', 5, 35), ('>', 3, 25), ('>', 2, 15), ('>', 1.5, 10)])} + {ladder('mean_abs_r', [('<', 0.03, 25), ('<', 0.05, 20), ('<', 0.08, 15), ('<', 0.1, 10)])}
 + CASE WHEN similarity IN ('Novel structure', 'Direct approach (novel)') THEN 20 ELSE 5 END + {ladder('n_operations', [('<=', 2, 20), ('<=', 4, 15), ('<=', 6, 10)])})) AS interest_score FROM (SELECT c.*, s.m AS mean_abs_r, s.sd / s.m AS cv_r, b.w / s.w AS improvement FROM (VALUES {_IV}) c(name, approach, n_operations, similarity) JOIN sm s ON s.formula = name, (SELECT w FROM sm WHERE formula = 'bazett') b))""",
                         extra=CAND, more=f"sm AS ({_IM})"), dbl="improvement mean_abs_r cv_r", big="n_operations interest_score")
def _(spark, sf_dir):
    cat, df = cataloged(spark, sf_dir)
    summary = candidates.cross_dataset_summary(moments.hr_corr(df, cat.names, ["dataset"]))
    return candidates.interest(cat.to_df(), summary)


@query("g01_top_n", E("SELECT formula, abs_r, row_number() OVER (ORDER BY abs_r, formula) AS rank, CASE WHEN abs_r < base THEN printf('%.1fx better', base / abs_r) WHEN abs_r > base THEN printf('%.1fx worse', abs_r / base) ELSE '---' END AS vs_base FROM (SELECT *, max(CASE WHEN formula = 'bazett' THEN abs_r END) OVER () AS base FROM (" +
                        union(f"SELECT '{f}' AS formula, abs(corr(q_{f}, hr_bpm)) AS abs_r FROM e" for f in FORMULAS) + ")) ORDER BY rank LIMIT 3"), dbl="abs_r")
def _(spark, sf_dir):
    return schema.top_n(moments.hr_corr(qtc(spark, sf_dir)).select("formula", "abs_r"), "abs_r", 3)


# ---- beats --------------------------------------------------------------------------------
B = f"WITH b AS ({BEATS_SQL}), br AS (SELECT *, lead(r_peak) OVER (PARTITION BY ecg_id ORDER BY beat_no) - r_peak AS rr FROM b) "


def _in(e, lo, hi):
    return f"CASE WHEN {e} > {lo} AND {e} < {hi} THEN {e} END"


_RRM = "quantile_cont(rr * 2e0, 0.5)"
_PR = f"quantile_cont(CASE WHEN rr IS NOT NULL THEN {_in('((r_peak - p_onset) * 2e0)', 80, 400)} END, 0.5)"
_QRS = f"quantile_cont({_in('((s_peak - q_peak) * 2e0)', 40, 200)}, 0.5)"
_QT = f"quantile_cont({_in('((t_offset - coalesce(q_peak, r_peak - 20)) * 2e0)', 200, 700)}, 0.5)"


@query("f01_rr_from_beats", B + f"SELECT ecg_id, {_RRM} AS rr_ms, 60000e0 / {_RRM} AS hr_bpm FROM br GROUP BY ecg_id", dbl="rr_ms hr_bpm")
def _(spark, sf_dir):
    return bt.rr_from_beats(beats(spark, sf_dir))


for _id, _name, _sql in (("f02_pr_interval", "pr_ms", _PR), ("f03_qrs_duration", "qrs_ms", _QRS), ("f04_qt_interval", "qt_ms", _QT)):
    @query(_id, B + f"SELECT ecg_id, {_sql} AS {_name} FROM br GROUP BY ecg_id", dbl=_name)
    def _(spark, sf_dir, name=_name):
        return bt.beat_interval(beats(spark, sf_dir), name)


# Signals: the embedding with the key of the record (modulo); peaks fall inside and outside of it.
_PEAKS = ("SELECT ecg_id, beat_no, (r_peak % 70) - 3 AS r_peak, CASE WHEN p_onset IS NOT NULL THEN p_onset % 64 END AS p_peak, CASE WHEN t_offset IS NOT NULL THEN t_offset % 80 END AS t_peak FROM {b}")


def _amp(p):
    return f"quantile_cont(CAST(CASE WHEN {p} >= 0 AND {p} < 64 THEN embedding[{p} + 1] END AS DOUBLE), 0.5)"


@query("f05_amplitudes", B + f", pk AS ({_PEAKS.format(b='b')}) SELECT ecg_id, {_amp('r_peak')} AS r_amplitude, {_amp('p_peak')} AS p_amplitude, {_amp('t_peak')} AS t_amplitude FROM pk JOIN embeddings ON vec_id = ecg_id % 500 GROUP BY ecg_id", dbl="r_amplitude p_amplitude t_amplitude")
def _(spark, sf_dir):
    peaks = spark.sql(_PEAKS.format(b="{b}"), b=beats(spark, sf_dir))
    ids = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS ecg_id", "o_orderkey % 500 AS vec_id")
    signals = ids.join(table(spark, sf_dir, "embeddings"), "vec_id").selectExpr("ecg_id", "embedding AS signal")
    return bt.amplitudes(peaks, signals)


@query("f06_detection_rates", B + "SELECT ecg_id, count(*) AS n_beats, count(p_onset) / CAST(count(*) AS DOUBLE) AS p_wave_detection_rate, count(t_offset) / CAST(count(*) AS DOUBLE) AS t_wave_detection_rate FROM b GROUP BY ecg_id HAVING count(*) >= 3", dbl="p_wave_detection_rate t_wave_detection_rate")
def _(spark, sf_dir):
    return bt.detection_rates(beats(spark, sf_dir))


_FEAT = f"SELECT ecg_id, count(*) AS n_beats, {_RRM} AS rr_ms, {_PR} AS pr_ms, {_QRS} AS qrs_ms, {_QT} AS qt_ms, count(p_onset) / CAST(count(*) AS DOUBLE) AS p_wave_detection_rate, count(t_offset) / CAST(count(*) AS DOUBLE) AS t_wave_detection_rate, {_RRM} / 1000e0 AS rr_s, 60000e0 / {_RRM} AS hr_bpm FROM br GROUP BY ecg_id"


@query("f07_record_features", B + _FEAT, dbl="rr_ms pr_ms qrs_ms qt_ms p_wave_detection_rate t_wave_detection_rate rr_s hr_bpm")
def _(spark, sf_dir):
    return bt.record_features(beats(spark, sf_dir))


_ARR = f"quantile_cont({_in('(rr / 500e0)', 0.4, 2.0)}, 0.5)"
_AQT = f"quantile_cont({_in('((t_offset - q_peak) * 2e0)', 200, 600)}, 0.5)"


@query("f08_alt_intervals", B + f"SELECT ecg_id, {_AQT} AS qt_ms, {_ARR} AS rr_s, count(*) AS n_beats, 60e0 / {_ARR} AS hr_bpm FROM br GROUP BY ecg_id HAVING {_AQT} IS NOT NULL AND {_ARR} IS NOT NULL", dbl="qt_ms rr_s hr_bpm")
def _(spark, sf_dir):
    return bt.alt_intervals(beats(spark, sf_dir))


@query("f09_is_usable", E("SELECT ecg_id, coalesce(signal_quality > 0.3 AND ecg_id % 9 > 0 AND hr_bpm <> 0, FALSE) AS is_usable FROM e"))
def _(spark, sf_dir):
    df = ecg(spark, sf_dir).selectExpr("ecg_id", "signal_quality > 0.3 AS usable", "ecg_id % 9 AS n_beats", "hr_bpm")
    return df.select("ecg_id", bt.is_usable().alias("is_usable"))


_AG = (f"a AS ({_FEAT}), z AS (SELECT ecg_id, {_AQT} AS qb, {_ARR} AS rb FROM br GROUP BY ecg_id HAVING {_AQT} IS NOT NULL AND {_ARR} IS NOT NULL), "
       "y AS (SELECT *, qt_ms + 125e0 / rr_s - 158e0 AS na, qb + 125e0 / rb - 158e0 AS nb, qt_ms / sqrt(rr_s) AS ba, qb / sqrt(rb) AS bb, 60e0 / rr_s AS hr FROM a LEFT JOIN z USING (ecg_id)), v AS (SELECT * FROM y WHERE qt_ms IS NOT NULL AND qb IS NOT NULL)")


@query("e67_method_agreement", B + f""", {_AG} SELECT *, abs_r_new_a < 0.05 AS passes_a, abs_r_new_b < 0.05 AS passes_b, abs_r_new_a < 0.05 AND abs_r_new_b < 0.05 AS passes_both FROM (SELECT count(*) AS n_total, {pct('count(qt_ms)', 'count(*)')} AS success_rate_a, {pct('count(qb)', 'count(*)')} AS success_rate_b FROM y),
 (SELECT count(*) AS n_both_valid, corr(qt_ms, qb) AS qt_correlation, corr(rr_s, rb) AS rr_correlation, avg(qt_ms - qb) AS qt_mean_diff, stddev_samp(qt_ms - qb) AS qt_std_diff, abs(corr(na, hr)) AS abs_r_new_a, abs(corr(nb, hr)) AS abs_r_new_b, abs(corr(ba, hr)) AS abs_r_base_a, abs(corr(bb, hr)) AS abs_r_base_b FROM v)""",
       dbl="success_rate_a success_rate_b qt_correlation rr_correlation qt_mean_diff qt_std_diff abs_r_new_a abs_r_new_b abs_r_base_a abs_r_base_b")
def _(spark, sf_dir):
    b = beats(spark, sf_dir)
    a = bt.record_features(b).selectExpr("ecg_id", "qt_ms AS qt_a", "rr_s AS rr_a")
    other = bt.alt_intervals(b).selectExpr("ecg_id", "qt_ms AS qt_b", "rr_s AS rr_b")
    return candidates.method_agreement(a.join(other, "ecg_id", "left"))


@query("e68_manual_check", E(f"SELECT * EXCLUDE (n_inverse_rr, n_bazett), {p_sql('abs_r_inverse_rr', 'n_inverse_rr')} AS p_inverse_rr, {p_sql('abs_r_bazett', 'n_bazett')} AS p_bazett FROM ("
                           "SELECT count(*) AS n, abs(corr(q_inverse_rr, hr_bpm)) AS abs_r_inverse_rr, abs(corr(q_bazett, hr_bpm)) AS abs_r_bazett, abs(corr(q_inverse_rr, hr_bpm)) < 0.05 AS passes, "
                           "count(q_inverse_rr) AS n_inverse_rr, count(q_bazett) AS n_bazett "
                           "FROM e WHERE qt_ms BETWEEN 200 AND 600 AND rr_s BETWEEN 0.4 AND 2.0)"), dbl="abs_r_inverse_rr abs_r_bazett p_inverse_rr p_bazett")
def _(spark, sf_dir):
    return candidates.manual_check(schema.valid_range(qtc(spark, sf_dir)))


# ---- summaries ----------------------------------------------------------------------------
@query("e79_run_summary", E("SELECT n_processed, n_usable, n_processed - n_usable AS n_failed, round(100e0 * n_usable / n_processed, 2) AS success_rate_pct FROM (SELECT count(*) AS n_processed, count(*) FILTER (WHERE signal_quality > 0.3) AS n_usable FROM e)"))
def _(spark, sf_dir):
    return summaries.run_summary(ecg(spark, sf_dir).withColumn("is_usable", F.col("signal_quality") > 0.3))


@query("e79_interval_statistics", E(union(f"SELECT '{c}' AS interval, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(quantile_cont({c}, 0.5), 2) AS median FROM e" for c in ("qt_ms", "rr_ms", "hr_bpm"))))
def _(spark, sf_dir):
    return summaries.interval_statistics(ecg(spark, sf_dir), ["qt_ms", "rr_ms", "hr_bpm"])


@query("e79_prep_report", E(union(strata_sql([("superclass", "superclass"), ("overall", "'OVERALL'")], f"'{f}' AS formula, count(q_{f}) AS n, round(corr(q_{f}, hr_bpm), 4) AS r") for f in FORMULAS)))
def _(spark, sf_dir):
    return summaries.prep_report(qtc(spark, sf_dir))


@query("e79_demographics", E("SELECT round(avg(age), 1) AS age_mean, round(stddev_samp(age), 1) AS age_std, round(100e0 * count(age) / count(*), 1) AS age_completeness, round(100e0 * count(sex) / count(*), 1) AS sex_completeness, count(*) FILTER (WHERE sex = 0) AS n_male, count(*) FILTER (WHERE sex = 1) AS n_female FROM e"))
def _(spark, sf_dir):
    return summaries.demographics(ecg(spark, sf_dir))


# ---- sources and sinks --------------------------------------------------------------------
_RT = E("SELECT ecg_id, qt_ms, hr_bpm, superclass FROM e")


def _small(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", "qt_ms", "hr_bpm", "superclass")


@query("a01_read_delimited_eu", _RT, dbl="qt_ms hr_bpm")
def _(spark, sf_dir):
    path = scratch(spark, "eu")
    tables.write_table(_small(spark, sf_dir), path, "csv", "eu")
    out = tables.read_delimited(spark, [f"{path}/missing", path], numeric=["qt_ms", "hr_bpm"])
    return out.withColumn("ecg_id", F.col("ecg_id").cast("bigint"))


@query("a01_read_delimited_std", _RT, dbl="qt_ms hr_bpm")
def _(spark, sf_dir):
    path = scratch(spark, "std")
    tables.write_table(_small(spark, sf_dir), path, "csv", "std")
    return tables.read_delimited(spark, path)


@query("a02_read_table_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query("a03_read_table_gzip", _RT, dbl="qt_ms hr_bpm")
def _(spark, sf_dir):
    path = f"{scratch(spark, 'gz')}/hosp.csv.gz"
    _small(spark, sf_dir).write.option("header", True).option("compression", "gzip").csv(path)
    return tables.read_table(spark, path, "ecg_id bigint, qt_ms double, hr_bpm double, superclass string")


@query("a05_load_pool", E("SELECT dataset, count(*) AS n FROM e GROUP BY 1"))
def _(spark, sf_dir):
    df = ecg(spark, sf_dir)
    parts = {d: df.filter(F.col("dataset") == d).drop("dataset", *(["age"] if d == "ds_c" else [])) for d in ("ds_a", "ds_b", "ds_c", "ds_d", "ds_e", "ds_f")}
    return tables.load_pool(parts)[1]


def _paths(spark, sf_dir):
    """File listing derived from orders: headers, data files and others by key."""
    df = table(spark, sf_dir, "orders").selectExpr("explode(array(concat('db/', o_custkey % 7, '/R', o_orderkey, '.hea'), CASE WHEN o_orderkey % 3 = 0 THEN concat('db/', o_custkey % 7, '/r', o_orderkey, '.dat') "
                                                   "WHEN o_orderkey % 3 = 1 THEN concat('db/', o_custkey % 7, '/R', o_orderkey, '.MAT') ELSE concat('db/x/R', o_orderkey, '.dat') END)) AS path")
    return records.split_paths(df)


@query("a06_file_inventory", "SELECT 'db/' || (o_custkey % 7) || '/R' || o_orderkey AS record_path FROM orders WHERE o_orderkey % 3 < 2")
def _(spark, sf_dir):
    return records.records(_paths(spark, sf_dir)).select("record_path")


@query("a06_extension_counts", "SELECT ext, count(*) AS n FROM (SELECT unnest(['.hea', CASE WHEN o_orderkey % 3 = 1 THEN '.mat' ELSE '.dat' END]) AS ext FROM orders) GROUP BY 1")
def _(spark, sf_dir):
    return records.extension_counts(_paths(spark, sf_dir))


def _headers(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('h', lpad(o_orderkey, 9, '0')) AS path", "o_orderkey",
        "concat('rec 12 500\\n#Age: ', o_custkey % 90, '\\n# Sex: ', CASE o_orderkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'F' WHEN 2 THEN 'unknown' ELSE '1' END, '\\n#Dx: 426783006, ', o_custkey, ',abc\\n#Rx: none') AS header")


@query("a08_read_headers", "SELECT o_orderkey, CAST(o_custkey % 90 AS DOUBLE) AS age, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 2 THEN NULL ELSE 1 END AS sex, '426783006|' || o_custkey AS codes FROM orders", dbl="age")
def _(spark, sf_dir):
    return records.parse_headers(_headers(spark, sf_dir)).select("o_orderkey", "age", "sex", F.array_join("codes", "|").alias("codes"))


@query("a09_has_coded_headers", "SELECT count(*) > 0 AS has_coded_headers FROM orders")
def _(spark, sf_dir):
    return records.has_coded_headers(_headers(spark, sf_dir))


@query("a10_read_manifest", "SELECT 'data/files/' || o_orderkey || '.hea' AS record_path FROM orders")
def _(spark, sf_dir):
    path = scratch(spark, "manifest")
    table(spark, sf_dir, "orders").selectExpr("concat('files/', o_orderkey, '.hea') AS path").write.mode("overwrite").option("header", True).csv(path)
    return tables.read_manifest(spark, path, "data/")


@query("a13_compact", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf_dir):
    path = scratch(spark, "compact")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(16).write.mode("overwrite").parquet(f"{path}/parts")
    return tables.compact(spark, f"{path}/parts", f"{path}/merged")


@query("a14_write_table_json", _RT, dbl="qt_ms hr_bpm")
def _(spark, sf_dir):
    path = f"{scratch(spark, 'json')}/t.json"
    tables.write_table(_small(spark, sf_dir), path, "json")
    return tables.read_table(spark, path, "ecg_id bigint, qt_ms double, hr_bpm double, superclass string")


@query("a15_flatten_report", E("SELECT superclass AS population, count(*) AS n, avg(hr_bpm) AS hr_mean FROM e GROUP BY 1"), dbl="hr_mean")
def _(spark, sf_dir):
    rows = ecg(spark, sf_dir).groupBy("superclass").agg(F.count(F.lit(1)).alias("n"), F.avg("hr_bpm").alias("hr_mean"))
    nested = rows.withColumn("sub", F.struct("n")).agg(F.map_from_entries(F.collect_list(F.struct("superclass", F.struct("n", "hr_mean", "sub")))).alias("report"))
    return tables.flatten_report(nested, "report", "population")


@query("a16_sample_export", E("SELECT ecg_id, hr_bpm, sex, dataset, qt_ms + 125e0 / rr_s - 125e0 AS qtc_inverse_rr, q_bazett AS qtc_bazett FROM e ORDER BY substring(md5('42|' || ecg_id), 1, 15), ecg_id LIMIT 5000"), dbl="hr_bpm qtc_inverse_rr qtc_bazett")
def _(spark, sf_dir):
    return tables.sample_export(qtc(spark, sf_dir, "c125"), 5000, ["ecg_id", "hr_bpm", "sex", "dataset", "qtc_inverse_rr", "qtc_bazett"])


@query("a17_route_errors", E("SELECT ecg_id, 'No QT interval' AS error FROM e WHERE qt_ms IS NULL AND ecg_id % 10 >= 3 UNION ALL SELECT ecg_id, 'Too few R-peaks' FROM e WHERE ecg_id % 10 < 3"))
def _(spark, sf_dir):
    df = ecg(spark, sf_dir).withColumn("n_beats", F.col("ecg_id") % 10)
    return tables.route_errors(df, tables.record_error())[1]


# ---- streams ------------------------------------------------------------------------------
def _arrivals(spark, sf_dir):
    """Events as arriving records, written as several files; every third id arrives twice."""
    path = scratch(spark, "arrivals")
    ev = table(spark, sf_dir, "events").selectExpr("event_id AS ecg_id", "CAST(ts AS TIMESTAMP) AS ts", "value", "IF(event_type = 'error', 0, 5) AS n_beats")
    ev.unionByName(ev.filter("ecg_id % 3 = 0")).repartition(6).write.mode("overwrite").parquet(path)
    return path, ev.schema


@query("h01_ingest_stream", "SELECT event_id AS ecg_id, value FROM events WHERE event_type <> 'error'", dbl="value")
def _(spark, sf_dir):
    path, fields = _arrivals(spark, sf_dir)
    out = scratch(spark, "ingest")
    reason = F.when(F.col("n_beats") < 3, "Too few R-peaks")
    for _ in range(2):  # the second run finds nothing left to do
        rows = ingest.dedup_stream(ingest.read_stream(spark, path, fields, files_per_batch=2))
        ingest.ingest_stream(rows, f"{out}/good", f"{out}/ckpt", reason=reason, errors=f"{out}/bad").awaitTermination()
    return spark.read.parquet(f"{out}/good").select("ecg_id", "value")


@query("h02_dedup_stream", "SELECT event_id AS ecg_id FROM events")
def _(spark, sf_dir):
    path, fields = _arrivals(spark, sf_dir)
    out = scratch(spark, "dedup")
    rows = ingest.read_stream(spark, path, fields, files_per_batch=3)
    ingest.ingest_stream(rows, f"{out}/good", f"{out}/ckpt", keys=["ecg_id"]).awaitTermination()
    return spark.read.parquet(f"{out}/good").select("ecg_id")


@query("h04_progress", "SELECT count(*) + count(*) FILTER (WHERE event_id % 3 = 0) AS seen, count(*) FILTER (WHERE event_type = 'error') + count(*) FILTER (WHERE event_id % 3 = 0 AND event_type = 'error') AS failed FROM events", big="seen failed")
def _(spark, sf_dir):
    path, fields = _arrivals(spark, sf_dir)
    out = scratch(spark, "progress")
    reason = F.when(F.col("n_beats") < 3, "Too few R-peaks")
    rows = ingest.read_stream(spark, path, fields, files_per_batch=2)
    ingest.ingest_stream(rows, f"{out}/good", f"{out}/ckpt", reason=reason, errors=f"{out}/bad", metrics=f"{out}/metrics").awaitTermination()
    return spark.read.parquet(f"{out}/metrics").agg(F.sum("seen").alias("seen"), F.sum("failed").alias("failed"))


# ---- end-to-end runs ----------------------------------------------------------------------
_PQ = "qt_ms BETWEEN 200 AND 600 AND rr_ms BETWEEN 400 AND 2000 AND hr_bpm BETWEEN 30 AND 150 AND signal_quality >= 0.3 AND t_wave_detection_rate >= 0.5"
_PW = (B + f", f AS ({_FEAT}), ecg AS ({ECG_SQL}), w AS (SELECT f.*, age, sex, superclass, signal_quality, dataset FROM f JOIN (SELECT ecg_id, age, sex, superclass, signal_quality, dataset FROM ecg) USING (ecg_id)), "
       f"g AS (SELECT * FROM w WHERE {_PQ}), " + poly_cte("g", 2))


@query("prepared_dataset_end_to_end", _PW + " SELECT ecg_id, age, sex, qt_ms, rr_ms, rr_s, hr_bpm, qrs_ms, pr_ms, signal_quality, t_wave_detection_rate, superclass, qt_ms - qt_expected + at_one AS qtc_reference_ms, qt_expected AS qt_expected_ms, "
       "qt_ms / sqrt(rr_s) AS qtc_bazett, qt_ms / cbrt(rr_s) AS qtc_fridericia, qt_ms + 154e0 * (1e0 - rr_s) AS qtc_framingham, qt_ms + 1.75e0 * (hr_bpm - 60e0) AS qtc_hodges FROM pf",
       dbl="age qt_ms rr_ms rr_s hr_bpm qrs_ms pr_ms signal_quality t_wave_detection_rate qtc_reference_ms qt_expected_ms qtc_bazett qtc_fridericia qtc_framingham qtc_hodges")
def _(spark, sf_dir):
    features = ecg(spark, sf_dir).select("ecg_id", "age", "sex", "superclass", "signal_quality", "dataset")
    return lifecycle.prepare_dataset(beats(spark, sf_dir), features)[0]


_VN = union(f"SELECT dataset, '{f}' AS formula, count(q_{f}) AS n, corr(q_{f}, hr_bpm) AS r, abs(corr(q_{f}, hr_bpm)) AS a FROM e GROUP BY dataset" for f in NAMES)
_VR = union(f"SELECT '{k}' AS ranking, formula, {c} AS value FROM s" for k, c in candidates.RANKINGS.items())
_VS = "('bazett', 'fridericia', 'framingham', 'hodges')"


@query("formula_validation_end_to_end", E(f"""SELECT ranking, rank, formula, value, is_standard, CASE WHEN value > 0 THEN best / value ELSE CAST('inf' AS DOUBLE) END AS improvement_vs_best_standard FROM
 (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY round(value, 12), formula) AS rank, formula IN {_VS} AS is_standard, min(CASE WHEN formula IN {_VS} THEN value END) OVER (PARTITION BY ranking) AS best FROM ({_VR}))""",
                                          extra=CAND, more=f"m AS ({_VN}), s AS ({SUMMARY})"), dbl="value improvement_vs_best_standard")
def _(spark, sf_dir):
    return lifecycle.validate_catalog(ecg(spark, sf_dir), catalog(spark))[2]
