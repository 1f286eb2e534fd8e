"""Row-level operators: columns, filters, formulas, classes, codes, joins, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (CATALOG_ROWS, CATALOG_SQL, DIAG_SQL, HOSP_SQL, REPORT_SQL, case, diag, ecg, hosp, query,
                             reports, table, thr, with_ecg)
from isoqt import fixed_values as fv
from isoqt.functions import classify as cl
from isoqt.functions import clean, codes, equations
from isoqt.functions import formulas as fo
from isoqt.operators import joins, schema
from isoqt.operators.ranks import running_index

E = with_ecg


# ---- B: columns and filters ---------------------------------------------------------------
def raw_names(spark, sf_dir):
    """The ECG rows under the names a source file uses."""
    return ecg(spark, sf_dir).selectExpr("ecg_id", "qt_ms AS QT_interval_ms", "rr_s AS RR_interval_sec",
                                         "hr_bpm AS heart_rate_bpm", "age AS Age", "sex AS gender",
                                         "superclass AS primary_superclass")


@query("b01_standardize_first_match",
       E("SELECT ecg_id, qt_ms, rr_s, hr_bpm, age, sex, superclass FROM e"), dbl="qt_ms rr_s hr_bpm age")
def _(spark, sf_dir):
    return schema.standardize(raw_names(spark, sf_dir), "first_match")


@query("b02_standardize_case_insensitive",
       E("SELECT ecg_id, qt_ms, rr_s AS RR_interval_sec, hr_bpm, age, sex AS gender, superclass FROM e"),
       dbl="qt_ms RR_interval_sec hr_bpm age")
def _(spark, sf_dir):
    return schema.standardize(raw_names(spark, sf_dir), "ci_rename")


@query("b03_standardize_copy",
       E("SELECT ecg_id, qt_ms AS QT_interval_ms, rr_s AS RR_interval_sec, qt_ms, rr_s FROM e"),
       dbl="QT_interval_ms RR_interval_sec qt_ms rr_s")
def _(spark, sf_dir):
    raw = raw_names(spark, sf_dir).select("ecg_id", "QT_interval_ms", "RR_interval_sec")
    return schema.standardize(raw, "copy")


@query("b04_fill_rate_columns", E("SELECT ecg_id, rr_ms, rr_ms / 1000e0 AS rr_s, 60e0 / (rr_ms / 1000e0) AS hr_bpm FROM e"),
       dbl="rr_ms rr_s hr_bpm")
def _(spark, sf_dir):
    return schema.fill_rate_columns(ecg(spark, sf_dir).select("ecg_id", "rr_ms"))


@query("b05_fix_rr_unit", E("SELECT ecg_id, dataset, rr_s FROM e"), dbl="rr_s")
def _(spark, sf_dir):
    mixed = ecg(spark, sf_dir).selectExpr(
        "ecg_id", "dataset", "CASE WHEN dataset IN ('ds_b', 'ds_e') THEN rr_ms ELSE rr_s END AS rr_s")
    return schema.fix_rr_unit(mixed)


@query("b06_coerce_numeric",
       "SELECT o_orderkey AS ecg_id, CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS DOUBLE) AS v FROM orders",
       dbl="v")
def _(spark, sf_dir):
    text = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ecg_id", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority "
        "ELSE CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS STRING) END AS v")
    return clean.coerce_numeric(text, ["v"])


@query("b07_project_existing", E("SELECT ecg_id, age, sex, qt_ms, rr_ms, superclass, CAST(superclass = 'MI' AS INTEGER) AS label_MI FROM e"),
       dbl="age qt_ms rr_ms")
def _(spark, sf_dir):
    wide = ecg(spark, sf_dir).select("ecg_id", "subject_id", "age", "sex", "qt_ms", "rr_ms", "superclass")
    return schema.project_existing(codes.one_hot(wide, classes=["MI"]))


@query("b08_drop_incomplete", E("SELECT ecg_id, qt_ms, rr_s, hr_bpm FROM e WHERE qt_ms IS NOT NULL"), dbl="qt_ms rr_s hr_bpm")
def _(spark, sf_dir):
    return schema.drop_incomplete(ecg(spark, sf_dir).select("ecg_id", "qt_ms", "rr_s", "hr_bpm"))


_STAGES = ["TRUE", "qt_ms IS NOT NULL", "qt_ms BETWEEN 200 AND 600", "rr_ms BETWEEN 400 AND 2000",
           "hr_bpm BETWEEN 30 AND 150", "signal_quality >= 0.3e0", "t_wave_detection_rate >= 0.5e0"]
_NAMES = ["initial", "qt_valid", "qt_range", "rr_range", "hr_range", "quality", "t_detection"]


@query("b09_quality_funnel", E(" UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS stage, count(*) FILTER (WHERE {' AND '.join(_STAGES[:i + 1])}) AS n, "
    f"round(100e0 * count(*) FILTER (WHERE {' AND '.join(_STAGES[:i + 1])}) / count(*), 2) AS retention_pct FROM e"
    for i, n in enumerate(_NAMES))), dbl="retention_pct")
def _(spark, sf_dir):
    return schema.quality_funnel(ecg(spark, sf_dir))


@query("b09_quality_filter", E(f"SELECT ecg_id, qt_ms, rr_ms, hr_bpm FROM e WHERE {' AND '.join(_STAGES)}"), dbl="qt_ms rr_ms hr_bpm")
def _(spark, sf_dir):
    return schema.quality_filter(ecg(spark, sf_dir)).select("ecg_id", "qt_ms", "rr_ms", "hr_bpm")


@query("b10_valid_range", E("SELECT ecg_id, qt_ms, rr_s FROM e WHERE qt_ms BETWEEN 200 AND 600 AND rr_s BETWEEN 0.4e0 AND 2e0"), dbl="qt_ms rr_s")
def _(spark, sf_dir):
    return schema.valid_range(ecg(spark, sf_dir)).select("ecg_id", "qt_ms", "rr_s")


@query("b11_finite", E("SELECT ecg_id, CASE WHEN ecg_id % 7 NOT IN (0, 1) THEN qt_ms END AS v FROM e"), dbl="v")
def _(spark, sf_dir):
    dirty = ecg(spark, sf_dir).selectExpr(
        "ecg_id", "CASE ecg_id % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE qt_ms END AS v")
    return dirty.select("ecg_id", clean.finite("v").alias("v"))


@query("b12_norm_subset_ci", E("SELECT ecg_id FROM e WHERE superclass = 'NORM'"))
def _(spark, sf_dir):
    return schema.norm_subset(ecg(spark, sf_dir).selectExpr("ecg_id", "lower(superclass) AS superclass"), "ci").select("ecg_id")


@query("b12_norm_subset_exact", E("SELECT ecg_id FROM e WHERE superclass = 'NORM'"))
def _(spark, sf_dir):
    return schema.norm_subset(ecg(spark, sf_dir), "exact").select("ecg_id")


@query("b12_norm_subset_fallback", E("SELECT ecg_id FROM e WHERE superclass <> 'NORM'"))
def _(spark, sf_dir):
    return schema.norm_subset(ecg(spark, sf_dir).filter("superclass <> 'NORM'"), "fallback").select("ecg_id")


_SEX_TEXT = "['M', 'male', ' Male ', 'FEMALE', 'f', '0', '1', '0.0', '1.0', NULL, 'x', 'm'][1 + ecg_id % 12]"


@query("b13_normalize_sex", E(f"""
SELECT ecg_id,
  CASE WHEN t IN ('M', 'male', 'Male') THEN 'M' WHEN t IN ('F', 'female', 'Female') THEN 'F' ELSE 'unknown' END AS names,
  CASE WHEN t IN ('0', '0.0', 'male', 'Male', 'MALE', 'm', 'M') THEN 'M' WHEN t IN ('1', '1.0', 'female', 'Female', 'FEMALE', 'f', 'F') THEN 'F' ELSE 'unknown' END AS labels,
  CASE WHEN lower(trim(t)) IN ('m', 'male', '0', '0.0') THEN 'M' WHEN lower(trim(t)) IN ('f', 'female', '1', '1.0') THEN 'F' ELSE 'unknown' END AS words,
  CASE WHEN t IN ('M', 'm', 'Male', 'male', 'MALE', '0') THEN 'M' WHEN t IN ('F', 'f', 'Female', 'female', 'FEMALE', '1') THEN 'F' END AS strict,
  CASE WHEN sex = 0 THEN 'M' WHEN sex = 1 THEN 'F' ELSE 'unknown' END AS number
FROM (SELECT *, {_SEX_TEXT} AS t FROM e)"""))
def _(spark, sf_dir):
    df = ecg(spark, sf_dir).selectExpr("ecg_id", "sex", "array('M', 'male', ' Male ', 'FEMALE', 'f', '0', '1', '0.0', "
                                       "'1.0', NULL, 'x', 'm')[int(ecg_id % 12)] AS t")
    return df.select("ecg_id", *[cl.normalize_sex("t", v).alias(v) for v in ("names", "labels", "words", "strict")],
                     cl.normalize_sex("sex", numeric=True).alias("number"))


@query("b14_qtc_threshold", E(f"SELECT ecg_id, {thr(450)} AS as_male, {thr(455)} AS midpoint, {thr(None)} AS strict FROM e"))
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", cl.qtc_threshold("sex", 450.0).alias("as_male"),
                                     cl.qtc_threshold("sex", 455.0).alias("midpoint"),
                                     cl.qtc_threshold("sex", None).alias("strict"))


@query("b15_bucketize", E(f"SELECT ecg_id, {case('hr_bpm', fv.HR_ZONES)} AS hr_zone, {case('age', fv.AGE_BINS)} AS age_group, "
                          f"{case('q_inverse_rr - thr', fv.SEVERITY_BINS)} AS severity FROM e"))
def _(spark, sf_dir):
    df = fo.all_qtc(ecg(spark, sf_dir))
    return df.select("ecg_id", cl.bucketize("hr_bpm", fv.HR_ZONES).alias("hr_zone"),
                     cl.bucketize("age", fv.AGE_BINS).alias("age_group"),
                     cl.bucketize(F.col("qtc_inverse_rr") - cl.qtc_threshold("sex", 455.0), fv.SEVERITY_BINS).alias("severity"))


def _ranges(c, ranges):
    whens = " ".join(f"WHEN {c} >= {lo} AND {c} < {hi} THEN '{n}'" for n, (lo, hi) in ranges.items())
    return f"CASE {whens} ELSE 'unknown' END"


@query("b16_categorize", E(f"SELECT ecg_id, {_ranges('hr_bpm', fv.HR_RANGES)} AS hr_category, {_ranges('age', fv.AGE_RANGES)} AS age_category FROM e"))
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", cl.categorize("hr_bpm", fv.HR_RANGES).alias("hr_category"),
                                     cl.categorize("age", fv.AGE_RANGES).alias("age_category"))


@query("b18_dedup_by_key", """
SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_partkey, l_suppkey)) AS l_partkey, min((l_partkey, l_suppkey))[2] AS l_suppkey
FROM lineitem GROUP BY ALL""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return schema.dedup(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("b18_dedup_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf_dir):
    return schema.dedup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query("b19_default_sex", E("SELECT ecg_id, CASE WHEN dataset IN ('ds_b', 'ds_d') AND age IS NOT NULL AND sex IS NULL THEN 0 ELSE sex END AS sex FROM e"))
def _(spark, sf_dir):
    return clean.default_sex(ecg(spark, sf_dir), ["ds_b", "ds_d"]).select("ecg_id", "sex")


@query("b20_identifiers", """
SELECT o_orderkey AS ecg_id, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '_hr' AS record_id, o_orderkey AS study_id,
  o_orderkey AS numeric_id FROM orders""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ecg_id", "concat('files/p', o_custkey, '/', lpad(o_orderkey, 7, '0'), '_hr.hea') AS path",
        "concat('files/s', o_orderkey, '/', o_orderkey) AS study")
    return o.select("ecg_id", clean.record_id("path").alias("record_id"), clean.study_id("study").alias("study_id"),
                    clean.numeric_id(clean.record_id("path")).alias("numeric_id"))


_HASH = "CAST('0x' || substring(md5('42|' || ecg_id), 1, 15) AS BIGINT)"


@query("b21_sample_n_per_dataset", E(f"SELECT ecg_id, dataset, qt_ms FROM e QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {_HASH}, ecg_id) <= 200"), dbl="qt_ms")
def _(spark, sf_dir):
    return schema.sample_n(ecg(spark, sf_dir).select("ecg_id", "dataset", "qt_ms"), 200, by=["dataset"])


@query("b22_split", E(f"SELECT ecg_id, dataset, {_HASH} % 100 < 20 AS is_test FROM e"))
def _(spark, sf_dir):
    return schema.split(ecg(spark, sf_dir).select("ecg_id", "dataset"))


@query("b23_clip", E("SELECT ecg_id, CASE WHEN q_bazett IS NOT NULL THEN greatest(420e0, least(460e0, q_bazett)) END AS q FROM e"), dbl="q")
def _(spark, sf_dir):
    return fo.all_qtc(ecg(spark, sf_dir)).select("ecg_id", clean.clip("qtc_bazett", 420.0, 460.0).alias("q"))


@query("b24_center", E("SELECT ecg_id, q_bazett - avg(q_bazett) OVER () AS qtc_bazett_residual, q_inverse_rr - avg(q_inverse_rr) OVER () AS qtc_inverse_rr_residual FROM e"),
       dbl="qtc_bazett_residual qtc_inverse_rr_residual")
def _(spark, sf_dir):
    out = schema.center(fo.all_qtc(ecg(spark, sf_dir)), ["qtc_bazett", "qtc_inverse_rr"])
    return out.select("ecg_id", "qtc_bazett_residual", "qtc_inverse_rr_residual")


@query("b25_enrich", E(f"""
SELECT ecg_id, q_bazett AS qtc_bazett, q_inverse_rr AS qtc_inverse_rr, thr AS threshold, coalesce(q_bazett > thr, FALSE) AS pred_bazett,
  coalesce(q_inverse_rr > thr, FALSE) AS pred_inverse_rr,
  CASE WHEN NOT coalesce(q_bazett > thr, FALSE) THEN 'GREEN' WHEN coalesce(q_inverse_rr > thr, FALSE) THEN 'RED' ELSE 'YELLOW' END AS triage,
  {case('hr_bpm', fv.HR_ZONES)} AS hr_zone FROM e"""), dbl="qtc_bazett qtc_inverse_rr threshold")
def _(spark, sf_dir):
    return schema.enrich(ecg(spark, sf_dir)).select("ecg_id", "qtc_bazett", "qtc_inverse_rr", "threshold", "pred_bazett",
                                                    "pred_inverse_rr", "triage", "hr_zone")


@query("b26_select_features", E("SELECT ecg_id, dataset, qt_ms, rr_s, hr_bpm, q_fridericia AS qtc_reference_ms FROM e WHERE qt_ms IS NOT NULL"),
       dbl="qt_ms rr_s hr_bpm qtc_reference_ms")
def _(spark, sf_dir):
    df = ecg(spark, sf_dir).withColumn("qtc_reference_ms", fo.qtc_fridericia())
    return schema.select_features(df, "standard")


# ---- C: scalar functions ------------------------------------------------------------------
for _id, _name in (("c01", "bazett"), ("c02", "fridericia"), ("c03", "framingham"), ("c04", "hodges")):
    @query(f"{_id}_{_name}", E(f"SELECT ecg_id, q_{_name} AS qtc FROM e"), dbl="qtc")
    def _(spark, sf_dir, name=_name):
        return ecg(spark, sf_dir).select("ecg_id", fo.formula(name).alias("qtc"))


@query("c05_inverse_rr", E("SELECT ecg_id, q_inverse_rr AS c158, qt_ms + 125e0 / rr_s - 125e0 AS c125, qt_ms + 110e0 / rr_s - 140e0 AS own FROM e"),
       dbl="c158 c125 own")
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", fo.qtc_inverse_rr().alias("c158"), fo.qtc_inverse_rr(preset="c125").alias("c125"),
                                     fo.qtc_inverse_rr(k=110, c=-140).alias("own"))


@query("c06_inverse_rr_from_hr", E("SELECT ecg_id, qt_ms + 125e0 / (60e0 / hr_bpm) - 158e0 AS qtc FROM e"), dbl="qtc")
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", fo.qtc_inverse_rr_hr().alias("qtc"))


@query("c07_validated", E("SELECT ecg_id, coalesce(qt_ms BETWEEN 200 AND 600 AND rr_s BETWEEN 0.4e0 AND 2e0, FALSE) AS in_range FROM e"))
def _(spark, sf_dir):
    return fo.validated(ecg(spark, sf_dir)).select("ecg_id", "in_range")


@query("c08_all_qtc", E("SELECT ecg_id, " + ", ".join(f"CASE WHEN ecg_id % 50 <> 0 THEN q_{f} END AS qtc_{f}" for f in fo.FORMULAS) + " FROM e"),
       dbl=" ".join(f"qtc_{f}" for f in fo.FORMULAS))
def _(spark, sf_dir):
    df = ecg(spark, sf_dir).withColumn("rr_s", F.expr("CASE WHEN ecg_id % 50 = 0 THEN 0 ELSE rr_s END"))
    return fo.all_qtc(df, hr=None).select("ecg_id", *[f"qtc_{f}" for f in fo.FORMULAS])


@query("c09_compare_formulas", E("SELECT ecg_id, q_inverse_rr AS inverse_rr, q_bazett AS bazett, q_inverse_rr - q_bazett AS difference FROM e"),
       dbl="inverse_rr bazett difference")
def _(spark, sf_dir):
    return fo.compare_formulas(ecg(spark, sf_dir), "inverse_rr", "bazett").select("ecg_id", "inverse_rr", "bazett", "difference")


@query("c10_classify4", E("""SELECT ecg_id, CASE WHEN q_bazett < CASE WHEN sex = 0 THEN 450 ELSE 460 END THEN 'normal' WHEN q_bazett < 470 THEN 'borderline'
  WHEN q_bazett < 500 THEN 'prolonged' WHEN q_bazett >= 500 THEN 'high_risk' END AS class FROM e"""))
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", cl.classify4(fo.qtc_bazett()).alias("class"))


C3 = """CASE WHEN {q} IS NULL THEN 'invalid' WHEN {q} <= CASE WHEN sex = 1 THEN 460 ELSE 450 END THEN 'normal'
 WHEN {q} <= CASE WHEN sex = 1 THEN 480 ELSE 470 END THEN 'borderline' ELSE 'prolonged' END"""


@query("c11_classify3", E(f"SELECT ecg_id, {C3.format(q='q_bazett')} AS class FROM e"))
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", cl.classify3(fo.qtc_bazett()).alias("class"))


CM = """CASE WHEN {q} IS NULL OR sex IS NULL THEN NULL WHEN {q} > thr THEN 'prolonged' WHEN {q} > thr - 10 THEN 'borderline' ELSE 'normal' END"""


@query("c12_classify_margin", E(f"SELECT ecg_id, {CM.format(q='q_bazett')} AS class FROM e"))
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", cl.classify_margin(fo.qtc_bazett()).alias("class"))


@query("c13_prolonged_policies", E(f"""SELECT ecg_id, coalesce(q_bazett > {thr(450)}, FALSE) AS null_is_false, q_bazett > {thr(None)} AS unknown_sex_null,
  q_bazett > {thr(455)} AS midpoint FROM e"""))
def _(spark, sf_dir):
    q = fo.qtc_bazett()
    return ecg(spark, sf_dir).select("ecg_id", cl.prolonged(q).alias("null_is_false"),
                                     cl.prolonged(q, unknown=None, on_null=None).alias("unknown_sex_null"),
                                     cl.prolonged(q, unknown=455.0, on_null=None).alias("midpoint"))


@query("c14_prolonged_inclusive", E(f"SELECT ecg_id, coalesce(q_bazett >= {thr(450)}, FALSE) AS by_sex, q_bazett >= 450 AS fixed FROM e"))
def _(spark, sf_dir):
    q = fo.qtc_bazett()
    return ecg(spark, sf_dir).select("ecg_id", cl.prolonged(q, inclusive=True).alias("by_sex"), cl.prolonged_at(q).alias("fixed"))


TRIAGE = "CASE WHEN NOT b THEN 'GREEN' WHEN b AND NOT k THEN 'YELLOW' WHEN b AND k THEN 'RED' END"


@query("c15_triage", E(f"SELECT ecg_id, coalesce({TRIAGE}, 'RED') AS red, coalesce({TRIAGE}, 'GREEN') AS green, CASE WHEN b IS NOT NULL AND k IS NOT NULL THEN {TRIAGE} END AS strict FROM e",
                       unknown=None, extra="q_bazett > thr AS b, q_inverse_rr > thr AS k"))
def _(spark, sf_dir):
    df = fo.all_qtc(ecg(spark, sf_dir)).withColumns({"b": cl.prolonged("qtc_bazett", unknown=None, on_null=None),
                                                     "k": cl.prolonged("qtc_inverse_rr", unknown=None, on_null=None)})
    return df.select("ecg_id", cl.triage("b", "k", "RED").alias("red"), cl.triage("b", "k", "GREEN").alias("green"),
                     cl.triage("b", "k").alias("strict"))


CONC = """CASE WHEN NOT k AND NOT b THEN 'concordant_normal' WHEN k AND b THEN 'concordant_prolonged' WHEN k AND NOT b THEN 'new_only_prolonged'
  WHEN NOT k AND b THEN 'reclassified_normal' ELSE 'unknown' END"""


@query("c16_concordance", E(f"SELECT ecg_id, {CONC} AS concordance FROM e", extra="q_bazett >= 450 AS b, q_inverse_rr >= 450 AS k"))
def _(spark, sf_dir):
    df = fo.all_qtc(ecg(spark, sf_dir))
    return df.select("ecg_id", cl.concordance(cl.prolonged_at("qtc_bazett"), cl.prolonged_at("qtc_inverse_rr")).alias("concordance"))


CONF = """greatest(0e0, 100e0
  - CASE WHEN hr_bpm < 50 OR hr_bpm > 120 THEN 20 WHEN (hr_bpm >= 50 AND hr_bpm < 55) OR (hr_bpm > 110 AND hr_bpm <= 120) THEN 10 ELSE 0 END
  - CASE WHEN abs(q_bazett - q_inverse_rr) > 40 THEN 25 WHEN abs(q_bazett - q_inverse_rr) > 20 THEN 10 ELSE 0 END
  - CASE WHEN abs(q_inverse_rr - thr) < 10 THEN 20 WHEN abs(q_inverse_rr - thr) < 20 THEN 10 ELSE 0 END)"""


@query("c17_confidence", E(f"SELECT ecg_id, {CONF} AS confidence FROM e"), dbl="confidence")
def _(spark, sf_dir):
    return schema.enrich(ecg(spark, sf_dir)).select("ecg_id", cl.confidence().alias("confidence"))


T4 = """CASE WHEN NOT b AND NOT k AND confidence >= 70 THEN 'GREEN' WHEN NOT b AND NOT k THEN 'GREEN-WATCH' WHEN b AND NOT k THEN 'YELLOW' ELSE 'RED' END"""
T4_EXTRA = f"coalesce(q_bazett > thr, FALSE) AS b, coalesce(q_inverse_rr > thr, FALSE) AS k, {CONF} AS confidence"


@query("c18_triage4", E(f"SELECT ecg_id, {T4} AS triage4 FROM e", extra=T4_EXTRA))
def _(spark, sf_dir):
    df = schema.enrich(ecg(spark, sf_dir)).withColumn("confidence", cl.confidence())
    return df.select("ecg_id", cl.triage4("pred_bazett", "pred_inverse_rr").alias("triage4"))


@query("c19_hybrid", E("SELECT ecg_id, CASE WHEN hr_bpm < 50 OR hr_bpm > 120 THEN q_bazett ELSE q_inverse_rr END AS qtc FROM e"), dbl="qtc")
def _(spark, sf_dir):
    return schema.enrich(ecg(spark, sf_dir)).select("ecg_id", cl.qtc_hybrid().alias("qtc"))


# Record codes as dict literals, by key.
SCP_TEXT = ("CASE o_orderkey % 8 WHEN 0 THEN '{''NORM'': 100.0, ''SR'': 0.0}' WHEN 1 THEN '{''IMI'': 50.0, ''AFIB'': 100.0}' "
            "WHEN 2 THEN '{''LVH'': 0.0, ''LVOLT'': 35.0}' WHEN 3 THEN '{''Sinus rhythm with PVCs noted'': 100.0}' "
            "WHEN 4 THEN '{''prolonged qt'': 80.0, ''RVH'': 15.0}' WHEN 5 THEN '{''XYZ'': 100.0}' WHEN 6 THEN '{}' ELSE NULL END")


def scp(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS ecg_id", f"{SCP_TEXT.replace(chr(39) * 2, chr(92) + chr(39))} AS scp_codes")


@query("c20_active_codes", """SELECT o_orderkey AS ecg_id, ['NORM', 'AFIB|IMI', 'LVOLT', 'Sinus rhythm with PVCs noted', 'RVH|prolonged qt', 'XYZ', '', NULL][1 + o_orderkey % 8] AS codes FROM orders""")
def _(spark, sf_dir):
    return scp(spark, sf_dir).select("ecg_id", F.array_join(F.array_sort(codes.active_codes("scp_codes")), "|").alias("codes"))


_SCP_VALUES = ", ".join(f"('{c}', '{s}')" for c, s in fv.SCP_SUPERCLASS.items())
_TEXT_VALUES = ", ".join("({}, '{}', '{}')".format(i, p.replace("'", "''"), s) for i, (p, s) in enumerate(fv.TEXT_SUPERCLASS.items()))
_PRIO = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.SUPERCLASS_PRIORITY.items()) + " END"


@query("c21_superclass_of_codes", f"""
WITH dict(code, sc) AS (VALUES {_SCP_VALUES}), phrases(pos, phrase, sc) AS (VALUES {_TEXT_VALUES}),
r AS (SELECT o_orderkey AS ecg_id, ['NORM', 'AFIB|IMI', 'LVOLT', 'Sinus rhythm with PVCs noted', 'RVH|prolonged qt', 'XYZ', NULL, NULL][1 + o_orderkey % 8] AS codes FROM orders),
x AS (SELECT DISTINCT unnest(string_split(codes, '|')) AS code FROM r WHERE codes IS NOT NULL),
inside AS (SELECT code, arg_min(sc, (-length(phrase), pos)) AS sc FROM x JOIN phrases ON contains(lower(trim(code)), phrase) GROUP BY code),
around AS (SELECT code, arg_min(sc, pos) AS sc FROM x JOIN phrases ON contains(phrase, lower(trim(code))) GROUP BY code),
m AS (SELECT x.code, coalesce(dict.sc, inside.sc, around.sc) AS sc FROM x LEFT JOIN dict USING (code) LEFT JOIN inside USING (code) LEFT JOIN around USING (code)),
rc AS (SELECT ecg_id, unnest(string_split(codes, '|')) AS code FROM r)
SELECT r.ecg_id, arg_max(m.sc, {_PRIO.format('m.sc')}) AS superclass FROM r LEFT JOIN rc USING (ecg_id) LEFT JOIN m USING (code) GROUP BY r.ecg_id""")
def _(spark, sf_dir):
    return scp(spark, sf_dir).select("ecg_id", codes.superclass_of_codes(codes.active_codes("scp_codes")).alias("superclass"))


_SNOMED = [("426783006", "164889003"), ("164865005", "111"), ("111975006", "59118001"), ("999", "998"), ("89792004", "426783006")]
_SNOMED_VALUES = ", ".join(f"('{c}', '{s}')" for c, (s, _) in fv.SNOMED_SUPERCLASS.items())


@query("c22_superclass_of_snomed", f"""
WITH dict(code, sc) AS (VALUES {_SNOMED_VALUES}), pairs(i, code) AS (VALUES {', '.join(f"({i}, '{c}')" for i, p in enumerate(_SNOMED) for c in p)}),
m AS (SELECT i, arg_max(sc, {_PRIO.format('sc')}) AS superclass, count(sc) AS n_known FROM pairs LEFT JOIN dict USING (code) GROUP BY i)
SELECT o_orderkey AS ecg_id, superclass, n_known FROM orders JOIN m ON i = o_orderkey % 5""", big="n_known")
def _(spark, sf_dir):
    arrays = ", ".join(f"array('{a}', '{b}')" for a, b in _SNOMED)
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS ecg_id", f"array({arrays})[int(o_orderkey % 5)] AS codes")
    return df.select("ecg_id", codes.superclass_of_snomed(F.col("codes")).alias("superclass"),
                     F.size(codes.snomed_descriptions(F.col("codes"))).alias("n_known"))


_KEY_CASE = "CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{s}'" for k, s in fv.REPORT_KEYWORDS) + " END"


@query("c23_superclass_of_report", f"""WITH rep AS ({REPORT_SQL}),
x AS (SELECT doc_id, lower(concat_ws(' ', report_0, report_1, report_2)) AS t FROM rep) SELECT doc_id, {_KEY_CASE} AS superclass FROM x""")
def _(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", codes.superclass_of_report(["report_0", "report_1", "report_2"]).alias("superclass"))


@query("c23_report_codes", f"""WITH rep AS ({REPORT_SQL}) SELECT doc_id,
  array_to_string(list_filter(list_transform(list_filter([report_1, report_2], lambda x: x IS NOT NULL), lambda x: trim(x)), lambda x: x <> ''), '|') AS codes FROM rep""".replace("array_to_string", "coalesce(array_to_string").replace(", '|') AS codes", ", '|'), '') AS codes"))
def _(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", F.array_join(codes.report_codes(["report_1", "report_2"]), "|").alias("codes"))


@query("c24_one_hot", E("SELECT ecg_id, " + ", ".join(f"CAST(superclass = '{s}' AS INTEGER) AS label_{s}" for s in fv.SUPERCLASSES) + " FROM e"))
def _(spark, sf_dir):
    return codes.one_hot(ecg(spark, sf_dir)).select("ecg_id", *[f"label_{s}" for s in fv.SUPERCLASSES])


_RX = "|".join(f"({p})" for p in fv.LONG_QT_PATTERNS)
DX_SQL = " OR ".join(f"coalesce(regexp_matches(lower({c}), '{_RX}'), FALSE)" for c in ("report_0", "report_1", "report_2"))


@query("c25_has_diagnosis", f"WITH rep AS ({REPORT_SQL}) SELECT doc_id, {DX_SQL} AS has_dx FROM rep")
def _(spark, sf_dir):
    df = reports(spark, sf_dir)
    return df.select("doc_id", codes.has_diagnosis(df, cols=["report_0", "report_1", "report_2"]).alias("has_dx"))


def prefix_sql(prefixes):
    return "coalesce(regexp_matches(all_diag_all, '''(" + "|".join(prefixes) + ")'), FALSE)"


@query("c26_has_code_prefix", f"WITH d AS ({DIAG_SQL}) SELECT study_id, {prefix_sql(fv.ICD_ANY_ARRHYTHMIA)} AS any_arrhythmia, {prefix_sql(fv.ICD_SEVERE_ARRHYTHMIA)} AS severe FROM d")
def _(spark, sf_dir):
    return diag(spark, sf_dir).select("study_id", codes.has_code_prefix("all_diag_all", fv.ICD_ANY_ARRHYTHMIA).alias("any_arrhythmia"),
                                      codes.has_code_prefix("all_diag_all", fv.ICD_SEVERE_ARRHYTHMIA).alias("severe"))


ICD_IN_SQL = "upper(replace(icd_code, '.', '')) IN (" + ", ".join(f"'{c}'" for c in fv.ICD_EVENT_CODES) + ")"


@query("c27_icd_in", f"WITH h AS ({HOSP_SQL}) SELECT ecg_id, icd_code, {ICD_IN_SQL} AS is_event FROM h")
def _(spark, sf_dir):
    return hosp(spark, sf_dir).select("ecg_id", "icd_code", codes.icd_in("icd_code", fv.ICD_EVENT_CODES).alias("is_event"))


def contains_sql(parts):
    return "coalesce(" + " OR ".join(f"contains(all_diag_all, '{p}')" for p in parts) + ", FALSE)"


@query("c28_icd_contains", f"WITH d AS ({DIAG_SQL}) SELECT study_id, {contains_sql(fv.ICD_VENTRICULAR)} AS ventricular, {contains_sql(fv.ICD_ARREST)} AS arrest FROM d")
def _(spark, sf_dir):
    return diag(spark, sf_dir).select("study_id", codes.icd_contains("all_diag_all", fv.ICD_VENTRICULAR).alias("ventricular"),
                                      codes.icd_contains("all_diag_all", fv.ICD_ARREST).alias("arrest"))


@query("c29_died_within", f"""WITH d AS ({DIAG_SQL}), x AS (SELECT o_orderkey, o_orderdate + INTERVAL '6' HOUR AS t FROM orders),
y AS (SELECT study_id, floor((epoch_us(dod) - epoch_us(t)) / 86400e6) AS days FROM d JOIN x ON study_id = o_orderkey)
SELECT study_id, coalesce(days BETWEEN 0 AND 30, FALSE) AS d30, coalesce(days BETWEEN 0 AND 90, FALSE) AS d90 FROM y""")
def _(spark, sf_dir):
    at = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS study_id", "o_orderdate + INTERVAL '6' HOUR AS t")
    return diag(spark, sf_dir).join(at, "study_id").select(
        "study_id", codes.died_within("dod", "t", 30).alias("d30"), codes.died_within("dod", "t", 90).alias("d90"))


@query("c30_formula_column", E("SELECT ecg_id, " + ", ".join(f"{s} AS {n}" for n, s in CATALOG_SQL.items()) +
                               ", qt_ms + (1e0 / power(sqrt(rr_s) + 1e0, 2)) AS nested FROM e"), dbl="cand_1 cand_2 cand_3 cand_4 nested")
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", *[equations.formula_column(eq, ap).alias(n) for n, ap, eq, _, _ in CATALOG_ROWS],
                                     equations.formula_column("inv(square(sqrt(RR_interval_sec) + 1))", "additive").alias("nested"))


# Equation texts derived from the part table: coefficients by key.
_EQ = "'(' || (100 + p_partkey % 50) || '.5 / RR_interval_sec) ' || CASE WHEN p_size % 2 = 0 THEN '-' ELSE '+' END || ' ' || (120 + p_size) || '.25'"
_AP = "CASE p_partkey % 3 WHEN 0 THEN 'additive' WHEN 1 THEN 'factor' ELSE 'direct' END"


def part_equations(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", f"{_EQ} AS equation", f"{_AP} AS approach", "p_retailprice / 10000 AS abs_r", "bigint(3 + p_size % 5) AS complexity")


@query("c32_extract_k_c", "SELECT p_partkey AS id, 100.5e0 + p_partkey % 50 AS k, (CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END) * (120.25e0 + p_size) AS c FROM part", dbl="k c")
def _(spark, sf_dir):
    return equations.extract_k_c(part_equations(spark, sf_dir)).select("id", "k", "c")


_EQ2 = "CASE p_partkey % 4 WHEN 0 THEN 'inv(sqrt(RR_interval_sec))' WHEN 1 THEN 'inv(cbrt(RR_interval_sec)) * 2' WHEN 2 THEN '1.0 + log(RR_interval_sec) - exp(0.1)' ELSE 'RR_interval_sec ^ 0.5 - 1' END"


@query("c33_formula_features", f"""WITH p AS (SELECT p_partkey AS id, {_EQ2} AS eq, {_AP} AS ap FROM part)
SELECT id, length(regexp_replace(eq, '[^-+*/^]', '', 'g')) AS n_operations, contains(eq, 'sqrt') AS has_sqrt, contains(eq, 'cbrt') AS has_cbrt,
  contains(eq, 'log') AS has_log, contains(eq, 'exp') AS has_exp,
  CASE WHEN ap = 'factor' THEN CASE WHEN contains(eq, 'sqrt') THEN 'Similar to Bazett' WHEN contains(eq, 'cbrt') THEN 'Similar to Fridericia' ELSE 'Novel structure' END
       WHEN ap = 'additive' THEN 'Similar to Framingham/Hodges' ELSE 'Direct approach (novel)' END AS similarity FROM p""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_EQ2} AS equation", f"{_AP} AS approach")
    return equations.formula_features(df).drop("equation", "approach")


@query("c34_unified_score", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 9 <> 0 THEN p_retailprice / 10000 END, 1e0) + 0.1e0 * ((3 + p_size % 5) / 7e0) AS score FROM part", dbl="score")
def _(spark, sf_dir):
    df = part_equations(spark, sf_dir).join(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size"), "id")
    r = F.when(F.col("p_size") % 9 != 0, F.col("abs_r"))
    return df.select("id", fo.unified_score(r, "complexity").alias("score"))


@query("c35_hrv", """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: 850e0 + 400e0 * CAST(v AS DOUBLE)) AS rr FROM embeddings),
y AS (SELECT vec_id, unnest(rr) AS rr, generate_subscripts(rr, 1) AS i FROM x),
z AS (SELECT *, rr - lag(rr) OVER (PARTITION BY vec_id ORDER BY i) AS step FROM y)
SELECT vec_id, avg(rr) AS rr_mean_ms, stddev_pop(rr) AS rr_std_ms, stddev_pop(60000e0 / rr) AS heart_rate_std, sqrt(avg(step * step)) AS rmssd FROM z GROUP BY vec_id""",
       dbl="rr_mean_ms rr_std_ms heart_rate_std rmssd")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, v -> 850D + 400D * double(v)) AS rr")
    return df.select("vec_id", codes.hrv("rr").alias("h")).select("vec_id", "h.*")


@query("c36_estimate_qt", E("SELECT ecg_id, 410e0 * sqrt(rr_s) AS qt FROM e"), dbl="qt")
def _(spark, sf_dir):
    return ecg(spark, sf_dir).select("ecg_id", fo.estimate_qt().alias("qt"))


@query("c37_improvement", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.001e0 THEN l_discount / l_tax ELSE CAST('inf' AS DOUBLE) END AS factor FROM lineitem", dbl="factor")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fo.improvement("l_discount", "l_tax", unknown=float("inf")).alias("factor"))


# ---- A: row functions of sources ----------------------------------------------------------
@query("a11_trace_index", "SELECT o_orderkey AS exam_id, o_orderpriority AS trace_file, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS trace_index FROM orders")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS exam_id", "o_orderpriority AS trace_file")
    return running_index(df, ["trace_file"], "exam_id", width=1000)


@query("a12_exam_superclass", """SELECT o_orderkey AS exam_id, CASE WHEN o_orderkey % 11 = 0 THEN 'ARR' WHEN o_orderkey % 7 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'CD'
  WHEN o_orderkey % 5 = 0 OR o_orderkey % 19 = 0 THEN 'ARR' WHEN o_orderkey % 2 = 0 THEN 'NORM' ELSE 'OTHER' END AS superclass,
  CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END AS sex FROM orders""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS exam_id", "o_orderkey % 11 = 0 AS AF", "o_orderkey % 7 = 0 AS `1dAVb`", "o_orderkey % 13 = 0 AS RBBB",
        "o_orderkey % 17 = 0 AS LBBB", "o_orderkey % 5 = 0 AS SB", "o_orderkey % 19 = 0 AS ST", "o_orderkey % 2 = 0 AS normal_ecg",
        "o_custkey % 2 = 0 AS is_male")
    return df.select("exam_id", codes.exam_superclass().alias("superclass"), codes.exam_sex().alias("sex"))


# ---- D: joins -----------------------------------------------------------------------------
def features(spark, sf_dir):
    """Feature rows with copies: one per line item of the order."""
    f = ecg(spark, sf_dir).selectExpr("ecg_id", "age", "sex", "superclass", "int(superclass = 'MI') AS label_MI")
    return f.join(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ecg_id"), "ecg_id").unionByName(
        f.filter("ecg_id % 3 = 0"))


_HAS = "(ecg_id % 3 = 0 OR ecg_id IN (SELECT l_orderkey FROM lineitem))"


@query("d01_merge_features", E(f"SELECT ecg_id, qt_ms, CASE WHEN {_HAS} THEN age END AS age, CASE WHEN {_HAS} THEN sex END AS sex, "
                               f"CASE WHEN {_HAS} THEN superclass END AS superclass, CASE WHEN {_HAS} THEN CAST(superclass = 'MI' AS INTEGER) END AS label_MI FROM e"), dbl="qt_ms age")
def _(spark, sf_dir):
    return joins.merge_features(ecg(spark, sf_dir).select("ecg_id", "qt_ms"), features(spark, sf_dir))


@query("d01_match_report", E(f"""SELECT count(*) AS n, 'superclass' AS "column", count(CASE WHEN {_HAS} THEN superclass END) AS matched, 100e0 * count(CASE WHEN {_HAS} THEN superclass END) / count(*) AS match_pct FROM e
 UNION ALL SELECT count(*), 'age', count(CASE WHEN {_HAS} THEN age END), 100e0 * count(CASE WHEN {_HAS} THEN age END) / count(*) FROM e"""), dbl="match_pct")
def _(spark, sf_dir):
    return joins.match_report(joins.merge_features(ecg(spark, sf_dir).select("ecg_id", "qt_ms"), features(spark, sf_dir)))


@query("d02_join_first_common", E("SELECT ecg_id, qt_ms, superclass FROM e"), dbl="qt_ms")
def _(spark, sf_dir):
    left = ecg(spark, sf_dir).selectExpr("ecg_id", "qt_ms")
    right = ecg(spark, sf_dir).selectExpr("ecg_id", "subject_id AS id", "superclass")
    return joins.join_first_common(left, right, cols=["superclass"])


@query("d03_lookup_demographics", E("SELECT ecg_id, qt_ms, CASE WHEN ecg_id % 4 <> 0 THEN age END AS age, CASE WHEN ecg_id % 4 <> 0 THEN sex END AS sex FROM e"), dbl="qt_ms age")
def _(spark, sf_dir):
    meta = ecg(spark, sf_dir).filter("ecg_id % 4 <> 0").select("ecg_id", "age", "sex")
    return joins.lookup_demographics(ecg(spark, sf_dir).select("ecg_id", "qt_ms"), meta)


@query("d04_match_cascade", """
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0') || '_hr'
  WHEN 2 THEN 'rec-' || o_custkey || 'x' ELSE 'zz' || o_custkey || 'q' END AS record_name FROM orders),
m AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS meta_id, 'dir/' || c_custkey || '/rec-' || c_custkey || 'x.dat' AS filename,
  CAST(20 + c_custkey % 60 AS DOUBLE) AS age FROM customer),
x AS (SELECT r.*, e.age AS a1, n.age AS a2 FROM r LEFT JOIN m e ON e.meta_id = r.record_name
  LEFT JOIN m n ON TRY_CAST(n.meta_id AS BIGINT) = TRY_CAST(string_split(r.record_name, '_')[1] AS BIGINT)),
f AS (SELECT p.record_name, arg_min(m.age, m.meta_id) AS a3 FROM (SELECT DISTINCT record_name FROM x WHERE a1 IS NULL AND a2 IS NULL) p JOIN m ON contains(m.filename, p.record_name) GROUP BY 1)
SELECT o_orderkey, record_name, coalesce(a1, a2, a3) AS age, CASE WHEN a1 IS NOT NULL THEN 'exact' WHEN a2 IS NOT NULL THEN 'numeric' WHEN a3 IS NOT NULL THEN 'filename' END AS matched_by
FROM x LEFT JOIN f USING (record_name)""", dbl="age")
def _(spark, sf_dir):
    rec = table(spark, sf_dir, "orders").selectExpr("o_orderkey", """CASE o_orderkey % 4 WHEN 0 THEN concat('c', o_custkey)
      WHEN 1 THEN concat(lpad(o_custkey, 5, '0'), '_hr') WHEN 2 THEN concat('rec-', o_custkey, 'x') ELSE concat('zz', o_custkey, 'q') END AS record_name""")
    meta = table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 2 = 0 THEN concat('c', c_custkey) ELSE string(c_custkey) END AS meta_id",
        "concat('dir/', c_custkey, '/rec-', c_custkey, 'x.dat') AS filename", "double(20 + c_custkey % 60) AS age")
    return joins.match_cascade(rec, meta, cols=("age",))


@query("d05_link_outcomes", E(f"SELECT ecg_id, ecg_id AS study_id, qt_ms, d.subject_id, d.all_diag_all, d.gender FROM e JOIN d ON d.study_id = e.ecg_id",
                              more=f"d AS ({DIAG_SQL})"), dbl="qt_ms")
def _(spark, sf_dir):
    return joins.link_outcomes(ecg(spark, sf_dir).select("ecg_id", "qt_ms"), diag(spark, sf_dir).drop("dod"))


@query("d05_link_outcomes_by_subject", E(f"SELECT ecg_id, subject_id, age, gender FROM e JOIN d USING (subject_id)",
                                         more=f"d AS (SELECT subject_id, min(gender) AS gender FROM ({DIAG_SQL}) GROUP BY 1)"), dbl="age")
def _(spark, sf_dir):
    left = ecg(spark, sf_dir).select("ecg_id", "subject_id", "age").withColumnRenamed("ecg_id", "rec").select("rec", "subject_id", "age")
    right = diag(spark, sf_dir).selectExpr("subject_id", "gender")
    return joins.link_outcomes(left, right).withColumnRenamed("rec", "ecg_id")


@query("d06_flag_membership", f"""WITH h AS ({HOSP_SQL}), ev AS (SELECT DISTINCT subject_id FROM h WHERE {ICD_IN_SQL}), dd AS (SELECT DISTINCT subject_id FROM ({DIAG_SQL}) WHERE dod IS NOT NULL)
SELECT o_orderkey AS ecg_id, o_custkey AS subject_id, o_custkey IN (SELECT subject_id FROM ev) AS arrhythmia, o_custkey IN (SELECT subject_id FROM dd) AS deceased FROM orders""")
def _(spark, sf_dir):
    events = hosp(spark, sf_dir).filter(codes.icd_in("icd_code", fv.ICD_EVENT_CODES))
    dead = diag(spark, sf_dir).filter("dod IS NOT NULL")
    return joins.flag_membership(ecg(spark, sf_dir).select("ecg_id", "subject_id"), {"arrhythmia": events, "deceased": dead})


@query("d07_unprocessed", "SELECT o_orderkey AS ecg_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ecg_id")
    return joins.unprocessed(ecg(spark, sf_dir).select("ecg_id"), done)


# ---- G: sets ------------------------------------------------------------------------------
_EV = f"SELECT DISTINCT subject_id FROM ({HOSP_SQL}) WHERE {ICD_IN_SQL}"
_DEAD = f"SELECT DISTINCT subject_id FROM ({DIAG_SQL}) WHERE dod IS NOT NULL"


def _event_sets(spark, sf_dir):
    return (hosp(spark, sf_dir).filter(codes.icd_in("icd_code", fv.ICD_EVENT_CODES)).select("subject_id"),
            diag(spark, sf_dir).filter("dod IS NOT NULL").select("subject_id"))


@query("g02_id_union", f"{_EV} UNION {_DEAD}")
def _(spark, sf_dir):
    return schema.id_union(*_event_sets(spark, sf_dir))


@query("g02_id_intersect", f"{_EV} INTERSECT {_DEAD}")
def _(spark, sf_dir):
    return schema.id_intersect(*_event_sets(spark, sf_dir))


@query("g03_id_except", f"{_DEAD} EXCEPT {_EV}")
def _(spark, sf_dir):
    events, dead = _event_sets(spark, sf_dir)
    return schema.id_except(dead, events)


@query("g04_pool", "SELECT o_orderkey AS id, o_totalprice AS price, NULL::VARCHAR AS name FROM orders UNION ALL SELECT p_partkey, NULL, p_name FROM part", dbl="price")
def _(spark, sf_dir):
    return schema.pool([table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_totalprice AS price"),
                        table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS name")])
