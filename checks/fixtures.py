"""Projections that let the driver tables stand in for ECG tables, and query registration.

The SQL runs unchanged in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ECG_SQL = """
SELECT h.o_orderkey AS ecg_id, h.o_custkey AS subject_id, h.o_orderdate AS ecg_time,
  CASE h.o_orderkey % 6 WHEN 0 THEN 'ds_a' WHEN 1 THEN 'ds_b' WHEN 2 THEN 'ds_c'
       WHEN 3 THEN 'ds_d' WHEN 4 THEN 'ds_e' ELSE 'ds_f' END AS dataset,
  CASE WHEN h.o_custkey % 23 = 0 THEN NULL WHEN h.o_custkey % 2 = 0 THEN 0 ELSE 1 END AS sex,
  CASE WHEN h.o_custkey % 19 = 0 THEN NULL
       ELSE CAST(18 + (h.o_custkey * 31) % 73 AS DOUBLE) END AS age,
  CASE WHEN h.o_orderkey % 10 < 5 THEN 'NORM' WHEN h.o_orderkey % 10 = 5 THEN 'MI'
       WHEN h.o_orderkey % 10 = 6 THEN 'STTC' WHEN h.o_orderkey % 10 = 7 THEN 'CD'
       WHEN h.o_orderkey % 10 = 8 THEN 'ARR' ELSE 'HYP' END AS superclass,
  h.hr AS hr_bpm, 60e0 / h.hr AS rr_s, 60000e0 / h.hr AS rr_ms,
  CASE WHEN h.o_orderkey % 97 = 0 THEN NULL
       ELSE 396e0 - 1.15e0 * (h.hr - 70e0) + h.z END AS qt_ms,
  CAST((h.o_orderkey * 37) % 101 AS DOUBLE) / 100e0 AS signal_quality,
  CAST((h.o_orderkey * 53) % 101 AS DOUBLE) / 100e0 AS t_wave_detection_rate
FROM (SELECT o_orderkey, o_custkey, o_orderdate,
        45e0 + CAST((o_orderkey * 7919) % 41 + (o_orderkey * 104729) % 37
                    + (o_custkey * 15485863) % 31 AS DOUBLE) * 0.85e0 AS hr,
        CAST((o_orderkey * 611953) % 61 + (o_custkey * 32452843) % 53 AS DOUBLE) - 56e0 AS z
      FROM orders) h
"""

BEATS_SQL = """
SELECT e.ecg_id, t.beat_no,
  100 + t.beat_no * e.step + (e.ecg_id * 13 + t.beat_no * 7) % 11 AS r_peak,
  CASE WHEN (e.ecg_id + t.beat_no) % 9 = 0 THEN NULL
       ELSE 100 + t.beat_no * e.step - 80 - (e.ecg_id * 3) % 17 END AS p_onset,
  CASE WHEN (e.ecg_id + t.beat_no) % 7 = 0 THEN NULL
       ELSE 100 + t.beat_no * e.step - 20 - (t.beat_no * 5) % 5 END AS q_peak,
  100 + t.beat_no * e.step + 20 + (e.ecg_id * 5) % 9 AS s_peak,
  CASE WHEN (e.ecg_id + t.beat_no) % 11 = 0 THEN NULL
       ELSE 100 + t.beat_no * e.step + 150 + (e.ecg_id * 17 + t.beat_no) % 40 END AS t_offset
FROM (SELECT o_orderkey AS ecg_id, 230 + (o_orderkey * 7919) % 400 AS step FROM orders) e
CROSS JOIN range(10) AS t(beat_no)
"""

DIAG_SQL = """
SELECT o_orderkey AS study_id, o_custkey AS subject_id,
  CASE o_orderkey % 29 WHEN 0 THEN '[''I472'', ''E119'']' WHEN 1 THEN '[''I461'']'
       WHEN 2 THEN '[''I480'', ''I10'']' WHEN 3 THEN '[''R000'']' WHEN 4 THEN '[''I4581'']'
       WHEN 5 THEN '[]' WHEN 6 THEN NULL ELSE '[''E119'', ''I10'']' END AS all_diag_all,
  CASE WHEN o_orderkey % 31 = 0 THEN o_orderdate + INTERVAL '20' DAY
       WHEN o_orderkey % 31 = 1 THEN o_orderdate + INTERVAL '75' DAY
       WHEN o_orderkey % 31 = 2 THEN o_orderdate - INTERVAL '3' DAY ELSE NULL END AS dod,
  CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender
FROM orders
"""

# Hospital diagnosis rows: one per line item, ICD codes by part key.
HOSP_SQL = """
SELECT l_orderkey AS ecg_id, o_custkey AS subject_id,
  CASE l_partkey % 37 WHEN 0 THEN 'i47.2' WHEN 1 THEN 'I490' WHEN 2 THEN 'I46.9' WHEN 3 THEN 'R96.0'
       WHEN 4 THEN 'I48' ELSE 'E119' END AS icd_code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

# Record texts: phrases of machine reports placed on documents by key.
REPORT_SQL = """
SELECT doc_id, text AS report_0,
  CASE doc_id % 9 WHEN 0 THEN 'Sinus rhythm' WHEN 1 THEN 'Atrial fibrillation' WHEN 2 THEN 'Prolonged QT interval'
       WHEN 3 THEN 'Left ventricular hypertrophy' WHEN 4 THEN 'Inferior infarct' WHEN 5 THEN '  '
       WHEN 6 THEN NULL WHEN 7 THEN 'Normal ECG' ELSE 'Nonspecific T wave changes' END AS report_1,
  CASE doc_id % 5 WHEN 0 THEN 'Sinus tachycardia' WHEN 1 THEN 'LQTS2 suspected' WHEN 2 THEN 'Abnormal'
       WHEN 3 THEN NULL ELSE 'ST elevation' END AS report_2
FROM documents
"""

CATALOG_ROWS = [
    ("cand_1", "additive", "(125.0 / RR_interval_sec) - 158.0", 5, 0.31),
    ("cand_2", "factor", "inv(sqrt(RR_interval_sec))", 4, 0.42),
    ("cand_3", "direct", "QT_interval_ms + square(1.2 - RR_interval_sec)", 6, 0.55),
    ("cand_4", "factor", "inv(cbrt(RR_interval_sec))", 4, 0.47),
]
# The same four candidates as DuckDB expressions.
CATALOG_SQL = {
    "cand_1": "qt_ms + (125e0 / rr_s - 158e0)", "cand_2": "qt_ms * (1e0 / sqrt(rr_s))",
    "cand_3": "qt_ms + power(1.2e0 - rr_s, 2)", "cand_4": "qt_ms * (1e0 / cbrt(rr_s))",
}
STANDARD_SQL = {
    "bazett": "qt_ms / sqrt(rr_s)", "fridericia": "qt_ms / cbrt(rr_s)",
    "framingham": "qt_ms + 154e0 * (1e0 - rr_s)", "hodges": "qt_ms + 1.75e0 * (hr_bpm - 60e0)",
}

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, dbl: str = "", big: str = ""):
    """Register a query and, if SQL can express it, its DuckDB counterpart.

    Doubles are compared to 6 decimals: every double column of the Spark result is rounded, and
    the columns named in ``dbl`` are in the SQL. Columns named in ``big`` become BIGINT.
    """
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
            return df.withColumns({**{c: F.round(c, 6) + F.lit(0.0) for c in doubles},  # + 0 turns -0.0 into 0.0
                                   **{c: F.col(c).cast("bigint") for c in big.split()}})
        QUERIES[name] = run
        if sql is not None:
            changes = [f"round({c}, 6) + 0e0 AS {c}" for c in dbl.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in big.split()]
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(changes)}) FROM ({sql})" if changes else sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ecg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ECG_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BEATS_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIAG_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def hosp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HOSP_SQL.replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}"),
                     lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPORT_SQL.replace("FROM documents", "FROM {documents}"),
                     documents=table(spark, sf_dir, "documents"))


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CATALOG_ROWS, "name string, approach string, equation string, complexity bigint, loss double")


# ---- pieces of DuckDB SQL -----------------------------------------------------------------
def thr(unknown) -> str:
    return f"CASE WHEN sex = 0 THEN 450e0 WHEN sex = 1 THEN 460e0 ELSE {'NULL' if unknown is None else f'{unknown}e0'} END"


def case(c: str, bins) -> str:
    """Left-closed buckets as CASE."""
    edges, labels = bins
    whens = "".join(f" WHEN {c} < {hi} THEN '{label}'" for hi, label in zip(edges[1:], labels))
    return f"CASE WHEN {c} < {edges[0]} THEN NULL{whens} END"


def formulas_sql(c: int = -158) -> str:
    return (f"qt_ms + 125e0 / rr_s + ({c}) AS q_inverse_rr, " +
            ", ".join(f"{sql} AS q_{f}" for f, sql in STANDARD_SQL.items()))


def with_ecg(body: str, c: int = -158, unknown=455, extra: str = "", more: str = "") -> str:
    """``body`` over e: the ECG rows with corrections q_*, threshold thr and ``extra`` columns.

    ``more`` adds further CTEs.
    """
    extra = f", {extra}" if extra else ""
    more = f", {more}" if more else ""
    return (f"WITH ecg AS ({ECG_SQL}), e0 AS (SELECT *, {formulas_sql(c)}, {thr(unknown)} AS thr FROM ecg), "
            f"e AS (SELECT *{extra} FROM e0){more} {body}")


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def poly_cte(source: str, degree: int, by: str = "dataset", name: str = "pf", x: str = "rr_s", y: str = "qt_ms", where: str = "TRUE") -> str:
    """CTEs fitting y on x per group by orthogonal polynomials (three-term recurrence).

    ``name`` gets qt_expected (the fit at x), at_one (the fit at 1), mean_y and fit_n.
    """
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    parts = [f"{name}_0 AS (SELECT *, CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL AND {where} THEN 1 END AS w, 1e0 AS p0, 1e0 AS o0 FROM {source})"]
    for k in range(degree + 1):
        parts.append(f"{name}_{k}s AS (SELECT *, sum(w * p{k} * p{k}) {over} AS h{k}, sum(w * {x} * p{k} * p{k}) {over} AS xh{k}, "
                     f"sum(w * ({y} - 400e0) * p{k}) {over} AS yh{k} FROM {name}_{k})")
        if k < degree:
            back = f"- h{k} / h{k - 1} * p{k - 1}" if k else ""
            back_one = f"- h{k} / h{k - 1} * o{k - 1}" if k else ""
            parts.append(f"{name}_{k + 1} AS (SELECT *, ({x} - xh{k} / h{k}) * p{k} {back} AS p{k + 1}, (1e0 - xh{k} / h{k}) * o{k} {back_one} AS o{k + 1} FROM {name}_{k}s)")
    fit = " + ".join(f"yh{k} / h{k} * p{k}" for k in range(degree + 1))
    one = " + ".join(f"yh{k} / h{k} * o{k}" for k in range(degree + 1))
    work = ", ".join(["w", *[f"{c}{k}" for k in range(degree + 1) for c in ("p", "o", "h", "xh", "yh")]])
    parts.append(f"{name} AS (SELECT * EXCLUDE ({work}), 400e0 + {fit} AS qt_expected, 400e0 + {one} AS at_one, avg({y}) {over} AS mean_y, count(w) {over} AS fit_n FROM {name}_{degree}s)")
    return ", ".join(parts)


def each(formulas, sql: str, names: dict | None = None) -> str:
    """UNION ALL of ``sql`` with {f} replaced by each formula."""
    return union(sql.replace("{f}", f) for f in formulas)


def p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation by the finite series of Student's t, whose length is half the sample."""
    log_q = f"ln(greatest(1e0 - ({r}) * ({r}), 1e-300))"
    even = f"list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5e0) - lgamma(0.5e0) - lgamma(k + 1e0) + k * {log_q})))"
    odd = f"list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: exp(lgamma(k + 1e0) + lgamma(1.5e0) - lgamma(k + 1.5e0) + (k + 0.5e0) * {log_q})))"
    size = f"least(abs({r}), 1e0)"
    return (f"CASE WHEN {r} IS NOT NULL AND {n} > 2 THEN greatest(0e0, CASE WHEN {n} % 2 = 0 THEN 1e0 - {size} * coalesce({even}, 0e0) "
            f"ELSE 1e0 - 2e0 / pi() * (asin({size}) + {size} * coalesce({odd}, 0e0)) END) END")


def strata_sql(strata, select: str, source: str = "e", having: str = "") -> str:
    """UNION ALL of one GROUP BY per (kind, label expression)."""
    return union(f"SELECT '{kind}' AS kind, {label} AS label, {select} FROM {source} WHERE {label} IS NOT NULL GROUP BY 2 {having}" for kind, label in strata)


def rsafe(r: str, n: str, min_n: int) -> str:
    return f"CASE WHEN {n} >= {min_n} THEN {r} END"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


def metric_sql(tp="tp", fp="fp", tn="tn", fn="fn", zero: str | None = "0e0") -> dict[str, str]:
    def d(a, b):
        return f"coalesce({div(a, b)}, {zero})" if zero else div(a, b)
    sens, spec = d(tp, f"({tp} + {fn})"), d(tn, f"({tn} + {fp})")
    big = [f"CAST({x} AS DOUBLE)" for x in (tp, fp, tn, fn)]
    return {"total": f"{tp} + {fp} + {tn} + {fn}", "sensitivity": sens, "specificity": spec, "ppv": d(tp, f"({tp} + {fp})"), "npv": d(tn, f"({tn} + {fn})"),
            "accuracy": d(f"({tp} + {tn})", f"({tp} + {fp} + {tn} + {fn})"), "f1": d(f"(2 * {tp})", f"(2 * {tp} + {fp} + {fn})"),
            "youden_j": f"{sens} + {spec} - 1", "mcc": d(f"({big[0]} * {big[2]} - {big[1]} * {big[3]})", f"sqrt(({big[0]} + {big[1]}) * ({big[0]} + {big[3]}) * ({big[2]} + {big[1]}) * ({big[2]} + {big[3]}))"),
            "fpr": f"1 - {spec}", "fnr": f"1 - {sens}"}


METRICS = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "f1", "youden_j", "mcc", "fpr", "fnr"]


def counts_sql(t: str, p: str, tag: str = "") -> str:
    return (f"count(*) FILTER (WHERE {t} AND {p}) AS {tag}tp, count(*) FILTER (WHERE NOT {t} AND {p}) AS {tag}fp, "
            f"count(*) FILTER (WHERE NOT {t} AND NOT {p}) AS {tag}tn, count(*) FILTER (WHERE {t} AND NOT {p}) AS {tag}fn")


def metrics_list(names=None, zero="0e0", tag: str = "") -> str:
    m = metric_sql(*[f"{tag}{x}" for x in ("tp", "fp", "tn", "fn")], zero=zero)
    return ", ".join(f"{m[n]} AS {tag}{n}" for n in (names or ["total", *METRICS]))
