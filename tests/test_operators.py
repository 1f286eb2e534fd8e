"""Properties of the statistical operators and brute-force comparisons on small data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoqt.functions.formulas import FORMULAS
from isoqt.functions import tails
from isoqt.operators import beats as bt
from isoqt.operators import bootstrap, joins, moments, ranks, reference, schema, sweep
from isoqt.operators.confusion import confusion, reclass_matrix
from isoqt.operators.quantiles import percentiles


@pytest.fixture(scope="module")
def pdf(ecg):
    return ecg.toPandas()


def test_r_ignores_constants(ecg):
    shifted = ecg.withColumn("qtc_shift", F.col("qtc_bazett") + 1234.5)
    r = {x["formula"]: x["r"] for x in moments.hr_corr(shifted, ["bazett", "shift"]).collect()}
    assert r["shift"] == pytest.approx(r["bazett"], abs=1e-12)


def test_corr_needs_enough_rows(ecg):
    rows = moments.hr_corr(ecg.filter("qt_ms IS NOT NULL").limit(9), ["bazett"], min_n=10).collect()
    assert rows[0]["r"] is None and rows[0]["n"] == 9


def test_percentiles_equal_numpy(ecg, pdf):
    probs = [0, 0.025, 0.5, 0.77, 0.975, 1]
    got = percentiles(ecg, {f"p{i}": ("qt_ms", p) for i, p in enumerate(probs)}, ["dataset"]).toPandas().set_index("dataset")
    for ds, group in pdf.groupby("dataset"):
        want = np.percentile(group["qt_ms"].dropna(), [100 * p for p in probs])
        assert np.allclose(got.loc[ds].to_numpy(float), want)


def test_percentiles_hot_value_and_null_group(spark):
    df = spark.createDataFrame([("a", 5.0)] * 1000 + [("a", float(i)) for i in range(100)] + [(None, 1.0), (None, 2.0)], "g string, v double")
    got = {r["g"]: (r["m"], r["hi"]) for r in percentiles(df, {"m": ("v", 0.5), "hi": ("v", 0.99)}, ["g"]).collect()}
    values = [5.0] * 1000 + list(range(100))
    assert got["a"] == pytest.approx((5.0, np.percentile(values, 99)))
    assert got[None] == pytest.approx((1.5, 1.99))


def test_percentile_of_equal_values_is_exact(spark):
    v = 428.1234567890123
    df = spark.createDataFrame([(v,)] * 38, "v double")
    assert percentiles(df, {"p": ("v", 0.975)}).first()["p"] == v


def test_spearman_equals_pandas(ecg, pdf):
    got = {r["dataset"]: r["rho"] for r in ranks.spearman(ecg, "qtc_bazett", "hr_bpm", ["dataset"]).collect()}
    for ds, g in pdf.dropna(subset=["qtc_bazett"]).groupby("dataset"):
        assert got[ds] == pytest.approx(g["qtc_bazett"].rank().corr(g["hr_bpm"].rank()), abs=1e-10)


def test_running_index(spark):
    df = spark.range(5000).selectExpr("id * 7 % 5000 AS k", "IF(id % 3 = 0, 'a', 'b') AS f")
    got = ranks.running_index(df, ["f"], "k", width=100).toPandas()
    for _, g in got.groupby("f"):
        assert g.sort_values("k")["trace_index"].tolist() == list(range(len(g)))


@pytest.mark.parametrize("degree", [2, 3, 6])
def test_poly_fit_equals_least_squares(ecg, pdf, degree):
    got = reference.poly_reference(ecg, degree, "rr1", ["dataset"]).select("ecg_id", "qt_expected_ms", "qtc_reference_ms").toPandas().set_index("ecg_id")
    for _, g in pdf.groupby("dataset"):
        k = g.dropna(subset=["qt_ms"])
        fit = np.polynomial.Polynomial.fit(k["rr_s"], k["qt_ms"], degree)
        assert np.allclose(got.loc[g["ecg_id"], "qt_expected_ms"], fit(g["rr_s"]), rtol=1e-6)
        want = k["qt_ms"] - fit(k["rr_s"]) + fit(1.0)
        assert np.allclose(got.loc[k["ecg_id"], "qtc_reference_ms"], want, rtol=1e-6)


def test_reference_is_independent_of_rate(ecg):
    out = reference.poly_reference(ecg, 6, "mean", ["dataset"]).withColumn("qtc_ref", F.col("qtc_reference_ms"))
    assert all(r["abs_r"] < 0.02 for r in moments.hr_corr(out, ["ref"], ["dataset"]).collect())


def test_confusion_cells_add_up(ecg):
    df = ecg.withColumns({"t": F.col("qtc_fridericia") > 420, "p": F.col("qtc_bazett") > 430})
    n = df.filter("t IS NOT NULL AND p IS NOT NULL").count()
    row = confusion(df, "t", "p").first()
    assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == n == row["total"]


def test_empty_denominator_policies(spark):
    df = spark.sql("SELECT false AS t, false AS p")
    assert confusion(df, "t", "p", zero=0.0).first()["sensitivity"] == 0.0
    assert confusion(df, "t", "p", zero=None).first()["sensitivity"] is None


def test_reclass_total_is_valid_rows(ecg):
    from isoqt.plans.clinical import with_classes
    row = reclass_matrix(with_classes(ecg), "class_bazett", "class_inverse_rr").first()
    assert row["total"] == ecg.filter("qt_ms IS NOT NULL").count() == row["upgraded"] + row["downgraded"] + row["unchanged"]


def test_sweep_equals_direct_r(ecg):
    cells = {(r["dataset"], r["k"]): r["abs_r"] for r in sweep.sweep_by_group(ecg, [100, 125], [-158]).collect()}
    direct = ecg.groupBy("dataset").agg(*[F.abs(F.corr(F.col("qt_ms") + F.lit(float(k)) / F.col("rr_s"), "hr_bpm")).alias(str(k)) for k in (100, 125)])
    for r in direct.collect():
        assert cells[(r["dataset"], 100.0)] == pytest.approx(r["100"], abs=1e-10)
        assert cells[(r["dataset"], 125.0)] == pytest.approx(r["125"], abs=1e-10)


def test_optimum_takes_first_c(ecg):
    best = sweep.sweep_optimum(sweep.sweep_k(ecg)).first()
    assert best["c_optimal"] == sweep.C_GRID[0] and best["k_optimal"] in sweep.K_GRID


def test_roc_equals_direct_counts(ecg):
    df = ecg.withColumn("t", F.col("ecg_id") % 3 == 0)
    pts = {r["threshold"]: r for r in sweep.roc(df, "t", ["bazett"]).collect()}
    assert len(pts) == 41
    for limit in (350, 430, 445, 550):
        want = df.agg(F.count_if(F.col("t") & (F.col("qtc_bazett") > limit)), F.count_if(~F.col("t") & (F.col("qtc_bazett") > limit))).first()
        assert (pts[limit]["tp"], pts[limit]["fp"]) == tuple(want)
        assert pts[limit]["tp"] + pts[limit]["fn"] == df.filter("t").count()


def test_bootstrap_brackets_estimate_and_ignores_partitioning(ecg):
    point = {(r["dataset"], r["formula"]): r["abs_r"] for r in moments.hr_corr(ecg, ["bazett"], ["dataset"]).collect()}
    def run(df):
        return {(r["dataset"], r["formula"]): (r["ci_low"], r["ci_high"]) for r in bootstrap.bootstrap_r(df, ["bazett"], replicates=200).collect()}
    a, b = run(ecg.repartition(2)), run(ecg.repartition(7))
    for key, r in point.items():
        assert a[key][0] < r < a[key][1]
        assert a[key] == pytest.approx(b[key], abs=1e-9)


def test_poisson_weights_have_unit_mean_and_variance():
    w = bootstrap.poisson_weights(np.arange(2000, dtype=np.int64), 101, 7, bootstrap._poisson_table())
    assert w.shape == (2000, 101) and w.mean() == pytest.approx(1.0, abs=0.01) and w.var() == pytest.approx(1.0, abs=0.02)


def test_bootstrap_confusion_brackets(spark):
    counts = spark.createDataFrame([("a", 80, 30, 870, 20)], "formula string, tp bigint, fp bigint, tn bigint, fn bigint")
    for r in bootstrap.bootstrap_confusion(counts, replicates=400).collect():
        assert r["ci_low"] <= r["point"] <= r["ci_high"]


@pytest.mark.parametrize("r,n", [(0.05, 50), (0.3, 30), (-0.8, 12), (0.01, 5000)])
def test_corr_p_equals_integral(spark, r, n):
    got = spark.createDataFrame([(r, n)], "r double, n bigint").select(tails.corr_p("r", "n")).first()[0]
    df, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
    u = np.linspace(0, math.pi / 2 - math.atan(t / math.sqrt(df)), 200001)  # x = sqrt(df) tan(pi/2 - u)
    density = np.sin(u) ** (df - 1)
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    assert got == pytest.approx(2 * norm * np.trapezoid(density, u), rel=1e-5)


@pytest.mark.parametrize("r,n,want", [(0.5, 3, 2 / 3), (0.3, 4, 0.7), (1.0, 9, 0.0), (0.0, 3, 1.0), (0.0, 10**11, 1.0), (None, 9, None), (0.5, 2, None), (float("nan"), 9, None)])
def test_corr_p_closed_forms(spark, r, n, want):
    got = spark.createDataFrame([(r, n)], "r double, n bigint").select(tails.corr_p("r", "n")).first()[0]
    assert got is None if want is None else got == pytest.approx(want, rel=1e-11)


@pytest.mark.parametrize("z", [0.5, 3.0, 12.0, 30.0])
def test_tails_meet_the_normal_for_huge_samples(spark, z):
    rows = spark.createDataFrame([(z / math.sqrt(1e11), 10**11, z * z)], "r double, n bigint, x double")
    p, chi = rows.select(tails.corr_p("r", "n"), tails.chi2_p("x")).first()
    assert chi == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-11) and p == pytest.approx(chi, rel=1e-6)


def test_chi2_p(spark):
    got = [r[0] for r in spark.createDataFrame([(3.841459,), (0.0,)], "x double").select(tails.chi2_p("x")).collect()]
    assert got == pytest.approx([0.05, 1.0], abs=1e-6)


def test_split_and_sample_survive_repartitioning(ecg):
    a = {r["ecg_id"] for r in schema.split(ecg).filter("is_test").select("ecg_id").collect()}
    b = {r["ecg_id"] for r in schema.split(ecg.repartition(9)).filter("is_test").select("ecg_id").collect()}
    assert a == b and 0.1 < len(a) / ecg.count() < 0.3
    s1 = {r["ecg_id"] for r in schema.sample_n(ecg, 20, by=["dataset"]).select("ecg_id").collect()}
    s2 = {r["ecg_id"] for r in schema.sample_n(ecg.repartition(5), 20, by=["dataset"]).select("ecg_id").collect()}
    assert s1 == s2 and len(s1) == 20 * ecg.select("dataset").distinct().count()
    for n in (0, 1, 33, 10**6):
        assert schema.sample_n(ecg, n).count() == min(n, ecg.count())
    assert schema.sample_n(ecg.limit(0), 5).count() == 0 and schema.sample_n(ecg.limit(0), 5, by=["dataset"]).count() == 0
    small = {r["ecg_id"] for r in schema.sample_n(ecg, 50).select("ecg_id").collect()}
    assert small < {r["ecg_id"] for r in schema.sample_n(ecg.repartition(7), 60).select("ecg_id").collect()}
    assert schema.sample_n(ecg.withColumn("ecg_id", F.lit(None).cast("bigint")), 40).count() == 40


def test_merge_keeps_row_count(ecg):
    features = ecg.select("ecg_id", "superclass").union(ecg.select("ecg_id", "superclass"))
    merged = joins.merge_features(ecg.select("ecg_id", "qt_ms"), features)
    assert merged.count() == ecg.count() and merged.filter("superclass IS NULL").count() == 0


def test_link_keeps_left_age(spark):
    left = spark.sql("SELECT 1 AS ecg_id, 40D AS age")
    right = spark.sql("SELECT 1 AS study_id, 99D AS age, 'M' AS gender")
    assert joins.link_outcomes(left, right).first()["age"] == 40.0


def test_rr_over_chunks(spark):
    rows = [(1, i, 100 + 400 * i + (i * i) % 50) for i in range(50)] + [(2, 0, 5)]
    df = spark.createDataFrame(rows, "ecg_id bigint, beat_no bigint, r_peak bigint")
    got = {(r["ecg_id"], r["beat_no"]): r["rr_samples"] for r in bt.with_rr(df, chunk=8).collect()}
    assert len(got) == 51 and got[(2, 0)] is None and got[(1, 49)] is None
    assert all(got[(1, i)] == rows[i + 1][2] - rows[i][2] for i in range(49))


def test_amplitude_ignores_outside(spark):
    sig = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0])], "ecg_id bigint, signal array<float>")
    beats = spark.createDataFrame([(1, 0, 1), (1, 1, -2), (1, 2, 3), (1, 3, 9)], "ecg_id bigint, beat_no bigint, r_peak bigint")
    assert bt.amplitudes(beats, sig).first()["r_amplitude"] == 2.0


def test_fix_rr_unit_only_in_ms_groups(ecg):
    mixed = ecg.withColumn("rr_s", F.when(F.col("dataset") == "ds_a", F.col("rr_ms")).otherwise(F.col("rr_s")))
    assert schema.fix_rr_unit(mixed).agg(F.max("rr_s")).first()[0] < 2


def test_threshold_grid(spark):
    rows = [("a", v) for v in (1.0, 2.0, 2.0, 5.0, None, float("nan"))] + [(None, 3.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for inclusive in (False, True):
        got = {(r["g"], r["threshold"]): r["n_above"] for r in sweep.threshold_grid(df, "v", [3.0, 2.0, 9.0], ["g"], inclusive).collect()}
        assert got == {(g, t): sum(1 for k, v in rows if k == g and v is not None and (v >= t if inclusive else v > t)) for g in ("a", None, "b") for t in (2.0, 3.0, 9.0)}
    assert [r["n_above"] for r in sweep.threshold_grid(df, "v", [2.0]).collect()] == [2]


def test_dedup_takes_first(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in schema.dedup(df, ["k"], ["v"]).collect()) == [(1, "a"), (2, "c")]


def test_match_cascade_by_filename(spark):
    rec = spark.createDataFrame([("00001_hr",), ("x9",), ("rec-7",), ("none",)], "record_name string")
    meta = spark.createDataFrame([("1", "f/00001_hr.dat", 10.0), ("x9", "f/x9", 20.0), ("q", "a/rec-7b.dat", 30.0)], "meta_id string, filename string, age double")
    got = {r["record_name"]: (r["age"], r["matched_by"]) for r in joins.match_cascade(rec, meta, cols=("age",)).collect()}
    assert got == {"00001_hr": (10.0, "numeric"), "x9": (20.0, "exact"), "rec-7": (30.0, "filename"), "none": (None, None)}


def test_match_cascade_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ab1_"), n))
    files = [(f"id{i:03d}", "dir/" + word(30) + ".dat", float(i)) for i in range(120)] + [("7", None, 1.0), (None, "dir/zz", 2.0), ("id003", "dir/zzabab", 3.0)]
    names = {word(int(n)) for n in rng.integers(1, 14, 400)} | {f[1][k : k + 15] for k, f in enumerate(files[:15])} | {"", "a", "007_x", "id005", "zz", "nowhere_at_all"}
    rows = [(n, i) for i, n in enumerate(sorted(names))] + [(None, 1000 + i) for i in range(300)] + [("a", 2000 + i) for i in range(300)]
    meta = spark.createDataFrame(files, "meta_id string, filename string, age double")
    rec = spark.createDataFrame([(n, i, 9.0) for n, i in rows], "record_name string, i bigint, age double")

    def want(name):
        if name is None:
            return None, None
        exact = sorted(a for k, _, a in files if k == name)
        if exact:
            return exact[0], "exact"
        head = name.split("_")[0]
        same = sorted(a for k, _, a in files if k is not None and k.isdigit() and head.isdigit() and int(k) == int(head))
        if same:
            return same[0], "numeric"
        held = sorted((k, a) for k, f, a in files if k is not None and f is not None and name in f)
        return (held[0][1], "filename") if held else (None, None)

    got = {r["i"]: (r["record_name"], r["age"], r["matched_by"]) for r in joins.match_cascade(rec, meta, cols=("age",)).collect()}
    assert got == {i: (n, *want(n)) for n, i in rows}
    assert joins.match_cascade(rec.limit(0), meta, cols=("age",)).count() == 0 and joins.match_cascade(rec, meta.limit(0), cols=("age",)).where("matched_by IS NOT NULL").count() == 0


def test_match_cascade_keeps_only_pieces_of_names(spark, monkeypatch):
    """Pieces that no name has are not written; names of other scripts, of one to eleven bytes, and of pieces all files have are found."""
    files = [(f"k{i:04d}", f"dir/größe-東京/{i}/rec-{i}x.dat", float(i)) for i in range(2000)]
    names = [f"rec-{i}x" for i in range(0, 2000, 7)] + [f"c{i}" for i in range(500)] + [f"zz{i}q" for i in range(500)] + ["ö", "京/77/", "東京", "größe-東京", "größe-京東"]
    rec = spark.createDataFrame([(n,) for n in names], "record_name string")
    meta = spark.createDataFrame(files, "meta_id string, filename string, age double")
    rows, whole = [], joins.written

    def counted(df, *args):
        out = whole(df, *args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(joins, "written", counted)
    got = {r["record_name"]: r["age"] for r in joins.match_cascade(rec, meta, cols=("age",)).collect()}
    assert got == {n: next((a for _, f, a in files if n in f), None) for n in names}
    print("rows written", rows)
    assert max(rows) <= 10 * len(files)


def test_uncoded_first_headers_do_not_hide_coded_ones(spark):
    from isoqt.sources.records import has_coded_headers

    rows = [(f"p{i:02d}", "# Age: 50") for i in range(9)]
    assert not has_coded_headers(spark.createDataFrame(rows, "path string, header string")).first()[0]
    assert has_coded_headers(spark.createDataFrame(rows + [("p99", "# Dx: 426177001")], "path string, header string")).first()[0]


def test_all_report_lines_are_kept(spark):
    from isoqt.functions.codes import report_codes

    cols = [f"r{i}" for i in range(8)]
    df = spark.createDataFrame([tuple(f" line {i} " for i in range(8))], cols)
    assert df.select(report_codes(cols).alias("c")).first().c == [f"line {i}" for i in range(8)]
