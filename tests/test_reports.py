"""Reports against pandas, tables, streams and the driver contract."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoqt.functions import classify as cl
from isoqt.functions import codes
from isoqt.operators import schema
from isoqt.plans import candidates, clinical, extremes, manuscript, safety, strata
from isoqt.session import written
from isoqt.sources import records, tables
from isoqt.streaming import ingest


def test_triage_red_is_both(ecg):
    rows = schema.enrich(ecg)
    assert rows.filter((F.col("triage") == "RED") != (F.col("pred_bazett") & F.col("pred_inverse_rr"))).count() == 0


def test_cascade_levels_cover_all_rows(ecg):
    r = clinical.cascade(ecg.withColumn("qtc_reference_ms", F.col("qtc_fridericia"))).first()
    assert r["green"] + r["yellow"] + r["red"] == r["n"] == ecg.count()
    assert r["any_tp"] == r["base_tp"] and r["any_fp"] == r["base_fp"]


def test_overlapping_populations_count_rows_twice(ecg):
    rows = schema.enrich(ecg)
    got = {r["population"]: r["n"] for r in extremes.population_report(rows).collect()}
    for name, flag in extremes.population_flags().items():
        assert got.get(name, 0) == rows.filter(flag).count()


def test_strata_add_up(ecg):
    df = ecg.withColumn("qtc_reference_ms", F.col("qtc_fridericia"))
    got = {(r["kind"], r["label"]): r["n"] for r in strata.subgroup_report(df).collect()}
    assert got[("Overall", "All datasets")] == ecg.count() == sum(n for (k, _), n in got.items() if k == "Dataset")


def test_small_groups_keep_only_n(ecg):
    df = ecg.limit(50).withColumn("qtc_reference_ms", F.col("qtc_fridericia"))
    for r in strata.subgroup_report(df).collect():
        assert r["n"] <= 50 and r["abs_r_bazett"] is None and r["fp_bazett"] is None


def test_chi2_with_yates(spark):
    df = spark.createDataFrame([("reclassified_normal", 200, 30, 80.0), ("concordant_normal", 300, 25, 70.0)],
                               "concordance string, n_records bigint, n_any_severe_event bigint, mean_hr double")
    r = safety.safety(df).first()
    a, b, c, d = 30, 170, 25, 275
    n = a + b + c + d
    expected = [(a + b) * (a + c) / n, (a + b) * (b + d) / n, (c + d) * (a + c) / n, (c + d) * (b + d) / n]
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in zip((a, b, c, d), expected))
    assert r["chi2"] == pytest.approx(want) and 0 < r["p_value"] < 0.05 and r["verdict"] == "NEEDS_REVIEW"


def test_odds_ratio_of_counts(spark):
    # without covariate effects the adjusted ratio is the crude one
    rows = []
    for group, events, n in (("reclassified_normal", 40, 200), ("concordant_normal", 20, 200)):
        for i in range(n):
            rows.append((group, 50.0 + (i % 2), i % 4 // 2, 70.0 + (i // 4) % 2, i < events))
    df = spark.createDataFrame(rows, "concordance string, age double, sex int, hr_bpm double, o boolean")
    r = safety.adjusted_odds(df, ["o"]).first()
    assert r["odds_ratio"] == pytest.approx((40 * 180) / (160 * 20), rel=0.02) and r["ci_low"] < r["odds_ratio"] < r["ci_high"] and r["p_value"] < 0.05


def test_odds_need_enough_rows(spark):
    df = spark.createDataFrame([("reclassified_normal", 50.0, 0, 70.0, True)], "concordance string, age double, sex int, hr_bpm double, o boolean")
    assert safety.adjusted_odds(df, ["o"]).first()["odds_ratio"] is None


def test_lodo_equals_direct(ecg):
    got = {(r["held_out"], r["formula"]): r for r in candidates.lodo(ecg, ["bazett"]).collect()}
    rest = ecg.filter("dataset <> 'ds_a'").agg(F.abs(F.corr("qtc_bazett", "hr_bpm"))).first()[0]
    assert got[("ds_a", "bazett")]["abs_r_rest"] == pytest.approx(rest, abs=1e-10)


def test_catalog(spark):
    rows = [("a", "factor", "inv(sqrt(RR))", 3, 0.2), ("b", "factor", "inv(sqrt(RR))", 3, 0.1), ("c", "direct", "inv(RR - 1)", 3, 0.05), ("d", "additive", "1 - RR", 2, 0.3)]
    cat = candidates.FormulaCatalog.from_df(spark.createDataFrame(rows, "name string, approach string, equation string, complexity bigint, score double"))
    assert cat.names == ["a", "d", "bazett", "fridericia", "framingham", "hodges"]
    text = {r["name"]: r["full_formula"] for r in cat.to_df().collect()}
    assert text["d"] == "QTc = QT + (1 - RR)"


def test_table_files(spark, ecg, tmp_path):
    small = ecg.select("ecg_id", "qt_ms", "superclass")
    for dialect in ("eu", "std"):
        path = str(tmp_path / dialect)
        tables.write_table(small, path, "csv", dialect)
        back = tables.read_delimited(spark, [str(tmp_path / "missing"), path])
        assert back.schema["qt_ms"].dataType.simpleString() == "double" and back.schema["superclass"].dataType.simpleString() == "string"
        assert back.agg(F.sum("qt_ms")).first()[0] == pytest.approx(small.agg(F.sum("qt_ms")).first()[0])
        assert back.filter("qt_ms IS NULL").count() == small.filter("qt_ms IS NULL").count()
    with pytest.raises(FileNotFoundError):
        tables.read_delimited(spark, [str(tmp_path / "none")])


def test_compact_removes_parts(spark, tmp_path):
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "parts"))
    merged = tables.compact(spark, str(tmp_path / "parts"), str(tmp_path / "all"))
    assert merged.count() == 100 and not list((tmp_path / "parts").glob("*.parquet"))
    spark.range(7).write.mode("append").parquet(str(tmp_path / "parts"))
    with pytest.raises(Exception, match="already exists"):
        tables.compact(spark, str(tmp_path / "parts"), str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 100 and spark.read.parquet(str(tmp_path / "parts")).count() == 7


def test_delimited_keeps_ids(spark, tmp_path):
    (tmp_path / "t.csv").write_text("padded,long,whole,part,none\n00012,9007199254740993,7,1.5,\n5,12345678901234567890,8,2,\n")
    back = tables.read_delimited(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in back.dtypes] == ["string", "string", "bigint", "double", "string"]
    assert {r["padded"] for r in back.collect()} == {"00012", "5"}


def test_written_keeps_partition_types(spark):
    df = spark.createDataFrame([("01", 1), ("02", 2)], "dataset string, n int")
    back = written(df, ["dataset"])
    assert back.schema == df.schema and {r["dataset"] for r in back.collect()} == {"01", "02"}


def test_code_map_quotes_and_none(spark):
    texts = ["""{"Bachmann's": 80.0, 'SR': 10.0}""", "{'AFIB': None}", "{'A': nan, 'B': 1.0}", "bad"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(codes.code_map("t").alias("m")).collect()
    assert rows[0]["m"] == {"Bachmann's": 80.0, "SR": 10.0} and rows[1]["m"] == {"AFIB": None} and rows[2]["m"] == {"A": None, "B": 1.0} and rows[3]["m"] is None


def test_catalog_names_are_unique(spark):
    df = spark.createDataFrame([("f", "ratio", "sqrt(RR)", 3, 0.1), ("f", "ratio", "RR", None, 0.2)], "name string, approach string, equation string, complexity int, score double")
    names = candidates.FormulaCatalog.from_df(df, standards=False).names
    assert len(names) == len(set(names)) == 2 and names[0] == "f"


def test_inventory(spark, tmp_path):
    for name in ("a/R1.hea", "a/r1.dat", "a/R2.hea", "b/R2.dat", "b/R3.hea", "b/R3.MAT", ".git/R4.hea", ".git/R4.dat", "RECORDS", "sub/exams.csv"):
        path = tmp_path / "db" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    files = records.list_files(spark, str(tmp_path / "db"))
    assert sorted(r["stem"] for r in records.records(files).collect()) == ["R1", "R3"]
    assert {r["ext"]: r["n"] for r in records.extension_counts(files).collect()}[".hea"] == 3
    assert records.metadata_file(files).first()["path"].endswith("exams.csv")
    assert records.detect_format(records.extension_counts(files), "db").first()[0] == "wfdb"


def test_late_records_and_all_batches_are_kept(spark, tmp_path):
    """Old files after new ones and a key that comes again; every batch has its row of metrics."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    for i, year in enumerate([2020, 2019, 2010, 2021, 2020]):
        spark.createDataFrame([(i % 4, f"{year}-01-01")], "ecg_id bigint, day string").coalesce(1).write.parquet(f"{src}/{i}")
    rows = ingest.read_stream(spark, f"{src}/*", "ecg_id bigint, day string", files_per_batch=1)
    ingest.ingest_stream(rows, f"{out}/good", f"{out}/ckpt", keys=["ecg_id"], metrics=f"{out}/metrics").awaitTermination()
    good = spark.read.parquet(f"{out}/good")
    assert sorted(r["ecg_id"] for r in good.collect()) == [0, 1, 2, 3] and good.filter("day = '2010-01-01'").count() == 1
    assert spark.read.parquet(f"{out}/metrics").agg(F.sum("seen")).first()[0] == 4


def test_stream_restart_leaves_no_duplicates(spark, tmp_path):
    src, out = str(tmp_path / "src"), tmp_path / "out"
    ids = spark.range(60).selectExpr("id AS ecg_id", "id % 4 AS n_beats")
    ids.filter("ecg_id < 40").repartition(4).write.parquet(src)
    reason = F.when(F.col("n_beats") == 0, "Too few R-peaks")

    def run():
        rows = ingest.dedup_stream(ingest.read_stream(spark, src, "ecg_id bigint, n_beats bigint", files_per_batch=2))
        q = ingest.ingest_stream(rows, str(out / "good"), str(out / "ckpt"), reason=reason, errors=str(out / "bad"))
        q.awaitTermination()
        return q

    first = ingest.progress(run())
    assert sum(p["seen"] for p in first) == 40 and sum(p["failed"] for p in first) == 10
    ids.filter("ecg_id >= 30").repartition(3).write.mode("append").parquet(src)  # ten ids arrive again
    run()
    run()
    good, bad = spark.read.parquet(str(out / "good")), spark.read.parquet(str(out / "bad"))
    assert good.count() == good.select("ecg_id").distinct().count() == 45 and bad.count() == 15


def test_stored_reference_wins(ecg):
    out = manuscript.prepare(ecg.withColumn("qtc_reference_ms", F.when(F.col("dataset") == "ds_a", F.lit(500.0))))
    assert out.filter("dataset = 'ds_a' AND NOT truth").count() == 0
    assert out.filter("dataset <> 'ds_a' AND truth").count() < out.filter("dataset <> 'ds_a'").count()


def test_contract(spark):
    import __spark_entry__ as entry
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 200
    assert entry.entry(spark).count() == 5


def test_manuscript_tables_share_one_copy(ecg):
    from isoqt.plans.lifecycle import manuscript_tables
    out = manuscript_tables(ecg.select("ecg_id", "dataset", "sex", "age", "superclass", "hr_bpm", "rr_s", "qt_ms"))
    assert {k: v.count() for k, v in out.items() if k in ("table2", "table6", "headline")} == {"table2": 5, "table6": 5, "headline": 1}
    weighted = {r["formula"]: r["weighted_r"] for r in out["table2"].collect()}
    assert out["headline"].first()["r_bazett"] == pytest.approx(weighted["bazett"], abs=5e-4)
