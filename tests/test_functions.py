"""Documented values and null, sex and threshold policies."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from isoqt.functions import classify as cl
from isoqt.functions import clean, codes, equations
from isoqt.functions import formulas as fo


def one(spark, sql, *cols):
    row = spark.sql(sql).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def test_documented_values(spark):
    df = spark.sql("SELECT 380D AS qt_ms, 0.8D AS rr_s, 75D AS hr_bpm")
    row = df.select(fo.qtc_inverse_rr(), fo.qtc_inverse_rr_hr(), fo.qtc_bazett()).first()
    assert row[0] == pytest.approx(378.25) and row[1] == pytest.approx(378.25)
    assert row[2] == pytest.approx(424.85, abs=0.01)
    assert spark.sql("SELECT 400D AS qt_ms, 1D AS rr_s").select(fo.qtc_inverse_rr()).first()[0] == pytest.approx(367.0)
    diff = fo.compare_formulas(df, "inverse_rr", "bazett").first()["difference"]
    assert diff == pytest.approx(-46.6, abs=0.01)


def test_presets_differ_by_constant(spark):
    a, b = spark.sql("SELECT 400D AS qt_ms, 0.9D AS rr_s").select(fo.qtc_inverse_rr(preset="c158"), fo.qtc_inverse_rr(preset="c125")).first()
    assert b - a == pytest.approx(33.0)


@pytest.mark.parametrize("rr", ["0D", "-1D", "CAST(NULL AS DOUBLE)"])
def test_unusable_rr_gives_null(spark, rr):
    row = fo.all_qtc(spark.sql(f"SELECT 400D AS qt_ms, {rr} AS rr_s"), hr=None).first()
    assert all(row[f"qtc_{f}"] is None for f in fo.FORMULAS)


def test_validated_modes(spark):
    df = spark.sql("SELECT * FROM VALUES (400D, 1D), (100D, 1D), (400D, 3D), (NULL, 1D) t(qt_ms, rr_s)")
    assert [r["in_range"] for r in fo.validated(df).collect()] == [True, False, False, False]
    assert fo.validated(df, "drop").count() == 1
    with pytest.raises(PySparkException):
        fo.validated(df, "raise").collect()


@pytest.mark.parametrize("qtc,sex,want", [(420, 0, "normal"), (465, 1, "borderline"), (450, 0, "borderline"), (470, 1, "prolonged"), (500, 0, "high_risk")])
def test_classify4(spark, qtc, sex, want):
    assert one(spark, f"SELECT {qtc}D AS q, {sex} AS sex", cl.classify4("q")) == want


@pytest.mark.parametrize("qtc,sex,want", [("450D", "0", "normal"), ("450.1D", "0", "borderline"), ("470.1D", "0", "prolonged"), ("480D", "1", "borderline"),
                                          ("460D", "NULL", "borderline"), ("CAST(NULL AS DOUBLE)", "0", "invalid")])
def test_classify3(spark, qtc, sex, want):
    assert one(spark, f"SELECT {qtc} AS q, INT({sex}) AS sex", cl.classify3("q")) == want


def test_threshold_is_strict_or_inclusive(spark):
    sql = "SELECT 450D AS q, 0 AS sex"
    assert one(spark, sql, cl.prolonged("q")) is False
    assert one(spark, sql, cl.prolonged("q", inclusive=True)) is True


@pytest.mark.parametrize("kw,want", [({}, True), ({"unknown": 455.0}, False), ({"unknown": None, "on_null": None}, None), ({"unknown": None}, False)])
def test_unknown_sex_policies(spark, kw, want):
    assert one(spark, "SELECT 452D AS q, INT(NULL) AS sex", cl.prolonged("q", **kw)) is want


@pytest.mark.parametrize("on_null,want", [("RED", "RED"), ("GREEN", "GREEN"), (None, None)])
def test_triage_null_policies(spark, on_null, want):
    assert one(spark, "SELECT BOOLEAN(NULL) AS b, BOOLEAN(NULL) AS k", cl.triage("b", "k", on_null)) == want


def test_nan_becomes_null(spark):
    sql = "SELECT double('NaN') AS a, double('Infinity') AS b, double('-Infinity') AS c, 1D AS d"
    assert one(spark, sql, *[clean.finite(c) for c in "abcd"]) == (None, None, None, 1.0)


def test_hr_100_is_normal_only_in_manuscript(spark):
    from isoqt.fixed_values import HR_BINS
    assert one(spark, "SELECT 100D AS hr_bpm", cl.bucketize("hr_bpm", HR_BINS), cl.manuscript_hr_zone()) == ("Tachycardia", "Normal")


def test_elapsed_days_floor(spark):
    sql = "SELECT timestamp'2020-01-02 01:00:00' AS a, timestamp'2020-01-01 23:00:00' AS b"
    assert one(spark, sql, codes.elapsed_days("a", "b"), codes.elapsed_days("b", "a")) == (0, -1)


def test_improvement_infinite(spark):
    assert math.isinf(one(spark, "SELECT 0.5D AS a, 0D AS b", fo.improvement("a", "b")))


def test_sinus_tachycardia_differs_by_source(spark):
    assert one(spark, "SELECT 1", codes.superclass_of_snomed(F.array(F.lit("427084000")))) == "ARR"
    assert one(spark, "SELECT 1", codes.superclass_of_code(F.lit("Sinus tachycardia"))) == "NORM"


def test_longest_phrase_wins(spark):
    assert one(spark, "SELECT 1", codes.superclass_of_code(F.lit("Sinus rhythm with PVCs"))) == "ARR"
    assert one(spark, "SELECT 1", codes.superclass_of_code(F.lit("prolonged qt"))) == "STTC"  # inside a known phrase


@pytest.mark.parametrize("text,want", [("['I472', 'E119']", True), ("['E119', 'I461']", True), ("['E119', 'XI46']", False), ("[]", False), (None, False), ('["I469"]', True)])
def test_code_prefix(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(codes.has_code_prefix("t", ["I472", "I46"])).first()[0] is want


@pytest.mark.parametrize("text,want", [("Prolonged QT interval", True), ("LQTS2 suspected", True), ("qt ok", False), ("code I45.81 found", True), ("long story", False)])
def test_has_diagnosis(spark, text, want):
    df = spark.createDataFrame([(text, None)], "report string, labels string")
    assert df.select(codes.has_diagnosis(df)).first()[0] is want
    assert df.select(codes.has_diagnosis(df, anchors=None)).first()[0] is want


@pytest.mark.parametrize("equation,approach,want", [
    ("(125.0 / RR_interval_sec) - 158.0", "additive", 400 + 125 / 0.8 - 158), ("inv(sqrt(RR_interval_sec))", "factor", 400 / math.sqrt(0.8)),
    ("square(sqrt(RR) + 1) ^ 2", "direct", ((math.sqrt(0.8) + 1) ** 2) ** 2), ("inv(square(cbrt(RR + 1)))", "additive", 400 + 1 / (1.8 ** (2 / 3))), ("-RR^2", "direct", -0.64)])
def test_equations(spark, equation, approach, want):
    df = spark.sql("SELECT 400D AS qt_ms, 0.8D AS rr_s, 75D AS hr_bpm")
    assert df.select(equations.formula_column(equation, approach)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("equation", ["__import__('os')", "RR.real", "foo(RR)", "RR +", "RR; RR", "'a'", "lambda: 1", "sqrt(RR, 2)"])
def test_unknown_words_are_refused(equation):
    assert equations.equation_column(equation) is None


def test_probe_rejects_infinite(spark):
    assert equations.usable_formulas(spark, [("inv(RR - 1)", "direct"), ("RR", "direct"), ("log(RR - 2)", "direct"), ("bad(", "direct")]) == [False, True, False, False]


def test_default_sex_only_for_listed(spark):
    df = spark.sql("SELECT * FROM VALUES ('Georgia', 50D, INT(NULL)), ('other', 50D, NULL), ('Georgia', NULL, NULL), ('Georgia', 50D, 1) t(dataset, age, sex)")
    assert [r["sex"] for r in clean.default_sex(df).collect()] == [0, None, None, 1]


def test_headers(spark):
    from isoqt.sources.records import has_coded_headers, parse_headers
    df = spark.createDataFrame([("a", "x 1\n#Age: 63\n#Sex: Female\n#Dx: 426783006,abc 164889003"), ("b", "y\n# age 7\n#sex: m")], "path string, header string")
    a, b = parse_headers(df).orderBy("path").collect()
    assert (a["age"], a["sex"], a["codes"]) == (63.0, 1, ["426783006", "164889003"])
    assert (b["age"], b["sex"], b["codes"]) == (7.0, 0, [])
    assert has_coded_headers(df).first()[0] is True
    assert has_coded_headers(df.filter("path = 'b'")).first()[0] is False
