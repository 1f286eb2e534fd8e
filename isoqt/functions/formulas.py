"""Heart-rate corrections of the QT interval as Column expressions (JVM only, codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.fixed_values import INVERSE_RR_C, INVERSE_RR_K

FORMULAS = ["inverse_rr", "bazett", "fridericia", "framingham", "hodges"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def above_zero(c: Column | str) -> Column:
    """The value where it is positive, else null: an RR or HR of 0 corrects nothing."""
    return F.when(col(c) > 0, col(c))


def qtc_bazett(qt="qt_ms", rr="rr_s") -> Column:
    return col(qt) / F.sqrt(above_zero(rr))


def qtc_fridericia(qt="qt_ms", rr="rr_s") -> Column:
    return col(qt) / F.cbrt(above_zero(rr))


def qtc_framingham(qt="qt_ms", rr="rr_s") -> Column:
    return col(qt) + F.lit(154.0) * (F.lit(1.0) - above_zero(rr))


def qtc_hodges(qt="qt_ms", hr=None, rr="rr_s") -> Column:
    """With a heart rate when one is given, else from 60/RR."""
    rate = above_zero(hr) if hr is not None else F.lit(60.0) / above_zero(rr)
    return col(qt) + F.lit(1.75) * (rate - F.lit(60.0))


def qtc_inverse_rr(qt="qt_ms", rr="rr_s", k: float = INVERSE_RR_K, c: float | None = None,
                   preset: str = "c158") -> Column:
    """QT + k/RR + c; ``preset`` names one of the two published constants c."""
    constant = INVERSE_RR_C[preset] if c is None else float(c)
    return col(qt) + F.lit(float(k)) / above_zero(rr) + F.lit(constant)


def qtc_inverse_rr_hr(qt="qt_ms", hr="hr_bpm", k: float = INVERSE_RR_K, c: float | None = None,
                      preset: str = "c158") -> Column:
    return qtc_inverse_rr(qt, F.lit(60.0) / above_zero(hr), k, c, preset)


def formula(name: str, preset: str = "c158", hr: str | None = "hr_bpm") -> Column:
    """The named correction over the standard columns."""
    return {
        "inverse_rr": lambda: qtc_inverse_rr(preset=preset),
        "bazett": qtc_bazett,
        "fridericia": qtc_fridericia,
        "framingham": qtc_framingham,
        "hodges": lambda: qtc_hodges(hr=hr),
    }[name]()


def all_qtc(df: DataFrame, preset: str = "c158", formulas=FORMULAS,
            hr: str | None = "hr_bpm") -> DataFrame:
    """Add one ``qtc_<formula>`` column per formula in a single projection."""
    return df.withColumns({f"qtc_{f}": formula(f, preset, hr) for f in formulas})


def compare_formulas(df: DataFrame, a: str, b: str, preset: str = "c158") -> DataFrame:
    """Two corrections side by side with their difference."""
    left, right = formula(a, preset), formula(b, preset)
    return df.withColumns({a: left, b: right, "difference": left - right})


def validated(df: DataFrame, mode: str = "flag", qt="qt_ms", rr="rr_s") -> DataFrame:
    """Check QT in 200..600 ms and RR in 0.4..2.0 s: raise on, flag, or drop rows outside."""
    ok = F.coalesce(col(qt).between(200, 600) & col(rr).between(0.4, 2.0), F.lit(False))
    if mode == "flag":
        return df.withColumn("in_range", ok)
    if mode == "drop":
        return df.filter(ok)
    outside = (col(qt) < 200) | (col(qt) > 600) | (col(rr) < 0.4) | (col(rr) > 2.0)
    message = F.lit("QT must be within 200..600 ms and RR within 0.4..2.0 s")
    return df.withColumn(qt, F.when(outside, F.raise_error(message)).otherwise(col(qt)))


def estimate_qt(rr="rr_s") -> Column:
    """QT expected for an RR by inverting Bazett at 410 ms."""
    return F.lit(410.0) * F.sqrt(above_zero(rr))


def improvement(a, b, eps: float = 0.001, unknown: float | None = None) -> Column:
    """a/b, infinite where b is not above ``eps``; ``unknown`` is the result where b is missing, or a is and b is not above ``eps``."""
    missing = F.lit(None if unknown is None else float(unknown)).cast("double")
    return (F.when(col(b) > eps, F.try_divide(col(a), col(b)))
            .when(col(b).isNotNull() & col(a).isNotNull(), F.lit(float("inf"))).otherwise(missing))


def unified_score(abs_r, complexity, maxsize: int = 7) -> Column:
    """|r| plus a complexity penalty; an unknown |r| counts as 1."""
    return F.coalesce(col(abs_r), F.lit(1.0)) + F.lit(0.1) * (col(complexity) / F.lit(float(maxsize)))
