"""Sex codes, thresholds, QTc classes and triage as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoqt.fixed_values import (CONFIDENCE_WEIGHTS, POPULATION_LIMITS, THRESHOLD_FEMALE,
                                THRESHOLD_MALE)
from isoqt.functions.formulas import col


# ---- sex ----------------------------------------------------------------------------------
# Codes accepted per variant (fixed values). Numbers 0/1 are accepted by every variant.
SEX_CODES = {
    "names": (["M", "male", "Male"], ["F", "female", "Female"]),
    "labels": (["0", "0.0", "male", "Male", "MALE", "m", "M"],
               ["1", "1.0", "female", "Female", "FEMALE", "f", "F"]),
    "words": (["m", "male", "0", "0.0"], ["f", "female", "1", "1.0"]),
    "strict": (["M", "m", "Male", "male", "MALE", "0"],
               ["F", "f", "Female", "female", "FEMALE", "1"]),
}


def normalize_sex(sex="sex", variant: str = "labels", numeric: bool = False) -> Column:
    """'M', 'F' or unknown. Numeric columns hold 0 for male and 1 for female.

    Variants differ in the text codes they accept ('names' knows no digits, 'words' trims and
    ignores case) and in what unknown is: null for 'strict', the word 'unknown' otherwise.
    """
    male, female = SEX_CODES[variant]
    value = col(sex)
    if numeric:
        is_male, is_female = value == 0, value == 1
    else:
        text = F.lower(F.trim(value.cast("string"))) if variant == "words" else value.cast("string")
        is_male, is_female = text.isin(male), text.isin(female)
    out = F.when(is_male, "M").when(is_female, "F")
    return out if variant == "strict" else out.otherwise("unknown")


def qtc_threshold(sex="sex", unknown: float | None = THRESHOLD_MALE) -> Column:
    """450 for male (0), 460 for female (1), ``unknown`` (450, 455 or null) otherwise."""
    value = col(sex)
    return (F.when(value == 0, F.lit(THRESHOLD_MALE))
            .when(value == 1, F.lit(THRESHOLD_FEMALE))
            .otherwise(F.lit(unknown).cast("double")))


# ---- buckets ------------------------------------------------------------------------------
def bucketize(c, bins) -> Column:
    """Left-closed buckets; null outside the edges. ``bins`` is (edges, labels)."""
    edges, labels = bins
    value = col(c)
    out = F.when(value < edges[0], F.lit(None))
    for high, label in zip(edges[1:], labels):
        out = out.when(value < high, F.lit(label))
    return out


def bucket_order(c, bins) -> Column:
    """Position of a bucket label, for ordered reports."""
    return F.array_position(F.array(*[F.lit(x) for x in bins[1]]), col(c)).cast("int")


def categorize(c, ranges: dict, default: str = "unknown") -> Column:
    """First range [low, high) holding the value, else ``default``."""
    value = col(c)
    whens = [((value >= lo) & (value < hi), name) for name, (lo, hi) in ranges.items()]
    out = F.when(*whens[0])
    for cond, name in whens[1:]:
        out = out.when(cond, name)
    return out.otherwise(default)


def manuscript_hr_zone(hr="hr_bpm") -> Column:
    """<60, 60..100 and >100: here 100 bpm is normal."""
    return (F.when(col(hr) < 60, "Bradycardia").when(col(hr) <= 100, "Normal")
            .when(col(hr) > 100, "Tachycardia"))


def manuscript_age_group(age="age") -> Column:
    """The group labelled '>65' starts at 65."""
    return (F.when(col(age) < 40, "<40").when(col(age) < 65, "40-65").when(col(age) >= 65, ">65"))


# ---- classes ------------------------------------------------------------------------------
def classify4(qtc, sex="sex") -> Column:
    """normal / borderline / prolonged / high_risk; everyone not male uses 460."""
    q, limit = col(qtc), F.when(col(sex) == 0, F.lit(THRESHOLD_MALE)).otherwise(F.lit(THRESHOLD_FEMALE))
    return (F.when(q < limit, "normal").when(q < 470, "borderline").when(q < 500, "prolonged")
            .when(q >= 500, "high_risk"))


def classify3(qtc, sex="sex") -> Column:
    """normal (<=450/460), borderline (<=470/480), prolonged; a missing QTc is invalid."""
    q = col(qtc)
    female = F.coalesce(col(sex) == 1, F.lit(False))
    return (F.when(q.isNull(), "invalid")
            .when(q <= F.when(female, 460.0).otherwise(450.0), "normal")
            .when(q <= F.when(female, 480.0).otherwise(470.0), "borderline")
            .otherwise("prolonged"))


def classify_margin(qtc, sex="sex", margin: float = 10.0) -> Column:
    """prolonged above the threshold, borderline within ``margin`` below it; null if unknown."""
    q, limit = col(qtc), qtc_threshold(sex, unknown=None)
    return (F.when(q.isNull() | col(sex).isNull(), F.lit(None))
            .when(q > limit, "prolonged").when(q > limit - margin, "borderline")
            .otherwise("normal"))


def prolonged(qtc, sex="sex", unknown: float | None = THRESHOLD_MALE, inclusive: bool = False,
              on_null: bool | None = False) -> Column:
    """QTc above (or at, if ``inclusive``) the sex threshold.

    ``unknown`` is the threshold without a sex (None gives a null result) and ``on_null`` the
    result where QTc or the threshold is missing.
    """
    q, limit = col(qtc), qtc_threshold(sex, unknown)
    flag = q >= limit if inclusive else q > limit
    return flag if on_null is None else F.coalesce(flag, F.lit(on_null))


def prolonged_at(qtc, limit: float = 450.0) -> Column:
    """Inclusive comparison with one fixed limit."""
    return col(qtc) >= F.lit(float(limit))


def triage(base, confirm, on_null: str | None = None) -> Column:
    """GREEN if the base formula is normal, YELLOW if only it is prolonged, RED if both are.

    ``on_null`` is the level of rows with a missing prediction; with None they stay null.
    """
    b, k = col(base), col(confirm)
    out = F.when(~b, "GREEN").when(b & ~k, "YELLOW").when(b & k, "RED")
    if on_null is None:
        return F.when(b.isNotNull() & k.isNotNull(), out)
    return F.coalesce(out, F.lit(on_null))


def concordance(base, new) -> Column:
    """Agreement of two predictions; 'unknown' where one is missing."""
    b, n = col(base), col(new)
    return (F.when(~n & ~b, "concordant_normal").when(n & b, "concordant_prolonged")
            .when(n & ~b, "new_only_prolonged").when(~n & b, "reclassified_normal")
            .otherwise("unknown"))


# ---- confidence ---------------------------------------------------------------------------
def confidence(base="qtc_bazett", new="qtc_inverse_rr", hr="hr_bpm", threshold="threshold",
               weights=CONFIDENCE_WEIGHTS, limits=POPULATION_LIMITS) -> Column:
    """100 minus penalties for extreme rates, disagreeing formulas and closeness to threshold."""
    h, lo, hi = col(hr), limits["extreme_brady_max_hr"], limits["extreme_tachy_min_hr"]
    gap, near = F.abs(col(base) - col(new)), F.abs(col(new) - col(threshold))
    w = weights
    penalties = [
        F.when((h < lo) | (h > hi), w["hr_extreme_penalty"])
         .when(((h >= lo) & (h < 55)) | ((h > 110) & (h <= hi)), w["hr_borderline_penalty"]),
        F.when(gap > 40, w["disagree_high_penalty"]).when(gap > 20, w["disagree_low_penalty"]),
        F.when(near < 10, w["near_threshold_high_penalty"])
         .when(near < 20, w["near_threshold_low_penalty"]),
    ]
    total = reduce(lambda a, b: a + b, [p.otherwise(0) for p in penalties])
    return F.greatest(F.lit(0.0), F.lit(100.0) - total)


def triage4(base, new, score="confidence", high_cutoff: float = 70) -> Column:
    """GREEN, GREEN-WATCH (negative but unsure), YELLOW (discordant), otherwise RED."""
    b, n = F.coalesce(col(base), F.lit(False)), F.coalesce(col(new), F.lit(False))
    return (F.when(~b & ~n & (col(score) >= high_cutoff), "GREEN")
            .when(~b & ~n, "GREEN-WATCH").when(b & ~n, "YELLOW").otherwise("RED"))


def qtc_hybrid(base="qtc_bazett", new="qtc_inverse_rr", hr="hr_bpm", limits=POPULATION_LIMITS) -> Column:
    """The base formula at extreme rates, the new one elsewhere."""
    extreme = (col(hr) < limits["extreme_brady_max_hr"]) | (col(hr) > limits["extreme_tachy_min_hr"])
    return F.when(extreme, col(base)).otherwise(col(new))
