"""Diagnosis code, report text and outcome expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.fixed_values import (DIAGNOSIS_COLUMNS, LONG_QT_ANCHORS, LONG_QT_PATTERNS, REPORT_KEYWORDS, SCP_SUPERCLASS,
                                SNOMED_SUPERCLASS, SUPERCLASSES, SUPERCLASS_PRIORITY, TEXT_SUPERCLASS)
from isoqt.functions.formulas import col


def code_map(text) -> Column:
    """A dict literal such as {'SR': 100.0, "Bachmann's": None} as map<string,double>; bad text gives null.

    Both quote styles are read as they stand; None and nan are null values.
    """
    plain = F.regexp_replace(col(text), r"(:\s*)(?:None|nan)(?=\s*[,}])", "$1null")
    return F.from_json(plain, "map<string,double>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def active_codes(text) -> Column:
    """Codes whose likelihood is above zero."""
    return F.map_keys(F.map_filter(code_map(text), lambda _, v: v > 0))


def has_code_prefix(text, prefixes) -> Column:
    """True if any code of a list literal starts with one of the prefixes.

    The prefixes are looked up right after an opening quote, so the list is not parsed.
    """
    pattern = r"""(?:^\s*\[|,)\s*['"](?:""" + "|".join(prefixes) + ")"
    return F.coalesce(col(text).rlike(pattern), F.lit(False))


def icd_normalized(code) -> Column:
    return F.upper(F.replace(col(code), F.lit("."), F.lit("")))


def icd_in(code, codes) -> Column:
    """Exact membership after dropping dots and upper-casing."""
    return F.coalesce(icd_normalized(code).isin(sorted({c.replace(".", "").upper() for c in codes})),
                      F.lit(False))


def icd_contains(text, parts) -> Column:
    """True if any part occurs anywhere in the text."""
    hits = [F.contains(col(text), F.lit(p)) for p in parts]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def elapsed_days(later, earlier) -> Column:
    """Whole days elapsed, floored (not calendar days)."""
    gap = col(later) - col(earlier)
    days = F.extract(F.lit("DAY"), gap)  # cut towards zero
    return (days - F.when(gap < days * F.expr("INTERVAL '1' DAY"), 1).otherwise(0)).cast("bigint")


def died_within(dod, at, days: int) -> Column:
    """Death 0..``days`` whole days after the recording; unknown dates count as no."""
    return F.coalesce(elapsed_days(dod, at).between(0, days), F.lit(False))


def has_diagnosis(df: DataFrame, patterns=LONG_QT_PATTERNS, cols=DIAGNOSIS_COLUMNS, anchors=LONG_QT_ANCHORS) -> Column:
    """True if any pattern matches any of the text columns present, ignoring case.

    Every match of the default patterns holds one of the anchors, so the regex only runs on texts
    with an anchor; pass ``anchors=None`` with patterns of your own.
    """
    regex = "|".join(f"(?:{p})" for p in patterns)

    def hit(c):
        text = F.lower(F.col(c))
        if not anchors:
            return F.coalesce(text.rlike(regex), F.lit(False))
        anchored = reduce(lambda a, b: a | b, [F.contains(text, F.lit(a)) for a in anchors])
        return F.when(anchored, text.rlike(regex)).otherwise(False)

    hits = [hit(c) for c in cols if c in df.columns]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def superclass_of_report(cols) -> Column:
    """First keyword found in the joined, lower-cased report lines decides."""
    text = F.lower(F.concat_ws(" ", *[col(c) for c in cols]))
    first, *rest = REPORT_KEYWORDS
    out = F.when(F.contains(text, F.lit(first[0])), first[1])
    for keyword, superclass in rest:
        out = out.when(F.contains(text, F.lit(keyword)), superclass)
    return out


def report_codes(cols, n: int | None = None) -> Column:
    """The non-blank ones among the present report lines; ``n`` keeps only the first lines where a caller asks for it."""
    present = F.array_compact(F.array(*[col(c) for c in cols]))
    return F.filter(F.transform(present if n is None else F.slice(present, 1, n), lambda x: F.trim(x)), lambda x: x != "")


def exam_superclass(af="AF", avb="1dAVb", rbbb="RBBB", lbbb="LBBB", sb="SB", st="ST",
                    normal="normal_ecg") -> Column:
    """Superclass of an exam row with boolean findings."""
    def yes(c):
        return F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False))
    return (F.when(yes(af), "ARR").when(yes(avb) | yes(rbbb) | yes(lbbb), "CD")
            .when(yes(sb) | yes(st), "ARR").when(yes(normal), "NORM").otherwise("OTHER"))


def exam_sex(is_male="is_male") -> Column:
    return F.when(F.coalesce(F.col(is_male).cast("boolean"), F.lit(False)), 0).otherwise(1)


def one_hot(df: DataFrame, c: str = "superclass", classes=SUPERCLASSES) -> DataFrame:
    """One 0/1 ``label_<class>`` column per superclass."""
    return df.withColumns({f"label_{k}": F.coalesce((F.col(c) == k).cast("int"), F.lit(0))
                           for k in classes})


def priority(superclass) -> Column:
    out = F.lit(0)
    for name, rank in SUPERCLASS_PRIORITY.items():
        out = F.when(col(superclass) == name, rank).otherwise(out)
    return out


# ---- code tables as expressions -----------------------------------------------------------
def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def superclass_of_phrase(code) -> Column:
    """Superclass of a free-text code: the longest known phrase inside it, else the first
    known phrase that contains it. Ties between phrases of one length keep table order."""
    text = F.lower(F.trim(col(code)))
    inside = [F.when(F.contains(text, F.lit(p)), TEXT_SUPERCLASS[p]) for p in sorted(TEXT_SUPERCLASS, key=len, reverse=True)]
    around = [F.when(F.contains(F.lit(p), text), superclass) for p, superclass in TEXT_SUPERCLASS.items()]
    return F.coalesce(*inside, *around)


def superclass_of_code(code) -> Column:
    """Dictionary lookup of an SCP code, else its meaning as a phrase."""
    known = F.try_element_at(literal_map(SCP_SUPERCLASS.items()), col(code))
    return F.coalesce(known, superclass_of_phrase(code))


def superclass_of_codes(codes) -> Column:
    """Superclass of highest priority among the codes of a record (null if none is known)."""
    found = F.array_compact(F.transform(codes, superclass_of_code))
    ranked = F.transform(found, lambda s: F.struct(priority(s).alias("p"), s.alias("s")))
    return F.array_max(ranked)["s"]


def superclass_of_snomed(codes) -> Column:
    """Superclass of highest priority among SNOMED codes."""
    table = literal_map([(c, s) for c, (s, _) in SNOMED_SUPERCLASS.items()])
    found = F.array_compact(F.transform(codes, lambda c: F.try_element_at(table, c)))
    ranked = F.transform(found, lambda s: F.struct(priority(s).alias("p"), s.alias("s")))
    return F.array_max(ranked)["s"]


def snomed_descriptions(codes) -> Column:
    """Descriptions of the known SNOMED codes."""
    table = literal_map([(c, d) for c, (_, d) in SNOMED_SUPERCLASS.items()])
    return F.array_compact(F.transform(codes, lambda c: F.try_element_at(table, c)))


# ---- heart-rate variability ---------------------------------------------------------------
def hrv(rr) -> Column:
    """Struct of mean, population std, std of 60000/RR and RMSSD of an RR array (ms)."""
    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def std(a):
        centre = mean(a)
        return F.sqrt(mean(F.transform(a, lambda x: (x - centre) * (x - centre))))

    a = F.transform(col(rr), lambda x: x.cast("double"))
    n = F.size(a)
    positive = F.forall(a, lambda x: x > 0)
    steps = F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(1))), F.slice(a, 1, F.greatest(n - 1, F.lit(1))),
                       lambda x, y: (x - y) * (x - y))
    return F.struct(
        F.when(n > 1, mean(a)).alias("rr_mean_ms"),
        F.when(n > 1, std(a)).alias("rr_std_ms"),
        F.when((n > 1) & positive,
               std(F.transform(a, lambda x: F.lit(60000.0) / F.when(x > 0, x)))).alias("heart_rate_std"),
        F.when(n > 2, F.sqrt(mean(steps))).alias("rmssd"),
    )
