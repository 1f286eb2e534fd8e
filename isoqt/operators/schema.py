"""Column standardisation, derivation, filters, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoqt.fixed_values import (ALIASES_CASE_INSENSITIVE, ALIASES_COPY, ALIASES_FIRST_MATCH, FEATURE_SETS,
                                PREPARED_COLUMNS)
from isoqt.functions.classify import bucketize, prolonged, qtc_threshold, triage
from isoqt.functions.formulas import above_zero, all_qtc
from isoqt.operators.quantiles import percentiles
from isoqt.operators.reference import attach
from isoqt.fixed_values import HR_ZONES


# ---- names --------------------------------------------------------------------------------
def standardize(df: DataFrame, mode: str = "first_match", aliases: dict | None = None) -> DataFrame:
    """Bring alias column names to the standard ones.

    'first_match' renames the first alias present; 'ci_rename' renames every alias, ignoring
    case; 'copy' adds the standard name next to the original if it is absent.
    """
    if mode == "first_match":
        table = aliases or ALIASES_FIRST_MATCH
        found = {names[0]: std for std, all_names in table.items()
                 if (names := [n for n in all_names if n in df.columns])}
        return df.withColumnsRenamed({a: s for a, s in found.items() if a != s})
    if mode == "ci_rename":
        table = aliases or ALIASES_CASE_INSENSITIVE
        renames = {c: std for c in df.columns for std, names in table.items() if c.lower() in names}
        return df.withColumnsRenamed({a: s for a, s in renames.items() if a != s})
    table = aliases or ALIASES_COPY
    added = {}
    for std, names in table.items():
        present = [n for n in names if n in df.columns]
        if std not in df.columns and present:
            added[std] = F.col(present[0])
    return df.withColumns(added) if added else df


def fill_rate_columns(df: DataFrame) -> DataFrame:
    """Derive the missing ones of rr_s, rr_ms and hr_bpm from those present."""
    have = set(df.columns)
    if "rr_s" not in have and "rr_ms" in have:
        df, have = df.withColumn("rr_s", F.col("rr_ms") / 1000.0), have | {"rr_s"}
    if "hr_bpm" not in have and "rr_s" in have:
        df, have = df.withColumn("hr_bpm", F.lit(60.0) / above_zero("rr_s")), have | {"hr_bpm"}
    if "rr_s" not in have and "hr_bpm" in have:
        df, have = df.withColumn("rr_s", F.lit(60.0) / above_zero("hr_bpm")), have | {"rr_s"}
    if "rr_ms" not in have and "rr_s" in have:
        df = df.withColumn("rr_ms", F.col("rr_s") * 1000.0)
    return df


def fix_rr_unit(df: DataFrame, by=("dataset",), rr: str = "rr_s", limit: float = 10.0) -> DataFrame:
    """Groups whose median RR exceeds ``limit`` hold milliseconds: divide them by 1000."""
    medians = percentiles(df, {"__median": (rr, 0.5)}, by)
    joined = attach(df, medians, by)
    return joined.withColumn(rr, F.when(F.col("__median") > limit, F.col(rr) / 1000.0)
                             .otherwise(F.col(rr))).drop("__median")


def project_existing(df: DataFrame, cols=PREPARED_COLUMNS, prefix: str = "label_") -> DataFrame:
    """The wanted columns that exist plus every ``label_*`` column."""
    keep = [c for c in cols if c in df.columns] + [c for c in df.columns if c.startswith(prefix)]
    return df.select(*keep)


def drop_incomplete(df: DataFrame, essential=("qt_ms", "rr_s", "hr_bpm", "qtc_reference_ms")) -> DataFrame:
    return df.dropna(subset=[c for c in essential if c in df.columns])


# ---- filters ------------------------------------------------------------------------------
def quality_stages(df: DataFrame) -> list[tuple[str, Column]]:
    """The stages of the quality filter, in order; the last two only where the column exists."""
    stages = [
        ("qt_valid", F.col("qt_ms").isNotNull()),
        ("qt_range", F.col("qt_ms").between(200, 600)),
        ("rr_range", F.col("rr_ms").between(400, 2000)),
        ("hr_range", F.col("hr_bpm").between(30, 150)),
    ]
    if "signal_quality" in df.columns:
        stages.append(("quality", F.col("signal_quality") >= 0.3))
    if "t_wave_detection_rate" in df.columns:
        stages.append(("t_detection", F.col("t_wave_detection_rate") >= 0.5))
    return stages


def quality_filter(df: DataFrame) -> DataFrame:
    """Rows passing every stage (the predicates reach the scan)."""
    for _, stage in quality_stages(df):
        df = df.filter(stage)
    return df


def quality_funnel(df: DataFrame) -> DataFrame:
    """Rows left after each stage and their share of the first count, in one scan."""
    stages = quality_stages(df)
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("initial")]
    for name, stage in stages:
        passed = passed & stage
        counts.append(F.count_if(passed).alias(name))
    names = ["initial", *[n for n, _ in stages]]
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("stage"), F.col(n).alias("n"))
                     for i, n in enumerate(names)])
    return (df.agg(*counts).select("initial", F.explode(rows).alias("s")).select("initial", "s.*")
            .select("position", "stage", "n",
                    F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("initial")), F.lit(0.0)), 2)
                    .alias("retention_pct")))


def valid_range(df: DataFrame) -> DataFrame:
    """QT 200..600 ms and RR 0.4..2.0 s, bounds included."""
    return df.filter(F.col("qt_ms").between(200, 600) & F.col("rr_s").between(0.4, 2.0))


def norm_subset(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Rows of class NORM: 'exact', ignoring case ('ci'), or 'fallback' to all rows if none is.

    The fallback compares one counted row, not a window over the table.
    """
    if mode == "ci":
        return df.filter(F.upper("superclass") == "NORM")
    if mode == "exact":
        return df.filter(F.col("superclass") == "NORM")
    found = df.agg(F.count_if(F.col("superclass") == "NORM").alias("__norm"))
    joined = attach(df, found, ())
    return joined.filter((F.col("superclass") == "NORM") | (F.col("__norm") == 0)).drop("__norm")


# ---- enrichment ---------------------------------------------------------------------------
def enrich(df: DataFrame, preset: str = "c158", unknown: float | None = 455.0, inclusive: bool = False,
           on_null: bool | None = False, formulas=("inverse_rr", "bazett", "fridericia"),
           triage_null: str | None = "GREEN", zones=HR_ZONES) -> DataFrame:
    """All corrections, threshold, predictions, triage and rate zone in a few projections."""
    out = all_qtc(df, preset, formulas).withColumn("threshold", qtc_threshold("sex", unknown))
    out = out.withColumns({f"pred_{f}": prolonged(f"qtc_{f}", "sex", unknown, inclusive, on_null)
                           for f in formulas})
    return out.withColumns({"triage": triage("pred_bazett", "pred_inverse_rr", triage_null),
                            "hr_zone": bucketize("hr_bpm", zones)})


def center(df: DataFrame, cols, suffix: str = "_residual") -> DataFrame:
    """Value minus its overall mean."""
    means = df.agg(*[F.avg(c).alias(f"__mean_{c}") for c in cols])
    joined = attach(df, means, ())
    return joined.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"__mean_{c}") for c in cols}).drop(
        *[f"__mean_{c}" for c in cols])


def select_features(df: DataFrame, feature_set: str = "standard",
                    required=("qt_ms", "rr_s", "qtc_reference_ms", "hr_bpm")) -> DataFrame:
    """Columns of a feature set that exist, plus the required ones; rows must be complete in the
    features and the reference."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    features = [c for c in FEATURE_SETS[feature_set] if c in df.columns]
    keep = list(dict.fromkeys([*(c for c in ("ecg_id", "dataset") if c in df.columns), *features, *required]))
    return df.select(*keep).dropna(subset=[*features, "qtc_reference_ms"])


# ---- rows ---------------------------------------------------------------------------------
def dedup(df: DataFrame, keys=None, order=None) -> DataFrame:
    """Distinct rows, or one row per key: the first by ``order``.

    The first row is an aggregate (smallest order struct), so copies shrink before the shuffle
    and a hot key never fills one task.
    """
    if keys is None:
        return df.distinct()
    keys = list(keys)
    if order is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, "__first.*").select(*df.columns)


def hash_order(keys, seed: int) -> Column:
    """Seeded position of a key among 2^60: the first 15 hex digits of an md5, which any engine can compute."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sample_n(df: DataFrame, n: int, keys=("ecg_id",), by=(), seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` rows, overall or per group; the same under any partitioning.

    Counts of the leading 16 bits of the hash, at most 65,536 rows a group, tell which bucket holds the n-th row. Rows of the
    buckets before it are taken by a filter. Only rows of that bucket are needed in order, and buckets are ranked apart, so
    no task sorts a group, whether n is small or large. Rows that repeat a key follow each other in any order.
    """
    by = list(by)
    hashed = df.withColumn("__h", hash_order(keys, seed)).withColumn("__b", F.shiftright("__h", 44))
    counts = hashed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bound = (counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter(F.col("__before") < n)
             .groupBy(*by).agg(F.max_by(F.struct(F.col("__b").alias("b"), (n - F.col("__before")).alias("wanted")), "__b").alias("__last")))
    bound = bound.select(*by, F.col("__last.b").alias("__last"), F.col("__last.wanted").alias("__wanted"))
    near = attach(hashed, bound, by).filter(F.col("__b") <= F.col("__last"))
    ranked = Window.partitionBy(*by, "__b").orderBy("__h", *keys)
    kept = near.withColumn("__rn", F.row_number().over(ranked)).filter((F.col("__b") < F.col("__last")) | (F.col("__rn") <= F.col("__wanted")))
    return kept.drop("__h", "__b", "__last", "__wanted", "__rn")


def split(df: DataFrame, test_pct: int = 20, keys=("ecg_id",), seed: int = 42) -> DataFrame:
    """Add is_test: a hash of the key decides, so the split survives any repartitioning."""
    return df.withColumn("is_test", F.pmod(hash_order(keys, seed), F.lit(100)) < test_pct)


def top_n(df: DataFrame, metric: str, n: int | None = None, base: str = "bazett", name: str = "formula",
          ascending: bool = True) -> DataFrame:
    """Sort by a metric, keep the first ``n``, add a 1-based rank and a label against ``base``.

    With ``n`` the rows are cut by a distributed top-n first; without it the table is a report of
    one row per formula.
    """
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    kept = df if n is None else df.orderBy(order, name).limit(n)
    ranked = kept.withColumn("rank", F.row_number().over(Window.orderBy(order, name)).cast("bigint"))
    ref = df.filter(F.col(name) == base).select(F.col(metric).alias("__base"))
    ranked = attach(ranked, ref, ())
    value, ref_value = F.col(metric), F.col("__base")
    label = (F.when(value < ref_value, F.format_string("%.1fx better", F.try_divide(ref_value, value)))
             .when(value > ref_value, F.format_string("%.1fx worse", F.try_divide(value, ref_value)))
             .otherwise("---"))
    return ranked.withColumn("vs_base", label).drop("__base")


# ---- sets ---------------------------------------------------------------------------------
def id_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def id_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def id_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def pool(frames) -> DataFrame:
    """UNION ALL by name; columns missing in a frame become null."""
    first, *rest = list(frames)
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
