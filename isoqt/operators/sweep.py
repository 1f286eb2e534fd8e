"""Parameter sweeps in closed form: one scan, whatever the size of the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoqt.fixed_values import INVERSE_RR_C, INVERSE_RR_K
from isoqt.functions.formulas import above_zero


def _grid(start: float, stop: float, step: float) -> list[float]:
    count = int(round((stop - start) / step))
    return [start + i * step for i in range(count + 1)]


K_GRID, C_GRID = _grid(100, 150, 5), _grid(-180, -130, 5)


def sweep_moments(df: DataFrame, by=("dataset",)) -> DataFrame:
    """Sums of QT, 1/RR and HR per group: r(QT + k/RR + c, HR) follows for any k and c."""
    q, u, h = F.col("qt_ms") - 400.0, F.lit(1.0) / above_zero("rr_s") - 1.2, F.col("hr_bpm") - 75.0
    rows = df.select(*by, q.alias("q"), u.alias("u"), h.alias("h")).dropna(subset=["q", "u", "h"])
    pairs = {"q": ["q"], "u": ["u"], "h": ["h"], "qq": ["q", "q"], "uu": ["u", "u"], "hh": ["h", "h"],
             "qu": ["q", "u"], "qh": ["q", "h"], "uh": ["u", "h"]}
    sums = []
    for name, cols in pairs.items():
        value = F.col(cols[0])
        for c in cols[1:]:
            value = value * F.col(c)
        sums.append(F.sum(value).alias(f"s_{name}"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def sweep_r(k: Column) -> Column:
    """|r| at coefficient k from the sums; adding a constant c never changes it."""
    def cov(a, b):
        name = a + b if f"{a}{b}" in ("qq", "uu", "hh", "qu", "qh", "uh") else b + a
        return F.col("n") * F.col(f"s_{name}") - F.col(f"s_{a}") * F.col(f"s_{b}")
    top = cov("q", "h") + k * cov("u", "h")
    spread = cov("q", "q") + 2 * k * cov("q", "u") + k * k * cov("u", "u")
    return F.when((F.col("n") >= 10) & (spread > 0) & (cov("h", "h") > 0),
                  F.abs(top / F.sqrt(spread) / F.sqrt(cov("h", "h"))))


def sweep_by_group(df: DataFrame, ks=K_GRID, cs=C_GRID, by=("dataset",)) -> DataFrame:
    """|r| per group and grid point."""
    rows = (sweep_moments(df, by).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
            .withColumn("abs_r", sweep_r(F.col("k"))))
    cells = rows.withColumn("c", F.explode(F.array(*[F.lit(float(c)) for c in cs])))
    return cells.select(*by, "n", "k", "c", "abs_r")


def sweep_k(df: DataFrame, ks=K_GRID, cs=C_GRID, by=("dataset",)) -> DataFrame:
    """Size-weighted and worst |r| per grid point."""
    cells = sweep_by_group(df, ks, cs, by)
    return cells.groupBy("k", "c").agg(
        (F.sum(F.col("abs_r") * F.col("n")) / F.sum("n")).alias("weighted_r"),
        F.max("abs_r").alias("worst_r"))


def sweep_fine(df: DataFrame, optimum: DataFrame, reach: float = 15, step: float = 2, by=("dataset",)) -> DataFrame:
    """Second sweep of ``step`` within ``reach`` of a first optimum (a one-row table)."""
    def around(c):
        return F.sequence(F.col(c).cast("int") - int(reach), F.col(c).cast("int") + int(reach), F.lit(int(step)))
    grid = optimum.select(F.lit(1).alias("__one"), around("k_optimal").alias("ks"), around("c_optimal").alias("cs"))
    rows = (sweep_moments(df, by).withColumn("__one", F.lit(1)).join(grid, "__one")
            .withColumn("k", F.explode("ks")).withColumn("k", F.col("k").cast("double"))
            .withColumn("abs_r", sweep_r(F.col("k"))))
    cells = rows.withColumn("c", F.explode("cs")).withColumn("c", F.col("c").cast("double"))
    return cells.groupBy("k", "c").agg(
        (F.sum(F.col("abs_r") * F.col("n")) / F.sum("n")).alias("weighted_r"),
        F.max("abs_r").alias("worst_r"))


def sweep_optimum(grid: DataFrame, by=(), r: str = "weighted_r") -> DataFrame:
    """Smallest |r|; ties (all values of c) go to the smallest k, then the smallest c."""
    best = F.min_by(F.struct("k", "c", r), F.struct(F.round(r, 12), "k", "c")).alias("b")
    return grid.groupBy(*by).agg(best).select(
        *by, F.col("b.k").alias("k_optimal"), F.col("b.c").alias("c_optimal"),
        F.col(f"b.{r}").alias("r_optimal"))


def _nearest(grid: DataFrame, axis: str, wanted: Column) -> Column:
    """Aggregate: r at the grid value nearest to ``wanted`` (the smaller one on a tie)."""
    return F.min_by(F.col("r"), F.struct(F.abs(F.col(axis) - wanted), F.col(axis)))


def sweep_rigidity(grid: DataFrame, k_ref: float = INVERSE_RR_K, c_ref: float = INVERSE_RR_C["c158"],
                   offsets=(5, 10, 15, 20), limit: float = 0.01) -> DataFrame:
    """|r| at the reference and its change at offsets along k and c, with rigidity flags.

    Rigid means the change exceeds ``limit`` at +-10 in k (at +-20 in c).
    """
    k, c = F.lit(float(k_ref)), F.lit(float(c_ref))
    deltas = {}
    for d in offsets:
        for sign, word in ((1, "plus"), (-1, "minus")):
            deltas[f"k_{word}_{d}"] = (F.col("k"), k + sign * d, F.col("c"), c)
            deltas[f"c_{word}_{d}"] = (F.col("c"), c + sign * d, F.col("k"), k)
    values = [F.min_by("weighted_r", F.struct(F.abs(moved - to) + F.abs(kept - at), "k", "c")).alias(name)
              for name, (moved, to, kept, at) in deltas.items()]
    ref = F.min_by("weighted_r", F.struct(F.abs(F.col("k") - k) + F.abs(F.col("c") - c), "k", "c"))
    wide = grid.agg(ref.alias("r_at_reference"), *values)
    moved = wide.select("r_at_reference", *[(F.col(n) - F.col("r_at_reference")).alias(n) for n in deltas])
    k_rigid = (F.col("k_plus_10") > limit) | (F.col("k_minus_10") > limit)
    c_rigid = (F.col("c_plus_20") > limit) | (F.col("c_minus_20") > limit)
    return moved.withColumns({"k_is_rigid": k_rigid, "c_is_rigid": c_rigid, "overall_rigid": k_rigid & c_rigid})


def sweep_by_dataset(cells: DataFrame, by=("dataset",), k_ref: float = INVERSE_RR_K,
                     c_ref: float = INVERSE_RR_C["c158"]) -> DataFrame:
    """Optimum of each group, |r| at the reference and the distance between both."""
    best = sweep_optimum(cells, by, "abs_r")
    ref = F.min_by("abs_r", F.struct(F.abs(F.col("k") - k_ref) + F.abs(F.col("c") - c_ref), "k", "c"))
    at = cells.groupBy(*by).agg(ref.alias("r_at_reference"))
    return best.join(at, list(by)).withColumns({
        "delta_k": F.col("k_optimal") - k_ref, "delta_c": F.col("c_optimal") - c_ref})


def sweep_verdict(optimum: DataFrame, rigidity: DataFrame, near: float = 10.0, k_ref: float = INVERSE_RR_K,
                  c_ref: float = INVERSE_RR_C["c158"]) -> DataFrame:
    """Rigid and with the optimum near the reference on both axes (two one-row tables)."""
    both = optimum.withColumn("__one", F.lit(1)).join(
        rigidity.select("overall_rigid", F.lit(1).alias("__one")), "__one").drop("__one")
    k_close = F.abs(F.col("k_optimal") - k_ref) <= near
    c_close = F.abs(F.col("c_optimal") - c_ref) <= near
    return both.withColumns({"k_close": k_close, "c_close": c_close,
                             "confirmed": F.col("overall_rigid") & k_close & c_close})


# ---- thresholds ---------------------------------------------------------------------------
def roc(df: DataFrame, truth: str, formulas, start: int = 350, stop: int = 550, step: int = 5) -> DataFrame:
    """Confusion counts and Youden's J per formula and threshold (prediction: QTc above it).

    Each value falls into the first threshold it does not exceed; a histogram by that step and
    the truth, summed from the top, gives all thresholds in one pass.
    """
    slots = (stop - start) // step + 1
    values = F.array(*[F.struct(F.lit(f).alias("formula"), F.col(f"qtc_{f}").alias("q")) for f in formulas])
    rows = df.select(F.coalesce(F.col(truth), F.lit(False)).alias("t"), F.explode(values).alias("m")).select("t", "m.*")
    # slot = number of thresholds strictly below the value (a missing value exceeds none)
    steps = F.greatest(F.lit(0), F.least(F.lit(slots), F.ceil((F.col("q") - start) / step)))
    slot = F.when(F.col("q").isNotNull(), steps).otherwise(0)
    hist = rows.groupBy("formula", slot.cast("int").alias("slot")).agg(
        F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("m"))
    # one row per formula holding its (at most slots + 1) histogram bars
    bars = hist.groupBy("formula").agg(F.collect_list(F.struct("slot", "p", "m")).alias("bars"),
                                       F.sum("p").alias("n_positive"), F.sum("m").alias("n_negative"))
    points = bars.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def above(field):
        return F.aggregate("bars", F.lit(0).cast("bigint"),
                           lambda s, b: s + F.when(b["slot"] > F.col("i"), b[field]).otherwise(0))

    out = points.withColumns({"tp": above("p"), "fp": above("m")}).withColumns({
        "threshold": (F.col("i") * step + start).cast("bigint"),
        "fn": F.col("n_positive") - F.col("tp"), "tn": F.col("n_negative") - F.col("fp")})
    sens = F.coalesce(F.try_divide("tp", "n_positive"), F.lit(0.0))
    spec = F.coalesce(F.try_divide("tn", "n_negative"), F.lit(0.0))
    return out.select("formula", "threshold", "tp", "fp", "fn", "tn", sens.alias("sensitivity"),
                      spec.alias("specificity"), (sens + spec - 1).alias("youden_j"))


def roc_optimum(points: DataFrame, standard: float = 450) -> DataFrame:
    """First threshold with the largest J per formula and its distance from the standard one."""
    ranked = Window.partitionBy("formula").orderBy(F.desc(F.round("youden_j", 12)), "threshold")
    best = points.withColumn("rn", F.row_number().over(ranked)).filter("rn = 1")
    return best.select("formula", "threshold", "sensitivity", "specificity", "youden_j",
                       (F.col("threshold") - int(standard)).alias("delta"))


def slope_sweep(df: DataFrame, qtc: str = "qtc_bazett", threshold: str = "threshold", reference_hr: float = 75,
                start: float = -0.5, step: float = 0.05, count: int = 20) -> DataFrame:
    """Threshold + slope * (HR - reference): false-positive rate per slope, best and fixed.

    Every slope is a conditional count in the same scan; the first lowest rate wins.
    """
    slopes = [start + i * step for i in range(count)]
    flags = [F.count_if(F.col(qtc) > F.col(threshold) + F.lit(s) * (F.col("hr_bpm") - reference_hr)).alias(f"f{i}")
             for i, s in enumerate(slopes)]
    wide = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(qtc) > F.col(threshold)).alias("fixed"), *flags)
    options = F.array(*[F.struct(F.col(f"f{i}").alias("fp"), F.lit(i).alias("i"), F.lit(s).alias("slope"))
                        for i, s in enumerate(slopes)])
    best = F.array_min(options)
    return wide.select(best["slope"].alias("optimal_slope"),
                       (100.0 * best["fp"] / F.col("n")).alias("fp_rate_adaptive"),
                       (100.0 * F.col("fixed") / F.col("n")).alias("fp_rate_fixed"))


def adjust_sweep(df: DataFrame, qtc: str = "qtc_inverse_rr", threshold: str = "threshold", low: int = -20,
                 high: int = 20, step: int = 2, min_fp_rate: float = 0.5, weight: float = 0.1) -> DataFrame:
    """Best shift of the threshold: gain in false-positive rate minus ``weight`` per ms.

    Only shifts keeping the rate above ``min_fp_rate`` and scoring above 0 count; else 0.
    """
    shifts = list(range(low, high + 1, step))
    flags = [F.count_if(F.col(qtc) > F.col(threshold) + s).alias(f"f{i}") for i, s in enumerate(shifts)]
    wide = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(qtc) > F.col(threshold)).alias("now"), *flags)
    current = 100.0 * F.col("now") / F.col("n")
    options = []
    for i, s in enumerate(shifts):
        rate = 100.0 * F.col(f"f{i}") / F.col("n")
        score = (current - rate) - abs(s) * weight
        ok = (rate > min_fp_rate) & (score > 0)
        options.append(F.when(ok, F.struct(F.round(score, 12).alias("score"), F.lit(-i).alias("order"),
                                           F.lit(s).alias("shift"), rate.alias("rate"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return wide.select(F.coalesce(best["shift"], F.lit(0)).cast("bigint").alias("optimal_adjustment"),
                       current.alias("current_fp_rate"),
                       F.coalesce(best["rate"], current).alias("optimal_fp_rate"))


# ---- thresholds ---------------------------------------------------------------------------
def threshold_grid(df: DataFrame, value, limits, by=(), inclusive: bool = False) -> DataFrame:
    """n_above of every group at every limit: rows whose value is above it, or at it if ``inclusive``.

    One scan counts the rows of each group by how many of the ascending limits they pass; all limits are sums of these
    counts. A group without a row above a limit has 0 there; null and NaN values are above none.
    """
    limits, by = sorted(set(limits)), list(by)
    v = F.col(value) if isinstance(value, str) else value
    v = F.when(~F.isnan(v.cast("double")), v)
    steps = F.array(*[F.lit(t) for t in limits])
    passed = F.size(F.filter(steps, (lambda t: v >= t) if inclusive else (lambda t: v > t)))
    counts = df.groupBy(*by, passed.alias("__passed")).agg(F.count(F.lit(1)).alias("__n"))
    grid = counts.select("*", F.posexplode(steps).alias("__at", "threshold"))
    above = F.sum(F.when(F.col("__passed") > F.col("__at"), F.col("__n")).otherwise(F.lit(0)))
    return grid.groupBy(*by, "threshold").agg(above.cast("bigint").alias("n_above"))
