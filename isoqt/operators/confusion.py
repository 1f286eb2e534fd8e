"""Confusion counts, metrics and reclassification matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoqt.functions.formulas import col


def confusion_counts(truth, pred, tag: str = "") -> list[Column]:
    """tp, fp, tn, fn over rows where both flags are known."""
    t, p = col(truth), col(pred)
    return [F.count_if(t & p).alias(f"{tag}tp"), F.count_if(~t & p).alias(f"{tag}fp"),
            F.count_if(~t & ~p).alias(f"{tag}tn"), F.count_if(t & ~p).alias(f"{tag}fn")]


def ratio(a, b, zero: float | None = 0.0) -> Column:
    """a/b with ``zero`` (0 or None for null) where b is 0."""
    out = F.try_divide(col(a).cast("double"), col(b))
    return out if zero is None else F.coalesce(out, F.lit(float(zero)))


def confusion_metrics(df: DataFrame, zero: float | None = 0.0, tag: str = "") -> DataFrame:
    """Metrics from tp/fp/tn/fn columns; empty denominators give ``zero``."""
    tp, fp, tn, fn = (F.col(f"{tag}{c}") for c in ("tp", "fp", "tn", "fn"))
    sens, spec = ratio(tp, tp + fn, zero), ratio(tn, tn + fp, zero)
    d = [x.cast("double") for x in (tp, fp, tn, fn)]
    mcc_base = F.sqrt((d[0] + d[1]) * (d[0] + d[3]) * (d[2] + d[1]) * (d[2] + d[3]))
    return df.withColumns({
        f"{tag}total": tp + fp + tn + fn,
        f"{tag}sensitivity": sens, f"{tag}specificity": spec,
        f"{tag}ppv": ratio(tp, tp + fp, zero), f"{tag}npv": ratio(tn, tn + fn, zero),
        f"{tag}accuracy": ratio(tp + tn, tp + fp + tn + fn, zero),
        f"{tag}f1": ratio(2 * tp, 2 * tp + fp + fn, zero),
        f"{tag}youden_j": sens + spec - 1,
        f"{tag}mcc": ratio(d[0] * d[2] - d[1] * d[3], mcc_base, zero),
        f"{tag}fpr": 1 - spec, f"{tag}fnr": 1 - sens,
    })


def confusion(df: DataFrame, truth, pred, by=(), zero: float | None = 0.0) -> DataFrame:
    return confusion_metrics(df.groupBy(*by).agg(*confusion_counts(truth, pred)), zero)


def per_formula(wide: DataFrame, formulas, keep=(), fields=("tp", "fp", "tn", "fn")) -> DataFrame:
    """Turn ``<formula>_<field>`` columns into one row per formula."""
    rows = F.array(*[F.struct(F.lit(f).alias("formula"),
                              *[F.col(f"{f}_{x}").alias(x) for x in fields]) for f in formulas])
    return wide.select(*keep, F.explode(rows).alias("m")).select(*keep, "m.*")


LEVELS = ["normal", "borderline", "prolonged"]


def matrix_counts(a, b, tag: str = "") -> list[Column]:
    """Nine cells ``<from>_to_<to>`` of two 3-level classes ('invalid' is left out)."""
    return [F.count_if((col(a) == x) & (col(b) == y)).alias(f"{tag}{x}_to_{y}")
            for x in LEVELS for y in LEVELS]


def matrix_names(tag: str = "") -> list[str]:
    return [f"{tag}{x}_to_{y}" for x in LEVELS for y in LEVELS]


def matrix_totals(df: DataFrame, tag: str = "") -> DataFrame:
    """Upgraded, downgraded, unchanged and total of a reclassification matrix."""
    def total(keep):
        cells = [F.col(f"{tag}{x}_to_{y}") for i, x in enumerate(LEVELS)
                 for j, y in enumerate(LEVELS) if keep(i, j)]
        return sum(cells[1:], cells[0])
    return df.withColumns({
        f"{tag}upgraded": total(lambda i, j: j > i), f"{tag}downgraded": total(lambda i, j: j < i),
        f"{tag}unchanged": total(lambda i, j: j == i), f"{tag}total": total(lambda i, j: True)})


def reclass_matrix(df: DataFrame, a, b, by=()) -> DataFrame:
    return matrix_totals(df.groupBy(*by).agg(*matrix_counts(a, b)))
