"""Bootstrap intervals by reweighting, without resampling rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.functions.formulas import FORMULAS
from isoqt.operators.moments import SHIFT_HR, SHIFT_QTC, pair_corr

MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: turns counters into independent-looking bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_table() -> np.ndarray:
    """Poisson(1) weight for each of 65,536 equally likely 16-bit draws."""
    cumulative = np.cumsum([exp(-1.0) / factorial(k) for k in range(10)])
    return np.searchsorted(cumulative, (np.arange(65536) + 0.5) / 65536).astype(np.float32)


def poisson_weights(keys: np.ndarray, replicates: int, seed: int, table: np.ndarray) -> np.ndarray:
    """Weights (rows x replicates) that depend on key, replicate and seed only."""
    blocks = (replicates + 3) // 4
    counter = np.arange(1, blocks + 1, dtype=np.uint64) * MIX
    offset = np.uint64(seed * int(MIX) % (1 << 64))
    start = _mix(keys.astype(np.uint64) + offset)
    bits = _mix(start[:, None] + counter[None, :])
    return table[bits.view(np.uint16)][:, :replicates]


def bootstrap_moments(df: DataFrame, formulas=FORMULAS, by=("dataset",), key: str = "ecg_id",
                      replicates: int = 1000, seed: int = 42, hr: str = "hr_bpm") -> DataFrame:
    """Six weighted sums per group, formula and replicate.

    Every row gets Poisson(1) weights from a hash of (key, replicate, seed), so the draw does not
    depend on how the rows are partitioned. Tasks add up sums and emit them once per partition.
    """
    by, formulas = list(by), list(formulas)
    values = [f"qtc_{f}" for f in formulas]
    rows = df.filter(F.col(hr).isNotNull()).select(
        F.xxhash64(F.col(key)).alias("__key"), *by, F.col(hr).alias("__hr"), *values)

    def emit(sums) -> Iterator[pd.DataFrame]:
        for group, total in sums.items():
            cube = total.reshape(replicates, len(formulas), 6)
            for i, f in enumerate(formulas):
                out = pd.DataFrame(cube[:, i, :], columns=["n", "x", "y", "xx", "yy", "xy"])
                for name, value in zip(by, group):
                    out[name] = value
                out["formula"], out["replicate"] = f, np.arange(replicates)
                yield out[[*by, "formula", "replicate", "n", "x", "y", "xx", "yy", "xy"]]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sums = _poisson_table(), {}
        for batch in batches:
            for group, pdf in (batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]):
                for at in range(0, len(pdf), 2048):
                    part = pdf.iloc[at:at + 2048]
                    weights = poisson_weights(part["__key"].to_numpy(), replicates, seed, table)
                    x = part["__hr"].to_numpy(dtype=float) - SHIFT_HR
                    columns = []
                    for v in values:
                        y = part[v].to_numpy(dtype=float) - SHIFT_QTC
                        ok = np.isfinite(y)
                        y, u = np.where(ok, y, 0.0), np.where(ok, x, 0.0)
                        columns += [ok.astype(float), u, y, u * u, y * y, u * y]
                    total = weights.T.astype(float) @ np.column_stack(columns)
                    group = group if isinstance(group, tuple) else (group,)
                    sums[group] = sums.get(group, 0.0) + total
            if len(sums) > 64:  # bounds the memory of a task; Spark adds up the parts
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in by)
    schema = (f"{keys}formula string, replicate int, n double, x double, y double, xx double, "
              "yy double, xy double")
    moments = rows.mapInPandas(weigh, schema)
    return moments.groupBy(*by, "formula", "replicate").agg(
        *[F.sum(c).alias(f"b__{c}") for c in ("n", "x", "y", "xx", "yy", "xy")])


def bootstrap_r(df: DataFrame, formulas=FORMULAS, by=("dataset",), key: str = "ecg_id",
                replicates: int = 1000, seed: int = 42, level: float = 0.95, min_n: int = 30) -> DataFrame:
    """Percentile interval of |r(QTc, HR)| per group and formula."""
    draws = bootstrap_moments(df, formulas, by, key, replicates, seed).withColumn(
        "abs_r", F.abs(pair_corr("b", min_n)))
    return _interval(draws, [*by, "formula"], level)


def bootstrap_weighted_r(df: DataFrame, formulas=FORMULAS, by=("dataset",), key: str = "ecg_id",
                         replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of the population-weighted |r| per formula.

    Each group weighs by its valid pairs of the formula, as when each group's pairs are resampled to their own number.
    """
    draws = bootstrap_moments(df, formulas, by, key, replicates, seed).withColumn(
        "abs_r", F.abs(pair_corr("b")))
    valid = [F.count_if(F.col(f"qtc_{f}").isNotNull() & F.col("hr_bpm").isNotNull()).alias(f) for f in formulas]
    sizes = df.groupBy(*by).agg(*valid).unpivot(list(by), list(formulas), "formula", "size")
    weighted = (draws.join(sizes, [*by, "formula"]).filter(F.col("abs_r").isNotNull())
                .groupBy("formula", "replicate")
                .agg((F.sum(F.col("abs_r") * F.col("size")) / F.sum("size")).alias("abs_r")))
    return _interval(weighted, ["formula"], level)


def _interval(draws: DataFrame, keys, level: float) -> DataFrame:
    tail = (1.0 - level) / 2.0
    bounds = F.percentile("abs_r", F.array(F.lit(tail), F.lit(1.0 - tail)))
    return (draws.groupBy(*keys).agg(bounds.alias("q"))
            .select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high")))


CONFUSION_METRICS = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "f1", "youden_j", "mcc"]


def bootstrap_confusion(counts: DataFrame, keys=("formula",), replicates: int = 1000,
                        level: float = 0.95, seed: int = 42) -> DataFrame:
    """Stratified bootstrap intervals of confusion metrics from tp/fp/tn/fn rows.

    Resampling within the two classes draws tp from Binomial(P, tp/P) and fp from
    Binomial(N, fp/N), so only the counts are needed. A class without rows falls back to
    resampling all rows, which again leaves a binomial.
    """
    from isoqt.operators.confusion import confusion_metrics

    keys = list(keys)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                rng = np.random.default_rng([seed, abs(int(row["__hash"]))])
                positive, negative = row["tp"] + row["fn"], row["fp"] + row["tn"]
                tp = rng.binomial(positive, row["tp"] / positive, replicates) if positive else np.zeros(replicates)
                fp = rng.binomial(negative, row["fp"] / negative, replicates) if negative else np.zeros(replicates)
                out = pd.DataFrame({"tp": tp, "fp": fp, "tn": negative - fp, "fn": positive - tp}, dtype="int64")
                for k in keys:
                    out[k] = row[k]
                yield out[[*keys, "tp", "fp", "tn", "fn"]]

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in counts.schema if f.name in keys)
    base = counts.select(*keys, "tp", "fp", "tn", "fn", F.xxhash64(*keys).alias("__hash"))
    draws = confusion_metrics(base.mapInPandas(draw, f"{types}tp bigint, fp bigint, tn bigint, fn bigint"))
    tail = (1.0 - level) / 2.0
    points = confusion_metrics(counts.select(*keys, "tp", "fp", "tn", "fn"))
    bounds = draws.groupBy(*keys).agg(*[
        F.percentile(m, F.array(F.lit(tail), F.lit(1.0 - tail))).alias(m) for m in CONFUSION_METRICS])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("ci_low"),
                              F.col(m)[1].alias("ci_high")) for m in CONFUSION_METRICS])
    point_rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("point"))
                           for m in CONFUSION_METRICS])
    low_high = bounds.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.*")
    point = points.select(*keys, F.explode(point_rows).alias("m")).select(*keys, "m.*")
    return point.join(low_high, [*keys, "metric"])
