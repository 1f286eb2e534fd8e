"""Radix percentiles, running totals and logistic fits against numpy."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoqt.operators import logistic, prefix, quantiles, ranks


def test_image_is_the_order_of_doubles(spark):
    rng = np.random.default_rng(1)
    random = [v for v in (struct.unpack("d", struct.pack("Q", int(b)))[0] for b in rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) if v == v]
    edges = [0.0, 5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), np.nextafter(1.0, 0), np.nextafter(1.0, 2), np.nextafter(1024.0, 0), 1.7976931348623157e308, float("inf")]
    powers = [2.0**e for e in range(-1074, 1024, 7)]
    values = [float(s * v) for v in random + edges + powers for s in (1, -1)]
    got = np.array([r["i"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(quantiles.ordered_image(F.col("v")).alias("i")).collect()])
    bits = (np.array(values) + 0.0).view(np.int64)
    want = np.where(bits < 0, -(bits & 0x7FFFFFFFFFFFFFFF), bits)
    finite = np.isfinite(values)
    assert (got[finite] == want[finite]).all()
    assert (got[np.argsort(values, kind="stable")][1:] >= got[np.argsort(values, kind="stable")][:-1]).all()


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_percentiles_of_many_distinct_values(spark, monkeypatch, few):
    """1e5 distinct values of one octave, and values over all magnitudes: all passes are taken where ``few`` is 0."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(2)
    groups = {"rr": rng.uniform(0.6, 1.2, 100_000), "wide": 10.0 ** rng.uniform(-250, 250, 3000) * rng.choice([-1, 1], 3000), "grid": rng.integers(300, 500, 5000).astype(float), "one": np.array([7.5])}
    df = spark.createDataFrame(pd.DataFrame({"g": np.repeat(list(groups), [len(v) for v in groups.values()]), "v": np.concatenate(list(groups.values()))}))
    df = df.unionByName(spark.createDataFrame([("none", None), ("nan", float("nan"))], "g string, v double"))
    probs = [0, 0.1, 0.5, 0.975, 1]
    got = {r["g"]: [r[f"p{i}"] for i in range(5)] for r in quantiles.percentiles(df, {f"p{i}": ("v", p) for i, p in enumerate(probs)}, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.percentile(values, [100 * p for p in probs]).tolist(), rel=1e-12)


def test_one_scan_is_enough_on_a_grid(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(quantiles, "settle", lambda df, keep=quantiles.settle: passes.append(1) or keep(df))
    df = spark.range(9000).select((F.col("id") % 300 + 300).cast("double").alias("v"))
    assert quantiles.percentiles(df, {"m": ("v", 0.5)}).first()["m"] == 449.5 and len(passes) == 1


def test_running_total_and_ranks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b", None], 4000), "v": rng.permutation(4000).astype(float), "n": rng.integers(1, 5, 4000)})
    got = prefix.running_total(spark.createDataFrame(pdf), ["g"], "v", "n", "t").toPandas().sort_values("v")
    pdf = pdf.sort_values("v")
    want = pdf.groupby("g", dropna=False)["n"].cumsum() - pdf["n"]
    assert (got["t"].to_numpy() == want.to_numpy()).all()
    pdf["v"] = (pdf["v"] // 3) / 7
    ranked = {(r["g"], r["v"]): r["rank"] for r in ranks.average_ranks(spark.createDataFrame(pdf[["g", "v"]]), "v", ["g"]).collect()}
    for g, v, r in zip(pdf["g"], pdf["v"], pdf.groupby("g", dropna=False)["v"].rank()):
        assert ranked[(None if pd.isna(g) else g, v)] == r


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(60, 15, n), "b": rng.integers(0, 2, n).astype(float), "c": rng.normal(75, 12, n)})
    eta = -4 + 0.03 * pdf["a"] + 0.7 * pdf["b"] + 0.01 * pdf["c"]
    pdf["o"] = rng.random(n) < 1 / (1 + np.exp(-eta))
    pdf["rare"] = pdf.index < 1
    pdf["never"] = False
    df = spark.createDataFrame(pdf).withColumn("o", F.when(F.col("a") > 20, F.col("o"))).unionByName(spark.createDataFrame([(None, 0.0, 70.0, True, True, True)], "a double, b double, c double, o boolean, rare boolean, never boolean"))
    got = {r["outcome"]: r for r in logistic.fit_all(df, ["o", "rare", "never"], ["a", "b", "c"]).collect()}
    use = pdf[pdf["a"] > 20]
    x, y, beta = np.column_stack([np.ones(len(use)), use[["a", "b", "c"]]]), use["o"].to_numpy(float), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        information = (x * (p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(information, x.T @ (y - p))
    assert got["o"]["converged"] and got["o"]["n"] == len(use) and got["o"]["events"] == y.sum() and got["o"]["score"] < 1e-9
    assert got["o"]["beta"] == pytest.approx(beta.tolist(), rel=1e-7) and got["o"]["se"] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(information))).tolist(), rel=1e-6)
    assert got["never"]["beta"] is None and not got["never"]["converged"] and got["never"]["events"] == 0
    # Perfect separation by rank: no finite solution, reported as such.
    apart = df.select(F.col("a"), (F.col("a") > 60).alias("o")).where("a IS NOT NULL")
    r = logistic.fit_all(apart, ["o"], ["a"]).first()
    assert not r["converged"]
    assert logistic.fit_all(df.limit(0), ["o"], ["a"]).first()["n"] == 0
