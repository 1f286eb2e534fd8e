"""Logistic regressions of many outcomes on the same covariates: one Newton loop, one scan a step for all of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.session import written

STEPS, TOLERANCE = 30, 1e-10


def fit_all(df: DataFrame, outcomes, covariates, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per outcome: n, events, converged, steps, score (largest component at the solution, per row) and the arrays beta and se (intercept first).

    The covariates and outcomes are written once, without rows that lack a covariate; each Newton step is one aggregation of
    scores and informations by outcome over that copy. Covariates are
    centred and scaled inside. An outcome without events or without non-events, with fewer rows than coefficients, or
    whose information is singular (collinear covariates, separation) has null coefficients and is not converged.
    """
    outcomes, covariates = list(outcomes), list(covariates)
    k, m = len(covariates) + 1, len(outcomes)
    data = written(df.select(*[F.col(c).cast("double").alias(c) for c in covariates], *[F.col(o).cast("boolean").cast("int").alias(o) for o in outcomes])
                   .dropna(subset=covariates))
    middle = data.agg(*[F.avg(c).alias(f"m_{c}") for c in covariates], *[F.stddev_pop(c).alias(f"s_{c}") for c in covariates]).first()
    centre = np.array([middle[f"m_{c}"] or 0.0 for c in covariates])
    spread = np.array([middle[f"s_{c}"] or 1.0 for c in covariates])
    size = 2 + k + k * k
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # One row for each known outcome of a row, made as the copy is read.
    known = F.filter(F.array(*[F.struct(F.lit(o).alias("o"), F.col(name).cast("double").alias("y")) for o, name in enumerate(outcomes)]), lambda s: s["y"].isNotNull())
    x = [F.lit(1.0)] + [(F.col(c) - F.lit(float(centre[i]))) / F.lit(float(spread[i])) for i, c in enumerate(covariates)]
    long = data.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], F.explode(known).alias("s")).select(*[f"x{i}" for i in range(k)], "s.o", "s.y")

    def sums_at(beta: np.ndarray) -> np.ndarray:
        """Rows, events, score (k) and information (k x k) of every outcome, flat."""
        own = [F.get(F.lit(beta[:, i].tolist()), F.col("o")) for i in range(k)]
        eta = sum((own[i] * F.col(f"x{i}") for i in range(1, k)), own[0])
        p = 1.0 / (1.0 + F.exp(-eta))
        rows = long.withColumn("p", p).withColumns({"e": F.col("y") - F.col("p"), "w": F.col("p") * (1 - F.col("p"))})
        sums = rows.groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), *[F.sum(F.col("e") * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)],
                                     *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs])
        total = np.zeros((m, size))
        for r in sums.collect():  # one row an outcome
            information = [r[f"h{min(i, j)}_{max(i, j)}"] for i in range(k) for j in range(k)]
            total[r["o"]] = [r["n"], r["events"], *[r[f"g{i}"] for i in range(k)], *information]
        return total

    beta, taken, state = np.zeros((m, k)), np.zeros(m, int), ["open"] * m
    covariance, found = [None] * m, None
    for step in range(steps + 1):
        found = sums_at(beta)
        for o in range(m):
            n, events, score, information = found[o][0], found[o][1], found[o][2 : 2 + k], found[o][2 + k :].reshape(k, k)
            if state[o] != "open":
                continue
            if n <= k or not 0 < events < n or np.linalg.cond(information) > 1e13:
                state[o] = "none"
            elif np.abs(score).max() <= tolerance * n or step == steps:
                state[o] = "done" if np.abs(score).max() <= tolerance * n else "stopped"
                covariance[o] = np.linalg.inv(information)
            else:
                beta[o] += np.clip(np.linalg.solve(information, score), -5, 5)
                taken[o] = step + 1
        if "open" not in state:
            break
    # Back to the covariates' own units.
    rows = []
    back = np.eye(k)
    back[0, 1:], back[np.arange(1, k), np.arange(1, k)] = -centre / spread, 1 / spread
    for o, name in enumerate(outcomes):
        n, events, score = int(found[o][0]), int(found[o][1]), float(np.abs(found[o][2 : 2 + k]).max())
        if covariance[o] is None:
            rows.append((name, n, events, False, int(taken[o]), None, None, None))
            continue
        own, var = back @ beta[o], np.diag(back @ covariance[o] @ back.T)
        rows.append((name, n, events, state[o] == "done", int(taken[o]), score / n, [float(v) for v in own], [math.sqrt(v) for v in var]))
    schema = "outcome string, n bigint, events bigint, converged boolean, steps int, score double, beta array<double>, se array<double>"
    return df.sparkSession.createDataFrame(rows, schema)
