"""Poisson regression on smooth functions of covariates, by sums over rows only.

Each covariate has cubic B-splines over its range and a penalty on second differences of their coefficients. A round of
reweighting turns every row into its part of X'WX, X'Wz and z'Wz, which are summed in tasks and then across them; the
driver sees these sums, a few thousand numbers, chooses how much to smooth each covariate and solves for coefficients."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.written import written

#: B-splines of a covariate, and their degree.
SPLINES, DEGREE = 10, 3
#: Weights of the penalties that are tried, by powers of ten, and the part of the sums that is added to their diagonal.
LIGHTEST, HEAVIEST, RIDGE = -3.0, 7.0, 1e-12


def splines(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Values of the B-splines on equal steps from low to high, a row a value; values beyond the range are at its ends. One
    column of ones where the range is empty."""
    if not high > low:
        return np.ones((len(x), 1))
    step = (high - low) / (SPLINES - DEGREE)
    knots = low + step * np.arange(-DEGREE, SPLINES + 1)
    x = np.clip(x, low, high)
    own = np.minimum(((x - low) / step).astype(int), SPLINES - DEGREE - 1) + DEGREE
    out = np.zeros((len(x), SPLINES + DEGREE))
    out[np.arange(len(x)), own] = 1
    for d in range(1, DEGREE + 1):
        k = np.arange(out.shape[1] - 1)
        left = (x[:, None] - knots[k]) / (d * step) * out[:, :-1]
        right = (knots[k + d + 1] - x[:, None]) / (d * step) * out[:, 1:]
        out = left + right
    return out


@dataclass
class Smooths:
    """A fitted regression: covariates with their ranges, coefficients (the constant first), and what the fit came to."""

    covariates: list[str]
    ranges: list[tuple[float, float]]
    beta: np.ndarray
    penalties: np.ndarray
    freedom: float
    deviance: float

    def columns(self, rows: pd.DataFrame) -> np.ndarray:
        parts = [splines(rows[c].to_numpy(float), *r) for c, r in zip(self.covariates, self.ranges, strict=True)]
        return np.concatenate([np.ones((len(rows), 1)), *parts], axis=1)


def penalty(widths: list[int], weights: np.ndarray) -> np.ndarray:
    """The penalty matrix of smooths of these many splines, the constant first."""
    out, at = np.zeros((1 + sum(widths), 1 + sum(widths))), 1
    for n, w in zip(widths, weights, strict=True):
        if n > 2:
            d = np.diff(np.eye(n), 2, axis=0)
            out[at : at + n, at : at + n] += w * d.T @ d
        at += n
    return out


def without_constants(widths: list[int]) -> np.ndarray:
    """Columns that span the coefficients whose sum is 0 in each smooth, and the constant: splines sum to 1, so that all
    functions remain, each once."""
    out, at, to = np.zeros((1 + sum(widths), 1 + sum(n - 1 for n in widths))), 1, 1
    out[0, 0] = 1
    for n in widths:
        out[at : at + n, to : to + n - 1] = np.linalg.qr(np.eye(n) - 1 / n)[0][:, : n - 1]
        at, to = at + n, to + n - 1
    return out


def solved(a: np.ndarray, b: np.ndarray, c: float, n: float, widths: list[int], weights: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(criterion, coefficients, degrees of freedom): the unbiased risk of the weighted fit, of known scale 1."""
    t = without_constants(widths)
    inner, right = t.T @ a @ t, t.T @ b
    both = inner + t.T @ penalty(widths, weights) @ t
    both += np.eye(len(both)) * RIDGE * np.trace(both)
    found = np.linalg.solve(both, np.column_stack([right, inner]))
    beta, freedom = found[:, 0], float(np.trace(found[:, 1:]))
    return (c - 2 * beta @ right + beta @ inner @ beta) / n + 2 * freedom / n - 1, t @ beta, freedom


def chosen(a: np.ndarray, b: np.ndarray, c: float, n: float, widths: list[int], start: np.ndarray) -> np.ndarray:
    """Powers of ten of the penalties of least risk, one covariate after the other, on steps of 1, then finer."""
    powers = start.copy()
    for step in (1.0, 1.0, 0.25):
        for k in range(len(powers)):
            tried = np.arange(LIGHTEST, HEAVIEST + 0.5) if step == 1.0 else np.clip(powers[k] + step * np.arange(-3, 4), LIGHTEST, HEAVIEST)
            risks = [solved(a, b, c, n, widths, 10 ** np.where(np.arange(len(powers)) == k, t, powers))[0] for t in tried]
            powers[k] = tried[int(np.argmin(risks))]
    return powers


def summing(model: Smooths, count: str, first: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows to sums (k, v) of a task: X'WX row by row, X'Wz, z'Wz, the rows and their deviance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(model.beta)
        total = np.zeros(p * p + p + 3)
        for rows in batches:
            x, y = model.columns(rows), rows[count].to_numpy(float)
            eta = np.log(np.maximum(y, 0.1)) if first else np.clip(x @ model.beta, -30, 30)
            mu = np.exp(eta)
            z = eta + (y - mu) / mu
            xw = x * mu[:, None]
            deviance = 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0) - (y - mu)).sum()
            total += np.concatenate([(xw.T @ x).ravel(), xw.T @ z, [(mu * z * z).sum(), len(y), deviance]])
        yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    return run


def fitted(rows: DataFrame, covariates: list[str], count: str, rounds: int = 50, tolerance: float = 1e-7) -> Smooths:
    """The regression of a count on smooths of covariates: reweighted until the deviance changes by less than the tolerance,
    with the penalties chosen anew in each round. Rows have a value for all of them."""
    ends = rows.agg(*[f(c).cast("double").alias(f"{n}{k}") for k, c in enumerate(covariates) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = [(ends[f"lo{k}"] or 0.0, ends[f"hi{k}"] or 0.0) for k in range(len(covariates))]
    widths = [SPLINES if high > low else 1 for low, high in ranges]
    model = Smooths(covariates, ranges, np.zeros(1 + sum(widths)), np.full(len(covariates), 1.0), 0.0, np.inf)
    rows, p = rows.select(count, *covariates), len(model.beta)
    for k in range(rounds):
        sums = rows.mapInPandas(summing(model, count, k == 0), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        got = np.zeros(p * p + p + 3)
        got[sums["k"]] = sums["v"]
        a, b, (c, n, deviance) = got[: p * p].reshape(p, p), got[p * p : p * p + p], got[-3:]
        if n == 0 or (k > 1 and abs(model.deviance - deviance) <= tolerance * (abs(deviance) + 1)):
            break
        model.penalties = chosen(a, b, c, n, widths, model.penalties) if k < 8 else model.penalties  # settled by then, so that rounds converge
        _, model.beta, model.freedom = solved(a, b, c, n, widths, 10**model.penalties)
        model.deviance = deviance
    return model


def predicted(rows: DataFrame, model: Smooths, keep: list[str], out: str = "expected") -> DataFrame:
    """(*keep, out): what the regression expects of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part[keep].assign(**{out: np.exp(np.clip(model.columns(part) @ model.beta, -30, 30))})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*dict.fromkeys([*keep, *model.covariates])).mapInPandas(run, f"{kinds}, {out} double")


def profile(rows: DataFrame, covariates: list[str], count: str = "coverage") -> DataFrame:
    """(bin_id, ratio): working residuals of the regression, less their minimum; 0 for bins without coverage or a
    covariate."""
    used = rows.where(F.col(count) > 0)
    for c in covariates:
        used = used.where(F.col(c) > 0)
    used = written(used.select("bin_id", F.col(count).cast("double").alias(count), *[F.col(c).cast("double").alias(c) for c in covariates]), "covariates")
    out = predicted(used, fitted(used, covariates, count), ["bin_id", count]).withColumn("residual", (F.col(count) - F.col("expected")) / F.col("expected"))
    least = out.agg(F.min("residual").alias("least"))
    out = out.crossJoin(F.broadcast(least)).select("bin_id", (F.col("residual") - F.col("least")).alias("ratio"))  # one row
    return rows.select("bin_id").join(out, "bin_id", "left").select("bin_id", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
