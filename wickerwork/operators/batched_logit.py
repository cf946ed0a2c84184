"""Many logistic regressions over one table in the same passes: each row knows which of the models it trains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose products are made at a time.
SLICE_ROWS = 2048


def _passes(rows: DataFrame, cells: int, per_slice) -> np.ndarray:
    """The sum over all rows of per_slice(x, y, w), an array of `cells` numbers: summed in each task, then by Spark cell by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells)
        for batch in batches:
            for lo in range(0, len(batch), SLICE_ROWS):
                part = batch.iloc[lo : lo + SLICE_ROWS]
                total += per_slice(np.stack(part["x"].to_list()), part["y"].to_numpy(float), np.stack(part["w"].to_list()))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "v": total[at]})

    out = np.zeros(cells)
    for row in rows.mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[row["at"]] = row["v"]
    return out


def fit_batched(rows: DataFrame, members: int, width: int, reg: float = 0.01, iterations: int = 40, tolerance: float = 1e-9) -> np.ndarray:
    """(members, width + 1) coefficients, the intercept last, of rows(x array<double>, y 0/1, w array<double>: the row's weight in each model).

    Model m minimises its weighted mean log loss plus reg / 2 times the squares of its coefficients in units of its own features' standard
    deviation; the intercept is free. All models take Newton steps together, one pass over the rows a step: a task sums gradients and second
    derivatives, members x (width + 1)^2 numbers whatever the rows. A step that raises a model's loss is halved for it."""
    d = width + 1
    sums = _passes(rows, members * (2 * width + 1), lambda x, y, w: np.concatenate([w.sum(0), (w.T @ x).ravel(), (w.T @ x**2).ravel()]))
    n = np.maximum(sums[:members], 1e-300)
    mean, square = (sums[members + i * members * width :][: members * width].reshape(members, width) / n[:, None] for i in (0, 1))
    variance = np.maximum(square - mean**2, 0.0) * (n / np.maximum(n - 1, 1))[:, None]
    flat = variance < 1e-24
    penalty = np.concatenate([np.where(flat, 1.0, reg * variance), np.zeros((members, 1))], axis=1)

    def slice_sums(beta):
        def sums_of(x, y, w):
            ones = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            z = ones @ beta.T
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            loss = (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
            gradient = (w * (p - y[:, None])).T @ ones
            curve = np.stack([(ones * v[:, None]).T @ ones for v in (w * p * (1 - p)).T])
            return np.concatenate([loss, gradient.ravel(), curve.ravel()])

        return sums_of

    beta = best = np.zeros((members, d))
    lowest, step = np.full(members, np.inf), np.zeros((members, d))
    for _ in range(iterations):
        got = _passes(rows, members * (1 + d + d * d), slice_sums(beta))
        loss = got[:members] / n + 0.5 * (penalty * beta**2).sum(1)
        gradient = got[members : members * (1 + d)].reshape(members, d) / n[:, None] + penalty * beta
        curve = got[members * (1 + d) :].reshape(members, d, d) / n[:, None, None] + np.einsum("md,de->mde", penalty, np.eye(d))
        worse = loss > lowest + 1e-12
        best, lowest = np.where(worse[:, None], best, beta), np.where(worse, lowest, loss)
        newton = np.stack([-np.linalg.lstsq(h, g, rcond=None)[0] for h, g in zip(curve, gradient, strict=True)])
        newton[:, :width] = np.where(flat, 0.0, newton[:, :width])
        step = np.where(worse[:, None], step / 2, newton)
        beta = best + step
        if np.abs(step).max() < tolerance:
            break
    return beta


def mean_probability(x: Column, beta: np.ndarray) -> Column:
    """The models' mean probability for a column of array<double>."""

    def score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        z = np.stack(values.to_list()) @ beta[:, :-1].T + beta[:, -1]
        return pd.Series((1 / (1 + np.exp(-np.clip(z, -700, 700)))).mean(1))

    return F.pandas_udf(score, "double")(x)
