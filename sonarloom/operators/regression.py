"""Least squares through the origin with several regressors: sums in Spark, a small solve on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge(df: DataFrame, regressors: list[str], target: str, weight: float = 1e-6) -> dict[str, float]:
    """Coefficients of target ~ regressors. One pass; what reaches the driver is a matrix of their number squared.

    weight x the mean of the Gram matrix's diagonal is added to that diagonal, so it means the same at any level of the signals. Rows with a null take no part. Without rows all coefficients are 0.
    """
    columns = [*regressors, target]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.select(*columns).dropna().agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).head()
    sums = {p: float(row[i]) for i, p in enumerate(pairs)}
    gram = np.array([[sums.get((a, b), sums.get((b, a))) for b in regressors] for a in regressors])
    right = np.array([sums[a, target] for a in regressors])
    return dict(zip(regressors, np.linalg.lstsq(gram + weight * np.trace(gram) / len(regressors) * np.eye(len(regressors)), right, rcond=None)[0].tolist()))
