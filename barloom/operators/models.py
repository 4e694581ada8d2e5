"""Ridge probes whose training is one Spark aggregation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ridge:
    """Standardised ridge regression; the sums of products come from one aggregation."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for c, m, s, w in zip(self.columns, self.mean, self.scale, self.weights, strict=True):
            out = out + (F.col(c) - m) / s * w
        return out


def fit_ridge(train: DataFrame, columns: list[str], target: str, alpha: float = 10.0) -> Ridge | None:
    """The driver gets one row of sums; none where there are no rows."""
    names = [*columns, target]
    sums = [F.count("*").alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)] + [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    r = train.dropna(subset=names).agg(*sums).first()
    n, k = r["n"], len(columns)
    if not n:
        return None
    mean = np.array([r[f"s{i}"] / n for i in range(k + 1)])
    cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] / n - mean[i] * mean[j] for j in range(k + 1)] for i in range(k + 1)])
    scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    scale[scale < 1e-12] = 1.0
    gram = n * cov[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k)
    weights = np.linalg.solve(gram, n * cov[:k, k] / scale)
    return Ridge(tuple(columns), tuple(mean[:k].tolist()), tuple(scale.tolist()), tuple(weights.tolist()), float(mean[k]))


def shuffled_labels(rows: DataFrame, label: str, seed: int) -> DataFrame:
    """G11's control: on each date the labels change hands by a seeded hash of the symbol."""
    day = Window.partitionBy("ts")
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("symbol")))
    placed = rows.withColumn("__at", F.row_number().over(day.orderBy("symbol")))
    given = rows.select("ts", F.col(label).alias("__label"), F.row_number().over(day.orderBy(mixed, "symbol")).alias("__at"))
    return placed.join(given, ["ts", "__at"]).withColumn(label, F.col("__label")).drop("__at", "__label")
