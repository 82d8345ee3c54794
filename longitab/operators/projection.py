"""Principal components: fit on training rows in one pass, project, and go back."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longitab.functions.small import small_rows
from longitab.operators.moments import grouped_moments, lists, vectors


@dataclass(frozen=True)
class Projection:
    """Standardising step and principal axes fitted together.

    ``features`` names the input columns, or is the name of one array column.
    ``axes`` is p x k, ``share`` the variance share of each component. A feature that is constant
    in training has width 0 and counts as 0.
    """

    features: list[str] | str
    mean: np.ndarray
    width: np.ndarray
    axes: np.ndarray
    share: np.ndarray

    @property
    def k(self) -> int:
        return self.axes.shape[1]


def _vector(features: list[str] | str) -> Column:
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(f).cast("double") for f in features])


def principal_axes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, and unit axes as columns. The first entry of an axis that is
    not tiny is positive."""
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = np.clip(values[::-1], 0.0, None), axes[:, ::-1]
    first = (np.abs(axes) > 1e-6).argmax(axis=0)
    return values, axes * np.where(axes[first, np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def pca_fit(train: DataFrame, features: list[str] | str, k: int | None = None,
            share: float | None = None, standardise: bool = True) -> Projection:
    """Principal axes of the training rows, ``k`` of them or enough for a variance ``share``.

    One scan: counts, means and products are merged from all tasks, and scaling and axes both come
    from them. What reaches the driver is p x p, whatever the number of rows. Rows with a null teach
    nothing; ``pca_transform`` refuses them, so impute first.
    """
    if (k is None) == (share is None):
        raise ValueError("give k or share")
    sums = small_rows(grouped_moments(train.select(_vector(features).alias("_v")), "_v"))
    if not sums:
        raise ValueError("no row to fit on")
    n, mean = sums[0]["n"], np.array(sums[0]["mean"])
    p = len(mean)
    if k is not None and not 1 <= k <= p:
        raise ValueError(f"{k} components of {p} features")
    cov = np.array(sums[0]["m2"]).reshape(p, p) / max(n - 1, 1)
    width = np.sqrt(np.diag(cov)) if standardise else np.ones(p)
    scale = np.divide(1.0, width, out=np.zeros(p), where=width > 0)
    values, axes = principal_axes(cov * scale[:, None] * scale[None, :])
    shares = values / values.sum() if values.sum() > 0 else np.zeros(p)
    if share is not None:
        k = min(int(np.searchsorted(np.cumsum(shares), share - 1e-12)) + 1, p)
    return Projection(features, mean, width, axes[:, :k], shares[:k])


def pca_transform(df: DataFrame, model: Projection, out: str = "components") -> DataFrame:
    """Add the component array: one matrix product per Arrow batch."""
    turn = np.divide(1.0, model.width, out=np.zeros(len(model.width)), where=model.width > 0)[:, None] * model.axes
    mean = model.mean

    @F.arrow_udf("array<double>")
    def project(column: pa.Array) -> pa.Array:
        if not len(column):
            return column
        if column.null_count or column.flatten().null_count:
            raise ValueError("a row with a null has no components; impute first")
        return lists((vectors(column) - mean) @ turn)

    return df.withColumn(out, project(_vector(model.features)))


def pca_inverse(df: DataFrame, model: Projection, column: str = "components",
                out: str | None = None) -> DataFrame:
    """Components back to features: one matrix product per Arrow batch.

    Writes the feature columns the model was fitted on, or the array column ``out``.
    """
    back = (model.axes * model.width[:, None]).T
    mean = model.mean

    @F.arrow_udf("array<double>")
    def restore(column: pa.Array) -> pa.Array:
        return lists(vectors(column) @ back + mean) if len(column) else column

    values = restore(F.col(column))
    if isinstance(model.features, str):
        return df.withColumn(out or model.features, values)
    if out:
        return df.withColumn(out, values)
    restored = df.withColumn("_back", values)
    return restored.withColumns({f: F.get("_back", F.lit(i)) for i, f
                                 in enumerate(model.features)}).drop("_back")


def explained_variance(model: Projection, spark) -> DataFrame:
    """Share and running share of the variance, one row per component."""
    running = np.cumsum(model.share)
    rows = [(i + 1, float(s), float(r)) for i, (s, r) in enumerate(zip(model.share, running))]
    return spark.createDataFrame(rows, "component int, share double, running_share double")


def axis_weights(model: Projection, spark) -> DataFrame:
    """``component, feature, weight``: the axes in long form; features of an array by position."""
    names = [str(i) for i in range(len(model.mean))] if isinstance(model.features, str) else list(model.features)
    rows = [(j + 1, f, float(model.axes[i, j])) for i, f in enumerate(names) for j in range(model.k)]
    return spark.createDataFrame(rows, "component int, feature string, weight double")
