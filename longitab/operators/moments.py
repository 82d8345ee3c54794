"""Means and covariances of vectors: one partial sum per task, merged in two steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SALTS = 1_024


def vectors(column) -> np.ndarray:
    """An Arrow list column of equal-length rows as a 2-D array, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = pc.min_max(pc.list_value_length(column))
    if widths["min"].as_py() != widths["max"].as_py():
        raise ValueError("vectors of one column must have one length")
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(matrix: np.ndarray) -> pa.Array:
    """A 2-D array as an Arrow list column of doubles."""
    n, width = matrix.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, "i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def merge(a, b):
    """Pool two ``(n, mean, m2)`` triples; stable when the mean is far from zero."""
    if a is None:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def grouped_moments(df: DataFrame, column: str, by: str | list[str] = ()) -> DataFrame:
    """Count, mean and centred product sums of an array column: ``by..., n, mean, m2``.

    ``m2`` is p*p, row by row. Rows with a null vector or null entries are left out. Rows are
    never shuffled: each task sends one partial result per group, and those are merged first
    over ``SALTS`` salts, so no task sees more than a fraction of the partials.
    """
    by = [by] if isinstance(by, str) else list(by)
    data = df.select(*by, F.col(column).cast("array<double>").alias("_x")).filter(
        F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))
    schema = T.StructType([data.schema[c] for c in by]
                          + [T.StructField("_salt", T.IntegerType()),
                             T.StructField("n", T.LongType()),
                             T.StructField("mean", T.ArrayType(T.DoubleType())),
                             T.StructField("m2", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def groups(batch):
        if not by:
            return {(): slice(None)} if batch.num_rows else {}
        # Codes per key column, null among them, so that no key changes its type.
        coded = [batch.column(i).dictionary_encode(null_encoding="encode") for i in range(len(by))]
        code = np.zeros(batch.num_rows, np.int64)
        for c in coded:
            code = np.unique(code * len(c.dictionary) + c.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if batch.num_rows else []
        return {tuple(c.dictionary[c.indices[int(rows[0])].as_py()].as_py() for c in coded): rows for rows in parts}

    def partial(batches):
        held = {}
        for batch in batches:
            x = vectors(batch.column(len(by)))
            for key, rows in groups(batch).items():
                part = x[rows]
                mean = part.mean(axis=0)
                centred = part - mean
                held[key] = merge(held.get(key), (len(part), mean, centred.T @ centred))
        salt = TaskContext.get().partitionId() % SALTS
        rows = [(*k, salt, v[0], v[1].tolist(), v[2].reshape(-1).tolist()) for k, v in held.items()]
        columns = list(zip(*rows)) if rows else [[]] * len(arrow)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return pooled_moments(data.mapInArrow(partial, schema), by)


def pooled_moments(partials: DataFrame, by: list[str]) -> DataFrame:
    """Partial results ``by..., _salt, n, mean, m2`` merged over salts, then over all: ``by..., n, mean, m2``."""
    def pool(table: pa.Table) -> pa.Table:
        total = None
        for n, mean, m2 in zip(table.column("n").to_pylist(), vectors(table.column("mean")),
                               vectors(table.column("m2"))):
            total = merge(total, (n, mean, m2.reshape(len(mean), -1)))
        pooled = [pa.array([total[0]], pa.int64()), lists(total[1][None, :]),
                  lists(total[2].reshape(1, -1))]
        kept = table.select([*by, "_salt"]).slice(0, 1)
        return pa.table([*kept.columns, *pooled], names=[*by, "_salt", "n", "mean", "m2"])

    rows = partials.select(*by, "_salt", "n", "mean", "m2")
    return (rows.groupBy(*by, "_salt").applyInArrow(pool, rows.schema)
            .groupBy(*by).applyInArrow(pool, rows.schema).drop("_salt"))


def covariance(df: DataFrame, features: list[str] | str, by: str | None = None) -> DataFrame:
    """Sample covariance of each pair of features, ``i <= j``: ``by, feature_i, feature_j, n, cov``.

    ``features`` is a list of columns, or the name of one array column, whose features are
    then named by their position from 0.
    """
    named = not isinstance(features, str)
    data = df.withColumn("_v", F.array(*[F.col(f).cast("double") for f in features])
                         if named else F.col(features))
    sums = grouped_moments(data, "_v", by or [])
    p = F.size("mean")
    pair = sums.select(*([by] if by else []), "n", p.alias("_p"), F.posexplode("m2").alias("_k", "_m2"))
    i, j = F.floor(F.col("_k") / F.col("_p")).cast("int"), (F.col("_k") % F.col("_p")).cast("int")
    if named:
        names = F.array(*[F.lit(f) for f in features])
        feature = lambda at: F.get(names, at)
    else:
        feature = lambda at: at
    return (pair.filter(i <= j)
            .select(*([by] if by else []), feature(i).alias("feature_i"),
                    feature(j).alias("feature_j"), "n",
                    (F.col("_m2") / F.nullif(F.col("n") - 1, F.lit(0))).alias("cov")))
