"""Packed visits, whole or in bounded parts, and features read from them.

``pack_sequences`` holds a whole entity in a row, ``pack_parts`` at most ``part_len`` visits: what
reads or draws parts needs no room for the longest entity, and pads nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from longitab.functions.ranges import SLICE_ROWS, lagged, number_rows
from longitab.functions.small import join_null_safe
from longitab.operators.moments import lists, vectors

#: Visits of a part, unless stated.
PART_LEN = 64
#: Columns of packed rows that are neither entity nor class.
PACKED = ("part", "context", "first", "seq", "mask", "len", "dropped")


def _vector(features: list[str] | str) -> Column:
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(f).cast("double") for f in features])


def longest(df: DataFrame, entity: str) -> int:
    """Visits of the entity with the most; at least 1."""
    return df.groupBy(entity).count().agg(F.max("count")).first()[0] or 1


def pack_parts(df: DataFrame, entity: str, order: list[str], features: list[str] | str, part_len: int,
               label: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All visits as ``entity, label, part, context, first, seq, len``: parts of at most ``part_len``.

    Each part but the first begins with the last visit of the part before, ``context`` = 1, so no
    pair of neighbours is lost. ``first`` is the number of a part's first visit, from 1. Visits are numbered by slices and grouped by entity and part: rows
    are bounded and no entity is on one task, however many visits it has. ``order`` must be unique
    in an entity. A label that varies in a part is the part's smallest.
    """
    if part_len < 2:
        raise ValueError("a part holds two visits at least")
    extra = [label] if label else []
    rows = df.select(entity, *extra, *[c for c in order if c not in (entity, *extra)], _vector(features).alias("_v"))
    rows = number_rows(rows, [entity], order, "_r", slice_rows)
    stride = part_len - 1
    own = F.greatest(F.floor((F.col("_r") - 2) / stride), F.lit(0))
    again = (F.col("_r") > 1) & ((F.col("_r") - 1) % stride == 0)
    parts = F.when(again, F.array(own, own + 1)).otherwise(F.array(own))
    grouped = (rows.withColumn("part", F.explode(parts))
               .groupBy(entity, "part")
               .agg(*[F.min(c).alias(c) for c in extra],
                    F.array_sort(F.collect_list(F.struct("_r", "_v"))).alias("_s"))
               .withColumn("context", (F.col("part") > 0).cast("int"))
               .filter(F.size("_s") > F.col("context")))
    return grouped.select(entity, *extra, "part", "context", (F.col("part") * stride + 1).alias("first"),
                          F.transform("_s", lambda s: s["_v"]).alias("seq"), F.size("_s").alias("len"))


def starts(seqs: DataFrame) -> DataFrame:
    """One packed row per entity: its first part."""
    return seqs.filter("part = 0") if "part" in seqs.columns else seqs


def _padded(grouped: DataFrame, keep: list[str], max_len: int) -> DataFrame:
    """``seq, mask, len`` from sorted structs ``_s``."""
    real = F.transform("_s", lambda s: s["_v"])
    n = F.size("_s")
    blank = F.transform(F.get(real, F.lit(0)), lambda v: F.lit(0.0))
    return grouped.select(
        *keep,
        F.concat(real, F.array_repeat(blank, F.lit(max_len) - n)).alias("seq"),
        F.concat(F.array_repeat(F.lit(True), n),
                 F.array_repeat(F.lit(False), F.lit(max_len) - n)).alias("mask"),
        n.alias("len"))


def pack_sequences(df: DataFrame, entity: str, order: list[str], features: list[str] | str,
                   max_len: int | None = None, label: str | None = None, keep: str = "first", pad: bool = False) -> DataFrame:
    """One row per entity: ``entity, label, seq, mask, len``, in order.

    By default every visit stays and a row is as long as its own entity; with ``pad`` rows are filled
    with zeros to the longest entity, which is counted first. ``max_len`` is a chosen cut, filled to
    it: ``keep`` says which end stays, and ``dropped`` counts the visits of the entity that were left
    out. The rank filter then runs in each map task up to
    1,000 visits. A row holds a whole entity; for entities of unbounded length use ``pack_parts``.
    A label that varies in an entity is its smallest.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"unknown end {keep}")
    cut = max_len is not None
    if pad and not cut:
        max_len = longest(df, entity)
    vector = _vector(features)
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    extra = [label] if label else []
    source = df
    visits = (df.select(entity, *extra, *[c for c in order if c not in (entity, *extra)],
                        vector.alias("_v"))
              .withColumn("_r", F.row_number().over(Window.partitionBy(entity).orderBy(*by))))
    visits = visits.filter(F.col("_r") <= max_len) if cut else visits
    position = F.col("_r") if keep == "first" else -F.col("_r")
    grouped = (visits.groupBy(entity)
               .agg(*[F.min(label).alias(label)] if label else [],
                    F.array_sort(F.collect_list(F.struct(position.alias("p"), "_v"))).alias("_s")))
    if max_len is None:
        real = F.transform("_s", lambda s: s["_v"])
        return grouped.select(entity, *extra, real.alias("seq"), F.transform("_s", lambda s: F.lit(True)).alias("mask"), F.size("_s").alias("len"))
    packed = _padded(grouped, [entity, *extra], max_len)
    if not cut:
        return packed
    sizes = source.groupBy(entity).agg(F.count("*").alias("_all"))
    return join_null_safe(packed, sizes, [entity]).withColumn("dropped", F.col("_all") - F.col("len")).drop("_all")


def unpack_sequences(seqs: DataFrame, features: list[str] | None = None,
                     keep: list[str] = (), out: str = "components") -> DataFrame:
    """Sequences to visit rows with ``step`` from 1; padding is dropped, and so are the visits that
    parts repeat.

    Writes one column per name in ``features``, or the array column ``out``.
    """
    if "part" in seqs.columns:
        visits = (seqs.select(*keep, *[c for c in ("first", "context") if c not in keep], F.posexplode("seq").alias("_t", "_x"))
                  .filter(F.col("_t") >= F.col("context"))
                  .withColumn("step", (F.col("first") + F.col("_t")).cast("int")))
    else:
        visits = (seqs.select(*keep, F.posexplode(F.arrays_zip("seq", "mask")).alias("_t", "_v"))
                  .filter(F.col("_v.mask")).withColumn("_x", F.col("_v.seq"))
                  .withColumn("step", (F.col("_t") + 1).cast("int")))
    if features is None:
        return visits.select(*keep, "step", F.col("_x").alias(out))
    return visits.select(*keep, "step", *[F.get("_x", F.lit(i)).alias(f) for i, f in enumerate(features)])


def static_features(seqs: DataFrame, out: str = "features") -> DataFrame:
    """The last visit only: what a classifier without order sees. Parts give one row per entity."""
    last = F.element_at("seq", F.col("len"))
    if "part" not in seqs.columns:
        return seqs.withColumn(out, last)
    keys = [c for c in seqs.columns if c not in PACKED]
    return seqs.groupBy(*keys).agg(F.max_by(last, "part").alias(out))


def _path_sums(x: np.ndarray, ends: np.ndarray, context: np.ndarray, whole: bool) -> np.ndarray:
    """Sums over the visits of each row, in the order of ``order_features``; rows are
    ``x[ends[i]:ends[i + 1]]``. Every sum of an entity is the sum over its parts."""
    n, p = len(ends) - 1, x.shape[1]
    own = np.ones(len(x))
    own[ends[:-1][context > 0]] = 0.0
    step = np.ones(len(x))
    step[ends[:-1]] = 0.0
    before = np.vstack([x[:1], x[:-1]])
    change = (x - before) * step[:, None]
    i, j = np.triu_indices(p) if whole else (np.arange(p), np.arange(p))
    area = (before[:, :, None] * change[:, None, :]).reshape(len(x), -1) if whole else before * change
    columns = [own[:, None], step[:, None], x * own[:, None], change, area, change[:, i] * change[:, j]]
    sums = np.add.reduceat(np.hstack(columns), ends[:-1], axis=0)
    first = x[ends[:-1]] * (context == 0)[:, None]
    return np.hstack([sums[:, :2], first, sums[:, 2:]])


def order_features(seqs: DataFrame, out: str = "features", pairs: str = "all") -> DataFrame:
    """Features of the order of visits whose width depends on the number of features alone.

    Per entity: mean, last visit, mean step, the iterated sums of the path and the products of its
    steps, both per step. The iterated sum of features i and j adds up, over the steps, how far i
    has come since the first visit times the step of j. With p features the width is
    ``3 p + p * p + p * (p + 1) / 2``, or ``5 p`` where ``pairs`` is ``own``: i = j alone.

    The sum of a sequence is the sum over its parts plus, for each part, the way up to it times the
    change in it (the product rule of iterated sums). Taken from the origin rather than from the
    first visit both become one sum, so parts are merged by an aggregate in any order, and the first
    visit is taken off at the end. One visit gives zeros but for mean and last visit. Standardise
    features far from zero first; rows with a null are refused, so impute first.
    """
    if pairs not in ("all", "own"):
        raise ValueError(f"unknown pairs {pairs}")
    whole = pairs == "all"
    keys = [c for c in seqs.columns if c not in PACKED]
    context = F.col("context") if "part" in seqs.columns else F.lit(0)
    rows = seqs.filter("len > 0").select(*keys, context.cast("int").alias("_c"), F.slice("seq", F.lit(1), F.col("len")).alias("_x"))
    schema = T.StructType([rows.schema[c] for c in keys] + [T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def sums(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(len(keys) + 1)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))))
            flat = column.flatten()
            if flat.null_count or flat.flatten().null_count:
                raise ValueError("a visit has a null feature")
            made = _path_sums(vectors(flat), ends, b.column(len(keys)).to_numpy(), whole)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], lists(made)], schema=arrow)

    total = rows.mapInArrow(sums, schema)
    if "part" in seqs.columns:
        total = (total.select(*keys, F.posexplode("_sums").alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
                 .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("_sums")))

    @F.arrow_udf("array<double>")
    def finish(column: pa.Array) -> pa.Array:
        if not len(column):
            return column
        s = vectors(column)
        # 2 + 3p + p * p + p (p + 1) / 2 sums, or 2 + 5p
        p = (s.shape[1] - 2) // 5 if not whole else int(round((-3.5 + np.sqrt(12.25 + 6 * (s.shape[1] - 2))) / 3))
        n, steps = s[:, :1], np.maximum(s[:, 1:2], 1)
        first, total, change = (s[:, 2 + k * p:2 + (k + 1) * p] for k in range(3))
        rest = s[:, 2 + 3 * p:]
        way = (first[:, :, None] * change[:, None, :]).reshape(len(s), -1) if whole else first * change
        area, square = rest[:, :way.shape[1]] - way, rest[:, way.shape[1]:]
        return lists(np.hstack([total / n, first + change, change / steps, area / steps, square / steps]))

    return total.select(*keys, finish("_sums").alias(out))


def _mean_of_products(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) / F.size(products)


def sequence_features(seqs: DataFrame, out: str = "features") -> DataFrame:
    """All visits flat, then step differences, then slope and mean lag-1 product per feature.

    With T visits of p features the width is ``T*p + (T-1)*p + 2*p``; padded entries are 0.
    The slope is the least-squares slope over the visit number; one visit gives 0.
    """
    n = F.col("len")
    width = F.size(F.get("seq", F.lit(0)))
    max_len = F.size("seq")
    steps = F.sequence(F.lit(1), max_len - 1)
    differences = F.flatten(F.transform(
        F.when(max_len > 1, steps).otherwise(F.array()),
        lambda t: F.zip_with(
            F.get("seq", t), F.get("seq", t - 1),
            lambda now, before: F.when(t < n, now - before).otherwise(F.lit(0.0)))))
    axes = F.sequence(F.lit(0), width - 1)

    def series(j):
        return F.transform(F.slice("seq", F.lit(1), n), lambda v: F.get(v, j))

    def slope(j):
        y = series(j)
        middle = (n - 1) / F.lit(2.0)
        top = F.aggregate(F.transform(y, lambda v, t: (t - middle) * v), F.lit(0.0),
                          lambda acc, x: acc + x)
        return F.when(n > 1, top / (n * (F.pow(n.cast("double"), F.lit(2.0)) - 1) / 12.0)).otherwise(0.0)

    def lag_product(j):
        y = series(j)
        return F.when(n > 1, _mean_of_products(F.slice(y, F.lit(2), n - 1),
                                               F.slice(y, F.lit(1), n - 1))).otherwise(0.0)

    return seqs.withColumn(out, F.concat(
        F.flatten("seq"), differences, F.transform(axes, slope), F.transform(axes, lag_product)))


def visit_differences(visits: DataFrame, entity: str, step: str, features: list[str],
                      chunk: int | None = None) -> DataFrame:
    """Visit-level form: change of each feature since the visit before, as ``d_<feature>``."""
    prior = lagged(visits, [entity], step, {f"_b_{f}": (f, 1) for f in features},
                   chunk or SLICE_ROWS)
    return (prior.withColumns({f"d_{f}": F.col(f) - F.col(f"_b_{f}") for f in features})
            .drop(*[f"_b_{f}" for f in features]))
