"""Feature choice, visit order, imputation, label coding, class profile and scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longitab.functions.quantiles import medians
from longitab.functions.ranges import SLICE_ROWS, number_rows, ordered_numbers, with_slices
from longitab.functions.small import join_small


def select_numeric(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Keep ``keep`` and the named features, as doubles; a value that is no number is null."""
    return df.select(*keep, *[F.expr(f"try_cast(`{f}` AS double)").alias(f) for f in features])


def cast_failures(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: rows, nulls, and values that are there but are no number. One scan."""
    counts = []
    for f in features:
        failed = F.col(f).isNotNull() & F.expr(f"try_cast(`{f}` AS double)").isNull()
        counts.append(F.struct(F.lit(f).alias("feature"),
                               F.count("*").alias("n_rows"),
                               F.count_if(F.col(f).isNull()).alias("n_null"),
                               F.count_if(failed).alias("n_failed")))
    return df.agg(F.explode(F.array(*counts)).alias("c")).select("c.*")


def order_visits(df: DataFrame, entity: str, ts: str, tie: str, fmt: str | None = None,
                 out: str = "step", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Number the visits of each entity from 1 by ``ts``, then ``tie``.

    ``fmt`` parses ``ts`` from text; text that is no date becomes null and sorts first.
    """
    if fmt is not None:
        df = df.withColumn(ts, F.try_to_timestamp(F.col(ts), F.lit(fmt)))
    return number_rows(df, [entity], [ts, tie], out, slice_rows)


@dataclass(frozen=True)
class FillModel:
    """The value that stands for a null, by feature; null where no training row has one."""

    values: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: F.coalesce(F.col(f), F.lit(v).cast("double")) for f, v in self.values.items()})


def fit_imputer(train: DataFrame, features: list[str], strategy: str) -> FillModel:
    """Fit ``mean`` or ``median`` on the training rows; ``.transform(df)`` fills nulls.

    Both are exact, and no task holds the distinct values of a feature.
    """
    if strategy == "median":
        return FillModel(medians(train, features))
    if strategy != "mean":
        raise ValueError(f"unknown strategy {strategy}")
    one = train.agg(*[F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None))).alias(f) for f in features]).first()
    return FillModel({f: one[f] for f in features})


def carry_forward(df: DataFrame, features: list[str], entity: str, order: list[str],
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Fill a null with the last value before it in the entity; leading nulls stay."""
    sliced, any_cut = with_slices(df, [entity], order, slice_rows)
    keys = [entity, "_slice"] if any_cut else [entity]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {f: F.last(f, ignorenulls=True).over(w) for f in features}
    if not any_cut:
        return sliced.withColumns(filled).drop("_slice")
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f"_{f}")
            for f in features]
    before = Window.partitionBy(entity).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = (sliced.groupBy(*keys).agg(*last)
             .withColumns({f"_{f}": F.last(f"_{f}", ignorenulls=True).over(before)
                           for f in features})
             .filter(F.col("_slice") > 0))
    return (join_small(sliced.withColumns(filled), carry, keys, "left")
            .withColumns({f: F.coalesce(f, f"_{f}") for f in features})
            .drop("_slice", *[f"_{f}" for f in features]))


def impute(df: DataFrame, features: list[str], strategy: str, train: DataFrame | None = None,
           entity: str | None = None, order: list[str] | None = None,
           slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Fill nulls by the training ``mean``/``median``, or by ``locf`` inside each entity."""
    if strategy == "locf":
        return carry_forward(df, features, entity, order, slice_rows)
    return fit_imputer(df if train is None else train, features, strategy).transform(df)


@dataclass(frozen=True)
class LabelModel:
    """Class names with their index, as a table: there may be as many as rows."""

    col: str
    names: DataFrame
    unseen: str = "error"

    def transform(self, df: DataFrame, out: str = "label") -> DataFrame:
        """Add the index. A null name has a null index; a name that was not fitted is an error, or null."""
        known = self.names.select(F.col("name").alias(self.col), F.col("nr").alias("_nr"))
        joined = join_small(df, known, [self.col], "left")
        found = F.col("_nr").cast("int")
        if self.unseen == "error":
            found = F.when(F.col(self.col).isNotNull() & found.isNull(),
                           F.raise_error(F.concat(F.lit("unknown class "), F.col(self.col).cast("string"))).cast("int")).otherwise(found)
        return joined.withColumn(out, found).drop(*({"_nr"} - {out}))


def fit_labels(df: DataFrame, col: str, unseen: str = "error") -> LabelModel:
    """Class names in ascending order, numbered from 0 without gaps.

    Names are range-partitioned and numbered inside their partition, after those of the partitions
    before: nothing but a count per partition reaches the driver, however many classes there are.
    """
    if unseen not in ("error", "null"):
        raise ValueError(f"unknown rule {unseen}")
    names = df.select(F.col(col).alias("name")).filter("name IS NOT NULL").distinct()
    return LabelModel(col, ordered_numbers(names, ["name"], "nr"), unseen)


def encode_label(df: DataFrame, col: str, model: LabelModel | None = None, out: str = "label") -> DataFrame:
    """Class name to a dense index from 0; null stays null."""
    return (model or fit_labels(df, col)).transform(df, out)


def class_profile(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, share of all rows, and ratio to the largest class. Totals come from an
    aggregate over the class counts, so that no task holds all classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = counts.agg(F.struct(F.sum("n").alias("sum"), F.max("n").alias("max")).alias("t")).select("t").scalar()
    return counts.withColumn("share", F.col("n") / every["sum"]).withColumn("ratio", F.col("n") / every["max"])


@dataclass(frozen=True)
class ScaleModel:
    """Per-feature shift and width fitted on training rows, with the training range."""

    features: list[str]
    shift: list[float]
    width: list[float]
    low: list[float]
    high: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Scale; a feature that is constant in training becomes 0."""
        return df.withColumns({
            f: ((F.col(f) - F.lit(m)) / F.lit(w)) if w else F.col(f) * F.lit(0.0)
            for f, m, w in zip(self.features, self.shift, self.width)})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: F.col(f) * F.lit(w) + F.lit(m)
                               for f, m, w in zip(self.features, self.shift, self.width)})

    def clip(self, df: DataFrame) -> DataFrame:
        """Hold each unscaled feature inside its training range; null stays null."""
        def held(f: str, lo: float, hi: float) -> Column:
            return F.when(F.col(f).isNotNull(), F.greatest(F.least(f, F.lit(hi)), F.lit(lo)))
        return df.withColumns({f: held(f, lo, hi) for f, lo, hi
                               in zip(self.features, self.low, self.high)})


def fit_scale(train: DataFrame, features: list[str], kind: str = "zscore") -> ScaleModel:
    """``zscore`` (sample deviation) or ``minmax``; one aggregate, one row to the driver."""
    if kind not in ("zscore", "minmax"):
        raise ValueError(f"unknown scaling {kind}")
    stats = []
    for f in features:
        value = F.col(f).cast("double")
        stats.append(F.array(F.avg(value), F.stddev_samp(value), F.min(value), F.max(value)))
    rows = train.agg(F.array(*stats).alias("s")).first()["s"]
    for f, (mean, _, _, _) in zip(features, rows):
        if mean is None:
            raise ValueError(f"feature {f} has no value to fit on")
    low, high = [r[2] for r in rows], [r[3] for r in rows]
    if kind == "zscore":
        return ScaleModel(list(features), [r[0] for r in rows], [r[1] or 0.0 for r in rows],
                          low, high)
    return ScaleModel(list(features), low, [h - lo for lo, h in zip(low, high)], low, high)


def scale(df: DataFrame, features: list[str], kind: str = "zscore",
          train: DataFrame | None = None) -> DataFrame:
    """Fit on ``train`` (or ``df``) and scale ``df``."""
    return fit_scale(df if train is None else train, features, kind).transform(df)


def unscale(df: DataFrame, model: ScaleModel) -> DataFrame:
    """Inverse of ``scale``."""
    return model.inverse(df)
