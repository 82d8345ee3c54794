"""Classifiers, train/test runs, and scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from longitab.functions.small import small_rows
from longitab.operators.moments import grouped_moments, vectors


#: Bytes of training rows that one task takes in a step of the optimiser.
STEP_BYTES = 8 << 20


class Perceptron:
    """Scaled features into ``MultilayerPerceptronClassifier``.

    ``hidden`` are the hidden layer widths; input and output widths come from the data, with
    labels dense from 0.
    """

    def __init__(self, features: str = "features", hidden=(16,), seed: int = 42,
                 max_iter: int = 100, label: str = "label", classes: int | None = None):
        self.features, self.hidden, self.seed = features, list(hidden), seed
        self.max_iter, self.label, self.classes = max_iter, label, classes

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_raw", array_to_vector(F.col(self.features).cast("array<double>")))

    def pipeline(self, width: int, classes: int) -> Estimator:
        return Pipeline(stages=[
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
            MultilayerPerceptronClassifier(
                featuresCol="_x", labelCol=self.label, predictionCol="_p",
                layers=[width, *self.hidden, classes], seed=self.seed, maxIter=self.max_iter)])

    def fit(self, train: DataFrame):
        """The optimiser rereads the rows on every step, so they are held while it runs, in as many
        partitions as their size is worth: a step of a few rows is one task."""
        rows = self._vectors(train.select(self.label, self.features)).select(self.label, "_raw")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            width = len(rows.select("_raw").first()["_raw"])
            n, most = rows.agg(F.count("*"), F.max(self.label)).first()
            parts = max(1, -(-n * width * 8 // STEP_BYTES))
            model = self.pipeline(width, self.classes or most + 1).fit(rows.coalesce(parts))
        finally:
            rows.unpersist()
        return Fitted(lambda df: model.transform(self._vectors(df))
                      .withColumn("prediction", F.col("_p").cast("int")), self._layers(model))

    @staticmethod
    def _layers(model) -> list:
        """Matrices and biases, with the scaling in the first layer."""
        scaling, network = model.stages
        sizes, flat = network.getLayers(), network.weights.toArray()
        out, at = [], 0
        for n_in, n_out in zip(sizes, sizes[1:]):
            matrix = flat[at:at + n_in * n_out].reshape(n_in, n_out).T
            at += n_in * n_out
            out.append((matrix, flat[at:at + n_out]))
            at += n_out
        std = scaling.std.toArray()
        scale = np.divide(1.0, std, out=np.zeros(len(std)), where=std > 0)
        matrix, bias = out[0]
        out[0] = matrix * scale, bias - matrix @ (scale * scaling.mean.toArray())
        return out


class Fitted:
    """A fitted classifier: ``predict`` adds ``prediction``; ``layers`` are its weights, if it has any:
    for each layer the matrix (units, inputs) and the bias."""

    def __init__(self, predict, layers: list | None = None):
        self.predict, self.layers = predict, layers


def weights_table(fitted: Fitted, spark) -> DataFrame:
    """``layer, unit, input, weight`` of a network from its raw features on, all from 0; the bias has
    ``input`` -1."""
    rows = [(k, i, j, float(w)) for k, (m, b) in enumerate(fitted.layers)
            for i in range(len(b)) for j, w in [*enumerate(m[i]), (-1, b[i])]]
    return spark.createDataFrame(rows, "layer int, unit int, input int, weight double")


def forward(df: DataFrame, weights: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
    """Predictions of a network from its ``weights_table``, as one expression per row: sigmoid units in
    the inner layers, the largest output unit, ties to the lower one. The table is small."""
    rows = small_rows(weights, 1_000_000)
    x = F.col(features).cast("array<double>")
    last = max(r["layer"] for r in rows)
    for k in range(last + 1):
        own = [r for r in rows if r["layer"] == k]
        units = 1 + max(r["unit"] for r in own)
        listed = [sorted((r["input"], r["weight"]) for r in own if r["unit"] == i) for i in range(units)]
        table = F.array(*[F.struct(F.lit(w[0][1]).alias("b"), F.array(*[F.lit(v) for _, v in w[1:]]).alias("w")) for w in listed])
        column = f"_layer{k}"
        df = df.withColumn(column, F.transform(table, lambda u: F.aggregate(F.zip_with(u["w"], x, lambda a, b: a * b), u["b"], lambda acc, v: acc + v)))
        if k < last:
            df = df.withColumn(column, F.transform(column, lambda z: 1 / (1 + F.exp(-z))))
        x = F.col(column)
    best = F.array_position(x, F.array_max(x)).cast("int") - 1
    return df.withColumn(out, best).drop(*[f"_layer{k}" for k in range(last + 1)])


def mlp(features: str = "features", layers=(16,), seed: int = 42, **settings) -> Perceptron:
    """Static classifier, for ``static_features``."""
    return Perceptron(features, layers, seed, **settings)


def sequence_mlp(features: str = "features", layers=(16,), seed: int = 42, **settings) -> Perceptron:
    """The same classifier for ``sequence_features``: only its input differs from ``mlp``."""
    return Perceptron(features, layers, seed, **settings)


class Softmax:
    """Softmax regression by full-gradient rounds, each a grouped sum over the training rows.

    The rows are held while it runs, in as many partitions as their size is worth. A task adds up the
    gradient of its rows; classes x features numbers a task are merged by an aggregate and reach the driver. Starts at zero, so nothing is drawn. Labels are dense from 0.
    """

    def __init__(self, features: str = "features", rounds: int = 50, rate: float = 0.5, label: str = "label", classes: int | None = None):
        self.features, self.rounds, self.rate, self.label, self.classes = features, rounds, rate, label, classes

    def fit(self, train: DataFrame) -> Fitted:
        rows = train.select(F.col(self.label).cast("int").alias("label"), F.col(self.features).cast("array<double>").alias("x"))
        rows = rows.filter("label IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, most = rows.agg(F.count("*"), F.max("label")).first()
            sums = small_rows(grouped_moments(rows, "x"))[0]
            p, classes = len(sums["mean"]), self.classes or most + 1
            mean = np.array(sums["mean"])
            std = np.sqrt(np.diag(np.array(sums["m2"]).reshape(p, p)) / max(n - 1, 1))
            scale = np.divide(1.0, std, out=np.zeros(p), where=std > 0)
            weight = np.zeros((classes, p + 1))
            held = rows.coalesce(max(1, -(-n * p * 8 // STEP_BYTES)))
            for _ in range(self.rounds):
                weight = weight - self.rate * self._gradient(held, mean, scale, weight) / n
        finally:
            rows.unpersist()
        matrix, bias = weight[:, :p] * scale, weight[:, p] - weight[:, :p] @ (scale * mean)

        @F.arrow_udf("int")
        def best(x: pa.Array) -> pa.Array:
            return pa.array((vectors(x) @ matrix.T + bias).argmax(axis=1).astype(np.int32)) if len(x) else pa.array([], pa.int32())

        column = F.col(self.features).cast("array<double>")
        return Fitted(lambda df: df.withColumn("prediction", best(column)), [(matrix, bias)])

    @staticmethod
    def _gradient(rows: DataFrame, mean, scale, weight) -> np.ndarray:
        classes, width = weight.shape

        def run(batches):
            total = np.zeros(weight.shape)
            for b in batches:
                if b.num_rows:
                    x = np.hstack([(vectors(b.column(1)) - mean) * scale, np.ones((b.num_rows, 1))])
                    z = x @ weight.T
                    z = np.exp(z - z.max(axis=1, keepdims=True))
                    z /= z.sum(axis=1, keepdims=True)
                    z[np.arange(b.num_rows), b.column(0).to_numpy()] -= 1.0
                    total += z.T @ x
            yield pa.record_batch({"at": pa.array(np.arange(total.size)), "g": pa.array(total.reshape(-1))})

        sums = rows.mapInArrow(run, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
        out = np.zeros(classes * width)
        for at, g in sums:
            out[at] = g
        return out.reshape(weight.shape)


def softmax(features: str = "features", rounds: int = 50, rate: float = 0.5, **settings) -> Softmax:
    """Linear classifier whose every round SQL can check."""
    return Softmax(features, rounds, rate, **settings)


class Centroid:
    """Nearest class mean. Fit is one grouped average; ties go to the lower label."""

    def __init__(self, features: str = "features", label: str = "label"):
        self.features, self.label = features, label

    def fit(self, train: DataFrame) -> Fitted:
        vector = array_to_vector(F.col(self.features).cast("array<double>"))
        means = train.groupBy(self.label).agg(Summarizer.mean(vector).alias("_m")).select(
            self.label, vector_to_array("_m").alias("mean"))
        rows = sorted(small_rows(means, 10_000), key=lambda r: r[self.label])
        labels = np.array([r[self.label] for r in rows], dtype=np.int32)
        centres = np.array([r["mean"] for r in rows])
        half = (centres**2).sum(axis=1) / 2

        @F.arrow_udf("int")
        def nearest(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.int32())
            return pa.array(labels[np.argmin(half - vectors(x) @ centres.T, axis=1)])

        column = F.col(self.features).cast("array<double>")
        return Fitted(lambda df: df.withColumn("prediction", nearest(column)))


def centroid(features: str = "features", label: str = "label") -> Centroid:
    """Baseline whose result SQL can check."""
    return Centroid(features, label)


def trtr(est, real: DataFrame, side: str = "side") -> DataFrame:
    """Train on the real ``train`` side, predict the real ``test`` side."""
    return tstr(est, real.filter(F.col(side) == "train"), real.filter(F.col(side) == "test"))


def tstr(est, train: DataFrame, real_test: DataFrame) -> DataFrame:
    """Train on any table (synthetic), predict the real test rows."""
    return est.fit(train).predict(real_test)


def confusion(pred: DataFrame, label: str = "label") -> DataFrame:
    """``label, prediction, n``."""
    return pred.groupBy(F.col(label).alias("label"), "prediction").agg(F.count("*").alias("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """``metric, label, value``: precision, recall and F1 per class (label set), then accuracy,
    balanced accuracy and macro F1 (label null).

    Averages run over the classes that occur as label; a ratio with nothing below it is 0.
    """
    hit = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"),
                 F.when(hit, F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("said"), F.lit(0).cast("long").alias("right")))
    ratio = lambda top, below: F.when(below > 0, top / below).otherwise(0.0)
    per = (cells.select(F.inline(sides)).groupBy("c")
           .agg(*[F.sum(x).alias(x) for x in ("actual", "said", "right")])
           .withColumn("precision", ratio(F.col("right"), F.col("said")))
           .withColumn("recall", ratio(F.col("right"), F.col("actual")))
           .withColumn("f1", ratio(2.0 * F.col("right"), F.col("said") + F.col("actual"))))
    by_class = per.select(F.col("c").cast("int").alias("label"), "precision", "recall", "f1").unpivot(
        ["label"], ["precision", "recall", "f1"], "metric", "value")
    occurs = F.col("actual") > 0
    overall = per.agg(
        (F.sum("right") / F.nullif(F.sum("actual"), F.lit(0))).alias("accuracy"),
        F.avg(F.when(occurs, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(occurs, F.col("f1"))).alias("macro_f1"))
    whole = overall.select(F.lit(None).cast("int").alias("label"), "*").unpivot(
        ["label"], ["accuracy", "balanced_accuracy", "macro_f1"], "metric", "value")
    return by_class.unionByName(whole).select("metric", "label", "value")


def compare(results: DataFrame, base: str, other: str) -> DataFrame:
    """Gap of ``other`` over ``base`` per metric: in points, and relative to ``base``."""
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    return (results.filter(F.col("model").isin(base, other)).groupBy("metric")
            .agg(at(base).alias("base_value"), at(other).alias("other_value"))
            .withColumn("points", F.col("other_value") - F.col("base_value"))
            .withColumn("relative", F.col("points") / F.nullif(F.col("base_value"), F.lit(0.0))))
