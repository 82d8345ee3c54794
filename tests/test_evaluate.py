import math

import pytest
from pyspark.sql import functions as F

from longitab.operators import evaluate as ev
from longitab.operators import sequences as sq
from longitab.operators import synthesis as sy
from longitab.plans.experiment import Config, run_experiment, sequence_gain
from longitab.sources.records import read_phase, visit_schema
from planted import ar_order


def score(pred, metric="balanced_accuracy"):
    rows = ev.class_metrics(ev.confusion(pred)).filter("label IS NULL").collect()
    return {r["metric"]: r["value"] for r in rows}[metric]


def test_metrics_by_hand(spark):
    cells = spark.createDataFrame([(0, 0, 6), (0, 1, 2), (1, 1, 1), (1, 2, 1), (0, 2, 0)], "label int, prediction int, n bigint")
    got = {(r["metric"], r["label"]): r["value"] for r in ev.class_metrics(cells).collect()}
    assert math.isclose(got[("precision", 0)], 1.0) and math.isclose(got[("recall", 0)], 0.75)
    assert math.isclose(got[("precision", 1)], 1 / 3) and got[("precision", 2)] == 0 and got[("recall", 2)] == 0
    assert math.isclose(got[("accuracy", None)], 0.7)
    assert math.isclose(got[("balanced_accuracy", None)], (0.75 + 0.5) / 2)
    assert math.isclose(got[("macro_f1", None)], (12 / 14 + 2 / 5) / 2)


def test_compare(spark):
    df = spark.createDataFrame([("M3", "accuracy", 0.5), ("M4", "accuracy", 0.57), ("M1", "accuracy", 0.9),
                                ("M3", "macro_f1", 0.0), ("M4", "macro_f1", 0.1)], "model string, metric string, value double")
    got = {r["metric"]: r for r in ev.compare(df, "M3", "M4").collect()}
    assert math.isclose(got["accuracy"]["points"], 0.07) and math.isclose(got["accuracy"]["relative"], 0.14)
    assert got["macro_f1"]["relative"] is None


def test_centroid(spark):
    train = spark.createDataFrame([(3, [0.0, 0.0]), (3, [0.0, 2.0]), (8, [10.0, 1.0])], "label int, features array<double>")
    test = spark.createDataFrame([(3, [4.9, 1.0]), (3, [5.1, 1.0]), (8, [5.0, 1.0])], "label int, features array<double>")
    pred = ev.tstr(ev.centroid(), train, test).orderBy("features").collect()
    assert [r["prediction"] for r in pred] == [3, 3, 8]


@pytest.fixture(scope="module")
def planted(spark):
    seqs = ar_order(spark, 3000).withColumn("side", F.when(F.col("entity_id") < 2000, "train").otherwise("test"))
    return seqs.cache()


def test_order_is_needed(spark, planted):
    """The class shows only in the order of visits: last-visit models stay at chance."""
    train, test = planted.filter("side = 'train'"), planted.filter("side = 'test'")
    plan = spark.createDataFrame([(c, 800) for c in range(3)], "label int, target bigint")
    synth = sy.populate(spark, sy.fit_sequence_model(train, pooled=False), plan, 5).rows
    settings = dict(layers=(12,), max_iter=60)
    static = score(ev.tstr(ev.mlp(**settings), sq.static_features(synth), sq.static_features(test)))
    order = score(ev.tstr(ev.sequence_mlp(**settings), sq.sequence_features(synth), sq.sequence_features(test)))
    assert abs(static - 1 / 3) < 0.1
    assert order > 0.65


def test_mlp_repeats(spark, planted):
    data = sq.sequence_features(planted)
    runs = [ev.confusion(ev.trtr(ev.mlp(layers=(4,), max_iter=10), data)).orderBy("label", "prediction").collect()
            for _ in range(2)]
    assert runs[0] == runs[1] and sum(r["n"] for r in runs[0]) == 1000


def test_experiment(spark, tmp_path):
    visits = sq.unpack_sequences(ar_order(spark, 700), ["a"], ["entity_id", "label"]).withColumn(
        "b", F.col("a") * 2 + F.col("step"))
    path = str(tmp_path / "phases")
    cfg = Config(features=["a", "b"], n=400, k=2, max_len=6, pooled=False, hidden=(8,), max_iter=40, path=path)
    results = run_experiment(visits, cfg).cache()
    rows = {(r["model"], r["metric"]): r["value"] for r in results.filter("label IS NULL").collect()}
    assert {m for m, _ in rows} == {"M1", "M2", "M3", "M4"}
    assert rows[("M4", "balanced_accuracy")] > rows[("M3", "balanced_accuracy")] + 0.1
    assert set(r["metric"] for r in sequence_gain(results).collect()) == {"accuracy", "balanced_accuracy", "macro_f1"}
    stored = spark.read.parquet(path)
    assert {r["phase"] for r in stored.select("phase").distinct().collect()} == {"phase1", "phase2"}
    assert stored.filter("phase = 'phase2'").select("entity_id").distinct().count() == 400
    assert visit_schema(["a"]).names[0] == "entity_id" and read_phase


def test_softmax_rounds_run_on_few_partitions(spark, monkeypatch):
    """A round over a few rows is one task, however many partitions they came in, with the same weights."""
    df = spark.range(400).select((F.col("id") % 3).cast("int").alias("label"),
                                 F.array((F.col("id") % 3 + F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("features"))
    plain, parts = ev.Softmax._gradient, []
    monkeypatch.setattr(ev.Softmax, "_gradient", staticmethod(lambda rows, *a: (parts.append(rows.rdd.getNumPartitions()), plain(rows, *a))[1]))
    many, one = (ev.softmax(rounds=3).fit(df.repartition(k)).layers[0] for k in (24, 1))
    assert parts == [1] * 6
    assert all(abs(a - b).max() < 1e-12 for a, b in zip(many, one))
