import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitab.operators import moments as mo
from longitab.operators import prepare as pr
from longitab.operators import projection as pj
from longitab.operators import sequences as sq
from longitab.operators import split as sp
from longitab.sources.records import bad_rows, read_phase, read_records, visit_schema, write_phase
from planted import wide55


def test_bad_csv_rows_are_kept(spark, tmp_path):
    lines = ["entity_id,step,visit_ts,label,f1", "1,1,2024-01-01T00:00:00,0,1.5", "2,1,2024-01-01T00:00:00,0,oops",
             "3,1,,1,2.5", "4,1,2024-01-02T00:00:00,1,3.5,extra"]
    path = os.path.join(tmp_path, "v.csv")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    df = read_records(spark, path, visit_schema(["f1"])).cache()
    rows = {r["entity_id"]: r for r in df.collect()}
    assert len(rows) == 4
    assert rows[2]["f1"] is None and "oops" in rows[2]["_corrupt_record"]
    assert rows[3]["visit_ts"] is None and rows[3]["_corrupt_record"] is None
    assert rows[4]["_corrupt_record"] is not None
    assert bad_rows(df).count() == 2
    fresh = read_records(spark, path, visit_schema(["f1"]))  # not cached
    assert bad_rows(fresh).count() == 2
    assert sorted(r[0] for r in bad_rows(fresh).select("entity_id").collect()) == [2, 4]
    with pytest.raises(ValueError):
        read_records(spark, path, visit_schema([]), "xml")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_phase_hand_over(spark, tmp_path, fmt):
    path = os.path.join(tmp_path, "phases")
    df = spark.createDataFrame([(1, 0.5, 0), (2, 1.5, 1), (3, None, 1)], "entity_id bigint, f1 double, label int")
    write_phase(df, path, "phase1", fmt)
    write_phase(df, path, "phase2", fmt)
    write_phase(df.filter("label = 1"), path, "phase2", fmt)
    with pytest.raises(ValueError):
        write_phase(df, path, "../phase3", fmt)
    assert read_phase(spark, path, "phase1", df.schema, fmt).count() == 3
    back = read_phase(spark, path, "phase2", df.schema, fmt)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == [(2, 1.5, 1), (3, None, 1)]
    assert "PartitionFilters: [isnotnull(phase" in back._jdf.queryExecution().toString()


def test_dates_from_text(spark):
    df = spark.createDataFrame([(1, 1, "02/01/2024"), (2, 1, "01/01/2024"), (3, 1, "bad")], "id int, e int, d string")
    out = {r["id"]: r["step"] for r in pr.order_visits(df, "e", "d", "id", fmt="dd/MM/yyyy").collect()}
    assert out == {3: 1, 2: 2, 1: 3}


def test_impute_uses_train_only(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "f double")
    train = spark.createDataFrame([(10.0,), (20.0,), (60.0,)], "f double")
    assert [r[0] for r in pr.impute(df, ["f"], "mean", train=train).collect()] == [1.0, 3.0, 30.0]
    assert [r[0] for r in pr.impute(df, ["f"], "median", train=train).collect()] == [1.0, 3.0, 20.0]


def test_labels_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "name string")
    assert {r["name"]: r["label"] for r in pr.encode_label(df, "name").collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("kind", ["zscore", "minmax"])
def test_scaling_there_and_back(spark, kind):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0), (None, 5.0)], "a double, b double")
    model = pr.fit_scale(df, ["a", "b"], kind)
    scaled = model.transform(df)
    assert [r["b"] for r in scaled.collect()] == [0.0] * 4
    back = [tuple(r) for r in pr.unscale(scaled, model).collect()]
    assert back[3] == (None, 5.0)
    assert np.allclose([b[0] for b in back[:3]], [1, 2, 6])
    far = spark.createDataFrame([(99.0, 9.0), (None, 1.0)], "a double, b double")
    assert [tuple(r) for r in model.clip(far).collect()] == [(6.0, 5.0), (None, 5.0)]


def test_covariance_far_from_zero(spark):
    x = wide55(60, 3, 4) + 1e7
    df = spark.createDataFrame([(i % 2, *map(float, r)) for i, r in enumerate(x)],
                               "g int, a double, b double, c double, d double")
    for parts in (1, 3, 8):
        rows = mo.covariance(df.repartition(parts), list("abcd"), by="g").collect()
        assert len(rows) == 20
        for r in rows:
            want = np.cov(x[r["g"]::2].T)["abcd".index(r["feature_i"]), "abcd".index(r["feature_j"])]
            assert math.isclose(r["cov"], want, rel_tol=1e-6, abs_tol=1e-6)


def test_pca(spark):
    x = wide55()
    names = [f"f{i}" for i in range(55)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                               T.StructType([T.StructField("id", T.LongType())]
                                            + [T.StructField(n, T.DoubleType()) for n in names]))
    model = pj.pca_fit(df, names, k=39)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert np.allclose(model.share, values[:39] / values.sum(), atol=1e-9)
    assert np.allclose(model.axes.T @ model.axes, np.eye(39), atol=1e-9)
    back = pj.pca_inverse(pj.pca_transform(df, model), model).orderBy("id").select(*names).toPandas().to_numpy()
    lost = (((x - back) / x.std(0, ddof=1)) ** 2).sum() / (len(x) - 1)
    assert math.isclose(lost, values[39:].sum(), rel_tol=1e-6, abs_tol=1e-9)
    assert pj.pca_fit(df, names, share=0.999).k <= 39
    assert model.share.sum() > 0.999
    shares = pj.explained_variance(model, spark).orderBy("component").collect()
    assert math.isclose(shares[-1]["running_share"], model.share.sum())
    with pytest.raises(ValueError):
        pj.pca_fit(df, names)


def visits(spark):
    rows = [(1, 2, 0, 1.0, 10.0), (1, 1, 0, 2.0, 20.0), (1, 3, 0, 4.0, 40.0), (2, 1, 1, 7.0, 70.0)]
    return spark.createDataFrame(rows, "e int, t int, label int, a double, b double")


def test_pack_and_unpack(spark):
    seqs = sq.pack_sequences(visits(spark), "e", ["t"], ["a", "b"], 2, "label")
    got = {r["e"]: r for r in seqs.collect()}
    assert got[1]["seq"] == [[2.0, 20.0], [1.0, 10.0]] and got[1]["len"] == 2
    assert got[2]["seq"] == [[7.0, 70.0], [0.0, 0.0]] and got[2]["mask"] == [True, False]
    last = {r["e"]: r for r in sq.pack_sequences(visits(spark), "e", ["t"], ["a"], 2, keep="last").collect()}
    assert last[1]["seq"] == [[1.0], [4.0]]
    wide = sq.pack_sequences(visits(spark), "e", ["t"], ["a", "b"], 4, "label")
    back = sq.unpack_sequences(wide, ["a", "b"], ["e", "label"])
    assert sorted(tuple(r) for r in back.select("e", "step", "label", "a", "b").collect()) == sorted(
        tuple(r) for r in visits(spark).collect())


def test_null_stays_under_mask(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 3.0)], "e int, t int, a double")
    row = sq.pack_sequences(df, "e", ["t"], ["a"], 3).first()
    assert row["seq"] == [[None], [3.0], [0.0]] and row["mask"] == [True, True, False]


def test_sequence_features(spark):
    seqs = sq.pack_sequences(visits(spark), "e", ["t"], ["a", "b"], 4, "label")
    got = {r["e"]: r["features"] for r in sq.sequence_features(seqs).collect()}
    flat = [2, 20, 1, 10, 4, 40, 0, 0]
    diff = [-1, -10, 3, 30, 0, 0]
    assert got[1] == pytest.approx(flat + diff + [1.0, 10.0] + [(2 * 1 + 1 * 4) / 2, (200 + 400) / 2])
    assert got[2] == pytest.approx([7, 70] + [0] * 6 + [0] * 6 + [0, 0, 0, 0])
    one = sq.sequence_features(sq.pack_sequences(visits(spark), "e", ["t"], ["a"], 1)).collect()
    assert all(len(r["features"]) == 3 for r in one)
    assert {r["e"]: r["features"] for r in sq.static_features(seqs).collect()} == {1: [4.0, 40.0], 2: [7.0, 70.0]}


def test_splits(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    for parts in (1, 5):
        rows = sp.split_rows(df.repartition(parts), "id", "label", 0.7)
        got = {(r["label"], r["side"]): r["count"] for r in rows.groupBy("label", "side").count().collect()}
        assert got == {(0, "train"): 630, (0, "test"): 270, (1, "train"): 70, (1, "test"): 30}
    approx = sp.split_rows(df, "id", "label", 0.7, exact=False).filter("side = 'train'").count()
    assert 640 < approx < 760
    entities = sp.split_entities(df.withColumn("e", F.col("id") % 50), "e")
    assert entities.groupBy("e").agg(F.countDistinct("side").alias("n")).filter("n > 1").count() == 0
