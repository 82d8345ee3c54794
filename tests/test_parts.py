"""Ragged parts, order features, medians, axes and the hashed neighbour search."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from longitab.functions.draws import normals, step_normals
from longitab.functions.quantiles import medians
from longitab.operators import evaluate as ev
from longitab.operators import neighbours as nb
from longitab.operators import projection as pj
from longitab.operators import sequences as sq
from longitab.operators import synthesis as sy
from planted import ar_order


@pytest.fixture(scope="module")
def model(spark):
    return sy.fit_sequence_model(ar_order(spark, 1200), pooled=False)


def flat(drawn):
    return {(r["entity_id"], r["step"]): r["x"] for r in sq.unpack_sequences(drawn, keep=["entity_id"], out="x").collect()}


def test_draws_in_pieces():
    ids = np.arange(40)
    whole = step_normals(3, ids, 0, 30, 3)
    assert np.array_equal(np.concatenate([step_normals(3, ids, a, b - a, 3) for a, b in ((0, 1), (1, 12), (12, 30))], axis=1), whole)
    assert abs(whole.mean()) < 0.05 and abs(whole.std() - 1) < 0.05 and whole.shape == (40, 30, 3)


def test_same_draws_for_any_part_length(spark, model):
    lengths = [sorted({1, 2, 5, 40}), [3], [7, 64]]
    uneven = sy.SequenceModel(**{**model.__dict__, "lengths": lengths, "length_share": [[0.25, 0.5, 0.75, 1.0], [1.0], [0.5, 1.0]], "max_len": 64})
    runs = [sy.synthesize(spark, uneven, 300, 5, part_len=n) for n in (2, 7, 64)]
    got = [flat(r) for r in runs]
    assert got[0] == got[1] == got[2] == flat(sy.synthesize(spark, uneven, 300, 5))
    assert runs[1].agg(F.max("len")).first()[0] == 7
    stored = sum(r["n"] for r in runs[1].select((F.size("seq") - F.col("context")).alias("n")).collect())
    assert stored == len(got[0])  # only real visits are drawn, nothing is filled
    again = sy.fit_sequence_model(runs[1], pooled=False)
    assert again.max_len == 64 and np.allclose(again.mean_len, uneven.mean_len, rtol=0.15)


def test_a_long_entity_leaves_other_rows_short(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id") % 500).alias("e"), F.col("id").alias("t"),
                                    F.sin("id").alias("x"), F.lit(1).alias("label"))
    whole = sq.pack_sequences(rows, "e", ["t"], ["x"], label="label")
    assert whole.filter("e > 0").agg(F.max(F.size("seq"))).first()[0] == 4
    parts = sq.pack_parts(rows, "e", ["t"], ["x"], 16, "label", slice_rows=300)
    assert parts.agg(F.max(F.size("seq"))).first()[0] == 16
    back = sq.unpack_sequences(parts, ["x"], ["e"]).collect()
    want = {(r["e"], r["x"]) for r in rows.collect()}
    assert len(back) == 3000 and {(r["e"], r["x"]) for r in back} == want
    assert sorted(r["step"] for r in back if r["e"] == 0)[-1] == whole.filter("e = 0").first()["len"]
    last = {r["e"]: r["features"] for r in sq.static_features(parts).collect()}
    assert last == {r["e"]: r["features"] for r in sq.static_features(whole).collect()}


def by_hand(x, pairs):
    x, n = np.array(x), len(x)
    d, p = np.diff(x, axis=0), np.array(x).shape[1]
    steps = max(n - 1, 1)
    area, square = np.zeros((p, p)), np.zeros((p, p))
    for t in range(n - 1):
        area += np.outer(x[t] - x[0], d[t])
        square += np.outer(d[t], d[t])
    i, j = np.triu_indices(p) if pairs == "all" else (np.arange(p), np.arange(p))
    area = area.reshape(-1) if pairs == "all" else np.diag(area)
    return np.concatenate([x.mean(axis=0), x[-1], d.sum(axis=0) / steps, area / steps, square[i, j] / steps])


@pytest.mark.parametrize("pairs", ["all", "own"])
def test_order_features_by_hand(spark, pairs):
    rng = random.Random(4)
    series = {e: [[rng.gauss(2, 1) for _ in range(3)] for _ in range(n)] for e, n in ((1, 1), (2, 2), (3, 9), (4, 50))}
    rows = spark.createDataFrame([(e, t, 1, *x) for e, xs in series.items() for t, x in enumerate(xs)], "e int, t int, label int, a double, b double, c double")
    want = {e: by_hand(x, pairs) for e, x in series.items()}
    sources = [sq.pack_parts(rows, "e", ["t"], ["a", "b", "c"], n, "label") for n in (2, 5, 100)]
    sources += [sq.pack_sequences(rows, "e", ["t"], ["a", "b", "c"], label="label"), sq.pack_sequences(rows, "e", ["t"], ["a", "b", "c"], label="label", pad=True)]
    for seqs in sources:
        got = {r["e"]: r["features"] for r in sq.order_features(seqs, pairs=pairs).collect()}
        assert set(got) == set(want) and all(np.allclose(got[e], want[e]) for e in want)
    assert len(want[1]) == (24 if pairs == "all" else 15)
    assert sq.order_features(sources[0].filter("e > 9")).collect() == []
    with pytest.raises(Exception, match="null"):
        sq.order_features(sq.pack_parts(rows.withColumn("a", F.lit(None).cast("double")), "e", ["t"], ["a"], 5)).collect()


def test_order_is_seen_by_fixed_width(spark):
    seqs = ar_order(spark, 3000)
    data = sq.order_features(seqs.withColumn("side", F.when(F.col("entity_id") < 2000, "train").otherwise("test")))
    cells = ev.class_metrics(ev.confusion(ev.trtr(ev.mlp(layers=(12,), max_iter=60), data))).filter("label IS NULL").collect()
    assert {r["metric"]: r["value"] for r in cells}["balanced_accuracy"] > 0.65


def test_medians(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, float("nan"), 1.0, 2.0, rng.gauss(0, 9)]), 5.0, None, float(i)) for i in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    known = [r[0] for r in rows if r[0] is not None and not math.isnan(r[0])]
    assert medians(df.repartition(5), list("abcd")) == {"a": statistics.median(known), "b": 5.0, "c": None, "d": 250.0}
    two = spark.createDataFrame([(1.0,), (4.0,)], "a double")
    assert medians(two, ["a"]) == {"a": 2.5} and medians(two.limit(0), ["a"]) == {"a": None}


def test_axes_equal_numpy_in_one_scan(spark):
    x = normals(3, np.arange(300), 4) @ normals(4, np.arange(4), 4)
    df = spark.createDataFrame([(i, *map(float, r), 7.0) for i, r in enumerate(x)], "id int, a double, b double, c double, d double, e double")
    model = pj.pca_fit(df, list("abcde"), k=4)
    values, axes = np.linalg.eigh(np.corrcoef(x.T))
    assert np.allclose(model.share, values[::-1] / 4) and np.allclose(np.abs(model.axes[:4]), np.abs(axes[:, ::-1]))
    assert np.allclose(model.axes[4], 0) and (model.axes[0] > 0).all()
    scores = np.array([r["components"] for r in pj.pca_transform(df, model).orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(scores, z @ model.axes[:4])
    assert np.allclose(np.array([[r[c] for c in "abcde"] for r in pj.pca_inverse(pj.pca_transform(df, model), model).orderBy("id").collect()])[:, :4], x)


def clustered(n, d, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(40, d))[rng.integers(0, 40, n)] * 4 + rng.normal(size=(n, 3)) @ rng.normal(size=(3, d))


def test_hashed_neighbours_recall(spark):
    x = clustered(4000, 12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    real, synth = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    points = nb.settle(nb.distinct_points(real, synth, "x"))
    names = {tuple(r["x"]): r["point"] for r in points.collect()}
    name = [names[tuple(v.tolist())] for v in x]
    got = {(r["point"], r["other"]) for r in nb.hashed_neighbours(points, 4000, 5, 8, 256).collect()}
    hits = 0
    for i in range(0, 4000, 40):
        d = ((x - x[i]) ** 2).sum(axis=1)
        hits += sum((name[i], name[j]) in got for j in np.argsort(d)[1:6])
    assert hits >= 0.9 * 500
    exact = {r["source"]: r["same_share"] for r in nb.neighbour_mix(real, synth, "x", 5, 256).collect()}
    hashed = {r["source"]: r["same_share"] for r in nb.neighbour_mix(real, synth, "x", 5, 256, tables=8).collect()}
    assert all(abs(exact[s] - hashed[s]) < 0.02 for s in exact)


def test_hashed_neighbours_of_copies_and_few_points(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)] + [(100, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    real, synth = df.filter("id < 30"), df.filter("id >= 30")
    exact = sorted(tuple(r) for r in nb.neighbour_mix(real, synth, "x", 5).collect())
    assert sorted(tuple(r) for r in nb.neighbour_mix(real, synth, "x", 5, tables=3).collect()) == exact


def gappy(spark, n=1500, steps=6, share=0.2):
    """Planted sequences of two features, the second half the first one's last value, with missing entries."""
    rng = np.random.default_rng(5)
    a = np.array([[0.6, 0.0], [0.5, 0.2]])
    rows = []
    for e in range(n):
        x, seq = rng.normal(size=2), []
        for _ in range(steps + e % 5):
            x = np.array([1.0, -0.5]) + a @ x + rng.normal(size=2) * [0.5, 0.3]
            seq.append([None if rng.random() < share else float(v) for v in x])
        rows += [(e, t, e % 2, *v) for t, v in enumerate(seq)]
    return a, spark.createDataFrame(rows, "e int, t int, label int, a double, b double")


@pytest.mark.parametrize("part_len", [4, 64])
def test_dynamics_come_back_with_missing_entries(spark, part_len):
    a, rows = gappy(spark)
    parts = sq.pack_parts(rows, "e", ["t"], ["a", "b"], part_len, "label").cache()
    model = sy.fit_sequence_model(parts, rounds=15)
    assert np.allclose(model.transition[0], a, atol=0.05)
    noise = model.noise_root @ model.noise_root.transpose(0, 2, 1)
    assert np.allclose(noise[0], np.diag([0.25, 0.09]), atol=0.03) and np.allclose(model.intercept, [1.0, -0.5], atol=0.12)
    again = sy.fit_sequence_model(parts.repartition(3), rounds=15)
    assert np.allclose(again.transition, model.transition, atol=1e-8)


def test_rounds_change_nothing_without_missing_entries(spark):
    seqs = ar_order(spark, 400)
    one, two = sy.fit_sequence_model(seqs, pooled=False), sy.fit_sequence_model(seqs, pooled=False, rounds=3)
    assert np.allclose(one.transition, two.transition) and np.allclose(one.noise_root, two.noise_root) and np.allclose(one.start_mean, two.start_mean)


def test_conditional_normal():
    cov = np.array([[2.0, 0.6, 0.2], [0.6, 1.0, 0.3], [0.2, 0.3, 1.5]])
    mean, x = np.array([1.0, 2.0, 3.0]), np.array([[np.nan, 2.5], [1.0, np.nan], [np.nan, np.nan], [0.0, 1.0]])
    m, v = sy._given(np.tile(mean, (4, 1)), np.tile(cov, (4, 1, 1)), x, 1)
    assert np.allclose(m[0, 0], 1 + 0.2 / 1.5 * (2.5 - 3)) and np.allclose(v[0, 0, 0], 2 - 0.04 / 1.5) and np.allclose(m[2], mean)
    gain = cov[0, 1:] @ np.linalg.inv(cov[1:, 1:])
    assert np.allclose(m[3], [1 + gain @ (x[3] - mean[1:]), 0, 1]) and np.allclose(v[3, 0, 0], 2 - gain @ cov[1:, 0]) and not v[3, 1:].any()


def test_split_records(spark, tmp_path):
    from pyspark.sql import types as T

    from longitab.sources.records import split_records
    (tmp_path / "in.csv").write_text('id,x,d,s\n1,2.5,2024-01-02,a\n2,abc,2024-01-02,b\n3,,,"q, ""r"""\n4,1,2024-13-40,c,extra\n5,7\n6,,2024-01-02,\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("d", T.DateType()), T.StructField("s", T.StringType())])
    good, bad = split_records(spark, str(tmp_path / "in.csv"), schema, str(tmp_path / "out"), ["d"], escape='"')
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 6] and good.schema.names == schema.names
    got = {r["line"].split(",")[0]: sorted((x["column"], x["kind"]) for x in r["reasons"]) for r in bad.collect()}
    assert got == {"2": [("x", "bad_value")], "3": [("d", "missing")], "4": [("*", "field_count"), ("d", "bad_value")],
                   "5": [("*", "field_count"), ("d", "missing")]}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_labels_of_many_classes(spark):
    from longitab.operators import prepare as pr
    df = spark.createDataFrame([(f"n{i % 700:04d}" if i % 9 else None,) for i in range(5000)], "name string")
    names = sorted({r["name"] for r in df.collect() if r["name"]})
    got = {(r["name"], r["label"]) for r in pr.encode_label(df, "name").collect()}
    assert got == {(n, i) for i, n in enumerate(names)} | {(None, None)}
    other = spark.createDataFrame([("n0001",), ("zz",), (None,)], "name string")
    assert [r["label"] for r in pr.fit_labels(df, "name", "null").transform(other).orderBy("name").collect()] == [None, 1, None]
    with pytest.raises(Exception, match="unknown class zz"):
        pr.fit_labels(df, "name").transform(other).collect()
    assert pr.encode_label(df.limit(0), "name").collect() == []


def test_plan_over_many_classes(spark):
    from test_synthesis import plan_by_hand
    counts = {i: 1 + i % 7 for i in range(900)}
    df = spark.createDataFrame([(c, v / sum(counts.values())) for c, v in counts.items()], "label int, share double")
    for n, mode, lam in ((1000, "proportional", 0.0), (4321, "near_balanced", 0.9), (450, "near_balanced", 1.0), (0, "proportional", 0.0)):
        got = {r["label"]: r["target"] for r in sy.class_plan(df, n, mode, lam).collect()}
        assert got == plan_by_hand(counts, n, lam) and sum(got.values()) == n


def test_phase_report_equals_single_reports(spark):
    from longitab.operators import fidelity as fi
    rng = random.Random(8)
    rows = [(p, rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(0, 1), 1.0])) for p in ("real", "p1", "p2") for _ in range(300)]
    df = spark.createDataFrame(rows, "phase string, label string, x double")
    real, synth = df.filter("phase = 'real'").drop("phase"), df.filter("phase <> 'real'")
    got = {(r["phase"], r["level"], r["label"]): (r["n1"], r["n0"], r["nulls"], round(r["d"], 12)) for r in fi.phase_ks_report(real, synth, ["x"]).collect()}
    want = {}
    for p in ("p1", "p2"):
        own = synth.filter(F.col("phase") == p)
        one = fi.ks_statistic(real, own, ["x"]).collect() + fi.ks_statistic(real, own, ["x"], ["label"]).collect()
        want |= {(p, "class" if i else "phase", r["label"] if i else None): (r["n1"], r["n0"], r["nulls"], round(r["d"], 12)) for i, r in enumerate(one)}
    assert got == want
    levels = fi.ks_statistic(synth.withColumn("y", F.col("x")), synth.filter("x > 0").withColumn("y", F.col("x")), ["x", "y"], ["phase", "label"], [["phase"], []])
    assert {(r["level"], r["phase"], r["feature"]) for r in levels.collect()} == {(l, p, f) for f in "xy" for l, p in (("phase", "p1"), ("phase", "p2"), ("all", None))}


def test_forward_pass_from_weights(spark):
    import duckdb
    data = spark.createDataFrame([(i, int(abs(v[0]) + v[1] > 1), [float(x) for x in v]) for i, v in enumerate(normals(5, np.arange(300), 4))],
                                 "id int, label int, features array<double>")
    for est in (ev.mlp(layers=(5, 3), max_iter=30), ev.softmax(rounds=20)):
        fitted = est.fit(data)
        weights = ev.weights_table(fitted, spark)
        again = ev.forward(fitted.predict(data), weights, out="again")
        assert again.filter("prediction <> again").count() == 0 and again.columns[-2:] == ["prediction", "again"]
        w, x = weights.toPandas(), fitted.predict(data).toPandas()
        level = "SELECT id, unnest(range(4)) AS input, unnest(features) AS v FROM x"
        for k in range(len(fitted.layers)):
            z = f"SELECT id, unit AS input, sum(v * weight) + (SELECT weight FROM w b WHERE b.layer = {k} AND b.unit = a.unit AND b.input = -1) AS v " \
                f"FROM ({level}) JOIN w a USING (input) WHERE a.layer = {k} GROUP BY id, unit"
            level = z if k == len(fitted.layers) - 1 else f"SELECT id, input, 1 / (1 + exp(-v)) AS v FROM ({z})"
        found = duckdb.sql(f"SELECT count(*) FROM (SELECT id, arg_max(input, v) AS p FROM ({level}) GROUP BY 1) JOIN x USING (id) WHERE p = prediction").fetchall()[0]
        assert found[0] == 300 and w is not None and x is not None


def test_softmax_learns(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), (rng.normal(size=2) + 3 * np.array([c == 1, c == 2])).tolist(), "train" if i % 3 else "test") for i, c in enumerate(rng.integers(0, 3, 600))]
    df = spark.createDataFrame(rows, "label int, features array<double>, side string")
    cells = ev.class_metrics(ev.confusion(ev.trtr(ev.softmax(rounds=60), df))).filter("label IS NULL").collect()
    assert {r["metric"]: r["value"] for r in cells}["accuracy"] > 0.85


def test_hashed_pairs_are_sent_once(spark):
    """A pair that meets in several tables leaves one of them only: what is shuffled to join the tables
    is a list a point and table, not its pairs in all of them."""
    x = clustered(3000, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    points = nb.settle(nb.distinct_points(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), "x"))
    numbered = points.withColumn("id", F.monotonically_increasing_id())
    pairs = nb.met_lists(numbered, 3000, 5, 8, 256, 7, True)
    assert pairs.count() == pairs.select("id", "other").distinct().count()
    lists = nb.met_lists(numbered, 3000, 5, 8, 256, 7)
    assert lists.agg(F.sum(F.length("found"))).first()[0] < 3000 * 8 * 40
    exact = {r["source"]: r["same_share"] for r in nb.neighbour_mix(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), "x", 5, 256).collect()}
    hashed = {r["source"]: r["same_share"] for r in nb.neighbour_mix(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), "x", 5, 256, tables=8).collect()}
    assert all(abs(exact[s] - hashed[s]) < 0.01 for s in exact)


@pytest.mark.parametrize("narrow", [True, False])
def test_neighbours_of_unrelated_dimensions_by_all_pairs(spark, monkeypatch, narrow):
    """Where no block can be ruled out, points are not handed to every block one by one; the result is
    that of the blocks, copies and ties included."""
    rng = np.random.default_rng(4)
    x = 1000.0 + np.vstack([rng.normal(size=(1500, 20)), np.round(rng.normal(size=(500, 20)))])
    x = x.astype(np.float32).astype(float) if narrow else x
    x = np.vstack([x, x[:300], x[:100]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    real, synth = df.filter("id % 3 = 0"), df.filter("id % 3 > 0")
    used, plain = [], nb.all_pairs
    monkeypatch.setattr(nb, "all_pairs", lambda *a: used.append(a[-1]) or plain(*a))
    got = sorted(tuple(r) for r in nb.neighbour_mix(real, synth, "x", 5, 64).collect())
    assert used == [narrow]
    monkeypatch.setattr(nb, "MET_SHARE", 1_000)
    blocks = sorted(tuple(r) for r in nb.neighbour_mix(real, synth, "x", 5, 64).collect())
    assert len(used) == 1 and [r[:2] for r in got] == [r[:2] for r in blocks]
    assert all(abs(a[2] - b[2]) < 1e-12 and a[3] == b[3] for a, b in zip(got, blocks))
