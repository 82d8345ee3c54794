import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longitab.operators import fidelity as fi
from longitab.operators import neighbours as nb
from longitab.operators import prepare as pr

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
VALUES = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-5, 5)), max_size=60)


def ks_by_hand(a, b):
    a, b = [v for v in a if v is not None], [v for v in b if v is not None]
    if not a or not b:
        return None
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)


def p_by_hand(d, n1, n0):
    m = n1 * n0 / (n1 + n0)
    lam = (math.sqrt(m) + 0.12 + 0.11 / math.sqrt(m)) * d
    if lam < 0.3:
        return 1.0
    s = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 9))
    return min(1.0, max(0.0, s))


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "f double")


@SLOW
@given(VALUES, VALUES)
def test_ks_by_hand(spark, a, b):
    rows = fi.ks_report(column(spark, a), column(spark, b), ["f"]).collect()
    if not a and not b:
        assert rows == []
        return
    want, row = ks_by_hand(a, b), rows[0]
    assert row["nulls"] == (a + b).count(None)
    if want is None:
        assert row["d"] is None and row["p_value"] is None
    else:
        assert math.isclose(row["d"], want, abs_tol=1e-12)
        assert math.isclose(row["p_value"], p_by_hand(want, row["n1"], row["n0"]), abs_tol=1e-9)


def test_ks_is_exact_over_partitions(spark):
    """The counts are spread over range partitions; adaptive execution must not merge them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_ks_over_partitions(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_ks_over_partitions(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.choice([0.0, rng.lognormvariate(0, 3), round(rng.random(), 2)]), rng.gauss(i % 2, 2))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, side int, x double, y double")
    a, b = df.filter("side = 0"), df.filter("side = 1")
    got = {r["feature"]: r["d"] for r in fi.ks_statistic(a, b, ["x", "y"]).collect()}
    for i, f in ((2, "x"), (3, "y")):
        want = ks_by_numpy([r[i] for r in rows if r[1] == 0], [r[i] for r in rows if r[1] == 1])
        assert math.isclose(got[f], want, abs_tol=1e-12)


def ks_by_numpy(a, b):
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()


def test_ks_edges(spark):
    same = column(spark, [1.0, 2.0, 2.0, None])
    far = column(spark, [10.0, 11.0])
    assert fi.ks_statistic(same, same, ["f"]).first()["d"] == 0.0
    assert fi.ks_statistic(same, far, ["f"]).first()["d"] == 1.0


def test_report_per_phase(spark):
    real = spark.createDataFrame([(p, float(i), float(i)) for p in ("phase1", "phase2", None) for i in range(50)],
                                 "phase string, f double, g double")
    synth = real.withColumn("g", F.when(F.col("phase") == "phase1", F.col("g") + 1000).otherwise(F.col("g")))
    got = {(r["phase"], r["feature"]): (r["passed"], r["share_passed"])
           for r in fi.ks_report(real, synth, ["f", "g"], ["phase"]).collect()}
    assert got == {("phase1", "f"): (True, 0.5), ("phase1", "g"): (False, 0.5),
                   ("phase2", "f"): (True, 1.0), ("phase2", "g"): (True, 1.0),
                   (None, "f"): (True, 1.0), (None, "g"): (True, 1.0)}


def test_overlap(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.2, 0.3), (5.0, 5.0), (-0.1, 0.0)], "pc1 double, pc2 double")
    apart = df.withColumns({"pc1": F.col("pc1") + 100})
    assert fi.grid_overlap(fi.pair(df, df, ["pc1", "pc2"]), 1.0).first()["overlap"] == 1.0
    assert fi.grid_overlap(fi.pair(df, apart, ["pc1", "pc2"]), 1.0).first()["overlap"] == 0.0


def mix_by_hand(points, k):
    """points: (source, vector). Ties at the k-th distance count in equal parts."""
    x = np.array([v for _, v in points], dtype=float)
    src = np.array([s for s, _ in points])
    shares = {}
    for i in range(len(points)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        others = [j for j in range(len(points)) if j != i]
        edge = sorted(d[j] for j in others)[k - 1]
        near = [j for j in others if d[j] < edge]
        tied = [j for j in others if d[j] == edge]
        same = sum(src[j] == src[i] for j in near)
        same += (k - len(near)) * sum(src[j] == src[i] for j in tied) / len(tied)
        shares.setdefault(src[i], []).append(same / k)
    return {s: (len(v), sum(v) / len(v)) for s, v in shares.items()}


@pytest.mark.parametrize("block_rows", [15, 64, 1024])
@pytest.mark.parametrize("shape", ["plane", "copies", "same_plane", "line", "cube"])
def test_neighbours_by_hand(spark, shape, block_rows):
    rng = random.Random(11)
    points = []
    for i in range(240):
        source = "real" if rng.random() < 0.6 else "synth"
        x = [rng.gauss(0, 1) + (0.8 if source == "synth" else 0), rng.expovariate(1)]
        if shape == "copies":
            x = [1.0, 2.0] if i % 3 == 0 else [round(v, 1) for v in x]
        elif shape == "same_plane":
            x = [0.0, 0.0, *x]
        elif shape == "line":
            x = x[:1]
        elif shape == "cube":
            x = x + [rng.gauss(0, 1), rng.random()]
        points.append((source, x))
    df = spark.createDataFrame(points, "source string, x array<double>")
    got = {r["source"]: r for r in nb.neighbour_mix(df.filter("source = 'real'"), df.filter("source = 'synth'"),
                                                    "x", 4, block_rows).collect()}
    n_real = sum(s == "real" for s, _ in points)
    for s, (n, share) in mix_by_hand(points, 4).items():
        assert got[s]["n"] == n
        assert math.isclose(got[s]["same_share"], share, abs_tol=1e-9)
    assert math.isclose(got["real"]["expected_share"], (n_real - 1) / (len(points) - 1))


def test_neighbours_visit_few_blocks(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i % 2, [rng.random(), rng.random()]) for i in range(4000)], "s int, x array<double>")
    points = nb.settle(nb.distinct_points(df.filter("s = 0"), df.filter("s = 1"), "x"))
    blocks = nb.Blocks(points, 4000, 100)
    blocked = blocks.assign()
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert len(sizes) > 25 and max(sizes) <= 300
    assert blocks.reach(nb.own_bounds(blocked, 5, 4)).count() < 4 * 4000


def test_lag_fidelity_and_moments(spark):
    rows = [(e, t, e % 2, float((e * 7 + t * t) % 11)) for e in range(12) for t in range(1, 9)]
    real = spark.createDataFrame(rows, "e int, step int, label int, f double")
    for chunk in (2, 10**6):
        got = fi.lag_fidelity(real, real, "e", "step", ["f"], "label", 2, chunk).collect()
        assert len(got) == 4 and all(r["gap"] == 0 for r in got)
        assert {r["lag"]: r["n_real"] for r in got if r["label"] == 0} == {1: 42, 2: 36}
    shifted = real.withColumn("f", F.col("f") * 2 + 1)
    for r in fi.moment_gap(real, shifted, ["f"], ["label"]).collect():
        assert math.isclose(r["mean_gap"], r["mean_real"] + 1) and math.isclose(r["sd_gap"], r["sd_real"])


def test_quality(spark):
    real = spark.createDataFrame([(1.0, 1.0), (2.0, 5.0)], "a double, b double")
    synth = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (9.0, 3.0), (None, 3.0)], "a double, b double")
    got = {(r["check"], r["feature"]): r["value"] for r in fi.quality_checks(real, synth, ["a", "b"]).collect()}
    assert got[("nulls", "a")] == 1 and got[("nulls", "b")] == 0
    assert math.isclose(got[("out_of_range_share", "a")], 1 / 3) and got[("out_of_range_share", "b")] == 0
    assert got[("repeats", "*")] == 1 and got[("copied_from_real", "*")] == 2


def test_projected_pair(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.gauss(0, 3), rng.gauss(0, 1), rng.gauss(5, 1)) for i in range(200)],
                               "id int, a double, b double, c double")
    out = fi.project_pair(df, df, ["a", "b", "c"], 2, ["id"])
    assert out.columns == ["id", "source", "pc1", "pc2"] and out.count() == 400
    assert fi.grid_overlap(out, 0.5).first()["overlap"] == pytest.approx(1.0)
    assert abs(out.agg(F.avg("pc1")).first()[0]) < 1e-9
    assert pr.class_profile(out, "source").filter("n = 200").count() == 2


def test_fidelity_report_reads_each_table_once(spark):
    """Tables that are costly to make are made once, and several phases give what each gives alone."""
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(8)
    rows = [(t, e, e % 3, s + 1, float(v), float(w)) for t in range(3) for e in range(40)
            for s, (v, w) in enumerate(rng.normal(size=(5, 2)) * (1 + t))]
    df = spark.createDataFrame(rows, "t int, entity_id int, label int, step int, a double, b double")
    real, one, two = (df.filter(f"t = {t}").mapInArrow(made, df.schema) for t in range(3))
    got = {tuple(r)[:3]: r["value"] for r in fi.fidelity_report(real, {"one": one, "two": two}, ["a", "b"]).collect()}
    assert seen.value == 600
    assert len(got) == 2 * (6 * 2 + 2)
    for name, synth in (("one", one), ("two", two)):
        want = {(name, "ks", r["feature"]): r["d"] for r in fi.ks_statistic(real, synth, ["a", "b"]).collect()}
        for r in fi.moment_gap(real, synth, ["a", "b"]).collect():
            want |= {(name, "mean_gap", r["feature"]): abs(r["mean_gap"]), (name, "sd_gap", r["feature"]): abs(r["sd_gap"])}
        gaps = fi.lag_fidelity(real, synth, "entity_id", "step", ["a", "b"], "label").groupBy("feature").agg(F.avg("gap")).collect()
        want |= {(name, "lag_gap", f): v for f, v in gaps}
        want |= {(name, r["check"], r["feature"]): r["value"] for r in fi.quality_checks(real, synth, ["a", "b"]).collect()}
        assert {k for k in got if k[0] == name} == set(want)
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_ks_counts_values_once(spark):
    a = spark.range(60).selectExpr("cast(id % 7 as double) AS x", "cast(id as double) AS y")
    b = spark.range(60).selectExpr("cast(id % 5 as double) AS x", "cast(id as double) AS y")
    found = fi.ks_statistic(a, b, ["x", "y"])
    assert "Range (0, 60" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["feature"]: round(r["d"], 9) for r in found.collect()} == {"x": 0.266666667, "y": 0.0}


def test_means_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(3)
    cases = {"near": [rng.gauss(0, 1) for _ in range(4000)], "wide": [rng.gauss(0, 1) * 10 ** rng.randrange(-9, 17) for _ in range(900)],
             "odd": [None, -0.0, 1e-300, 2.0**60, -(2.0**60)], "none": [None], "nan": [math.nan, 1.0], "inf": [math.inf, 1.0]}
    rows = [(k, v) for k, vs in cases.items() for v in vs]
    for order, parts in ((rows, 1), (rows[::-1], 5), (sorted(rows, key=str), 3)):
        df = fi.in_units(spark.createDataFrame(order, "k string, v double").repartition(parts), "v")
        got = {r["k"]: r["m"] for r in df.groupBy("k").agg(fi.mean_of_units("v", F.lit(True)).alias("m")).collect()}
        assert got["none"] is None and math.isnan(got.pop("nan")) and got.pop("inf") == math.inf
        for k in ("near", "wide", "odd"):
            known = [v for v in cases[k] if v is not None]
            assert got[k] == pytest.approx(math.fsum(known) / len(known), rel=1e-15, abs=1e-300)
        held = got if parts == 1 else held
        assert got == held
