import math
import random
from hashlib import md5

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longitab.functions.draws import normals, uniforms
from longitab.functions.selection import hash_cuts
from longitab.operators import prepare as pr
from longitab.operators import projection as pj
from longitab.operators import sequences as sq
from longitab.operators import synthesis as sy
from planted import ar_order

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def plan_by_hand(counts, n, lam):
    total, k = sum(counts.values()), len(counts)
    want = {c: round(n * ((1 - lam) * v / total + lam / k), 6) for c, v in counts.items()}
    out = {c: math.floor(w) for c, w in want.items()}
    rest = n - sum(out.values())
    for c in sorted(want, key=lambda c: (-(round(want[c] - math.floor(want[c]), 9)), c))[:rest]:
        out[c] += 1
    return out


@SLOW
@given(st.dictionaries(st.integers(0, 6), st.integers(1, 500), min_size=1, max_size=5), st.integers(0, 3000),
       st.sampled_from(["proportional", "near_balanced"]))
def test_plan_sums_to_n(spark, counts, n, mode):
    df = spark.createDataFrame(list(counts.items()), "label int, n bigint").withColumn(
        "share", F.col("n") / sum(counts.values()))
    plan = {r["label"]: r["target"] for r in sy.class_plan(df, n, mode).collect()}
    assert sum(plan.values()) == n and set(plan) == set(counts)
    lam = 0.9 if mode == "near_balanced" else 0.0
    total = sum(counts.values())
    for c, v in counts.items():
        assert abs(plan[c] - n * ((1 - lam) * v / total + lam / len(counts))) < 1 + 1e-6


def test_plan_edges(spark):
    def plan(counts, n, mode="proportional"):
        df = spark.createDataFrame(list(counts.items()), "label int, share double")
        return {r["label"]: r["target"] for r in sy.class_plan(df, n, mode).collect()}
    assert plan({4: 1.0}, 7) == {4: 7}
    assert plan({0: 0.25, 1: 0.25, 2: 0.25, 3: 0.25}, 2) == {0: 1, 1: 1, 2: 0, 3: 0}
    assert plan({0: 0.9, 1: 0.1}, 100, "near_balanced") == {0: 54, 1: 46}
    with pytest.raises(ValueError):
        plan({0: 1.0}, 1, "other")


def accept_by_hand(rows, targets, seed):
    kept = set()
    for label, target in targets.items():
        own = sorted((md5(f"{i}|{seed}".encode()).hexdigest(), i) for i, c in rows if c == label)
        kept |= {i for _, i in own[:target]}
    return kept


@SLOW
@given(st.lists(st.integers(0, 3), max_size=200), st.dictionaries(st.integers(0, 4), st.integers(0, 80), max_size=4),
       st.integers(0, 5), st.sampled_from([1, 2, 4]))
def test_rejection_by_hand(spark, labels, targets, seed, prefix):
    rows = list(enumerate(labels))
    cands = spark.createDataFrame(rows, "entity_id bigint, label int")
    plan = spark.createDataFrame(list(targets.items()), "label int, target bigint")
    got = [r["entity_id"] for r in sy.rejection_sample(cands, plan, seed).collect()]
    assert len(got) == len(set(got))
    assert set(got) == accept_by_hand(rows, targets, seed)
    cuts = {r["label"]: r["have"] for r in hash_cuts(cands, "label", "entity_id", plan, seed, prefix).collect()}
    assert cuts == {c: labels.count(c) for c in targets}


def test_rejection_report(spark):
    rows = [(i, i % 3) for i in range(30)]
    cands = spark.createDataFrame(rows, "entity_id bigint, label int")
    plan = spark.createDataFrame([(0, 4), (1, 25)], "label int, target bigint")
    for parts in (1, 3, 8):
        accepted = sy.rejection_sample(cands.repartition(parts), plan, 7)
        assert {r["entity_id"] for r in accepted.collect()} == accept_by_hand(rows, {0: 4, 1: 25}, 7)
    got = {r["label"]: (r["candidates"], r["accepted"], r["rejected"], r["target"], r["shortfall"])
           for r in sy.rejection_report(cands, accepted, plan).collect()}
    assert got == {0: (10, 4, 6, 4, 0), 1: (10, 10, 0, 25, 15), 2: (10, 0, 10, 0, 0)}


def test_draws():
    ids = np.arange(20000)
    u, z = uniforms(1, ids, 3), normals(1, ids, 4)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    assert np.abs(np.corrcoef(z.T) - np.eye(4)).max() < 0.03
    assert np.array_equal(normals(1, ids[500:600], 4), z[500:600])
    assert not np.array_equal(normals(2, ids, 4), z)


@pytest.fixture(scope="module")
def planted(spark):
    return ar_order(spark, 2400).cache()


def test_coefficients_come_back(spark, planted):
    model = sy.fit_sequence_model(planted, pooled=False)
    assert model.labels == [0, 1, 2]
    assert np.allclose([a[0, 0] for a in model.transition], [-0.8, 0.0, 0.8], atol=0.1)
    again = sy.fit_sequence_model(planted.repartition(3), pooled=False)
    assert np.allclose(again.transition, model.transition, atol=1e-10)
    pooled = sy.fit_sequence_model(planted)
    assert np.allclose(pooled.transition[0], pooled.transition[2])


def test_synthesis_ignores_partitions(spark, planted):
    model = sy.fit_sequence_model(planted, pooled=False)
    ids = sy.candidates(spark, model, 500, 9)
    runs = []
    for parts in (1, 3, 8):
        rows = sy.draw_sequences(ids.repartition(parts), model, 9).orderBy("entity_id").collect()
        runs.append([(r["entity_id"], r["label"], r["seq"], r["len"]) for r in rows])
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 500
    other = {r["entity_id"]: r["seq"] for r in sy.synthesize(spark, model, 50, 10).collect()}
    assert other[3] != runs[0][3][2]


def test_population_meets_the_plan(spark, planted):
    model = sy.fit_sequence_model(planted, pooled=False)
    plan = sy.class_plan(pr.class_profile(planted, "label"), 1500, "near_balanced")
    pop = sy.populate(spark, model, plan, 3)
    got = {r["label"]: r["count"] for r in pop.rows.groupBy("label").count().collect()}
    assert got == {r["label"]: r["target"] for r in plan.collect()} and not pop.shortfall
    assert pop.rows.select("entity_id").distinct().count() == 1500
    back = sy.fit_sequence_model(pop.rows, pooled=False)
    assert np.allclose([a[0, 0] for a in back.transition], [-0.8, 0.0, 0.8], atol=0.12)
    unknown = spark.createDataFrame([(0, 5), (77, 5)], "label int, target bigint")
    assert sy.populate(spark, model, unknown, 3).shortfall == {77: 5}


def test_lengths_follow_the_class(spark):
    rng = random.Random(2)
    rows = [(i, 0, t, rng.gauss(0, 1)) for i in range(60) for t in range(2)]
    rows += [(100 + i, 1, t, rng.gauss(0, 1)) for i in range(60) for t in range(1 + i % 5)]
    seqs = sq.pack_sequences(spark.createDataFrame(rows, "e int, label int, t int, a double"), "e", ["t"], ["a"], 6, "label")
    synth = sy.synthesize(spark, sy.fit_sequence_model(seqs), 400, 1).collect()
    assert {r["len"] for r in synth if r["label"] == 0} == {2}
    assert {r["len"] for r in synth if r["label"] == 1} == {1, 2, 3, 4, 5}
    for r in synth:
        assert r["mask"] == [t < r["len"] for t in range(5)]
        assert all(v == [0.0] for v in r["seq"][r["len"]:])


def test_decode(spark, planted):
    visits = sq.unpack_sequences(planted, ["a"], ["entity_id", "label"]).withColumn("b", 100 + 5 * F.col("a"))
    limits = pr.fit_scale(visits, ["a", "b"])
    proj = pj.pca_fit(visits, ["a", "b"], k=1)
    seqs = sq.pack_sequences(pj.pca_transform(visits, proj), "entity_id", ["step"], "components", 6, "label")
    synth = sy.synthesize(spark, sy.fit_sequence_model(seqs), 300, 4)
    out = sy.decode(synth, limits, proj)
    r = out.agg(F.min("a"), F.max("a"), F.max(F.abs(F.col("b") - 100 - 5 * F.col("a"))), F.count("*")).first()
    assert r[0] >= limits.low[0] and r[1] <= limits.high[0] and r[2] < 1e-6 and r[3] == 1800
    plain = sq.pack_sequences(limits.transform(visits), "entity_id", ["step"], ["a", "b"], 6, "label")
    unprojected = sy.decode(sy.synthesize(spark, sy.fit_sequence_model(plain), 50, 4), limits)
    assert set(unprojected.columns) == {"entity_id", "label", "step", "a", "b"}
