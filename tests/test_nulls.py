"""Null keys and values, large groups, and every visit kept."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from longitab.functions.hashing import hash_hex
from longitab.operators import fidelity as fi
from longitab.operators import moments as mo
from longitab.operators import prepare as pr
from longitab.operators import sequences as sq
from longitab.operators import split as sp
from longitab.operators import synthesis as sy
from longitab.sources.records import read_phase, write_phase


def test_null_class_is_split_and_accepted(spark):
    df = spark.range(300).withColumn("label", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")))
    got = {(r[0], r[1]): r[2] for r in sp.split_rows(df, "id", "label", 0.7).groupBy("label", "side").count().collect()}
    assert got == {(c, s): n for c in (None, 1, 2) for s, n in (("train", 70), ("test", 30))}
    plan = spark.createDataFrame([(None, 5), (1, 7)], "label int, target bigint")
    kept = sy.rejection_sample(df.withColumnRenamed("id", "entity_id"), plan, 3)
    assert {r[0]: r[1] for r in kept.groupBy("label").count().collect()} == {None: 5, 1: 7}


@pytest.mark.parametrize("slice_rows", [10, 10**6])
def test_null_entity_is_a_large_group(spark, slice_rows):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.col("id") % 10).alias("e"), F.col("id").alias("t"),
                                 F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("x"))
    rows = pr.order_visits(df.withColumn("i", F.col("t")), "e", "t", "i", slice_rows=slice_rows).toPandas()
    own = rows[rows.e.isna()].sort_values("t")
    assert own.step.tolist() == list(range(1, 201))
    filled = pr.impute(df, ["x"], "locf", entity="e", order=["t"], slice_rows=slice_rows).toPandas()
    got = filled[filled.e.isna()].sort_values("t").x.tolist()
    last, want = float("nan"), []
    for t in own.t:
        last = float(t) if t % 7 == 0 else last
        want.append(last)
    assert np.array_equal(got, want, equal_nan=True)


def test_grouped_moments_keep_the_key(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, 1.0), (big, 3.0), (None, 5.0), (big + 1, 2.0)], "g bigint, x double").coalesce(1)
    got = {r["g"]: (r["n"], r["mean"][0]) for r in mo.grouped_moments(df.select("g", F.array("x").alias("v")), "v", "g").collect()}
    assert got == {big: (2, 2.0), None: (1, 5.0), big + 1: (1, 2.0)}


def test_grid_leaves_nulls_out(spark):
    df = spark.createDataFrame([(0.5, 0.5), (None, 1.0), (1.0, None), (None, None)], "pc1 double, pc2 double")
    far = df.withColumn("pc1", F.col("pc1") + 9)
    row = fi.grid_overlap(fi.pair(df, far, ["pc1", "pc2"]), 1.0).first()
    assert (row["overlap"], row["cells"], row["shared_cells"], row["nulls"]) == (0.0, 2, 0, 6)
    empty = fi.grid_overlap(fi.pair(df.limit(0), df.limit(0), ["pc1", "pc2"]), 1.0).first()
    assert empty["overlap"] is None and empty["cells"] == 0


def test_many_groups(spark):
    a = spark.range(150_000).select(F.col("id").alias("g"), F.lit(1.0).alias("x"))
    out = fi.ks_statistic(a, a.withColumn("x", F.lit(2.0)), ["x"], ["g"])
    assert out.agg(F.count("*"), F.min("d"), F.max("d")).first()[:] == (150_000, 1.0, 1.0)


def test_median_is_exact(spark):
    df = spark.range(100_000).select((F.col("id") * 50_000.0).alias("x")).unionByName(spark.createDataFrame([(None,)], "x double"))
    assert pr.fit_imputer(df, ["x"], "median").values["x"] == 2_499_975_000.0
    assert pr.impute(df, ["x"], "median").filter("x IS NULL").count() == 0


def test_hash_tells_keys_apart(spark):
    df = spark.createDataFrame([("1|2", "3"), ("1", "2|3"), ("1", None), (None, "1"), ("1\\", "x")], "a string, b string")
    assert df.select(hash_hex(["a", "b"], 1).alias("h")).distinct().count() == 5


def test_csv_keeps_micros_nulls_and_empty_strings(spark, tmp_path):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(1, at, "", 1.5, 0), (2, None, None, float("nan"), 0), (3, at, 'a "q", b', None, 1)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, s string, x double, label int")
    write_phase(df, str(tmp_path), "phase1", "csv")
    back = read_phase(spark, str(tmp_path), "phase1", df.schema, "csv").orderBy("id").collect()
    assert [str(tuple(r)) for r in back] == [str(tuple(r)) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("part_len", [2, 7, 2000])
def test_parts_keep_every_visit(spark, part_len):
    # One entity has most of the rows; two have one visit and one has none but a null key.
    rows = spark.range(1, 3001).select(F.when(F.col("id") <= 2500, F.lit(0)).otherwise(F.col("id") % 50).alias("e"), F.col("id").alias("t"),
                                       F.sin("id").alias("x"), F.lit(1).alias("label"))
    parts = sq.pack_parts(rows, "e", ["t"], ["x"], part_len, "label", slice_rows=300)
    assert parts.agg(F.max("len"), F.sum(F.col("len") - F.col("context"))).first()[:] == (min(part_len, 2500), 3000)
    whole = sq.pack_sequences(rows, "e", ["t"], ["x"], label="label")
    assert whole.agg(F.sum("len")).first()[0] == 3000
    a, b = sy.fit_sequence_model(parts), sy.fit_sequence_model(whole)
    assert np.allclose(a.transition, b.transition) and np.allclose(a.start_mean, b.start_mean) and a.lengths == b.lengths


def test_a_cut_reports_what_it_drops(spark):
    rows = spark.range(10).select(F.lit(1).alias("e"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    row = sq.pack_sequences(rows, "e", ["t"], ["x"], 4).first()
    assert (row["len"], row["dropped"]) == (4, 6)
