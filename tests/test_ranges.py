"""Large groups: results do not depend on how a group is cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from longitab.functions import ranges
from longitab.functions.small import NotSmall, head, join_small, small_table
from longitab.operators import prepare as pr
from longitab.operators import sequences as sq


@pytest.fixture(scope="module")
def visits(spark):
    """One entity with a third of all rows, equal timestamps, gaps in the value."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        entity = 0 if i % 3 == 0 else rng.randrange(1, 60)
        value = None if rng.random() < 0.6 else round(rng.random(), 3)
        rows.append((i, entity, start + timedelta(seconds=rng.randrange(400)), value))
    return spark.createDataFrame(rows, "id bigint, entity bigint, ts timestamp, value double").repartition(7)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_counts_entries(spark):
    cuts = [1.0, 2.0, 2.5, 9.0]
    keys = [0.0, 1.0, 2.2, 2.5, 8.9, 9.0, 50.0]
    df = spark.createDataFrame([(k, cuts) for k in keys], "k double, cuts array<double>")
    got = [r[0] for r in df.select(ranges.search(F.col("cuts"), F.col("k"), 16)).collect()]
    assert got == [sum(c <= k for c in cuts) for k in keys]
    empty = spark.createDataFrame([(1.0, None), (1.0, [])], "k double, cuts array<double>")
    assert [r[0] for r in empty.select(ranges.search(F.col("cuts"), F.col("k"))).collect()] == [0, 0]


@pytest.mark.parametrize("slice_rows", [40, 300, 10**6])
def test_numbering(visits, slice_rows):
    got = pr.order_visits(visits, "entity", "ts", "id", slice_rows=slice_rows)
    want = visits.withColumn("step", F.row_number().over(Window.partitionBy("entity").orderBy("ts", "id")))
    assert as_set(got.select("id", "step")) == as_set(want.select("id", "step"))


@pytest.mark.parametrize("out", ["step", "_row", "_offset", "_slice"])
@pytest.mark.parametrize("slice_rows", [300, 10**6])
def test_numbering_under_any_name(visits, slice_rows, out):
    got = ranges.number_rows(visits, ["entity"], ["ts", "id"], out, slice_rows)
    want = visits.withColumn("step", F.row_number().over(Window.partitionBy("entity").orderBy("ts", "id")))
    assert got.columns == [*visits.columns, out]
    assert as_set(got.select("id", out)) == as_set(want.select("id", "step"))


def test_large_group_is_cut(visits):
    sliced, cut = ranges.with_slices(visits, ["entity"], ["ts", "id"], 100)
    sizes = {(r["entity"], r["_slice"]): r["count"] for r in sliced.groupBy("entity", "_slice").count().collect()}
    assert cut and len([k for k in sizes if k[0] == 0]) > 5
    assert max(n for (e, _), n in sizes.items() if e == 0) < 400


@pytest.mark.parametrize("slice_rows", [40, 10**6])
def test_carry_forward(visits, slice_rows):
    got = pr.impute(visits, ["value"], "locf", entity="entity", order=["ts", "id"], slice_rows=slice_rows)
    w = Window.partitionBy("entity").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = visits.withColumn("value", F.last("value", ignorenulls=True).over(w))
    assert as_set(got.select("id", "value")) == as_set(want.select("id", "value"))


@pytest.mark.parametrize("chunk", [3, 50, 10**6])
def test_lag(visits, chunk):
    numbered = pr.order_visits(visits, "entity", "ts", "id")
    got = ranges.lagged(numbered, ["entity"], "step", {"a": ("id", 1), "c": ("id", 3)}, chunk)
    w = Window.partitionBy("entity").orderBy("step")
    want = numbered.withColumn("a", F.lag("id", 1).over(w)).withColumn("c", F.lag("id", 3).over(w))
    assert as_set(got.select("id", "a", "c")) == as_set(want.select("id", "a", "c"))
    with pytest.raises(ValueError):
        ranges.lagged(numbered, ["entity"], "step", {"a": ("id", 4)}, 3)


def test_pack_limits_rows_before_the_shuffle(visits):
    plan = sq.pack_sequences(visits.fillna(0.0), "entity", ["ts", "id"], ["value"], 5)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_small_tables(spark):
    df = spark.range(20)
    assert head(df, 19) is None and head(df, 20).num_rows == 20
    with pytest.raises(NotSmall):
        small_table(df, 5)
    big = spark.range(100)
    assert join_small(big, df, ["id"], max_rows=5).count() == join_small(big, df, ["id"]).count() == 20
