"""Middle values of columns by counting, without one task that holds a column's distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longitab.functions.small import small_rows, small_table
from longitab.sources.shared import settle


def medians(df: DataFrame, features: list[str]) -> dict:
    """Exact median of each feature, the mean of the two middle values for even counts; null, where a
    feature has no value. Null and NaN are no values.

    Values are counted before they are shuffled. The counts are range-partitioned by feature and
    value and kept, so that a partition is a stretch of one order; totals per partition and feature
    say which partition holds the middle, and only that one is sorted.
    """
    one = [F.struct(F.lit(i).alias("f"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v")) for i, c in enumerate(features)]
    counts = df.select(F.inline(F.array(*one))).filter("v IS NOT NULL").groupBy("f", "v").agg(F.count("*").alias("n"))
    ranged = settle(counts.repartitionByRange("f", "v").withColumn("p", F.spark_partition_id()))
    # One row per partition and feature in it: at most partitions + features rows.
    totals = ranged.groupBy("f", "p").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("f").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    every = F.sum("n").over(Window.partitionBy("f"))
    placed = totals.withColumns({"b": F.coalesce(F.sum("n").over(before), F.lit(0)), "t": every})
    for name, rank in (("lo", F.expr("(t - 1) div 2")), ("hi", F.expr("t div 2"))):
        placed = placed.withColumn(name, rank)
    holds = [(F.col(r) >= F.col("b")) & (F.col(r) < F.col("b") + F.col("n")) for r in ("lo", "hi")]
    wanted = small_table(placed.filter(holds[0] | holds[1]).select("f", "p", "b", "lo", "hi"))
    upto = F.col("b") + F.sum("n").over(Window.partitionBy("f", "p").orderBy("v"))
    found = ranged.join(F.broadcast(wanted), ["f", "p"]).withColumn("upto", upto)
    at = [F.min(F.when(F.col("upto") > F.col(r), F.col("v"))).alias(r) for r in ("lo", "hi")]
    # The middle pair can be in two partitions: the first one lies in the earlier.
    rows = small_rows(found.groupBy("f", "p").agg(*at, F.max("upto").alias("end"), F.first("lo").alias("rl"), F.first("hi").alias("rh"), F.first("b").alias("b")))
    low = {r["f"]: r["lo"] for r in rows if r["b"] <= r["rl"] < r["end"]}
    high = {r["f"]: r["hi"] for r in rows if r["b"] <= r["rh"] < r["end"]}
    return {c: (low[i] + high[i]) / 2 if i in low else None for i, c in enumerate(features)}
