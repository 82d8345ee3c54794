"""The first rows of each class in hash order, without sorting the class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longitab.functions.hashing import hash_hex
from longitab.functions.small import join_null_safe, small_table

PREFIX = 4


def hash_cuts(df: DataFrame, label: str, key, targets: DataFrame, seed, prefix: int = PREFIX):
    """Per class, the hash of the last of the first ``target`` rows: ``label, target, have, cut``.

    Counts by the first ``prefix`` hex digits find the one prefix where each class reaches its
    target; only rows under that prefix (one in ``16**prefix``) are ranked. ``cut`` is null
    where the class has too few rows, and then all of them count. Keys must be unique.
    ``targets`` is ``label, target`` and small.
    """
    targets = small_table(targets.select(label, F.col("target").cast("long").alias("target")))
    hashed = df.select(label, hash_hex(key, seed).alias("_h")).withColumn(
        "_p", F.substring("_h", 1, prefix))
    upto = Window.partitionBy(label).orderBy("_p")
    counts = (hashed.groupBy(label, "_p").agg(F.count("*").alias("_n"))
              .withColumn("_upto", F.sum("_n").over(upto)))
    edges = small_table(
        join_null_safe(counts, F.broadcast(targets), [label])
        .groupBy(label, "target")
        .agg(F.max("_upto").alias("have"),
             F.min(F.when(F.col("_upto") >= F.col("target"),
                          F.struct("_p", (F.col("target") - F.col("_upto") + F.col("_n"))
                                   .alias("_need")))).alias("_edge"))
        .select(label, "target", "have", "_edge._p", "_edge._need"))
    rank = Window.partitionBy(label).orderBy("_h")
    cuts = (join_null_safe(hashed, F.broadcast(edges.filter("target > 0").select(label, "_p", "_need")), [label, "_p"])
            .withColumn("_r", F.row_number().over(rank))
            .filter(F.col("_r") == F.col("_need"))
            .select(label, F.col("_h").alias("cut")))
    return small_table(join_null_safe(join_null_safe(targets, edges.select(label, "have"), [label], "left"), cuts, [label], "left")
                       .select(label, "target", F.coalesce("have", F.lit(0)).alias("have"), "cut"))


def within_cut(df: DataFrame, label: str, key, cuts: DataFrame, seed) -> DataFrame:
    """Add ``_in``: whether the row is among the first ``target`` of its class. Map-only."""
    picked = join_null_safe(df, F.broadcast(cuts.select(label, "target", "cut")), [label], "left")
    inside = (F.col("target") > 0) & (F.col("cut").isNull() | (hash_hex(key, seed) <= F.col("cut")))
    return picked.withColumn("_in", F.coalesce(inside, F.lit(False))).drop("target", "cut")
