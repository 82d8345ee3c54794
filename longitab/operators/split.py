"""Train and test sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitab.functions.hashing import unit_hash
from longitab.functions.selection import hash_cuts, within_cut

SEED = 42


def split_rows(df: DataFrame, key, label: str, frac: float = 0.7, seed=SEED,
               exact: bool = True) -> DataFrame:
    """Add ``side``: ``train`` for ``frac`` of each class, else ``test``.

    ``exact`` takes the first ``floor(frac * n)`` rows of a class in hash order; it costs one
    count per class and hash prefix, and the rows themselves are not shuffled. Otherwise rows
    fall by their own hash alone and the shares hold only on average.
    """
    if not exact:
        return df.withColumn("side", F.when(unit_hash(key, seed) < frac, "train").otherwise("test"))
    targets = df.groupBy(label).agg(F.count("*").alias("_n")).select(
        label, F.floor(F.lit(float(frac)) * F.col("_n")).alias("target"))
    cuts = hash_cuts(df, label, key, targets, seed)
    return (within_cut(df, label, key, cuts, seed)
            .withColumn("side", F.when(F.col("_in"), "train").otherwise("test")).drop("_in"))


def split_entities(df: DataFrame, entity: str, frac: float = 0.7, seed=SEED) -> DataFrame:
    """Add ``side`` by the entity's hash, so all visits of one entity are on one side. Map-only."""
    return df.withColumn("side", F.when(unit_hash(entity, seed) < frac, "train").otherwise("test"))
