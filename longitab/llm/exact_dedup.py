"""Exact duplicates by a content sort, with DataFrame functions only.

Normalised texts are range-partitioned by sampled splitters, sorted in each partition, and
compared in full with their neighbours. A splitter holds the first code points of a text and a
hash of the whole text: samples stay small, and texts that share an opening can be parted. Equal
texts have equal keys, so they are neighbours in one partition.

A text with more than ``rows / HOT_TEXTS`` copies would fill a partition alone. Hash counts, added
up before their shuffle, find such texts; there are fewer than ``HOT_TEXTS``. Each task sorts and
compares its own copies first and only one row per task, hash and text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longitab.llm.common import partitions_of

#: At most so many texts are settled before the sort, by a broadcast of that many rows.
HOT_TEXTS = 4096
#: A group of so few rows is never worth it.
HOT_ROWS = 1000
#: Code points of a text in a splitter.
OPENING = 32
WHITE_SPACE = " \t\n\x0b\x0c\r"


def without_space(text: Column) -> Column:
    """``text`` without the characters ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=without_space,
               partitions: int | None = None, hot_rows: int = HOT_ROWS, with_row: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and
    ``row``, a struct of all columns, if ``with_row``.

    Of rows with equal normalised text, the one with the most code points in the original text
    stays, then the smallest id, null last. Null text counts as empty, and all empty texts are
    one group. Repeated rows are members of their own; one of them stays. Other columns of
    ``docs`` are ignored, an empty table gives an empty result.
    """
    n = partitions or partitions_of(docs.sparkSession)
    row = [F.struct("*").alias("_row")] if with_row else []
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *row)
    d = d.withColumn("_hash", F.xxhash64(normalise(F.col("_text"))))
    hot = _hot_hashes(d, hot_rows)
    out = _sorted_groups(d.filter(~F.col("_hash").isin(hot)) if hot else d, normalise, n)
    if hot:
        out = out.unionByName(_hot_groups(d.filter(F.col("_hash").isin(hot)), normalise))
    return out.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
                      F.col("_size").alias("group_size"), F.col("_kept").alias("kept"),
                      F.col("_sha").alias("text_sha256"), *[F.col("_row").alias("row") for _ in row])


def _hot_hashes(d: DataFrame, hot_rows: int) -> list[int]:
    counts = d.groupBy("_hash").count()
    total = d.count()
    return [r[0] for r in counts.filter(F.col("count") > max(hot_rows, total // HOT_TEXTS)).select("_hash").collect()]


def _with_text(d: DataFrame, normalise) -> DataFrame:
    return d.withColumn("_norm", normalise(F.col("_text"))).withColumn("_chars", F.coalesce(F.length("_text"), F.lit(0)))


def _sorted_groups(d: DataFrame, normalise, n: int) -> DataFrame:
    """Groups of the range-partitioned sort. The window needs no other shuffle: its keys
    contain those of the ranges."""
    ranged = d.withColumn("_open", F.substring(normalise(F.col("_text")), 1, OPENING)).repartitionByRange(n, "_open", "_hash")
    order = (Window.partitionBy("_open", "_hash", "_norm")
             .orderBy(F.desc("_chars"), F.asc_nulls_last("_id")))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = [c for c in d.columns if c == "_row"]
    return _with_text(ranged, normalise).select(
        "_id", F.first("_id").over(whole).alias("_keep"), F.count(F.lit(1)).over(whole).alias("_size"),
        (F.row_number().over(order) == 1).alias("_kept"), F.sha2("_norm", 256).alias("_sha"), *rows)


def _hot_groups(d: DataFrame, normalise) -> DataFrame:
    """Groups of the few texts with very many copies. Partial aggregation in the map tasks leaves
    one row per task and text; the texts found, fewer than ``HOT_TEXTS``, are broadcast as digests."""
    extra = [c for c in d.columns if c == "_row"]
    d = _with_text(d, normalise)
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i")))
    groups = (d.groupBy("_hash", "_norm").agg(best.alias("_best"), F.count(F.lit(1)).alias("_size"))
              .select(F.col("_hash").alias("_h"), F.sha2("_norm", 256).alias("_sha"), "_best", "_size"))
    rows = (d.withColumn("_s", F.sha2("_norm", 256)).join(
                F.broadcast(groups), (F.col("_hash") == F.col("_h")) & (F.col("_s") == F.col("_sha")))
            .withColumn("_first", F.col("_id").eqNullSafe(F.col("_best.i")) & (-F.col("_chars") == F.col("_best.c")))
            .select("_id", F.col("_best.i").alias("_keep"), "_size", "_first", "_sha", *extra))
    # A repeated row can be first several times; only those rows are numbered.
    winners = rows.filter("_first").withColumn(
        "_kept", F.row_number().over(Window.partitionBy("_sha").orderBy("_id")) == 1).drop("_first")
    return rows.filter(~F.col("_first")).withColumn("_kept", F.lit(False)).drop("_first").unionByName(winners)
