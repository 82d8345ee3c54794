"""Order inside a group without putting the whole group on one task.

A window over a group runs on one task, so a group with a third of all rows would decide the
run time. Here a large group is cut into ordered slices: cut points come from a hash sample of
its keys, each row finds its slice by binary search, the window runs per slice, and per-slice
totals carry over. Groups below the threshold keep slice 0 and pay for one row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longitab.functions.small import head, join_small
from longitab.sources.shared import settle

SLICE_ROWS = 1_000_000
MAX_SLICES = 1 << 16
OVERSAMPLE = 8


def search(cuts: Column, key: Column, size: int = MAX_SLICES) -> Column:
    """How many entries of the sorted array ``cuts`` are <= ``key``, by binary search.

    ``size`` bounds the array length. A null array gives 0.
    """
    steps, step = [], 1
    while step <= size:
        steps.append(step)
        step *= 2
    ladder = F.array(*[F.lit(s) for s in reversed(steps)])
    return F.when(cuts.isNull(), 0).otherwise(F.aggregate(
        ladder, F.lit(0),
        lambda pos, s: F.when(F.get(cuts, pos + s - 1) <= key, pos + s).otherwise(pos)))


def add_slice(df: DataFrame, name: str, cuts: Column, key: Column,
              size: int = MAX_SLICES) -> DataFrame:
    """Add the ``search`` result as a column; fewer steps where ``size`` bounds the cuts.

    It goes through ``explode`` of a one-element array, so that the optimiser keeps it as a
    computed column: copied into filters and join conditions it would run several times.
    """
    return df.withColumn(name, F.explode(F.array(search(cuts, key, size))))


def cut_points(df: DataFrame, group: list[str], key: Column, sizes: DataFrame | int,
               slice_rows: int, row: Column | None = None) -> DataFrame:
    """Cut points of each large group: ``group..., _cuts``.

    ``sizes`` holds ``group..., _n`` for the large groups, in distinct keys, and slices get
    like numbers of distinct keys. With no group it is the size of the whole table. With ``row``, a unique row key, ``_n`` counts rows and
    slices get like numbers of rows. Sampling is by hash, about ``OVERSAMPLE`` keys per slice.
    """
    slices = F.least(F.lit(MAX_SLICES), F.ceil(F.col("_n") / slice_rows)).cast("int")
    rate = F.greatest(F.lit(1), F.floor(F.col("_n") / (OVERSAMPLE * slices))).cast("long")
    drawn = df.select(*group, key.alias("_key"), F.xxhash64(key if row is None else row).alias("_h"))
    sized = join_small(drawn, sizes, group) if group else drawn.withColumn("_n", F.lit(sizes))
    sample = sized.filter(F.pmod("_h", rate) == 0)
    collected = F.collect_set("_key") if row is None else F.collect_list("_key")
    keys = F.col("_keys")
    every = F.size(keys) / F.col("_slices")
    cuts = F.transform(F.sequence(F.lit(1), F.col("_slices") - 1),
                       lambda i: F.get(keys, F.floor(i * every).cast("int")))
    return (sample.groupBy(*group)
            .agg(F.sort_array(collected).alias("_keys"),
                 F.first(slices).alias("_slices"))
            .filter(F.col("_slices") > 1)
            .select(*group, F.array_distinct(cuts).alias("_cuts")))


def slices_for(rows: int, slice_rows: int) -> int:
    """Most slices a group of ``rows`` rows is cut into."""
    return min(MAX_SLICES, max(1, -(-rows // slice_rows)))


def large_groups(df: DataFrame, group: list[str], rows: int) -> DataFrame:
    """Groups above ``rows`` rows with their size; at most 1 in ``rows`` rows is one."""
    return df.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)


def with_slices(df: DataFrame, group: list[str], order: list[str],
                slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, bool]:
    """Add ``_slice``, which rises with ``order`` inside ``group``; the flag says if any group
    was cut. Null order keys sort first, as in an ascending window."""
    large = large_groups(df, group, slice_rows)
    table = head(large)
    if table is not None and table.num_rows == 0:
        return df.withColumn("_slice", F.lit(0)), False
    size = MAX_SLICES
    if table is not None:
        large = df.sparkSession.createDataFrame(table, schema=large.schema)
        size = slices_for(max(table.column("_n").to_pylist()), slice_rows)
    key = F.struct(*order)
    cuts = cut_points(df, group, key, large, slice_rows)
    cut = join_small(df, cuts, group, "left")
    return add_slice(cut, "_slice", F.col("_cuts"), key, size).drop("_cuts"), True


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str,
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``row_number`` of each row in its group, by ``order``, which must be unique in it."""
    sliced, any_cut = with_slices(df, group, order, slice_rows)
    inner = Window.partitionBy(*group, "_slice").orderBy(*order)
    if not any_cut:
        inner = Window.partitionBy(*group).orderBy(*order)
        return sliced.drop("_slice").withColumn(out, F.row_number().over(inner).cast("long"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_rows"))
               .withColumn("_offset", F.sum("_rows").over(before))
               .filter(F.col("_offset") > 0)
               .select(*group, "_slice", "_offset"))
    numbered = sliced.withColumn("_row", F.row_number().over(inner))
    return (join_small(numbered, offsets, [*group, "_slice"], "left")
            .withColumn(out, F.col("_row") + F.coalesce("_offset", F.lit(0)))
            .drop(*{"_slice", "_row", "_offset"} - {out}))


def ordered_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``, the place of each row from 0 by ``order``, which must be unique and without null.

    Rows are range-partitioned and kept; a partition's rows are numbered after those of the
    partitions before it, whose counts are all that reaches the driver.
    """
    rows = settle(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = dict(tuple(r) for r in rows.groupBy("_p").count().collect())
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(F.lit(total).cast("long"))
        total += counts.get(p, 0)
    start = F.get(F.array(*before), F.col("_p")) if before else F.lit(0).cast("long")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn(out, start + inside - 1).drop("_p")


def lagged(df: DataFrame, group: list[str], step: str, columns: dict[str, tuple[str, int]],
           chunk: int = SLICE_ROWS) -> DataFrame:
    """Add ``{new: (column, k)}``, the value ``k`` rows back, given a dense ``step`` from 1.

    Windows run per run of ``chunk`` steps. The last rows of a run are handed to the next one
    too, so every lag is found and no group runs on one task. Only rows at the end of a run
    are doubled: none, where groups are shorter than ``chunk``.
    """
    reach = max(k for _, k in columns.values())
    if reach > chunk:
        raise ValueError("lag is longer than a run")
    run = F.floor((F.col(step) - 1) / chunk)
    last = F.pmod(F.col(step) - 1, F.lit(chunk)) >= chunk - reach
    runs = F.when(last, F.array(run, run + 1)).otherwise(F.array(run))
    w = Window.partitionBy(*group, "_run").orderBy(step)
    out = df.withColumn("_run", F.explode(runs))
    out = out.withColumns({new: F.lag(c, k).over(w) for new, (c, k) in columns.items()})
    return out.filter(F.col("_run") == run).drop("_run")
