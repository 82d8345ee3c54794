"""Do real and synthetic rows mix? Nearest-neighbour two-sample share (Schilling 1986).

The search is exact and never pairs all rows. Distinct points are cut into blocks of bounded
size along their first two coordinates. Each point gets an upper bound for its ``k``-th
distance inside its own block, and is then compared only with blocks that reach closer than
that. Two blocks meet in one task and pass on at most ``k + 1`` distances per point.

How many blocks are ruled out depends on the data: nearly all for the few components of
``project_pair``, few for many unrelated dimensions, where exact search stays quadratic. On
very large tables run it on projected rows, widest component first, or with ``tables``: then points
are hashed several times by random projections, each time into slices of bounded size along the
order of the hash, and a point is compared, exactly, with its slices. Rows shuffled are then
``tables`` times the points, whatever the dimension; neighbours that share no slice are missed.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longitab.functions.draws import normals
from longitab.functions.ranges import OVERSAMPLE, add_slice, cut_points, search, slices_for
from longitab.functions.small import join_small
from longitab.operators.fidelity import pair
from longitab.operators.moments import vectors
from longitab.sources.shared import settle

BLOCK_ROWS = 1_024
BROADCAST_CUTS = 2_000_000
DIGITS = 9
SLACK = 1e-6
#: Hashed search: projections of a table, bits of each in the hash, and rows that set its levels.
DIRECTIONS, BITS, LEVEL_ROWS = 4, 15, 4096
#: Search of all pairs: bytes of a block, rows that give a first bound, and the share of the blocks that
#: a point has to meet for it.
PAIR_BYTES, BOUND_ROWS, MET_SHARE = 16 << 20, 2048, 8


def distinct_points(real: DataFrame, synth: DataFrame, features: list[str] | str) -> DataFrame:
    """``point, x, n1, n0``: each distinct vector once, with its rows per source.

    Copies are counted before the shuffle, so a vector shared by a third of all rows is one
    point afterwards. Rows with a null are left out.
    """
    columns = [features] if isinstance(features, str) else list(features)
    x = (F.col(features) if isinstance(features, str) else F.array(*columns)).cast("array<double>")
    rows = pair(real, synth, columns).select("source", x.alias("x"))
    rows = rows.filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    return (rows.groupBy("x").agg(F.count_if(F.col("source") == "real").alias("n1"),
                                  F.count_if(F.col("source") == "synth").alias("n0"))
            .select(F.md5(F.col("x").cast("string")).alias("point"), "x", "n1", "n0"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, differences first so equal points give exactly 0."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        gap *= gap
        out += gap
    return out


class Blocks:
    """Cut points that send a point to a block: first coordinate, then the second inside it."""

    def __init__(self, points: DataFrame, size: int, block_rows: int):
        spark = points.sparkSession
        wanted = math.ceil(size / block_rows)
        first_rows = math.ceil(size / math.ceil(math.sqrt(wanted)))
        inner = max(1, math.ceil(first_rows / block_rows))
        self.strips = slices_for(size, first_rows)
        self.max_rows = max(1, BROADCAST_CUTS // inner)
        # Block work is compute, not bytes, so its partitions are counted in blocks.
        self.partitions = max(spark.sparkContext.defaultParallelism, wanted // 4)
        one = points.select("point", F.get("x", F.lit(0)).alias("_x1"),
                            F.coalesce(F.get("x", F.lit(1)), F.lit(0.0)).alias("_x2"))
        first = cut_points(one, [], F.col("_x1"), size, first_rows,
                           F.col("point")).select("_cuts").toArrow()
        found = first.column(0).to_pylist()
        cuts = found[0] if found else []
        # One literal for the few cuts of the first level; it is folded before the scan.
        self.first = F.from_json(F.lit(json.dumps(cuts)), "array<double>")
        strips = add_slice(one, "strip", self.first, F.col("_x1"), self.strips)
        sizes = strips.groupBy("strip").agg(F.count("*").alias("_n")).filter(F.col("_n") > block_rows)
        self.second = settle(cut_points(strips, ["strip"], F.col("_x2"), sizes, block_rows,
                                        F.col("point")))
        self.placed = settle(self.place(points))
        self.over = (self.placed.groupBy("strip", "tile").agg(F.count("*").alias("_n"))
                     .filter(F.col("_n") > 2 * block_rows)
                     .select("strip", "tile", F.ceil(F.col("_n") / block_rows).cast("int").alias("_parts")))

    def place(self, points: DataFrame) -> DataFrame:
        """Add ``strip`` and ``tile``."""
        strips = add_slice(points, "strip", self.first, F.get("x", F.lit(0)), self.strips)
        x2 = F.coalesce(F.get("x", F.lit(1)), F.lit(0.0))
        cut = join_small(strips, self.second, ["strip"], "left", self.max_rows)
        return add_slice(cut, "tile", F.col("_cuts"), x2).drop("_cuts")

    def assign(self) -> DataFrame:
        """The points with ``block``. Those that share both coordinates are told apart by hash."""
        parts = F.coalesce("_parts", F.lit(1))
        part = F.pmod(F.xxhash64("point"), parts.cast("long")).cast("int")
        return (join_small(self.placed, self.over, ["strip", "tile"], "left")
                .withColumn("block", F.struct("strip", "tile", part.alias("part")))
                .drop("strip", "tile", "_parts"))

    def reach(self, bounded: DataFrame) -> DataFrame:
        """One row per block that may hold a point within ``bound``, as ``other``."""
        edge = F.col("bound") + SLACK
        x1 = F.get("x", F.lit(0))
        x2 = F.coalesce(F.get("x", F.lit(1)), F.lit(0.0))
        strips = bounded.withColumn("strip", F.explode(F.sequence(
            search(self.first, x1 - edge, self.strips), search(self.first, x1 + edge, self.strips))))
        tiles = (join_small(strips, self.second, ["strip"], "left", self.max_rows)
                 .withColumn("tile", F.explode(F.sequence(
                     search(F.col("_cuts"), x2 - edge), search(F.col("_cuts"), x2 + edge))))
                 .drop("_cuts"))
        parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
        return (join_small(tiles, self.over, ["strip", "tile"], "left")
                .withColumn("_part", F.explode(parts))
                .withColumn("other", F.struct("strip", "tile", F.col("_part").alias("part")))
                .drop("strip", "tile", "_part", "_parts", "bound"))


def own_bounds(blocked: DataFrame, k: int, partitions: int) -> DataFrame:
    """Add ``bound``, a distance within which a point surely has ``k`` other rows.

    Infinite where the own block is too small to tell.
    """
    def bound(table: pa.Table) -> pa.Table:
        weight = table.column("n1").to_numpy() + table.column("n0").to_numpy()
        x = vectors(table.column("x"))
        d = squared(x, x)
        near = min(len(d), k + 1)
        order = np.argpartition(d, near - 1, axis=1)[:, :near]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1), 1)
        enough = np.cumsum(weight[order], axis=1) >= k + 1
        column = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
        limit = np.where(enough.any(axis=1),
                         np.sqrt(np.take_along_axis(d, column, axis=1)[:, 0]), np.inf)
        return table.drop_columns(["n1", "n0"]).append_column("bound", pa.array(limit))

    flat = blocked.select("point", "x", "n1", "n0", "block.*").repartition(
        partitions, "strip", "tile", "part")
    bounded = flat.groupBy("strip", "tile", "part").applyInArrow(
        bound, "point string, x array<double>, strip int, tile int, part int, bound double")
    return bounded.select("point", "x", "bound", F.struct("strip", "tile", "part").alias("block"))


def nearest_rows(queries: DataFrame, blocked: DataFrame, k: int, partitions: int) -> DataFrame:
    """``point, d, n1, n0``: per point the rows at each of its nearest distances.

    ``queries`` holds a point once per block in ``other``. Both sides are grouped by the pair
    of blocks, so a task holds two blocks whatever a block's popularity.
    """
    def name(c):
        return F.concat_ws(":", f"{c}.strip", f"{c}.tile", f"{c}.part")

    meetings = queries.select("block", "other").distinct()
    sides = blocked.select(F.col("block").alias("_b"), "x", "n1", "n0")
    data = (meetings.join(sides, F.col("other") == F.col("_b"))
            .select(name("block").alias("b"), name("other").alias("o"), "x", "n1", "n0")
            .repartition(partitions, "b", "o"))
    asked = queries.select(name("block").alias("qb"), name("other").alias("qo"), "point",
                           F.col("x").alias("qx")).repartition(partitions, "qb", "qo")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.float64(), pa.int64(), pa.int64())],
                            names=["point", "d", "n1", "n0"])
        d = squared(vectors(left.column("qx")), vectors(right.column("x")))
        take = min(d.shape[1], k + 1)
        edge = np.sqrt(np.partition(d, take - 1, axis=1)[:, take - 1]) + SLACK
        row, column = np.nonzero(d <= (edge * edge)[:, None])
        found = pa.table({"p": pa.array(row), "d": pa.array(np.round(np.sqrt(d[row, column]), DIGITS)),
                          "n1": right.column("n1").take(pa.array(column)),
                          "n0": right.column("n0").take(pa.array(column))})
        found = found.group_by(["p", "d"]).aggregate([("n1", "sum"), ("n0", "sum")])
        return pa.table({"point": left.column("point").take(found.column("p")), "d": found.column("d"),
                         "n1": found.column("n1_sum"), "n0": found.column("n0_sum")})

    return (asked.groupBy("qb", "qo").cogroup(data.groupBy("b", "o"))
            .applyInArrow(compare, "point string, d double, n1 bigint, n0 bigint")
            .groupBy("point", "d").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))


def closest(row: np.ndarray, column: np.ndarray, near: np.ndarray, weight: np.ndarray, k: int):
    """Of found pairs, sorted by row and distance, those that ``k`` rows need: fewer points do where they
    stand for many rows, and all at the last distance stay. The row's own point is one of its pairs."""
    order = np.lexsort((near, row))
    row, column, near = row[order], column[order], near[order]
    sums = np.cumsum(weight[column])
    begin = np.searchsorted(row, row, "left")
    before = np.where(begin > 0, sums[begin - 1], 0)
    inside = sums - weight[column] - before <= k
    last = np.zeros(row.max() + 1 if len(row) else 0)
    np.maximum.at(last, row[inside], near[inside])
    keep = near <= last[row]
    return row[keep], column[keep], near[keep]


def lists_of(ids: np.ndarray, row: np.ndarray, near: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> pa.Table:
    """``id, found``: the pairs of each row, sorted by ``row``, as one binary value. Its first byte is
    the width of a count; a pair is its distance and both counts."""
    width = next(w for w in (1, 2, 4, 8) if not len(row) or max(n1.max(), n0.max()) < 1 << (8 * w - 1))
    record = np.empty(len(row), dtype=[("d", "<f8"), ("n1", f"<i{width}"), ("n0", f"<i{width}")])
    record["d"], record["n1"], record["n0"] = near, n1, n0
    rows, counts = np.unique(row, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(counts * record.itemsize + 1)))
    flat = np.full(ends[-1], width, np.uint8)
    body = np.ones(len(flat), bool)
    body[ends[:-1]] = False
    flat[body] = record.view(np.uint8)
    found = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
    return pa.table({"id": pa.array(ids[rows], pa.int64()), "found": found})


LISTS = "id bigint, found binary"


def unlisted(column: pa.Array):
    """``value, d, n1, n0`` of the pairs in binary values, ``value`` the number of the value."""
    data = [np.frombuffer(v.as_buffer(), np.uint8) for v in column]
    widths = np.array([v[0] for v in data], dtype=np.int64)
    out = []
    for width in np.unique(widths):
        kind = np.dtype([("d", "<f8"), ("n1", f"<i{width}"), ("n0", f"<i{width}")])
        at = np.flatnonzero(widths == width)
        record = np.frombuffer(b"".join(data[i][1:] for i in at), kind)
        sizes = [(len(data[i]) - 1) // kind.itemsize for i in at]
        out.append((np.repeat(at, sizes), record["d"], record["n1"].astype(np.int64), record["n0"].astype(np.int64)))
    return [np.concatenate(v) for v in zip(*out)]


def list_shares(found: DataFrame, k: int) -> DataFrame:
    """``source, rows, share``: partial sums of the shares of points whose pairs are in ``found``, in one
    or several binary values. The pair at distance -1 holds the point's own rows."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            value, d, n1, n0 = unlisted(lists.flatten())
            point = owner[value]
            order = np.lexsort((d, point))
            point, d, n1, n0 = point[order], d[order], n1[order], n0[order]
            new = np.concatenate(([True], (np.diff(point) != 0) | (np.diff(d) != 0)))
            at = np.flatnonzero(new)
            point, d = point[at], d[at]
            n1, n0 = np.add.reduceat(n1, at), np.add.reduceat(n0, at)
            own = d < 0
            rows = {"real": n1[own], "synth": n0[own]}
            point, n1, n0 = point[~own], n1[~own], n0[~own]
            every = n1 + n0 - (d[~own] == 0)
            begin = np.searchsorted(point, point, "left")
            sums = np.cumsum(every)
            before = sums - every - np.where(begin > 0, sums[begin - 1], 0)
            use = (before < k) & (every > 0)
            used = np.minimum(every, k - before)[use]
            below = np.bincount(point[use], used, len(lists))
            for source, n in (("real", n1), ("synth", n0)):
                same = (n - (d[~own] == 0))[use]
                top = np.bincount(point[use], same * used / every[use], len(lists))
                there = (rows[source] > 0) & (below > 0)
                share = (top[there] / below[there] * rows[source][there]).sum()
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([int(rows[source][there].sum())]), pa.array([float(share)])],
                                                 names=["source", "rows", "share"])

    return (found.groupBy("id").agg(F.collect_list("found").alias("found")).select("found")
            .mapInArrow(run, "source string, rows bigint, share double"))


def pairwise(a: np.ndarray, b: np.ndarray, k: int, skip: bool):
    """Pairs ``row, column, near`` of rows of ``a`` and of ``b`` that may be among the ``k + 1`` nearest of
    either: of ``a`` in ``b``, then, unless ``skip``, of ``b`` in ``a``.

    Products of matrices with a margin above their rounding say which pairs can be, against a bound
    from ``BOUND_ROWS`` rows; only those are compared by differences."""
    middle = a.mean(axis=0)
    u, v = a - middle, b - middle
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    margin = 4 * (a.shape[1] + 8) * np.finfo(float).eps * (uu.max() + vv.max())

    def distances(i, j, x=u, y=v, xx=uu, yy=vv):
        d = x[i] @ y[j].T
        d *= -2.0
        d += xx[i][:, None]
        d += yy[j]
        return d

    def limits(x, y, xx, yy):
        take, out = min(len(y), k + 1), []
        spread = np.linspace(0, len(y) - 1, min(len(y), BOUND_ROWS)).astype(int)
        for at in range(0, len(x), 512):
            d = distances(slice(at, at + 512), spread, x, y, xx, yy)
            near = np.partition(d, min(take, d.shape[1]) - 1, axis=1)[:, min(take, d.shape[1]) - 1]
            out.append(np.square(np.sqrt(np.maximum(near + margin, 0.0)) + SLACK) + margin)
        return np.concatenate(out)

    of_a = limits(u, v, uu, vv)
    of_b = None if skip else limits(v, u, vv, uu)
    rows, columns, nears = [], [], []
    for i in range(0, len(u), 512):
        for j in range(0, len(v), 2048):
            d = distances(slice(i, i + 512), slice(j, j + 2048))
            mask = d <= of_a[i:i + 512, None]
            if not skip:
                mask |= d <= of_b[None, j:j + 2048]
            row, column = np.divmod(np.flatnonzero(mask), mask.shape[1])
            gap = a[row + i] - b[column + j]
            rows.append((row + i).astype(np.int32))
            columns.append((column + j).astype(np.int32))
            nears.append(np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), DIGITS))
    row, column, near = np.concatenate(rows), np.concatenate(columns), np.concatenate(nears)
    # A bound holds for differences too, so what is beyond it is of the other direction.
    wide = np.sqrt(of_a + 2 * margin) + SLACK
    here = near <= wide[row]
    first = row[here], column[here], near[here]
    if skip:
        return first, None
    here = near <= (np.sqrt(of_b + 2 * margin) + SLACK)[column]
    return first, (column[here], row[here], near[here])


def all_pairs(points: DataFrame, size: int, width: int, k: int, narrow: bool) -> DataFrame:
    """``id, found``: of each point its nearest points of every block, as by ``lists_of``, where bounds rule
    out few blocks. Points are dealt into blocks by hash; each two blocks meet in one task, for the
    neighbours of both. A block has at most ``PAIR_BYTES`` and there are enough blocks to keep all
    cores busy, so what is shuffled grows with points times blocks, and the work with their square."""
    spark = points.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = max(math.ceil(math.sqrt(6 * cores)), math.ceil(size * width * 8 / PAIR_BYTES))
    x = F.col("x").cast("array<float>") if narrow else F.col("x")
    own, other = F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int"), F.col("_other")
    rows = (points.select("id", x.alias("x"), "n1", "n0", own.alias("_own"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .select((F.least("_own", other) * F.lit(blocks).cast("long") + F.greatest("_own", other)).alias("pair"),
                    (F.col("_own") <= other).alias("left"), "id", "x", "n1", "n0"))

    def compare(t: pa.Table) -> pa.Table:
        pair, left = t.column("pair")[0].as_py(), t.column("left").to_numpy()
        x, ids = vectors(t.column("x")).astype(np.float64), t.column("id").to_numpy()
        n1, n0 = t.column("n1").to_numpy(), t.column("n0").to_numpy()
        same = pair // blocks == pair % blocks
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        if not len(a) or not len(b):
            return pa.table({"id": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
        one, two = pairwise(x[a], x[b], k, same)
        out = []
        for found, mine, theirs in ((one, a, b), (two, b, a)):
            if found is not None:
                row, column, near = closest(*found, (n1 + n0)[theirs], k)
                if same:
                    row, column, near = with_own(row, column, near)
                out.append(lists_of(ids[mine], row, near, n1[theirs][column], n0[theirs][column]))
        return pa.concat_tables(out)

    return (rows.repartition(max(cores, blocks * (blocks + 1) // 2), "pair").groupBy("pair").applyInArrow(compare, LISTS))


def blocks_met(blocks: Blocks, blocked: DataFrame, wanted: int, k: int) -> float:
    """About how many blocks a point has to be compared with, from the points of some eight blocks."""
    some = blocked.filter(F.pmod(F.xxhash64("block"), F.lit(max(1, wanted // 8))) == 0)
    met = blocks.reach(own_bounds(some, k, min(8, blocks.partitions)))
    n, pairs = met.agg(F.countDistinct("point"), F.count("*")).first()
    return pairs / n if n else float(wanted)


class Tables:
    """Hash tables of points. A point's key in a table is the interleaved bits of its random
    projections, each in levels of about equal count, so points near each other in all projections
    have keys near each other. Levels come from ``LEVEL_ROWS`` points, the first ones by name.

    A table's keys are cut into slices of about ``block_rows`` points by a sample, and points with one
    key that fill more than a few slices are dealt by hash. ``slots`` numbers the parts of all tables."""

    def __init__(self, points: DataFrame, size: int, tables: int, block_rows: int, seed: int):
        drawn = points.orderBy("point").limit(LEVEL_ROWS).select("x").toArrow()
        x = vectors(drawn.column(0))
        d, self.m = x.shape[1], min(x.shape[1], DIRECTIONS)
        self.turns = [np.linalg.qr(normals(seed + t, np.arange(d), self.m))[0] for t in range(tables)]
        marks = np.linspace(0, len(x) - 1, min(len(x), 1 << 10)).astype(int)
        self.levels = [np.sort(x @ q, axis=0)[marks] for q in self.turns]
        self.cuts = [np.zeros(0, np.int64)] * tables
        spark = points.sparkSession
        # Only sampled points are hashed for the cuts.
        rate = max(1, size // (OVERSAMPLE * slices_for(size, block_rows)))
        sample = self.keyed(points.filter(F.pmod(F.xxhash64("point"), F.lit(rate)) == 0))
        sizes = spark.createDataFrame([(t, size) for t in range(tables)], "table int, _n bigint")
        for t, cuts in cut_points(sample, ["table"], F.col("key"), sizes, block_rows, F.col("point")).toArrow().to_pandas().itertuples(index=False):
            self.cuts[t] = np.asarray(cuts, dtype=np.int64)
        parts = [np.ones(len(c) + 1, np.int64) for c in self.cuts]
        self.first = self.numbered(parts)
        self.parts = parts
        counts = self.placed(points.select("point", "x")).select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
        for slot, n in counts.filter(F.col("n") > 4 * block_rows).collect():
            t = next(t for t in range(tables) if self.first[t][0] <= slot <= self.first[t][-1])
            parts[t][slot - self.first[t][0]] = -(-n // block_rows)
        self.first = self.numbered(parts)
        self.slots = int(sum(p.sum() for p in parts))

    @staticmethod
    def numbered(parts: list) -> list:
        flat = np.concatenate(parts)
        return np.split(np.cumsum(flat) - flat, np.cumsum([len(p) for p in parts])[:-1])

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        out, at, level = np.zeros(len(x), np.int64), x @ self.turns[t], self.levels[t]
        grid = np.linspace(0.0, float((1 << BITS) - 1), len(level))
        code = np.stack([np.interp(at[:, j], level[:, j], grid) for j in range(self.m)], axis=1).astype(np.int64)
        for bit in range(BITS - 1, -1, -1):
            for j in range(self.m):
                out = (out << 1) | ((code[:, j] >> bit) & 1)
        return out

    def keyed(self, points: DataFrame) -> DataFrame:
        """``points`` once per table with ``table`` and ``key``."""
        keys, tables = self.keys, len(self.turns)

        @F.arrow_udf("array<bigint>")
        def hashed(column: pa.Array) -> pa.Array:
            if not len(column):
                return pa.array([], pa.list_(pa.int64()))
            x = vectors(column)
            made = np.stack([keys(x, t) for t in range(tables)], axis=1)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, tables, dtype=np.int32)), pa.array(made.reshape(-1)))

        return points.select("*", F.posexplode(hashed("x")).alias("table", "key"))

    def placed(self, points: DataFrame) -> DataFrame:
        """``points`` with ``slots``, the part that a point is in, for each table."""
        keys, cuts, first, parts = self.keys, self.cuts, self.first, [p.copy() for p in self.parts]
        tables = len(cuts)

        @F.arrow_udf("array<int>")
        def place(column: pa.Array, code: pa.Array) -> pa.Array:
            if not len(column):
                return pa.array([], pa.list_(pa.int32()))
            x, code, made = vectors(column), code.to_numpy(zero_copy_only=False), []
            for t in range(tables):
                at = np.searchsorted(cuts[t], keys(x, t), "right")
                made.append(first[t][at] + code % parts[t][at])
            made = np.stack(made, axis=1).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, tables, dtype=np.int32)), pa.array(made.reshape(-1)))

        return points.select("*", place("x", F.xxhash64("point")).alias("slots"))


def met_lists(points: DataFrame, size: int, k: int, tables: int, block_rows: int, seed: int, named: bool = False) -> DataFrame:
    """``id, found``: of each point the nearest points met in the parts of each table, as by ``lists_of``,
    or with ``named`` a row ``id, other, d, n1, n0`` each.

    A row carries its slots in the tables before, so a pair that met there is left out: it was found
    there, or enough nearer ones were. So no pair has to be shuffled to find it twice."""
    held = Tables(points, size, tables, block_rows, seed)
    rows = (held.placed(points).select("id", "x", "n1", "n0", "slots", F.posexplode("slots").alias("table", "slot"))
            .select("slot", "id", "x", "n1", "n0", F.slice("slots", F.lit(1), F.col("table")).alias("before")))
    spark = points.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), held.slots // 32)

    def compare(t: pa.Table) -> pa.Table:
        x, n1, n0 = vectors(t.column("x")), t.column("n1").to_numpy(), t.column("n0").to_numpy()
        ids = t.column("id").to_numpy()
        earlier = t.column("before").combine_chunks()
        earlier = earlier.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(earlier.flatten()) else np.zeros((len(x), 0), np.int32)
        d = squared(x, x)
        take = min(len(d), k + 1)
        edge = np.sqrt(np.partition(d, take - 1, axis=1)[:, take - 1]) + SLACK
        row, column = np.nonzero(d <= (edge * edge)[:, None])
        row, column, near = closest(row, column, np.round(np.sqrt(d[row, column]), DIGITS), n1 + n0, k)
        fresh = ~(earlier[row] == earlier[column]).any(axis=1)
        row, column, near = row[fresh], column[fresh], near[fresh]
        if named:
            return pa.table({"id": ids[row], "other": ids[column], "d": near, "n1": n1[column], "n0": n0[column]})
        if not earlier.shape[1]:
            row, column, near = with_own(row, column, near)
        return lists_of(ids, row, near, n1[column], n0[column])

    return rows.repartition(spread, "slot").groupBy("slot").applyInArrow(
        compare, "id bigint, other bigint, d double, n1 bigint, n0 bigint" if named else LISTS)


def with_own(row: np.ndarray, column: np.ndarray, near: np.ndarray):
    """Pairs with one more for each row there is: the point itself at distance -1."""
    own = np.unique(row)
    row, column, near = np.concatenate([row, own]), np.concatenate([column, own]), np.concatenate([near, np.full(len(own), -1.0)])
    order = np.argsort(row, kind="stable")
    return row[order], column[order], near[order]


def hashed_neighbours(points: DataFrame, size: int, k: int, tables: int, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """``point, other, d, n1, n0``: of each point the nearest other points found in any table's part,
    enough for ``k`` rows and all at the last distance; ``other`` is the point itself too, at 0. Each
    pair is there once. ``points`` must give the same rows in the same order each time, as settled ones do."""
    points = points.withColumn("id", F.monotonically_increasing_id())
    names = points.select("id", "point")
    return (met_lists(points, size, k, tables, block_rows, seed, True).join(names, "id")
            .join(names.select(F.col("id").alias("other"), F.col("point").alias("_o")), "other")
            .select("point", F.col("_o").alias("other"), "d", "n1", "n0"))


def neighbour_mix(real: DataFrame, synth: DataFrame, features: list[str] | str, k: int = 5,
                  block_rows: int = BLOCK_ROWS, tables: int | None = None) -> DataFrame:
    """``source, n, same_share, expected_share``: of the ``k`` nearest rows of a row, the share
    from its own source, and the share expected if both sources were one population.

    Distances are compared after rounding to nine digits. Rows tied at the ``k``-th distance
    count in equal parts, so no order among ties is needed. With ``tables`` the search is the hashed
    one, else exact.
    """
    spread = int(real.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = settle(distinct_points(real, synth, features).repartition(spread, "point"))
    whole = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    size = points.agg(F.count("*").alias("points"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"),
                      F.every(whole).alias("whole"), F.max(F.size("x")).alias("width"),
                      F.every(F.forall("x", lambda v: v.cast("float").cast("double") == v)).alias("narrow")).first()
    if not size["points"]:
        raise ValueError("no rows to compare")
    numbered = points.withColumn("id", F.monotonically_increasing_id())
    if tables:
        sums = list_shares(met_lists(numbered, size["points"], k, tables, block_rows, 7), k)
        return mixed(sums, size["n1"], size["n0"])
    blocks = Blocks(points, size["points"], block_rows)
    blocked = blocks.assign()
    wanted = math.ceil(size["points"] / block_rows)
    if wanted > MET_SHARE and size["whole"] and blocks_met(blocks, blocked, wanted, k) * MET_SHARE > wanted:
        found = all_pairs(numbered, size["points"], size["width"], k, size["narrow"])
        return mixed(list_shares(found, k), size["n1"], size["n0"])
    queries = settle(blocks.reach(own_bounds(blocked, k, blocks.partitions)))
    found = nearest_rows(queries, blocked, k, blocks.partitions)

    owners = points.select(F.col("point").alias("_p"), F.inline(F.array(
        F.struct(F.lit("real").alias("source"), F.col("n1").alias("rows")),
        F.struct(F.lit("synth").alias("source"), F.col("n0").alias("rows"))))).filter("rows > 0")
    is_real = F.col("source") == "real"
    me = F.when(F.col("d") == 0, 1).otherwise(0)
    before = Window.partitionBy("point", "source").orderBy("d").rowsBetween(
        Window.unboundedPreceding, -1)
    shares = (found.join(owners, F.col("point") == F.col("_p"))
              .withColumn("all", F.col("n1") + F.col("n0") - me)
              .withColumn("same", F.when(is_real, F.col("n1")).otherwise(F.col("n0")) - me)
              .withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0)))
              .filter((F.col("before") < k) & (F.col("all") > 0))
              .withColumn("used", F.least(F.col("all"), F.lit(k) - F.col("before")))
              .groupBy("point", "source", "rows")
              .agg((F.sum(F.col("same") * F.col("used") / F.col("all"))
                    / F.sum("used")).alias("share")))
    return mixed(shares.select("source", "rows", (F.col("share") * F.col("rows")).alias("share")), size["n1"], size["n0"])


def mixed(sums: DataFrame, n1: int, n0: int) -> DataFrame:
    """The result from ``source, rows, share``, shares summed over rows."""
    own = F.when(F.col("source") == "real", F.lit(n1)).otherwise(F.lit(n0))
    return (sums.groupBy("source").agg(F.sum("rows").alias("n"), F.sum("share").alias("_share"))
            .filter("n > 0")
            .select("source", "n", (F.col("_share") / F.col("n")).alias("same_share"),
                    ((own - 1) / F.lit(float(max(n1 + n0 - 1, 1)))).alias("expected_share")))
