"""Approximate nearest neighbours by cosine, through learned partitions.

A bounded sample is fitted: the graph of its nearest neighbours is cut into balanced parts by
recursive bisection (a spectral start, then swaps that cut fewer edges), and a softmax classifier
learns in which parts the neighbours of a vector are. All rows are then placed by the classifier.
A query goes to its most probable parts until their probabilities reach a mass that gives
``RECALL`` on sample vectors the classifier has not seen, and is compared there exactly.

The sample alone sets the routing, never the answer: rows of a part are compared in blocks of
bounded size, so a part with most of the rows is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longitab.functions.draws import uniforms
from longitab.llm.common import bounded_batches, written
from longitab.operators.moments import vectors

#: Vectors of the sample, and how many of them only check the routing.
SAMPLE, CHECKED = 4096, 1024
PARTS, GRAPH, STEPS = 16, 12, 300
#: Share of the sample's true neighbours that routing must reach.
RECALL = 0.97
#: Rows of a block, queries of a block, and queries compared at once.
BLOCK_ROWS, BLOCK_QUERIES, SLICE = 8192, 4096, 128
#: Vectors with more than rows / HOT copies are collapsed first; a group of HOT_ROWS is never worth it.
HOT, HOT_ROWS = 4096, 1000
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Symmetric 0/1 adjacency of the ``k`` nearest by cosine; ``x`` holds unit vectors."""
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    k = min(k, len(x) - 1)
    out = np.zeros(near.shape, np.float32)
    if k > 0:
        np.put_along_axis(out, np.argpartition(-near, k - 1, axis=1)[:, :k], 1.0, axis=1)
    return np.maximum(out, out.T)


def bisect(graph: np.ndarray) -> np.ndarray:
    """One side of a balanced cut with few edges: half the nodes, as a mask."""
    n = len(graph)
    degree = np.maximum(graph.sum(axis=1), 1e-9)
    scale = 1 / np.sqrt(degree)
    walk = scale[:, None] * graph * scale[None, :]
    first = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
    v = uniforms(13, np.array([n]), n)[0].astype(np.float32) - 0.5
    for _ in range(60):
        v = walk @ v + v
        v -= first * (first @ v)
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v * scale, kind="stable")[: n // 2]] = True
    for _ in range(20):
        # Gain of moving a node; the best nodes of both sides are swapped while that pays.
        to = graph @ side.astype(np.float32)
        gain = np.where(side, degree - 2 * to, 2 * to - degree)
        a, b = (np.flatnonzero(m)[np.argsort(-gain[m], kind="stable")[: max(1, n // 50)]] for m in (side, ~side))
        pays = gain[a[:len(b)]] + gain[b[:len(a)]] - 2 * graph[a[:len(b)], b[:len(a)]] > 0
        if not pays.any():
            break
        before = graph[side][:, ~side].sum()
        changed = side.copy()
        changed[a[:len(pays)][pays]], changed[b[:len(pays)][pays]] = False, True
        if graph[changed][:, ~changed].sum() >= before:
            break
        side = changed
    return side


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node; ``parts`` is a power of two."""
    out = np.zeros(len(graph), np.int64)
    if parts > 1 and len(graph) > 1:
        side = bisect(graph)
        for mask, base in ((side, 0), (~side, parts // 2)):
            out[mask] = base + balanced_parts(graph[mask][:, mask], parts // 2)
    return out


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights[:-1] + weights[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Softmax regression to a distribution over the parts, full gradients with Adam."""
    w = np.zeros((x.shape[1] + 1, target.shape[1]))
    with_one = np.hstack([x, np.ones((len(x), 1))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = with_one.T @ (probabilities(x, w) - target) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def chosen(p: np.ndarray, mass: float) -> np.ndarray:
    """Mask of each row's most probable parts: the fewest whose sum reaches ``mass``."""
    order = np.argsort(-p, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    keep = np.hstack([np.ones((len(p), 1), bool), sums[:, :-1] < mass])
    out = np.zeros(p.shape, bool)
    np.put_along_axis(out, order, keep, axis=1)
    return out


@dataclass(frozen=True)
class Router:
    """Classifier of parts, and the mass of probability a query's parts must reach."""

    weights: np.ndarray
    mass: float

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def place(self, x: np.ndarray) -> np.ndarray:
        return probabilities(units(x), self.weights).argmax(axis=1)

    def route(self, x: np.ndarray) -> np.ndarray:
        return chosen(probabilities(units(x), self.weights), self.mass)


def fit_router(x: np.ndarray, k: int, parts: int = PARTS) -> Router:
    """Router of a sample. Below four vectors a part there is one part."""
    x = units(x)
    while parts > 1 and len(x) < 4 * parts:
        parts //= 2
    if parts < 2:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1.0)
    checked = min(CHECKED, len(x) // 4)
    fit = x[checked:]
    graph = neighbour_graph(fit, GRAPH)
    label = balanced_parts(graph, parts)
    target = (graph + np.eye(len(graph), dtype=np.float32)) @ np.eye(parts)[label]
    weights = train_router(fit, target / target.sum(axis=1, keepdims=True))
    # Neighbours of unseen vectors among all others, and whether their own part is visited.
    near = x[:checked] @ x.T
    near[np.arange(checked), np.arange(checked)] = -np.inf
    k = min(k, len(x) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    p = probabilities(x, weights)
    home = p.argmax(axis=1)
    for mass in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995):
        if np.take_along_axis(chosen(p[:checked], mass), home[best], axis=1).mean() >= RECALL:
            return Router(weights, mass)
    return Router(weights, 2.0)


def _placed(rows: DataFrame, router: Router) -> DataFrame:
    """``rows`` (``id, x``) with ``part``."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([*b.columns, pa.array(router.place(vectors(b.column(1))).astype(np.int32))], names=["id", "x", "part"])

    return rows.select("id", "x").mapInArrow(run, f"id long, x {rows.schema['x'].dataType.simpleString()}, part int")


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x`` of the rows that take part."""
    x = F.col(vector_col)
    square = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    known = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(
        x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)))
    known = known.withColumn("_s", square).filter((F.col("_s") > 0) & (F.col("_s") < float("inf"))).drop("_s")
    sizes = known.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    return known.filter(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _collapsed(known: DataFrame, k: int) -> DataFrame:
    """``known`` without those copies of very frequent vectors that cannot be among ``k`` nearest:
    ties go to smaller ids, so ``k`` + 1 of them are enough."""
    total = known.count()
    counts = known.groupBy(F.xxhash64("x").alias("h")).count()
    hot = [r[0] for r in counts.filter(F.col("count") > max(HOT_ROWS, total // HOT)).select("h").collect()]
    if not hot:
        return known
    is_hot = F.xxhash64("x").isin(hot)
    order = Window.partitionBy("x").orderBy("id")
    few = (known.filter(is_hot).groupBy("id", "x").agg(F.count("*").alias("_n"))
           .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).select("id", "x"))
    return known.filter(~is_hot).unionByName(few)


def build_index(rows: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                sample: int = SAMPLE, parts: int = PARTS) -> tuple[DataFrame, Router]:
    """``id, x, part`` of every row that takes part, written, and the router."""
    bounded_batches(rows.sparkSession)
    known = _usable(rows, id_col, vector_col)
    drawn = known.orderBy(F.xxhash64("id"), "id", "x").limit(sample).select("x").toArrow()
    if not drawn.num_rows:
        return known.withColumn("part", F.lit(0)), Router(np.zeros((1, 1)), 1.0)
    router = fit_router(vectors(drawn.column(0)), k, parts)
    return written(_placed(_collapsed(known, k), router), "index"), router


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            sample: int = SAMPLE, parts: int = PARTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` the ``k`` nearest rows of ``rows``
    found, by cosine in double precision on the vectors given; ties go to the smaller id. A row with
    the query's own id is no candidate.

    Vectors that are null, zero, not finite or of another length than most, and rows with a null
    id, take no part on either side. Of queries that repeat an id the smallest vector counts; a
    candidate that repeats an id counts once, by its best score. With fewer candidates than ``k``
    in the visited parts there are fewer rows, so a small table is one part. Other columns are
    ignored; an empty table gives an empty result.
    """
    index, router = build_index(rows, k, id_col, vector_col, sample, parts)
    width = F.size("x")
    asked = _usable(queries, id_col, vector_col).groupBy("id").agg(F.min("x").alias("x"))
    lengths = [r[0] for r in index.select(width).limit(1).collect()]
    asked = asked.filter(width == (lengths[0] if lengths else -1))
    kind = index.schema["x"].dataType.simpleString()

    def route(batches):
        for b in batches:
            if b.num_rows:
                row, part = np.nonzero(router.route(vectors(b.column(1))))
                at = pa.array(row)
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(part.astype(np.int32))], names=["query", "q", "part"])

    sent = asked.mapInArrow(route, f"query long, q {kind}, part int")
    # Blocks of rows and of queries, by the counts of their parts.
    n_rows = {r[0]: r[1] for r in index.groupBy("part").count().collect()}
    n_asked = asked.count()
    blocks = F.array(*[F.lit(-(-n_rows.get(p, 0) // BLOCK_ROWS) or 1) for p in range(router.parts)])
    query_blocks = max(1, -(-n_asked // BLOCK_QUERIES))
    number = F.get(blocks, F.col("part"))
    row_block = F.pmod(F.xxhash64("id"), number.cast("long")).cast("int")
    query_block = F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")
    left = (index.withColumn("i", row_block).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    right = sent.withColumn("i", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("j", query_block)

    def compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [], [], []
        if rows.num_rows and queries.num_rows:
            x, ids = vectors(rows.column("x")), rows.column("id").to_numpy()
            q, own = vectors(queries.column("q")), queries.column("query").to_numpy()
            x_len, q_len = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            ux = x / x_len[:, None]
            for begin in range(0, len(q), SLICE):
                s = slice(begin, begin + SLICE)
                near = (q[s] / q_len[s, None]) @ ux.T
                near[own[s][:, None] == ids[None, :]] = -np.inf
                take = min(k, len(ids))
                edge = np.partition(near, len(ids) - take, axis=1)[:, len(ids) - take] - SLACK
                for i in range(len(near)):
                    at = np.flatnonzero((near[i] >= edge[i]) & (near[i] > -np.inf))
                    exact = (x[at] * q[begin + i]).sum(axis=1) / (x_len[at] * q_len[begin + i])
                    best = np.lexsort((ids[at], -exact))
                    if len(best) > k:
                        best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])][:k]
                    out[0].append(np.full(len(best), own[begin + i]))
                    out[1].append(ids[at][best])
                    out[2].append(exact[best])
        flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64))],
                        names=["query_id", "other", "score"])

    found = (left.groupBy("part", "i", "j").cogroup(right.groupBy("part", "i", "j"))
             .applyInArrow(compare, "query_id long, other long, score double")
             .groupBy("query_id", "other").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "other")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("other").alias(id_col), "score"))
