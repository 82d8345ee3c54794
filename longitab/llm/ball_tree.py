"""Exact ranked lexical search by sparse ball trees.

A document is a sparse vector of term impacts, an item a sparse vector of term weights, and a
score their inner product. Documents are cut into bounded blocks, each with a ball tree: a
subtree has the centroid ``c`` of its documents and the largest distance ``r`` of one from it, so
no document of it scores above ``q.c + |q| r``. For each item the subtrees are visited best bound
first, and the rest is pruned when no bound can reach the item's ``k``-th score. Bounds are rounded
up by more than floating point can lose; documents of a visited leaf are scored in 64-bit integers.

Only terms of the items are kept of a document. Their counts, the one thing written, are taken in
one pass over the texts; the search then runs where the blocks are, without a shuffle, and hands
on ``k`` documents of an item and task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longitab.llm.common import bounded_batches, pieces, written

#: Scoring constants (fixed values): impact = SCALE * tf div (1000 * tf + 8 * m), with a length
#: share of 75 per cent in m.
SCALE, TF_PART, M_PART, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 8, 75, 1000
#: Documents, or term counts, of a block, and documents of a leaf.
BLOCK_DOCS, BLOCK_TERMS, LEAF = 16_384, 2_000_000, 48
#: Text bytes of the items that are searched for in one pass; more take more passes.
PASS_BYTES = 4 << 20
#: Items whose bounds are taken together.
ITEMS = 64
#: Relative rounding of bounds; sums of a million terms lose less than 1e-9.
SLACK = 1e-9
#: Bytes to single spaces, letters to lower case: terms are ASCII letters and digits, and all that is not ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def term_counts(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, tf`` of every document: all its terms, and counts of the numbered ones."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        get = held.value.get
        for batch in pieces(batches, 1):
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                own, tf = np.unique(np.fromiter((v for v in map(get, words) if v is not None), np.int32), return_counts=True)
                sizes.append(len(words))
                terms.append(own)
                counts.append(tf)
                ends.append(ends[-1] + len(own))
            ends = pa.array(ends, pa.int32())
            flat = [np.concatenate(x) if x else np.zeros(0) for x in (terms, counts)]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()),
                                   pa.ListArray.from_arrays(ends, pa.array(flat[0].astype(np.int32))),
                                   pa.ListArray.from_arrays(ends, pa.array(flat[1].astype(np.int32)))], names=["id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "id long, n long, terms array<int>, tf array<int>")


class Block:
    """Documents as rows of one sparse matrix, in the order of the tree's leaves."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, width: int):
        self.ids, self.ends, self.terms, self.impact, self.width = ids, ends, terms, impact, width
        self.square = np.add.reduceat(impact.astype(np.float64) ** 2, ends[:-1])
        #: Of each node: centroid (terms, values), radius, its two children or None, its leaf or None.
        self.nodes, leaves = [], []
        self.split(np.arange(len(ids)), leaves)
        order = np.concatenate(leaves)
        self.leaf_ends = np.cumsum([0] + [len(rows) for rows in leaves])
        at, self.ends = self.entries(order)
        self.ids, self.terms, self.impact = ids[order], terms[at], impact[at]

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of ``rows`` and where each row's begin."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return np.repeat(self.ends[rows] - ends[:-1], sizes) + np.arange(ends[-1]), ends

    def split(self, rows: np.ndarray, leaves: list) -> int:
        """Adds the subtree of ``rows``: those nearer to one of two documents far apart, and those nearer
        to the other; halves where that parts less than an eighth."""
        at, ends = self.entries(rows)
        terms, impact = self.terms[at], self.impact[at].astype(np.float64)

        def apart(point: np.ndarray) -> np.ndarray:
            return self.square[rows] - 2 * np.add.reduceat(impact * point[terms], ends[:-1]) + point @ point

        def point(i: int) -> np.ndarray:
            out = np.zeros(self.width)
            out[terms[ends[i]:ends[i + 1]]] = impact[ends[i]:ends[i + 1]]
            return out

        centre = np.bincount(terms, impact, self.width) / len(rows)
        far = apart(centre)
        radius = math.sqrt(max(far.max(), 0.0) + SLACK * (self.square[rows].max() + centre @ centre))
        used = np.flatnonzero(centre)
        place = len(self.nodes)
        self.nodes.append(None)
        if len(rows) > LEAF:
            to_one = apart(point(int(far.argmax())))
            gap = to_one - apart(point(int(to_one.argmax())))
            order = np.argsort(gap, kind="stable")
            half = int((gap < 0).sum())
            if min(half, len(rows) - half) < max(1, len(rows) // 8):
                half = len(rows) // 2
            children, leaf = (self.split(rows[order[:half]], leaves), self.split(rows[order[half:]], leaves)), None
        else:
            children, leaf = None, len(leaves)
            leaves.append(rows)
        self.nodes[place] = (used, centre[used]), radius, children, leaf
        return place

    def bounds(self, weight: np.ndarray) -> np.ndarray:
        """(nodes, items): what no score of a node's documents exceeds; ``weight`` is (terms, items)."""
        length = np.sqrt((weight**2).sum(axis=0))
        sums = np.stack([centre @ weight[used] + radius * length for (used, centre), radius, *_ in self.nodes])
        return sums * (1 + SLACK) + 1.0

    def scores(self, leaf: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and integer scores of a leaf's documents."""
        a, b = self.leaf_ends[leaf], self.leaf_ends[leaf + 1]
        x, y = self.ends[a], self.ends[b]
        return self.ids[a:b], np.add.reduceat(self.impact[x:y] * weight[self.terms[x:y]], self.ends[a:b] - x)

    def search(self, bound: np.ndarray, weight: np.ndarray, found: list, k: int) -> int:
        """Adds the documents of one item to ``found``, its (score, -id) best so far; leaves visited."""
        queue, visited = [(-bound[0], 0)], 0
        while queue:
            best, node = heapq.heappop(queue)
            if len(found) == k and -best < found[0][0]:
                break
            _, _, children, leaf = self.nodes[node]
            if children is not None:
                for c in children:
                    heapq.heappush(queue, (-bound[c], c))
                continue
            visited += 1
            ids, score = self.scores(leaf, weight)
            least = found[0][0] if len(found) == k else 1
            for i in np.flatnonzero(score >= least):
                entry = int(score[i]), -int(ids[i])
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        return visited


def _search(vectors: DataFrame, queries: list[tuple], weight: np.ndarray, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """``item_id, item, doc_id, score``: the ``k`` best documents of each item in each task.
    A query is ``(item id, its number, terms, counts)``."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, weight))
    arrow = pa.schema([("item_id", pa.string() if kind == "string" else pa.int64()), ("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        queries, weight = shared.value
        found = [[] for _ in queries]

        def add(held):
            ids = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            block = Block(ids, np.concatenate(([0], np.cumsum(sizes))), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), len(weight))
            for begin in range(0, len(queries), ITEMS):
                chunk = queries[begin:begin + ITEMS]
                q = np.zeros((len(weight), len(chunk)), np.int64)
                for i, (_, _, terms, counts) in enumerate(chunk):
                    q[terms, i] = weight[terms] * counts
                bound = block.bounds(q.astype(np.float64))
                q = np.ascontiguousarray(q.T)
                for i in range(len(chunk)):
                    block.search(bound[:, i], q[i], found[begin + i], k)

        held, docs, entries = [], 0, 0
        for batch in batches:
            n, sizes = batch.column(1).to_numpy(), pc.list_value_length(batch.column(2)).to_numpy()
            terms, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
            impact = (SCALE * tf) // (TF_PART * tf + M_PART * np.repeat(m, sizes))
            held.append((batch.column(0).to_numpy(), sizes, terms, impact))
            docs, entries = docs + len(n), entries + len(tf)
            if docs >= BLOCK_DOCS or entries >= BLOCK_TERMS:
                add(held)
                held, docs, entries = [], 0, 0
        if docs:
            add(held)
        out = [(q[0], q[1], -d, s) for q, best in zip(queries, found) for s, d in best]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, arrow)], schema=arrow)

    some = vectors.filter("id IS NOT NULL AND size(terms) > 0").select("id", "n", "terms", "tf")
    return some.mapInArrow(run, f"item_id {kind}, item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, score above 0,
    equal scores by ascending id.

    A score is the sum over the item's terms, repeats included, of ``w * (1000000000 tf div
    (1000 tf + 8 m))`` in 64-bit integers, with ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and
    ``m = 25 + 75 n N div L`` (n a document's terms, N documents with any, L all their terms).

    Null, empty and wordless texts have no term: such items give no row. Items of more than
    ``PASS_BYTES`` are searched for in several passes. Equal rows of ``items`` count once; different
    texts under one id are ranked apart. A document with a null id counts in N, L and df and is
    never returned; rows that repeat an id are documents of their own. Whole texts count, however
    long. Other columns are ignored; an empty table on either side gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    kind = "string" if kind == "string" else "long"
    asked = items.select(F.col(item_col).cast(kind).alias("item"), F.col(item_text).cast("binary").alias("text")).filter("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    out = spark.createDataFrame([], f"item_id {kind}, item long, doc_id long, score long")
    for p in range(passes):
        t = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p).toArrow()
        number, queries = {}, []
        for i, (item, text) in enumerate(sorted(zip(t.column(0).to_pylist(), t.column(1).to_pylist()), key=repr)):
            own = [number.setdefault(w, len(number)) for w in terms_of(text)]
            if own:
                terms, counts = np.unique(np.array(own, np.int64), return_counts=True)
                queries.append((item, i * passes + p, terms, counts))
        if not queries:
            continue
        vectors = written(term_counts(docs, number, id_col, text_col), "terms")
        n_docs, n_terms = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(number), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r[0]] = r[1]
        weight = np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        out = out.unionByName(_search(vectors, queries, weight, n_docs, n_terms, k, kind))
    order = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), "doc_id")
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"))
