"""A Merkle manifest of a dataset, with a version of the tree for every changed leaf.

A row's leaf is the hash of its fields. Leaves of a group (a source) ascend by id; every ``ARITY``
consecutive nodes become the hash of their digests, until one is left, the group's subroot.
Subroots, in the order of their groups, give the root in the same way.

Nodes are immutable. A changed leaf makes a new version of the tree by path copying: its ancestors
are copied, and every other node is shared with the version before. A tree is built in aligned
blocks of ``ARITY ** DEPTH`` nodes, one block at a time in a task. Versions are made where their
block is; the tops of the blocks are the nodes of the next tree up, which is some two thousand
times smaller, and each version goes on with the siblings of its block there. No group, and no
list of versions, is ever in one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longitab.functions.ranges import number_rows
from longitab.functions.small import join_small
from longitab.llm.common import bounded_batches, written

ARITY, DEPTH = 3, 7
BLOCK = ARITY**DEPTH
#: Rows of a group that are numbered in one task.
SLICE_ROWS = 100_000


def encoded(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def digest_of(digests) -> bytes:
    """Hash of digests, concatenated as lowercase hex text."""
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def levels(n: int) -> int:
    """Steps from ``n`` nodes to one."""
    steps = 0
    while n > 1:
        n, steps = -(-n // ARITY), steps + 1
    return steps


def parent(children: tuple) -> tuple:
    return digest_of([c[0] for c in children]), children


def build(leaves: list[bytes], depth: int) -> tuple:
    """Top of a tree of ``(digest, children)`` nodes, ``depth`` steps above its leaves."""
    row = [(d, ()) for d in leaves]
    for _ in range(depth):
        row = [parent(tuple(row[i:i + ARITY])) for i in range(0, len(row), ARITY)]
    return row[0]


def with_leaf(top: tuple, at: int, depth: int, leaf: bytes) -> tuple:
    """Top of a version whose leaf ``at`` is ``leaf``: ``depth`` nodes are copied, others shared."""
    if depth == 0:
        return leaf, ()
    below = ARITY ** (depth - 1)
    i, children = at // below, top[1]
    return parent((*children[:i], with_leaf(children[i], at % below, depth - 1, leaf), *children[i + 1:]))


def siblings(top: tuple, at: int, depth: int) -> bytes:
    """Digests of the other nodes of each run on the way from leaf ``at`` to the top."""
    out = []
    for step in range(depth - 1, -1, -1):
        below = ARITY**step
        i, at = at // below, at % below
        out.append(b"".join(c[0] for j, c in enumerate(top[1]) if j != i))
        top = top[1][i]
    return b"".join(reversed(out))


def fold(digest: bytes, n: int, at: int, proof: bytes) -> tuple[bytes, bytes]:
    """The root that ``digest`` at place ``at`` of ``n`` nodes gives with the siblings of ``proof``,
    and what is left of the proof."""
    while n > 1:
        i = at % ARITY
        size = min(ARITY, n - at + i)
        run = [proof[32 * j:32 * j + 32] for j in range(size - 1)]
        digest, proof = digest_of([*run[:i], digest, *run[i:]]), proof[32 * (size - 1):]
        n, at = -(-n // ARITY), at // ARITY
    return digest, proof


_BLOCK_ROWS = "at long, digest binary, siblings binary, version binary, top binary"


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``key, n, at, digest, leaf``, of ``n`` in their tree) with their siblings inside
    the block, the block's top, and its top in the version that has ``leaf`` instead."""
    other = [c for c in nodes.columns if c not in ("key", "n", "at", "digest", "leaf")]
    schema = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in ("key", "n", *other))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        at = [a % BLOCK for a in t.column("at").to_pylist()]
        depth = min(DEPTH, levels(t.column("n")[0].as_py()))
        top = build(t.column("digest").to_pylist(), depth)
        leaves = t.column("leaf").to_pylist()
        made = [pa.array([siblings(top, a, depth) for a in at], pa.binary()),
                pa.array([None if x is None else with_leaf(top, a, depth, x)[0] for a, x in zip(at, leaves)], pa.binary()),
                pa.array([top[0]] * len(at), pa.binary())]
        return pa.table([*(t.column(c) for c in ("key", "n", *other, "at", "digest")), *made],
                        names=["key", "n", *other, "at", "digest", "siblings", "version", "top"])

    return (nodes.withColumn("_block", F.expr(f"at div {BLOCK}")).groupBy("key", "_block")
            .applyInArrow(lambda key, t: run(t.drop_columns(["_block"])), f"{schema}, {_BLOCK_ROWS}"))


def _tops(built: DataFrame) -> DataFrame:
    """The tops of written blocks, as nodes of the tree above."""
    return built.filter(F.col("at") % BLOCK == 0).select(
        "key", F.ceil(F.col("n") / BLOCK).alias("n"), F.expr(f"at div {BLOCK}").alias("at"), F.col("top").alias("digest"))


def _above(nodes: DataFrame) -> DataFrame:
    """``key, at, n, siblings, root``: for each node the siblings up to its tree's root."""
    built = []
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        built.append(written(_blocks(nodes.withColumn("leaf", F.lit(None).cast("binary"))), "tree"))
        nodes = _tops(built[-1])
    out = nodes.select("key", "at", "n", F.lit(b"").alias("siblings"), F.col("digest").alias("root"))
    for step in reversed(built):
        up = out.select("key", F.col("at").alias("_up"), F.col("siblings").alias("_more"), "root")
        out = (step.withColumn("_up", F.expr(f"at div {BLOCK}")).join(up, ["key", "_up"])
               .select("key", "at", "n", F.concat("siblings", "_more").alias("siblings"), "root"))
    return written(out, "paths")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source",
             changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (hash of the
    siblings up to the root, left to right and level by level), ``folded_root`` and ``verified``, as
    lowercase hex; then ``position`` in the group from 0, ``group_rows`` and ``proof``, the siblings.

    ``changed`` maps fields to their later values; where ``when`` is true, the row's version of the
    tree has the leaf of those values, and ``folded_root`` is its root. Elsewhere it is folded from
    the row's own leaf. ``verified`` tells whether it is the root of the manifest.

    Null fields have their own mark, so null and empty differ. A null group is the first one, null
    ids come first in a group, and rows that repeat an id follow by leaf; equal rows are leaves of
    their own. A group of one row is its leaf. Texts of any length are hashed where they are; other
    columns are ignored, and an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    value = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_hash(list(value.values()))
    now = leaf_hash([(changed or {}).get(f, v) for f, v in value.items()])
    group = F.col(f"`{group_col}`").cast("string")
    leaves = written(docs.select(
        F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group)).alias("key"), F.col(f"`{id_col}`").alias("id"),
        leaf.alias("digest"), (F.when(when, now) if when is not None else F.lit(None)).cast("binary").alias("now")), "leaves")
    counts = leaves.groupBy("key").agg(F.count("*").alias("n"))
    rows = join_small(number_rows(leaves, ["key"], ["id", "digest", "now"], "_row", SLICE_ROWS), counts, ["key"])
    rows = rows.select("key", "n", "id", (F.col("_row") - 1).alias("at"), "digest", F.coalesce("now", "digest").alias("leaf"))
    built = written(_blocks(rows), "blocks")

    paths = _above(_tops(built))
    groups = paths.filter("at = 0").select(F.lit(0).alias("all"), F.col("key").alias("group"), F.col("root").alias("digest"))
    n_groups = groups.count()
    ranked = written(number_rows(groups, ["all"], ["group"], "_row", SLICE_ROWS).select(
        F.lit("").alias("key"), F.lit(n_groups).cast("long").alias("n"), (F.col("_row") - 1).alias("at"), "digest", "group"), "groups")
    over = ranked.join(_above(ranked.drop("group")).select("at", "siblings", "root"), "at").select(
        F.col("group").alias("key"), F.col("at").alias("_rank"), F.col("siblings").alias("_last"), "root")
    paths = paths.withColumnRenamed("root", "subroot").join(over, "key").select(
        "key", F.col("at").alias("_block"), F.col("n").alias("_blocks"), F.concat("siblings", "_last").alias("_more"), "_rank", "subroot", "root")
    joined = built.withColumn("_block", F.expr(f"at div {BLOCK}")).join(paths, ["key", "_block"]).select(
        "id", "digest", "subroot", "root", F.concat("siblings", "_more").alias("proof"), "_more", "version",
        "_blocks", "_block", "_rank", F.col("at").alias("position"), F.col("n").alias("group_rows"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position", "group_rows", "proof"]
    schema = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, " \
             "verified boolean, position long, group_rows long, proof binary"

    def finish(batches):
        for b in batches:
            at = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names) if c != "id"}
            folded = []
            for top, n, block, rank, more in zip(at["version"], at["_blocks"], at["_block"], at["_rank"], at["_more"]):
                top, more = fold(top, n, block, more)
                folded.append(fold(top, n_groups, rank, more)[0])
            hexed = [pa.array([d.hex() for d in at[c]], pa.string()) for c in ("digest", "subroot", "root")]
            yield pa.record_batch(
                [b.column(0), *hexed, pa.array([digest_of([p]).hex() for p in at["proof"]], pa.string()),
                 pa.array([d.hex() for d in folded], pa.string()),
                 pa.array([f == r for f, r in zip(folded, at["root"])], pa.bool_()),
                 b.column("position"), b.column("group_rows"), b.column("proof")], names=names)

    return joined.mapInArrow(finish, schema)
