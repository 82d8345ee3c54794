"""Harmonic packing of documents into fixed-length sequences.

Lengths fall into classes by the reciprocal of the capacity: a piece of class k is at most
``capacity // k`` long and a bin of that class takes exactly k pieces. A document is cut so that
bins come out nearly full: into whole sequences, then into halves, quarters and so on down to
``capacity // exact``, which fill their bins without padding, and one rest below that, whose class
is ``capacity // length``, so that a bin lacks less than ``length + 1`` places.

Every task keeps the one open bin of each class and packs by itself, without a shuffle. The pieces in
bins still open at its end, at most the rests of its documents, go to a second pass, which packs them
in the same way in tasks of about ``PASS_TOKENS`` ids: how many tasks there were at first makes no
difference to the padding. Bins that the second pass leaves open are cut into groups of a power of two
of pieces where the pieces are equal, which need no padding; the others are filled first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitab.llm.common import bounded_batches, pieces, written
from longitab.llm.tokens import encoder

CAPACITY = 1024
#: The smallest fraction of a sequence, as its reciprocal, that is cut off exactly.
EXACT = 16
#: Sequence ids of one task start at its number times this; those of the second pass above all these.
SEQUENCES, SECOND = 1 << 40, 1 << 61
#: Parts of texts that a worker remembers with their ids, in each of two generations.
KEPT_PARTS = 600_000
#: Ids that a task of the second pass packs.
PASS_TOKENS = 1 << 20


def cut(n: int, capacity: int = CAPACITY, exact: int = EXACT) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of ``n`` ids."""
    out, start = [], 0
    while n - start >= capacity:
        out.append((start, capacity, 1))
        start += capacity
    k = 2
    while k <= exact:
        if n - start >= capacity // k:
            out.append((start, capacity // k, k))
            start += capacity // k
        k *= 2
    if n > start:
        out.append((start, n - start, capacity // (n - start)))
    return out


class Bins:
    """The open bin of each class; rows (piece..., sequence, offset) of the filled ones."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple]] = {}

    def close(self, bin_: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in bin_:
            yield *piece, self.next, offset
            offset += piece[2]
        self.next += 1

    def add(self, k: int, piece: tuple) -> Iterator[tuple]:
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            del self.open[k]
            yield from self.close(bin_)

    def left(self) -> Iterator[tuple]:
        """The pieces of open bins with their class instead of a place."""
        for k, bin_ in self.open.items():
            for piece in bin_:
                yield *piece, None, k

    def rest(self) -> Iterator[tuple]:
        """Open bins: equal pieces whose length is a power of two in groups of a power of two,
        the others first fit, longest first, into as few bins as that takes."""
        mixed: list[tuple] = []
        for k in sorted(self.open):
            bin_ = self.open[k]
            length = bin_[0][2]
            if any(p[2] != length for p in bin_) or length & (length - 1):
                mixed += bin_
                continue
            while bin_:
                m = 1 << (len(bin_).bit_length() - 1)
                yield from self.close(bin_[:m])
                bin_ = bin_[m:]
        left: list[list] = []
        for piece in sorted(mixed, key=lambda p: -p[2]):
            place = next((b for b in left if b[0] >= piece[2]), None)
            if place is None:
                left.append(place := [self.capacity, []])
            place[0] -= piece[2]
            place[1].append(piece)
        for _, bin_ in left:
            yield from self.close(bin_)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept_parts: int = KEPT_PARTS) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, and ``ids`` (little-endian unsigned 32-bit) if ``with_ids``.

    A document is its ids by ``tokenizer``, the path of a tokenizers file, and ``end_id``. Null text
    is empty and so has the end id alone; null ids and repeated rows are packed as rows of their
    own. A text of any length is cut into pieces. Other columns are ignored; an empty table gives an
    empty result. Sequences are full, a power of two long, or to be padded to ``capacity``; only the
    open bins of the second pass are padded by more than a rest's length. Which sequence a piece is in
    depends on how rows fall into partitions. ``kept_parts`` bounds what a worker remembers of encoded
    parts of texts: fewer take less memory and more time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.binary()))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        # a piece is (id, start, length, crc, doc_tokens, ids) and then its place
        cols = list(zip(*rows)) if rows else [[]] * 8
        order = [0, 1, 2, 3, 4, 6, 7] + [5] * with_ids
        return pa.record_batch([pa.array(cols[i], f.type) for i, f in zip(order, schema)], schema=schema)

    def run(batches):
        enc = encoder(tokenizer, kept_parts)
        bins = Bins(TaskContext.get().partitionId() * SEQUENCES, capacity)
        for batch in pieces(batches, 1):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1), end_id)):
                n = len(ids)
                for start, length, k in cut(n, capacity):
                    part = ids[start:start + length].tobytes()
                    rows += bins.add(k, (doc, start, length, zlib.crc32(part), n, part if with_ids else None))
            yield batch_of(rows)
        yield batch_of(list(bins.left()))

    def again(batches):
        bins = Bins(SECOND + TaskContext.get().partitionId() * SEQUENCES, capacity)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = []
            for r in zip(*columns):
                # the class stands in the place of the offset
                rows += bins.add(r[6], (*r[:5], r[7] if with_ids else None))
            yield batch_of(rows)
        yield batch_of(list(bins.rest()))

    kind = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    first = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
                    .mapInArrow(run, kind), "packed")
    opened = first.filter("sequence_id IS NULL")
    tokens = opened.agg(F.sum("length")).first()[0] or 0
    second = (opened.repartition(max(1, -(-tokens // PASS_TOKENS)), "id", "start")
              .sortWithinPartitions(F.desc("offset"), "id", "start").mapInArrow(again, kind))
    return first.filter("sequence_id IS NOT NULL").unionByName(second).withColumnRenamed("id", id_col)
