"""Token ids in files of compressed blocks, in ascending document order.

Documents are range-partitioned and sorted by id, so each partition's file holds a run of ids.
A file is Parquet with one row per block; a block, see ``range_coder``, needs nothing outside
itself. Spark commits and reads the files, so a lost executor or a store without local paths
changes nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longitab.llm.common import bounded_batches, partitions_of, together
from longitab.llm.range_coder import decode_block, encode_block
from longitab.llm.tokens import encoder

#: A block is closed at so many ids or documents; whole documents only.
BLOCK_IDS, BLOCK_DOCS = 1 << 21, 1 << 16
BLOCKS = "part int, block int, n_ids long, n_docs long, data binary"
_ROW = np.dtype([("id", "<i8"), ("n", "<u4"), ("null", "u1")])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
              text_col: str = "text", partitions: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, ordered by document id.

    Null text is empty: the end id alone. A null document id comes first, repeated rows follow
    each other; each is a document of its own. An empty table gives files without blocks. Other
    columns are ignored. A document longer than ``block_ids`` has a block of its own.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        enc, part, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        rows, ids, size = [], [], 0

        def close():
            table = np.array(rows, _ROW)
            data = encode_block(np.concatenate(ids), table.tobytes(), len(rows))
            return pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                                    "n_ids": pa.array([size]), "n_docs": pa.array([len(rows)]),
                                    "data": pa.array([data], pa.binary())})

        for batch in together(batches, 1):
            for doc, x in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1), end_id)):
                if rows and (size + len(x) > block_ids or len(rows) == BLOCK_DOCS):
                    yield close()
                    rows, ids, size, block = [], [], 0, block + 1
                rows.append((doc or 0, len(x), doc is None))
                ids.append(x)
                size += len(x)
        if rows:
            yield close()

    n = partitions or partitions_of(docs.sparkSession)
    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
     .repartitionByRange(n, "id").sortWithinPartitions("id").mapInArrow(run, BLOCKS).write.parquet(path))


def _starts(blocks: DataFrame) -> DataFrame:
    """Ids before each block. The window over everything has one row per file."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(parts, F.col("part") == F.col("p"))
            .select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("base") + F.col("inside")).alias("before")))


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: id, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32``, and ``ids`` (little-endian unsigned 32-bit) if ``with_ids``.

    Every block is decoded and held against its checksum; a damaged one raises.
    """
    files = spark.read.schema(BLOCKS).parquet(path)
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("inside", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.binary()))

    def run(batches):
        for batch in batches:
            for part, block, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids, table, n = decode_block(data)
                rows = np.frombuffer(table, _ROW, n)
                begin = np.concatenate(([0], np.cumsum(rows["n"].astype(np.int64))))
                raw = [ids[a:b].tobytes() for a, b in zip(begin, begin[1:])]
                cols = [pa.array(rows["id"], mask=rows["null"].astype(bool)), pa.array(np.full(n, part, np.int32)),
                        pa.array(np.full(n, block, np.int32)), pa.array(begin[:-1]),
                        pa.array(rows["n"].astype(np.int64)), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.record_batch(cols + ([pa.array(raw, pa.binary())] if with_ids else []), schema=schema)

    kind = "id long, part int, block int, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = files.select("part", "block", "data").mapInArrow(run, kind)
    out = found.join(_starts(files.select("part", "block", "n_ids")), (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    return out.select(F.col("id").alias(id_col), (F.col("before") + F.col("inside")).alias("start"), "n_tokens",
                      "ids_crc32", *["ids"] * with_ids)
