"""Benchmark decontamination: one Aho-Corasick automaton over windows of benchmark words.

Texts and items become lower-case words with one space around each. Every window of an item is a
pattern; a text is passed once through the automaton of all patterns, and the ends found are
mapped to word numbers and to code points of the original text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitab.llm.common import bounded_batches, pieces, texts_of

WINDOW = 10
#: Bytes of benchmark text for one automaton; a larger benchmark is an error, not a cut.
MAX_BENCHMARK_BYTES = 64 << 20
#: A-Z to a-z; other ASCII characters but letters and digits to a space. Bytes from 0x80 stay,
#: so characters beyond ASCII are parts of words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """Windows of consecutive words; fewer words, but not none, are one window."""
    if len(words) <= size:
        return [words] if words else []
    return [words[i:i + size] for i in range(len(words) - size + 1)]


def spaced(words: list[bytes]) -> str:
    """Words with one space around each, one character a byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def build(items: list[tuple], size: int = WINDOW):
    """Automaton: each pattern leads to (characters, words, numbers of the items that have it)."""
    import ahocorasick

    found: dict[str, tuple[int, set[int]]] = {}
    for number, (_, text) in enumerate(items):
        for w in windows_of(words_of(text or ""), size):
            found.setdefault(spaced(w), (len(w), set()))[1].add(number)
    automaton = ahocorasick.Automaton()
    for pattern, (n, numbers) in found.items():
        automaton.add_word(pattern, (len(pattern), n, tuple(sorted(numbers))))
    if found:
        automaton.make_automaton()
    return automaton


def scan(automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit runs of word numbers [begin, end), and numbers of the items that occur."""
    runs: list[tuple[int, int]] = []
    items: set[int] = set()
    if not words or not len(automaton):
        return runs, items
    text, starts = spaced(words), None
    for end, (chars, n, numbers) in automaton.iter(text):
        if starts is None:  # number of the word that begins after each space
            starts = np.cumsum([0] + [len(w) + 1 for w in words])
        first = int(np.searchsorted(starts, end - chars + 1))
        runs.append((first, first + n))
        items.update(numbers)
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(runs):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((begin, end))
    return merged, items


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Code points [begin, end) of word runs in the original text."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(TABLE))]
    point = np.cumsum([(b & 0xC0) != 0x80 for b in raw])  # code points up to and with each byte
    return [{"begin": int(point[at[b][0]]) - 1, "end": int(point[at[e - 1][1] - 1])} for b, e in runs]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   max_bytes: int = MAX_BENCHMARK_BYTES,
                   with_row: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (item ids as
    strings, sorted), ``items_sha256``, ``contaminated``, ``spans`` (code points of the hit runs),
    and ``row``, a struct of all columns, if ``with_row``.

    Null and empty texts have no words and no hits; so have items without words. Null item ids
    count as the string ``null``. Repeated item ids count once, repeated rows of ``docs`` each give
    a row. Other columns are ignored. The benchmark goes to every task, so its bytes are measured
    first; above ``max_bytes`` this raises.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    b = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"),
                         F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    size = b.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"a benchmark of {size} bytes is above max_bytes={max_bytes}")
    items = spark.sparkContext.broadcast([(r.i, r.t) for r in b.collect()])
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                        ("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
                        ("spans", span)])

    def run(batches):
        automaton = build(items.value, window)
        names = [i for i, _ in items.value]
        for batch in pieces(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words = words_of(text)
                runs, numbers = scan(automaton, words)
                ids = sorted({names[n] for n in numbers})
                rows.append((doc, len(words), sum(e - b for b, e in runs), len(ids), ids,
                             hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(runs), spans_of(text, runs)))
            found = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            yield pa.record_batch(found + ([batch.column(2)] if with_row else []), names=schema.names + ["row"] * with_row)

    kind = T.StructType.fromDDL("id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
                                "contaminated boolean, spans array<struct<begin: long, end: long>>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       *[F.struct("*").alias("row")] * with_row)
    return rows.mapInArrow(run, T.StructType([*kind, *rows.schema[2:]])).withColumnRenamed("id", id_col)
