"""Hierarchical Pitman-Yor language model over words.

Each context, the word before, has a restaurant whose dishes are words. All context restaurants
share one parent, the restaurant of all words, whose parent gives equal shares to every known word
and one unknown word. A customer is a token; a table of a context restaurant is a customer of the
parent. Seating is sampled by Gibbs sweeps: all customers of a dish leave and are seated again one
after another, given the parent's probabilities and the totals of the last sweep. The predictive
probabilities of the sweeps after the first ones are averaged.

Words are dealt to shards by hash. A shard holds all restaurants' seats of its words. Between
sweeps each shard sends its sums for its contexts, packed, to the contexts' owners, again by hash,
and gets the totals back. Seating depends on the seed, the shard and those totals, so a lost task
seats again in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longitab.llm.common import bounded_batches, let_go, partitions_of, pieces, written

#: The context at the start of a text. A word of one byte is the context of that number, a longer
#: one that of its hash with bit 9 set, so that none of them is this.
START = 256
LONGER = np.uint64(512)
#: Sweeps, and how many of them are left out of the average.
SWEEPS, BURN = 3, 1
STRENGTH = 1.0
#: Contexts with more than 1 / HOT_CONTEXTS of the tokens, and pairs of words with more than
#: 1 / HOT_PAIRS; there are fewer than that of either. Those pairs' probabilities, 32 MB at most,
#: go to every task.
HOT_CONTEXTS, HOT_PAIRS = 4096, 1 << 20
#: Customers of a dish seated one by one; then so many at once that the odds hardly change.
ONE_BY_ONE = 64
#: Tokens, or pairs of words, held by a task before it hands them on.
HELD = 4_000_000
SEED = 7


def in_training(id_col: str) -> Column:
    """crc32 of the id as text, mod 5, is not 1. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 1, F.lit(True))


def numbered(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Hashes and contexts of the distinct words of texts, START the last context; of each token the
    number of its word and of its context; and lengths of texts. A-Z in lower case, words
    ``[^\\x20\\x09-\\x0D]+`` and an end after the last; null is empty."""
    import xxhash

    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parts, text = cut.flatten(), pc.list_parent_indices(cut).to_numpy().astype(np.int64)
    there = pc.not_equal(pc.binary_length(parts), 0)  # white space at either end leaves an empty part
    coded = parts.filter(there).dictionary_encode()
    text = text[there.to_numpy(zero_copy_only=False)]
    words = np.append(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), [b"\n"])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    contexts = np.append(hashes | LONGER, np.uint64(START))
    short = np.flatnonzero(np.append(pc.binary_length(coded.dictionary).to_numpy() == 1, True))
    contexts[short] = [w[0] for w in words[short]]
    lengths = np.bincount(text, minlength=len(texts)) + 1
    ends = np.cumsum(lengths) - 1
    at = np.full(lengths.sum(), len(words) - 1, np.int64)
    at[np.arange(len(text)) + text] = coded.indices.to_numpy()
    before = np.empty(len(at), np.int64)
    before[1:] = at[:-1]
    before[ends - lengths + 1] = len(hashes)
    return hashes, contexts, at, before, lengths


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, compressed. Bytes of equal weight lie together, so that high ones that are
    all alike take no room."""
    head = [np.array([len(columns)], "<u4").tobytes()]
    head += [c.dtype.str.encode().ljust(4) + len(c).to_bytes(8, "little") for c in columns]
    data = b"".join(head + [np.ascontiguousarray(c).view("u1").reshape(len(c), c.itemsize).T.tobytes() for c in columns])
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def opened(data: bytes) -> list[np.ndarray]:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out, begin = [], 4 + 12 * n
    for i in range(4, begin, 12):
        kind, length = np.dtype(data[i:i + 4].decode().strip()), int.from_bytes(data[i + 4:i + 12], "little")
        size = kind.itemsize * length
        out.append(np.frombuffer(data, "u1", size, begin).reshape(kind.itemsize, length).T.copy().view(kind).reshape(length))
        begin += size
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of ordered numbers, the first one as it is; ``np.cumsum`` takes them back."""
    out = ordered.copy()
    out[1:] -= ordered[:-1]
    return out


def pack_pairs(key: np.ndarray, contexts: np.ndarray, at: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns in the order of sorted keys; a repeated key is kept once. ``at`` are places in the
    sorted ``contexts``; those of a key are kept as differences, which are small if they ascend."""
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    run = np.diff(np.concatenate((np.flatnonzero(first), [len(key)]))).astype("<u4")
    at = at.astype("<u4")
    return packed(steps(key[first].astype("<u8")), run, steps(contexts.astype("<u8")), np.where(first, at, steps(at)), *columns)


def unpack_pairs(data: bytes) -> list[np.ndarray]:
    """Distinct keys, how often each is there, contexts, places in them, and columns."""
    words, run, contexts, at, *columns = opened(data)
    total = np.cumsum(at, dtype="<u4")
    begin = np.cumsum(run, dtype=np.int64) - run
    at = total - np.repeat(total[begin] - at[begin], run)
    return [np.cumsum(words, dtype="<u8"), run, np.cumsum(contexts, dtype="<u8"), at, *columns]


def ranked(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct values of all arrays, and the place of each value of each array."""
    values, place = np.unique(np.concatenate(parts), return_inverse=True)
    return values, np.split(place.astype(np.int64), np.cumsum([len(p) for p in parts])[:-1])


def summed(held: list[tuple]):
    """Words, contexts, and of each pair of them, sorted, the places in both and the count. ``held`` has
    words, contexts, and of pairs the places in both and counts."""
    words, word = ranked([h[0] for h in held])
    contexts, context = ranked([h[1] for h in held])
    code = np.concatenate([w[h[2]] * len(contexts) + c[h[3]] for h, w, c in zip(held, word, context)])
    count = np.concatenate([h[4] for h in held])
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    code = code[first]
    return words, contexts, code // len(contexts), code % len(contexts), np.add.reduceat(count[order], first)


def narrowed(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of sorted ``values`` that ``places`` use, and the places in them."""
    used = np.zeros(len(values), bool)
    used[places] = True
    return values[used], (np.cumsum(used) - 1)[places]


def by_shard(key: np.ndarray, shards: int):
    """(shard, positions in key order) of sorted ``key``."""
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s]:edges[s + 1]]


def count_words(docs: DataFrame, text_col: str, shards: int, learned: Column) -> DataFrame:
    """``shard, data``: pairs of words and contexts of a shard, with counts. Each task adds up its
    own tokens first. Of rows that are not ``learned`` only the contexts are kept, so that their
    totals are there when these rows are scored."""
    def count(batches):
        held, size = [], 0

        def close():
            words, contexts, word, context, n = summed(held)
            key = words[word]
            rows = [(s, pack_pairs(key[i], *narrowed(context[i], contexts), n[i].astype("<u4"))) for s, i in by_shard(key, shards)]
            return pa.record_batch({"shard": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

        for batch in pieces(batches, 0):
            hashes, contexts, at, before, lengths = numbered(batch.column(0))
            weight = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), lengths)
            if len(at):
                code, n = np.unique((before * len(hashes) + at) * 2 + weight, return_counts=True)
                pair = code >> 1
                held.append((hashes, contexts, pair % len(hashes), pair // len(hashes), n * (code & 1)))
                size += len(pair)
            if size > HELD // 2:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    def merge(batches):
        for shard, blobs in runs(batches):
            held = []
            for b in blobs:
                words, run, contexts, at, n = unpack_pairs(b)
                held.append((words, contexts, np.repeat(np.arange(len(words)), run), at, n.astype(np.int64)))
            words, contexts, word, at, n = summed(held)
            some = n > 0
            key, at, n = words[word[some]], at[some], n[some]
            yield pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "data": pa.array([pack_pairs(key, contexts, at, n.astype("<i8"))], pa.binary()),
                "words": pa.array([int((key[1:] != key[:-1]).sum()) + (len(key) > 0)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()),
                "pairs": pa.array([len(n)], pa.int64()), "once": pa.array([int((n == 1).sum())], pa.int64()), "twice": pa.array([int((n == 2).sum())], pa.int64())})

    rows = docs.select(F.col(text_col).cast("string").alias("t"), learned.alias("l")).mapInArrow(count, "shard int, data binary")
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard")
    return written(rows.mapInArrow(merge, "shard int, data binary, words long, tokens long, pairs long, once long, twice long"), "words")


def runs(batches):
    """(shard, blobs) of batches sorted by shard."""
    shard, blobs = None, []
    for batch in batches:
        for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != shard and blobs:
                yield shard, blobs
                blobs = []
            shard = s
            blobs.append(data)
    if blobs:
        yield shard, blobs


def numbers(df: DataFrame, names: list[str]) -> dict:
    one = df.agg(*[F.sum(c).alias(c) for c in names]).first()
    return {c: one[c] or 0 for c in names}


@dataclass
class Totals:
    """What the shards share: numbers, discounts, of each sweep the customers and the tables of the
    parent, and the totals of the hot contexts as in ``Shard.totals``."""

    tokens: int
    words: int
    discount: float
    parent_discount: float
    sweeps: list[tuple[float, float]] = field(default_factory=list)
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_totals: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def seat(count: np.ndarray, new: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables at which ``count`` customers of each dish end up; ``new`` is the weight of a new table."""
    tables = np.ones(len(count), np.int64)
    order = np.argsort(-count, kind="stable")
    desc = count[order]
    seated, most = 1, int(desc[0]) if len(desc) else 0
    t, w = tables[order], new[order]
    while seated < most:
        step = 1 if seated < ONE_BY_ONE else seated // 16
        m = np.searchsorted(-desc, -seated, "left")  # dishes with customers still to come
        share = w[:m] / (w[:m] + seated - discount * t[:m])
        t[:m] += rng.random(m) < share if step == 1 else rng.binomial(np.minimum(step, desc[:m] - seated), share)
        seated += step
    tables[order] = t
    return tables


class Backs:
    """Weights of the parent by context; 1 in a context that no training token follows."""

    def __init__(self, contexts: np.ndarray, back: np.ndarray):
        self.contexts, self.back = contexts, np.append(back, 1.0)

    def __getitem__(self, context) -> np.ndarray:
        return self.back[found(self.contexts, np.asarray(context, np.uint64))]


def found(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in ``ordered``, its length for those that are not there."""
    at = np.searchsorted(ordered, values)
    if not len(ordered):
        return at
    return np.where(ordered[np.minimum(at, len(ordered) - 1)] == values, at, len(ordered))


class Shard:
    """Seats of the words of one shard, replayed from the totals of the sweeps so far.

    ``totals`` has the tokens of the shard's contexts, then a row of their tables at the start and
    one for each sweep. Without it, it is at the end of ``data``."""

    def __init__(self, number: int, data: bytes, shared: Totals, totals: np.ndarray | None = None):
        self.number, self.shared = number, shared
        if totals is None:
            split = int.from_bytes(data[:8], "little")
            totals, data = opened(data[8 + split:])[0], data[8:8 + split]
        self.words, run, self.contexts, self.at, self.count = unpack_pairs(data)
        self.totals = totals.reshape(-1, len(self.contexts)) if len(self.contexts) else totals.reshape(0, 0)
        self.word = np.repeat(np.arange(len(self.words)), run)
        self.tables = np.ones(len(self.count), np.int64)
        self.customers = np.bincount(self.word, minlength=len(self.words))
        self.parent_tables = np.ones(len(self.words), np.int64)
        self.many = np.flatnonzero(self.count > 1)

    @property
    def context(self) -> np.ndarray:
        return self.contexts[self.at]

    def parent(self, customers, tables, sweep: int):
        """Probability of words in the parent restaurant."""
        d = self.shared.parent_discount
        all_customers, all_tables = self.shared.sweeps[sweep]
        equal = 1.0 / (self.shared.words + 1)
        return (np.maximum(customers - d * tables, 0) + (STRENGTH + d * all_tables) * equal) / (STRENGTH + all_customers)

    def sweep(self, number: int) -> None:
        """Sweep ``number`` (from 1), given the totals of the one before."""
        s, rng, many = self.shared, np.random.default_rng((SEED, number, self.number)), self.many
        p = self.parent(self.customers, self.parent_tables, number - 1)
        weight = (STRENGTH + s.discount * self.totals[number][self.at[many]]) * p[self.word[many]]
        self.tables[many] = seat(self.count[many], weight, s.discount, rng)
        self.customers = np.bincount(self.word, self.tables, minlength=len(self.words)).astype(np.int64)
        weight = np.full(len(self.words), (STRENGTH + s.parent_discount * s.sweeps[number - 1][1]) / (s.words + 1))
        self.parent_tables = seat(self.customers, weight, s.parent_discount, rng)

    def predictive(self):
        """Average over the kept sweeps. Of each seat its probability; of each word, and at last of
        an unknown one, the probability in each context where it has no seat, by sweep."""
        s = self.shared
        here, absent = 0.0, []
        contexts = np.concatenate((self.contexts, s.hot))
        contexts, first = np.unique(contexts, return_index=True)
        for number in range(1, SWEEPS + 1):
            self.sweep(number)
            if number <= BURN:
                continue
            below, back = STRENGTH + self.totals[0], STRENGTH + s.discount * self.totals[number + 1]
            back = back / below
            p = np.append(self.parent(self.customers, self.parent_tables, number), self.parent(0, 0, number))
            here = here + np.maximum(self.count - s.discount * self.tables, 0) / below[self.at] + back[self.at] * p[self.word]
            if len(s.hot):
                back = np.concatenate((back, (STRENGTH + s.discount * s.hot_totals[number + 1]) / (STRENGTH + s.hot_totals[0])))
            absent.append((p, Backs(contexts, back[first])))
        return here / len(absent), absent


def away(absent, word, context):
    """Averaged probability of words in contexts where they have no seat."""
    return sum(p[word] * back[context] for p, back in absent) / len(absent)


def seat_rows(counts: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """``counts`` and the answers of the rounds so far, in one table."""
    rows = counts.select("shard", F.lit(-1).alias("round"), F.lit(-1).alias("owner"), "data")
    for number, answer in enumerate(answers):
        rows = rows.unionByName(answer.filter("shard >= 0").select("shard", F.lit(number).alias("round"), "owner", "data"))
    return rows


def with_totals(counts: DataFrame, answers: list[DataFrame], shards: int) -> DataFrame:
    """The same, a shard's together."""
    return seat_rows(counts, answers).repartitionById(shards, "shard").sortWithinPartitions("shard", "round")


class Gathered:
    """Counts of a shard and totals of its contexts, as the answers come in."""

    def __init__(self, number: int, data: bytes, shards: int):
        self.number, self.data, self.totals = number, data, []
        contexts = unpack_pairs(data)[2]
        self.size, self.places = len(contexts), dict(by_shard(contexts, shards))

    def add(self, number: int, owner: int, blob: bytes) -> None:
        while len(self.totals) <= number:
            self.totals.append(np.zeros((1 if self.totals else 2, self.size), np.int64))
        self.totals[number][:, self.places[owner]] = opened(blob)

    def table(self) -> np.ndarray:
        return np.concatenate(self.totals) if self.totals else np.zeros((0, 0), np.int64)


def shard_totals(batches, shards: int):
    """(shard, data, totals) of the rows of ``with_totals``."""
    held = None
    for batch in batches:
        for s, number, owner, blob in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if number >= 0:
                held.add(number, owner, blob)
                continue
            if held:
                yield held.number, held.data, held.table()
            held = Gathered(s, blob, shards)
    if held:
        yield held.number, held.data, held.table()


def exchanged(counts: DataFrame, answers: list[DataFrame], shared: Totals, shards: int) -> DataFrame:
    """One round: each shard's sums for its contexts (tokens and tables at the start, then tables
    after a sweep) go to the contexts' owners, and the totals come back as ``shard, owner, data``,
    those of hot contexts as shard -1. Adds to ``shared``."""
    spark, number, columns = counts.sparkSession, len(answers), 1 if answers else 2
    sent = spark.sparkContext.broadcast(shared)

    def ask(batches):
        for s, data, totals in shard_totals(batches, shards):
            shard = Shard(s, data, sent.value, totals)
            for i in range(1, number + 1):
                shard.sweep(i)
            sums = [np.bincount(shard.at, v, minlength=len(shard.contexts)).astype("<i8") for v in ([shard.tables] if number else [shard.count, shard.tables])]
            own = [(o, packed(steps(shard.contexts[i]), *(v[i] for v in sums))) for o, i in by_shard(shard.contexts, shards)]
            yield pa.record_batch({"owner": pa.array([o for o, _ in own], pa.int32()), "shard": pa.array([s] * len(own), pa.int32()),
                                   "data": pa.array([b for _, b in own], pa.binary()),
                                   "customers": pa.array([int(shard.customers.sum())] + [0] * (len(own) - 1), pa.int64()),
                                   "tables": pa.array([int(shard.parent_tables.sum())] + [0] * (len(own) - 1), pa.int64())})

    def answer(batches):
        def done():
            ids, inverse = np.unique(np.concatenate([i for _, i, _ in held]), return_inverse=True)
            sums = np.stack([np.bincount(inverse, np.concatenate([v[c] for _, _, v in held])) for c in range(columns)]).astype("<i8")
            ends = np.cumsum([len(i) for _, i, _ in held])
            rows = [(s, packed(*sums[:, inverse[e - len(i):e]])) for (s, i, _), e in zip(held, ends)]
            hot = np.flatnonzero(np.isin(ids, sent.value.hot) if number else sums[0] > sent.value.tokens / HOT_CONTEXTS)
            if len(hot):
                rows.append((-1, packed(ids[hot], *sums[:, hot])))
            return pa.record_batch({"shard": pa.array([r[0] for r in rows], pa.int32()), "owner": pa.array([owner] * len(rows), pa.int32()),
                                    "data": pa.array([r[1] for r in rows], pa.binary()),
                                    "customers": pa.array([customers] + [0] * (len(rows) - 1), pa.int64()),
                                    "tables": pa.array([tables] + [0] * (len(rows) - 1), pa.int64())})

        owner, held, customers, tables = None, [], 0, 0
        for batch in batches:
            for o, s, data, c, t in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if o != owner and held:
                    yield done()
                    held, customers, tables = [], 0, 0
                ids, *sums = opened(data)
                held.append((s, np.cumsum(ids, dtype="<u8"), sums))
                owner, customers, tables = o, customers + c, tables + t
        if held:
            yield done()

    asked = with_totals(counts, answers, shards).mapInArrow(ask, "owner int, shard int, data binary, customers long, tables long")
    asked = asked.repartitionById(shards, "owner").sortWithinPartitions("owner")
    out = written(asked.mapInArrow(answer, "shard int, owner int, data binary, customers long, tables long"), "answers")
    parent = numbers(out, ["customers", "tables"])
    ids, sums = [np.zeros(0, np.uint64)], [np.zeros((columns, 0), np.int64)]
    for r in out.filter("shard = -1").select("data").collect():
        hot, *found_sums = opened(r["data"])
        ids.append(hot)
        sums.append(np.stack(found_sums))
    ids, sums = np.concatenate(ids), np.concatenate(sums, axis=1)
    order = np.argsort(ids)
    shared.hot_totals = np.concatenate((shared.hot_totals, sums[:, order])) if number else sums[:, order]
    shared.hot = ids[order]
    shared.sweeps.append((float(parent["customers"]), float(parent["tables"])))
    return out


def taught(docs: DataFrame, text_col: str, learned: Column) -> tuple[DataFrame, list[DataFrame], Totals]:
    """Counts of the ``learned`` rows of ``docs``, answers of all rounds, and what shards share."""
    shards = partitions_of(docs.sparkSession)
    counts = count_words(docs, text_col, shards, learned)
    n = numbers(counts, ["words", "tokens", "once", "twice"])
    discount = min(0.95, max(0.05, (n["once"] + 1) / (n["once"] + 2 * n["twice"] + 2)))
    shared = Totals(int(n["tokens"]), int(n["words"]), discount, discount)
    answers = []
    for _ in range(SWEEPS + 1):
        answers.append(exchanged(counts, answers, shared, shards))
    return counts, answers, shared


def learn(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Totals]:
    """Seats of all rows of ``docs`` with the totals of all sweeps, ``shard, data``, and what the
    shards share."""
    counts, answers, shared = taught(docs, text_col, F.lit(True))
    return joined(counts, answers), shared


def joined(counts: DataFrame, answers: list[DataFrame]) -> DataFrame:
    shards = partitions_of(counts.sparkSession)

    def join(batches):
        for s, data, totals in shard_totals(batches, shards):
            yield pa.record_batch({"shard": pa.array([s], pa.int32()),
                                   "data": pa.array([len(data).to_bytes(8, "little") + data + packed(totals.astype("<i8").ravel())], pa.binary())})

    return with_totals(counts, answers, shards).mapInArrow(join, "shard int, data binary")


def base(count, shared: Totals):
    """log10 of the add-half share of a token with that training count."""
    n, v = shared.tokens, shared.words
    return np.log10((count + 0.5) / (n + 0.5 * (v + 1)))


def pair_code(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    return key * np.uint64(0x9E3779B97F4A7C15) + context


def hot_pairs(model: DataFrame, shared: Totals) -> tuple[np.ndarray, ...]:
    """Codes, hashes, contexts, counts of the word and log10 probabilities of the pairs with more
    than 1 / HOT_PAIRS of the tokens."""
    limit = shared.tokens / HOT_PAIRS
    sent = model.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(s, data, sent.value)
                hot = np.flatnonzero(shard.count > max(limit, 1))
                if not len(hot):
                    continue
                here, _ = shard.predictive()
                total = np.bincount(shard.word, shard.count, minlength=len(shard.words)).astype(np.int64)
                word = shard.word[hot]
                yield pa.record_batch({"key": pa.array(shard.words[word].view(np.int64)), "context": pa.array(shard.context[hot].view(np.int64)),
                                       "n": pa.array(total[word]), "log": pa.array(np.log10(here[hot]))})

    rows = model.select("shard", "data").mapInArrow(run, "key long, context long, n long, log double").toArrow()
    key, context = (rows[c].to_numpy().view(np.uint64) for c in ("key", "context"))
    code = pair_code(key, context)
    order = np.argsort(code)
    return code[order], key[order], context[order], rows["n"].to_numpy()[order], rows["log"].to_numpy()[order]


ROUTED = ("round int, task int, place int, id long, held_out boolean, n_tokens long, base double, score double, known long, "
          "shard int, data binary")
#: Rounds of tokens and of document rows, which come after those of the seats.
TOKENS, ROW = 1000, 1001


def score(docs: DataFrame, counts: DataFrame, answers: list[DataFrame], shared: Totals, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` and ``perplexity`` per token. The contexts of ``docs`` are those that
    ``taught`` has seen.

    Frequent pairs are scored where the text is. The other tokens, doc by doc and packed, go to the
    shard of their word, and the sums of each document come back.
    """
    spark = docs.sparkSession
    shards = partitions_of(spark)
    sent, hot = spark.sparkContext.broadcast(shared), spark.sparkContext.broadcast(hot_pairs(joined(counts, answers), shared))
    let_go(spark)  # the shuffles of the last round and of the seats

    def route(batches):
        task, place, held, size = TaskContext.get().partitionId(), 0, [], 0
        codes, keys, hot_contexts, n_hot, logs = hot.value
        names = ["round", "task", "place", "id", "held_out", "n_tokens", "base", "score", "known", "shard", "data"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.binary()]

        def batch_of(n, **columns):
            return pa.record_batch([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        def close():
            words, word = ranked([h[0] for h in held])
            contexts, context = ranked([h[1] for h in held])
            word = np.concatenate([w[h[2]] for h, w in zip(held, word)])
            context, doc = np.concatenate([c[h[3]] for h, c in zip(held, context)]), np.concatenate([h[4] for h in held])
            order = np.argsort(word * len(contexts) + context)
            key, context, doc = words[word[order]], context[order], doc[order]
            rows = [(s, pack_pairs(key[i], *narrowed(context[i], contexts), doc[i].astype("<u4"))) for s, i in by_shard(key, shards)]
            return batch_of(len(rows), round=[TOKENS] * len(rows), task=[task] * len(rows), shard=[r[0] for r in rows], data=[r[1] for r in rows])

        for batch in pieces(batches, 1):
            hashes, contexts, at, before, lengths = numbered(batch.column(1))
            n = batch.num_rows
            doc = np.repeat(np.arange(n), lengths)
            pair, token = np.unique(before * max(1, len(hashes)) + at, return_inverse=True)
            key, context = hashes[pair % len(hashes)], contexts[pair // len(hashes)]
            i = found(codes, pair_code(key, context))
            frequent = i < len(codes)
            i = np.minimum(i, max(0, len(codes) - 1))
            if len(codes):
                frequent &= (keys[i] == key) & (hot_contexts[i] == context)
            f, r = np.flatnonzero(frequent[token]), np.flatnonzero(~frequent[token])
            i = i[token[f]]
            yield batch_of(n, round=[ROW] * n, shard=[task % shards] * n, task=[task] * n, place=np.arange(place, place + n), id=batch.column(0).to_pylist(),
                           held_out=batch.column(2).to_pylist(), n_tokens=lengths,
                           base=np.bincount(doc[f], base(n_hot[i], sent.value), minlength=n) if len(f) else np.zeros(n),
                           score=np.bincount(doc[f], logs[i], minlength=n) if len(f) else np.zeros(n),
                           known=np.bincount(doc[f], minlength=n))
            pair = pair[token[r]]
            held.append((hashes, contexts, pair % len(hashes), pair // len(hashes), doc[r] + place))
            size, place = size + len(r), place + n
            if size > HELD // 2:
                yield close()
                held, size = [], 0
        if size:
            yield close()

    def look_up(batches):
        held = shard = None
        for batch in batches:
            row = batch.filter(pc.equal(batch.column("round"), ROW))
            if len(row):
                yield pa.record_batch([row.column(c) for c in own_columns] + [pa.nulls(len(row), pa.binary())], names=[*own_columns, "sums"])
            rest = batch.filter(pc.not_equal(batch.column("round"), ROW))
            for part, owner, task, number, data in zip(*(rest.column(c).to_pylist() for c in ("round", "owner", "task", "shard", "data"))):
                if part < 0:
                    held, shard = Gathered(number, data, shards), None
                    continue
                if part < TOKENS:
                    held.add(part, owner, data)
                    continue
                if shard is None:
                    shard = Shard(held.number, held.data, sent.value, held.table())
                    here, absent = shard.predictive()
                    total = np.append(np.bincount(shard.word, shard.count, minlength=len(shard.words)).astype(np.int64), 0)
                    stride = len(shard.contexts) + 1
                    code = shard.word * stride + shard.at
                    backs = [(p, back[shard.contexts]) for p, back in absent]
                if shard.number != number:
                    raise ValueError("the model has not seen these documents")
                words, run, contexts, at, doc = unpack_pairs(data)
                place = found(shard.contexts, contexts)
                if (place == len(shard.contexts)).any():
                    raise ValueError("the model has not seen these documents")
                word, context = np.repeat(found(shard.words, words), run), place[at]
                known = word < len(shard.words)
                seat_at = found(code, word * stride + context)
                p = sum(p[word] * back[context] for p, back in backs) / len(backs)
                ok = np.flatnonzero(seat_at < len(code))
                p[ok] = here[seat_at[ok]]
                here_docs = np.flatnonzero(np.bincount(doc))
                sums = packed(steps(here_docs.astype("<u4")), *(np.bincount(doc, v)[here_docs] for v in (base(total[word], sent.value), np.log10(p))),
                              np.bincount(doc, known)[here_docs].astype("<u4"))
                yield pa.record_batch([pa.array([task], t) if c == "task" else pa.nulls(1, t) for c, t in zip(own_columns, own_types)]
                                      + [pa.array([sums], pa.binary())], names=[*own_columns, "sums"])

    def collect(batches):
        """Rows of a task by place, then its sums."""
        def done():
            t = pa.concat_tables(rows)
            cols = [t.column("base").to_numpy().copy(), t.column("score").to_numpy().copy(), t.column("known").to_numpy().astype(float)]
            place = t.column("place").to_numpy()
            order = np.argsort(place)
            for data in sums:
                places, *found_sums = opened(data)
                at = order[np.cumsum(places, dtype=np.int64)]
                for c, v in zip(cols, found_sums):
                    c[at] += v
            n_tokens = t.column("n_tokens").to_numpy()
            return pa.record_batch([t.column("id").combine_chunks(), t.column("held_out").combine_chunks(), pa.array(n_tokens),
                                    pa.array(cols[2].astype(np.int64)), pa.array(np.full(len(t), sent.value.tokens)),
                                    pa.array(cols[0]), pa.array(cols[1]), pa.array(10.0 ** (-cols[1] / n_tokens))],
                                   names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        task, rows, sums = None, [], []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            number = t.column("task").to_numpy()
            for begin, end in zip(*(lambda e: (np.concatenate(([0], e)), np.concatenate((e, [len(t)]))))(np.flatnonzero(np.diff(number)) + 1)):
                if number[begin] != task and rows:
                    yield done()
                    rows, sums = [], []
                task, part = number[begin], t.slice(begin, end - begin)
                is_row = part.column("sums").is_null()
                sums += part.column("sums").drop_null().to_pylist()
                rows.append(part.filter(is_row))
        if rows:
            yield done()

    own_columns = ["task", "place", "id", "held_out", "n_tokens", "base", "score", "known"]
    own_types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), (~in_training(id_col)).alias("h"))
    back = (seat_rows(counts, answers).unionByName(own.mapInArrow(route, ROUTED), allowMissingColumns=True).repartitionById(shards, "shard")
            .sortWithinPartitions("shard", "round").mapInArrow(look_up, "task int, place int, id long, held_out boolean, n_tokens long, base double, "
                                                              "score double, known long, sums binary"))
    return (back.repartitionById(shards, F.col("task") % shards).sortWithinPartitions("task")
            .mapInArrow(collect, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                                 "score double, perplexity double").withColumnRenamed("id", id_col))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the training documents and score all.

    Null and empty texts are one end token. An unknown word has the probability of one unknown
    word. Without training documents all probabilities are 1. Repeated rows count and are scored
    each; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    return score(docs, *taught(docs, text_col, in_training(id_col)), id_col, text_col)
