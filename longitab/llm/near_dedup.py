"""Near duplicates through an LSH forest of MinHash signatures.

A signature holds ``VALUES`` minimum hashes of a document's shingle set. A tree of the forest is
one order of the signature's values: documents are sorted by it, and those whose signatures share
a prefix of ``DEPTH`` values are neighbours, a region. Documents that agree in more values stand
nearer to each other. A region with too many documents goes deeper: it is cut by the hash of its
next values, and the cut is made good below.

Links are confirmed on full sets. Candidates are at first the adjacent documents of every region,
which joins each group of copies into few components. Then, in regions that still hold several
components, every document outside the region's largest component that can have a link is compared
with all others of the region that can, in blocks of two bounded parts. The sets come along, so a
block confirms its links itself and hands on only those that join two components: fewer than it has
documents, whatever the size of a group. Pairs inside one component cannot change it, so no link
between components is lost.

Texts with one shingle set are one class and enter the forest once. A class goes by its smallest
id, or by a number of its own, above all ids, where it has none or another class has that id too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitab.functions.ranges import number_rows
from longitab.functions.small import join_small
from longitab.llm.common import bounded_batches, partitions_of, pieces, texts_of, written

#: Words of a shingle, and the share of common shingles that links two documents, in per cent.
SHINGLE, SHARE = 5, 80
VALUES, DEPTH = 128, 4
TREES = VALUES // DEPTH
#: Of one bit for each of 128 values, linked documents differ in 12.8 on average with a deviation
#: of 3.4; more than this are not compared in full. At a similarity of exactly 0.8 the chance is
#: below that of the forest's own misses.
MAX_BITS = 36
#: Documents of one block of a region; larger regions are cut deeper.
REGION = 10_000
#: At most so many regions are cut, by a broadcast of so many rows.
HOT_REGIONS = 20_000
#: Ids that are broadcast, 16 MB; more are joined by shuffle.
SMALL = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a published generator (its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles. Words are runs of other than
    ``[\\x20\\x09-\\x0D]`` with A-Z in lower case; fewer words than ``size`` are one shingle."""
    import xxhash

    cut = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    number = {w: i for i, w in enumerate(set().union(*cut))}
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    out = []
    for words in cut:
        h = hashes[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
        k = min(size, len(h))
        n = max(0, len(h) - size) + 1 if len(h) else 0
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s = _mix(s * _MULTIPLIER + h[i:i + n])
        out.append(np.unique(s))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes of non-empty sets, (sets, VALUES) of 32 bits."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, VALUES, np.uint64)
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), VALUES), np.uint32)
    for i in range(VALUES):
        out[:, i] = np.minimum.reduceat(flat * a[i] + b[i], starts) >> np.uint64(32)
    return out


def sketch(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n`` (set size), ``digest`` of the set, two bit words, and for each tree the hash of
    its first ``DEPTH`` values and its next values."""
    import xxhash

    bounded_batches(docs.sparkSession)
    longs = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bits0", pa.int64()),
                        ("bits1", pa.int64()), ("region", longs), ("next", longs)])

    def run(batches):
        for batch in pieces(batches, 1):
            sets = shingle_sets(texts_of(batch.column(1)), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            bits, region, nexts = np.zeros((len(sets), 2), np.int64), [None] * len(sets), [None] * len(sets)
            if full:
                sig = signatures([sets[i] for i in full]).astype(np.uint64)
                packed = np.packbits((sig & np.uint64(1)).astype(bool), axis=1)
                bits[full] = packed.view(np.int64)
                trees = sig.reshape(len(full), TREES, DEPTH)
                key = np.zeros((len(full), TREES), np.uint64)
                for d in range(DEPTH):
                    key = _mix(key * _MULTIPLIER + trees[:, :, d])
                after = np.roll(trees, -1, axis=1) >> np.uint64(17)  # 15 bits of each, so that they sort as signed
                order = after[:, :, 0] << np.uint64(45) | after[:, :, 1] << np.uint64(30) | after[:, :, 2] << np.uint64(15) | after[:, :, 3]
                for i, k, o in zip(full, key.view(np.int64).tolist(), order.view(np.int64).tolist()):
                    region[i], nexts[i] = k, o
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                                   pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(region, longs), pa.array(nexts, longs)],
                                  schema=schema)

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "id long, n long, digest binary, bits0 long, bits1 long, region array<long>, next array<long>"))


def forest(reps: DataFrame) -> DataFrame:
    """Rows ``tree, region, slice, id, bits0, bits1``, ``size`` of the region's slice and the
    adjacent document ``other`` with ``differ`` bits; documents alone in a region are left out.

    The regions that are cut deeper are found by counts that are added up before their shuffle."""
    rows = reps.select("id", "bits0", "bits1", F.posexplode(F.arrays_zip("region", "next")).alias("tree", "at"), "n").select(
        "tree", F.col("at.region").alias("region"), F.col("at.next").alias("next"), "id", "bits0", "bits1", "n")
    total = reps.count() * TREES
    limit = max(REGION, total // HOT_REGIONS)
    hot = rows.groupBy("tree", "region").count().filter(F.col("count") > limit).collect()
    if hot:
        cut = F.broadcast(reps.sparkSession.createDataFrame([(r[0], r[1], -(-r[2] // REGION)) for r in hot], "tree int, region long, slices int"))
        rows = rows.join(cut, ["tree", "region"], "left")
    else:
        rows = rows.withColumn("slices", F.lit(None).cast("long"))
    rows = rows.withColumn("slice", F.coalesce(F.pmod(F.xxhash64("next"), F.col("slices")), F.lit(0)))
    order = Window.partitionBy("tree", "region", "slice").orderBy("next", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.lead(F.struct("id", "bits0", "bits1")).over(order)
    return (rows.withColumn("_lead", lead).withColumn("size", F.count(F.lit(1)).over(whole)).filter("size > 1 OR slices > 1")
            .withColumn("differ", F.bit_count(F.col("bits0").bitwiseXOR(F.col("_lead.bits0"))) + F.bit_count(F.col("bits1").bitwiseXOR(F.col("_lead.bits1"))))
            .select("tree", "region", "slice", "id", "bits0", "bits1", "n", "size", "slices", F.col("_lead.id").alias("other"), "differ"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs that are among the ``k`` with the fewest differing bits of either document."""
    both = pairs.select(F.col("a").alias("x"), "a", "b", "differ").unionByName(pairs.select(F.col("b").alias("x"), "a", "b", "differ"))
    order = Window.partitionBy("x").orderBy("differ", F.xxhash64("a", "b"), "a", "b")
    return both.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("a", "b", "differ").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """``pairs`` with ``linked``: 100 * common >= share * all shingles, on the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= share * (len(x) + len(y) - common))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "linked": pa.array(linked, pa.bool_())})

    return joined.mapInArrow(run, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """``id, component``, the smallest id of each linked document's component, by alternating
    large and small stars. Every step adds up before its shuffle and is written."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = written(small.select("e.u", F.col("e.m").alias("v")).filter("u != v").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now


def across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose documents are in different components."""
    if labels is None:
        return pairs
    for c in "ab":
        pairs = pairs.join(labels.select(F.col("id").alias(c), F.col("component").alias("c" + c)), c, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def mixed_rows(near: DataFrame, labels: DataFrame | None, among: DataFrame | None = None) -> DataFrame:
    """Rows of regions of three or more documents that hold several components, since the two of a
    smaller one were adjacent; ``rest`` are those outside the region's largest component. With
    ``among``, of documents in that table of ids alone."""
    rows = near.filter("size > 2 OR slices > 1").select("tree", "region", "id", "bits0", "bits1", "n")
    if among is not None:
        rows = only(rows, among)
    rows = rows.join(labels, "id", "left") if labels is not None else rows.withColumn("component", F.lit(None).cast("long"))
    rows = rows.withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("tree", "region", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("tree", "region").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("k"), F.max("c").alias("most"),
                                                F.max_by("component", F.struct("c", "component")).alias("main")).filter("k > 1")
    return rows.join(mixed, ["tree", "region"]).withColumn("rest", F.col("component") != F.col("main"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of ``mixed_rows`` by block: ``left`` ones are compared with ``right`` ones.

    A region of up to ``REGION`` documents is one block. Of a larger one the rest and the largest
    component are both cut by hash into parts of about ``REGION``, and each two parts of the rest,
    and each part of the rest and of the largest component, are a block of about 2 * ``REGION``."""
    rest, n_main = F.col("rest"), F.col("most")
    parts_rest, parts_main = F.ceil((F.col("rows") - n_main) / REGION), F.ceil(n_main / REGION)
    own = F.pmod(F.xxhash64("id"), F.when(rest, parts_rest).otherwise(parts_main)).cast("int")
    rows = rows.withColumn("own", own).withColumn("_rest", (parts_rest - 1).cast("int")).withColumn("_main", (parts_main - 1).cast("int"))

    def block(kind, i, j, left, right):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))

    zero, yes, no, own = F.lit(0), F.lit(True), F.lit(False), F.col("own")
    of_rest = F.concat(F.transform(F.sequence(zero, "_rest"), lambda j: block(0, F.least(own, j), F.greatest(own, j), own <= j, own >= j)),
                       F.transform(F.sequence(zero, "_main"), lambda j: block(1, own, j, yes, no)))
    of_main = F.transform(F.sequence(zero, "_rest"), lambda i: block(1, i, own, no, yes))
    blocks = F.when(F.col("rows") <= REGION, F.array(block(0, zero, zero, rest, yes))).when(rest, of_rest).otherwise(of_main)
    return rows.withColumn("at", F.explode(blocks)).select("tree", "region", "at.*", "component", "id", "bits0", "bits1", "n")


def _by_block(batches, keys: list[str]):
    """The rows of each block, from batches that are sorted by block."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        key = np.stack([t.column(c).to_numpy() for c in keys])
        ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        begin = 0
        for end in ends.tolist():
            yield t.slice(begin, end - begin)
            begin = end
        held = t.slice(begin) if len(t) > begin else None
    if held is not None:
        yield held


_KEYS = ["tree", "region", "kind", "i", "j"]


def _candidates(t: pa.Table, share: int):
    """Slices ``at, to, ok`` of a block: whether places ``at`` and ``to`` are of different components
    and sizes and bits allow a link."""
    left, right, comp, b0, b1, n_set = (t.column(c).to_numpy() for c in ("left", "right", "component", "bits0", "bits1", "n"))
    left, right = left.astype(bool), right.astype(bool)
    b0, b1 = b0.view(np.uint64), b1.view(np.uint64)
    to = np.flatnonzero(right)
    for at in np.array_split(np.flatnonzero(left), max(1, -(-int(left.sum()) // 128))):
        d = np.bitwise_count(b0[at, None] ^ b0[to]) + np.bitwise_count(b1[at, None] ^ b1[to])
        ok = (d <= MAX_BITS) & (comp[at, None] != comp[to])
        ok &= (100 * n_set[at, None] >= share * n_set[to]) & (100 * n_set[to] >= share * n_set[at, None])
        yield at, to, ok


def block_members(near: DataFrame, labels: DataFrame | None, share: int, among: DataFrame | None = None) -> DataFrame:
    """``id`` of the documents that sizes and bits allow a link with another component in a mixed region."""
    n = partitions_of(near.sparkSession)
    rows = dealt(mixed_rows(near, labels, among)).repartition(n, *_KEYS).sortWithinPartitions(*_KEYS)

    def run(batches):
        for t in _by_block(batches, _KEYS):
            ids = t.column("id").to_numpy()
            some = np.zeros(len(ids), bool)
            for at, to, ok in _candidates(t, share):
                some[at[ok.any(axis=1)]] = True
                some[to[ok.any(axis=0)]] = True
            yield pa.record_batch({"id": pa.array(np.unique(ids[some]))})

    return rows.mapInArrow(run, "id long").distinct()


def block_links(near: DataFrame, labels: DataFrame | None, share: int, sets: DataFrame) -> DataFrame:
    """``a, b``: links between components, confirmed on the full ``sets`` (``id, shingles``, of the
    documents to compare), of every block those that join what its links did not join before."""
    n = partitions_of(near.sparkSession)
    rows = dealt(mixed_rows(near, labels, sets.select("id"))).join(sets, "id").select(*_KEYS, "left", "right", "component", "id", "bits0", "bits1", "n", "shingles")
    rows = rows.repartition(n, *_KEYS).sortWithinPartitions(*_KEYS)

    def links(t: pa.Table):
        ids, comp, size = (t.column(c).to_numpy() for c in ("id", "component", "n"))
        flat = np.frombuffer(b"".join(t.column("shingles").to_pylist()), np.uint64)
        ends = np.concatenate(([0], np.cumsum(size)))
        number, flat = np.unique(flat, return_inverse=True)
        parent = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        mark = np.zeros(len(number), bool)
        for at, to, ok in _candidates(t, share):
            for row, i in enumerate(at.tolist()):
                other = to[ok[row]]
                if not len(other):
                    continue
                mark[flat[ends[i]:ends[i + 1]]] = True
                for part in np.array_split(other, -(-int(size[other].sum()) // (1 << 20))):
                    sizes = size[part]
                    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    entries = np.repeat(ends[part] - begin, sizes) + np.arange(int(sizes.sum()))
                    common = np.add.reduceat(mark[flat[entries]].astype(np.int64), begin)
                    for j in part[100 * common >= share * (size[i] + sizes - common)].tolist():
                        x, y = root(int(comp[i])), root(int(comp[j]))
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            yield min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))
                mark[flat[ends[i]:ends[i + 1]]] = False

    def run(batches):
        for t in _by_block(batches, _KEYS):
            found = list(links(t))
            yield pa.record_batch({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.mapInArrow(run, "a long, b long").distinct()


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi", small: int | None = None,
         id_col: str = "id") -> DataFrame:
    """Rows of ``docs`` with (or, ``left_anti``, without) an id of ``ids``. Up to ``small`` ids,
    16 MB, are broadcast after a count; more are joined by shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= (SMALL if small is None else small) else ids, id_col, how)


def keyed(s: DataFrame) -> tuple[DataFrame, int | None]:
    """``digest, id, copies, key`` of each class of a sketch. ``key`` is the class's smallest id; where
    that is null, or another class has it too, a number above the largest id, which is returned
    then."""
    classes = s.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    odd = classes.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("digest").alias("d")).filter("id IS NULL OR c > 1")
    if not odd.limit(1).count():
        return classes.withColumn("key", F.col("id")), None
    top = s.agg(F.max("id")).first()[0] or 0
    more = join_small(classes, odd, ["id"]).filter("id IS NULL OR digest != d").select("digest", F.lit(0).alias("all"))
    more = number_rows(more, ["all"], ["digest"], "nr", 100_000).select("digest", (F.col("nr") + top).alias("own"))
    return written(classes.join(more, "digest", "left").withColumn("key", F.coalesce("own", "id")).drop("own"), "classes"), top


def near_duplicates(docs: DataFrame, size: int = SHINGLE, share: int = SHARE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (the smallest id that links
    lead to, itself included), ``kept`` (the id is the component's) and ``digest`` of the set.

    Null, empty and blank texts have no shingles and no links. Documents with equal sets are one
    class and enter the forest once, however many there are. A row with a null id takes its
    component's id, null if that has none, and is kept only then, in the component's first class.
    Rows that repeat an id with equal text are kept or dropped together; different texts under one id
    are apart, and of two that are linked the first class's is kept. Other columns are ignored; an
    empty table gives an empty result.
    """
    s = written(sketch(docs, size, id_col, text_col), "sketch")
    classes, top = keyed(s)
    keys = classes.select("digest", F.col("id").alias("_id"), "key")
    owners = keys.withColumnRenamed("digest", "_digest")
    reps = s.join(owners, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id"))).select(
        F.col("key").alias("id"), *[c for c in s.columns if c != "id"])
    near = written(forest(reps), "forest")
    first = near.filter(F.col("differ") <= MAX_BITS).filter("id != other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "differ")
    first = written(first.groupBy("a", "b").agg(F.min("differ").alias("differ")), "pairs")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sets_of(chosen: DataFrame) -> DataFrame:
        """``id, shingles`` of the classes named by ``id``."""
        import xxhash

        def run(batches):
            for batch in pieces(batches, 1):
                sets = [x.tobytes() for x in shingle_sets(texts_of(batch.column(1)), size)]
                yield pa.record_batch([batch.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())],
                                      names=["id", "digest", "shingles"])

        if top is None:
            made = only(source, chosen).dropDuplicates(["id"]).mapInArrow(run, "id long, digest binary, shingles binary")
            return written(made.select("id", "shingles"), "sets")
        wanted = only(keys.withColumnRenamed("key", "id"), chosen)
        texts = join_small(source, wanted.select(F.col("_id").alias("id")).distinct(), ["id"], max_rows=SMALL // 10)
        made = texts.mapInArrow(run, "id long, digest binary, shingles binary").drop("id").dropDuplicates(["digest"])
        return written(made.join(wanted.select("digest", "id"), "digest").select("id", "shingles"), "sets")

    def linkable(ids: DataFrame) -> DataFrame:
        """``id, shingles`` of those of which ``share`` per cent of the shingles are in other documents
        of ``ids``; no other document of them can have a link."""
        sets = sets_of(ids)
        own = sets.mapInArrow(explode_sets, "id long, shingle long")
        common = own.groupBy("shingle").count().filter("count > 1").select("shingle")
        known = own.join(common, "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("known"))
        some = known.join(sets, "id").filter(F.col("known") * 100 >= F.octet_length("shingles") / 8 * share)
        return written(some.select("id", "shingles"), "linkable")

    def explode_sets(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.record_batch({"id": pa.array(ids), "shingle": pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))})

    sets = sets_of(first.select(F.col("a").alias("id")).union(first.select("b")).distinct())
    checked = written(confirmed(nearest(first, 2), sets, share), "links")
    labels = components(checked.filter("linked"))
    more = across(first.join(checked, ["a", "b"], "left_anti"), labels)
    more = written(confirmed(more, sets, share), "links")
    links = checked.unionByName(more).filter("linked").select("a", "b")
    if more.filter("linked").limit(1).count():
        labels = components(links)
    # Of documents that can have a link at all, every pair of the regions that are still mixed.
    chosen = linkable(written(mixed_rows(near, labels).select("id").distinct(), "ids"))
    chosen = linkable(written(block_members(near, labels, share, chosen.select("id")), "ids"))
    last = written(block_links(near, labels, share, chosen), "links")
    if last.limit(1).count():
        labels = components(links.unionByName(last))
    found = classes.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    if top is not None:
        least = found.groupBy("component").agg(F.min("id").alias("least"))
        found = found.join(least, "component").withColumn("first", F.col("component") == F.col("key"))
    else:
        found = found.filter("copies > 1 OR component != key").withColumns({"least": F.col("component"), "first": F.lit(True)})
    out = s.select("id", "n", "digest").join(found.select("digest", "least", "first"), "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("_first"), "digest")
    return out.select(id_col, "n_shingles", "component_id", (F.col("_first") & F.col(id_col).eqNullSafe(F.col("component_id"))).alias("kept"), "digest")


def without_copies(docs: DataFrame, size: int = SHINGLE, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns. Rows go by their id;
    those whose id is null, or is kept with one text and dropped with another, by id and set."""
    import xxhash

    groups = written(near_duplicates(docs, size, share, id_col, text_col).select(F.col(id_col).alias("_id"), "kept", "digest"), "groups")
    by_id = groups.filter("NOT kept").select("_id").distinct()
    both = written(groups.groupBy("_id").agg(F.count_if("kept").alias("k"), F.count_if(~F.col("kept")).alias("d"))
                   .filter("d > 0 AND (_id IS NULL OR k > 0)").select("_id"), "both")
    if not both.limit(1).count():
        return only(docs, by_id.withColumnRenamed("_id", id_col), "left_anti", id_col=id_col)
    plain = only(docs, by_id.withColumnRenamed("_id", id_col), "left_anti", id_col=id_col)
    apart = docs.join(both, docs[id_col].eqNullSafe(both["_id"]), "left_semi")

    def digests(batches):
        for batch in pieces(batches, 0):
            sets = shingle_sets(texts_of(batch.column(0)), size)
            yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), batch.column(1)], names=["_digest", "_row"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    told = apart.select(F.col(f"`{text_col}`").cast("string"), row).mapInArrow(digests, T.StructType(
        [T.StructField("_digest", T.BinaryType()), T.StructField("_row", apart.select(row).schema["_row"].dataType)]))
    gone = groups.filter("NOT kept").select("_id", "digest").distinct()
    kept = told.join(gone, told["_row"][id_col].eqNullSafe(gone["_id"]) & (told["_digest"] == gone["digest"]), "left_anti")
    plain = plain.join(both, plain[id_col].eqNullSafe(both["_id"]), "left_anti")
    return plain.unionByName(kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns]))
