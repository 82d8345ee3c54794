"""Class plans, the sequence model, drawing from it, and rejection sampling to a plan.

The generator is a vector autoregression per class, not an adversarial network: linear
dynamics from the first two moments of neighbouring visits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitab.functions.draws import step_normals
from longitab.functions.hashing import unit_hash
from longitab.functions.ranges import ordered_numbers, search
from longitab.functions.selection import hash_cuts, within_cut
from longitab.functions.small import small_rows
from longitab.operators.moments import SALTS, grouped_moments, merge, pooled_moments
from longitab.operators.prepare import ScaleModel
from longitab.operators.projection import Projection, pca_inverse
from longitab.operators.sequences import PACKED, PART_LEN, unpack_sequences

#: Bytes of drawn sequences in one partition, and classes whose moments may reach the driver.
RANGE_BYTES = 256 << 20
MAX_CLASSES = 20_000
DRAW_ROWS = 1_000
#: Steps in which remainders of a class plan are counted.
REMAINDERS = 4_096


def class_plan(profile: DataFrame, n: int, mode: str = "proportional", lam: float = 0.9,
               label: str = "label") -> DataFrame:
    """``label, target`` summing to ``n``: by class share, or shares mixed with an even split.

    Rows left after rounding down go to the largest remainders, ties by label. Remainders are
    counted in ``REMAINDERS`` steps, which tell where the rows left run out; only classes of that
    step are put in order. So there may be as many classes as rows.
    """
    if mode not in ("proportional", "near_balanced"):
        raise ValueError(f"unknown mode {mode}")
    lam = lam if mode == "near_balanced" else 0.0
    classes = profile.count()
    weight = F.lit(1.0 - lam) * F.col("share") + F.lit(float(lam) / max(classes, 1))
    wanted = (profile.select(label, "share").withColumn("_want", F.round(F.lit(float(n)) * weight, 6))
              .withColumn("_floor", F.floor("_want").cast("long"))
              .withColumn("_step", F.floor((1 - (F.col("_want") - F.col("_floor"))) * REMAINDERS).cast("int")))
    steps = sorted(tuple(r) for r in wanted.groupBy("_step").agg(F.count("*"), F.sum("_floor")).collect())
    left = n - sum(s for _, _, s in steps)
    edge, need = -1, 0
    for step, count, _ in steps:
        if left <= 0:
            break
        edge, need, left = step, left, left - count
    more = (F.col("_step") < edge).cast("long")
    out = wanted.filter(F.col("_step") != edge).select(label, (F.col("_floor") + more).alias("target"))
    if edge < 0:
        return out
    inside = wanted.filter(F.col("_step") == edge).withColumn("_rest", F.round(F.col("_floor") - F.col("_want"), 9))
    ranked = ordered_numbers(inside.select("_rest", F.col(label), "_floor"), ["_rest", label], "_rank")
    return out.unionByName(ranked.select(label, (F.col("_floor") + (F.col("_rank") < need).cast("long")).alias("target")))


@dataclass(frozen=True)
class SequenceModel:
    """First visit and first-order dynamics per class; arrays are indexed by class position."""

    labels: list
    share: np.ndarray
    start_mean: np.ndarray
    start_root: np.ndarray
    transition: np.ndarray
    intercept: np.ndarray
    noise_root: np.ndarray
    lengths: list
    length_share: list
    max_len: int
    label_type: str

    @property
    def width(self) -> int:
        return self.start_mean.shape[1]

    @property
    def mean_len(self) -> float:
        """Visits of a sequence, on average over the classes."""
        means = [float(np.dot(k, np.diff([0.0, *s]))) for k, s in zip(self.lengths, self.length_share)]
        return float(np.dot(self.share, means))


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """Covariance pulled to a multiple of the identity.

    The weight is the closed form of Chen, Wiesel, Eldar and Hero 2010, which follows Ledoit
    and Wolf 2004 but needs no moments beyond the covariance.
    """
    p = len(cov)
    level = np.trace(cov) / p
    square, trace2 = float((cov**2).sum()), float(np.trace(cov) ** 2)
    spread = square - trace2 / p
    top = (1.0 - 2.0 / p) * square + trace2
    below = (n + 1.0 - 2.0 / p) * spread
    weight = 1.0 if below <= 0 else min(1.0, max(0.0, top / below))
    return (1.0 - weight) * cov + weight * level * np.eye(p)


def root(cov: np.ndarray) -> np.ndarray:
    """A square root of a covariance; small negative eigenvalues count as 0."""
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    return axes * np.sqrt(np.clip(values, 0.0, None))


def _pairs():
    steps = F.when(F.col("len") > 1, F.sequence(F.lit(1), F.col("len") - 1))
    return F.transform(steps, lambda t: F.concat(F.get("seq", t - 1), F.get("seq", t)))


def _left(row: dict) -> dict:
    """Moments of the first half of a vector."""
    p = len(row["mean"]) // 2
    m2 = np.array(row["m2"]).reshape(2 * p, 2 * p)[:p, :p]
    return {"n": row["n"], "mean": row["mean"][:p], "m2": m2.reshape(-1)}


def lag_pairs(seqs: DataFrame, label: str, out: str = "pair") -> DataFrame:
    """Each visit joined to the one before it, as one vector: ``label, pair``."""
    return seqs.select(label, F.explode(_pairs()).alias(out))


def _complete_moments(visited: DataFrame, label: str) -> list[dict]:
    """Moments of first visits and of neighbouring pairs without a null: ``label, start, n, mean, m2``."""
    # The first visit rides along as a pair with itself, so that the sequences are read once.
    starts = F.array(F.struct(F.lit(True).alias("start"), F.concat(
        F.get("seq", F.lit(0)), F.get("seq", F.lit(0))).alias("pair")))
    rest = F.transform(_pairs(), lambda v: F.struct(F.lit(False).alias("start"), v.alias("pair")))
    none = F.slice(starts, 1, 0)
    first_part = F.when(F.col("part") == 0, starts).otherwise(none) if "part" in visited.columns else starts
    return small_rows(grouped_moments(
        visited.select(label, F.inline(F.concat(first_part, F.coalesce(rest, none)))),
        "pair", [label, "start"]), 2 * MAX_CLASSES)


@dataclass(frozen=True)
class Dynamics:
    """First visit, a visit at any time, and the step from one to the next, by class position."""

    labels: list
    count: np.ndarray
    start_mean: np.ndarray
    start_cov: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    transition: np.ndarray
    intercept: np.ndarray
    noise_cov: np.ndarray


def _solve(sums: list[dict], label: str, pooled: bool, ridge: float) -> Dynamics:
    """The dynamics that moments of first visits and pairs give."""
    first = {r[label]: _left(r) for r in sums if r["start"]}
    pair = {r[label]: r for r in sums if not r["start"]}
    labels = sorted(first)
    if not labels:
        raise ValueError("no sequence to fit on")
    p = len(first[labels[0]]["mean"])
    count = np.array([first[c]["n"] for c in labels], dtype=float)

    def block(c):
        r = pair.get(c)
        if r is None:
            return 0, np.zeros(2 * p), np.zeros((2 * p, 2 * p))
        return r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(2 * p, 2 * p)

    blocks = [block(c) for c in labels]
    total = sum(m2 for _, _, m2 in blocks)
    total_n = sum(n for n, _, _ in blocks)

    def dynamics(m2):
        before, cross = m2[:p, :p], m2[p:, :p]
        weight = ridge * max(np.trace(before) / p, 1e-12)
        return cross @ np.linalg.inv(before + weight * np.eye(p))

    def residual(a, m2, n):
        left = m2[p:, p:] - a @ m2[:p, p:] - m2[p:, :p] @ a.T + a @ m2[:p, :p] @ a.T
        return left / max(n - 1, 1)

    shared = dynamics(total)
    shared_noise = shrunk(residual(shared, total, total_n), max(total_n, 1))
    pooled_start = sum(np.array(first[c]["m2"]).reshape(p, p) for c in labels) / max(count.sum() - len(labels), 1)
    starts, means, covs, transition, intercept, noise = [], [], [], [], [], []
    for c, (n, mean, m2) in zip(labels, blocks):
        own = first[c]
        cov = np.array(own["m2"]).reshape(p, p) / (own["n"] - 1) if own["n"] > 1 else pooled_start
        starts.append(shrunk(cov, own["n"]))
        a = shared if pooled or n < 2 else dynamics(m2)
        transition.append(a)
        intercept.append(mean[p:] - a @ mean[:p])
        noise.append(shrunk(residual(a, m2, n), n) if n > 1 else shared_noise)
        means.append(mean[:p] if n else np.array(own["mean"]))
        covs.append(m2[:p, :p] / (n - 1) if n > 1 else starts[-1])
    return Dynamics(labels, count, np.array([first[c]["mean"] for c in labels]), np.array(starts), np.array(means), np.array(covs),
                    np.array(transition), np.array(intercept), np.array(noise))


def _given(mean: np.ndarray, cov: np.ndarray, x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of rows of normal vectors, of which the entries from ``at`` on are ``x``
    where that is not NaN. Rows with one pattern of known entries are taken together."""
    mean, cov = mean.copy(), cov.copy()
    known = ~np.isnan(x)
    patterns, member = np.unique(known, axis=0, return_inverse=True)
    for k, pattern in enumerate(patterns):
        if not pattern.any():
            continue
        rows, o = np.flatnonzero(member.reshape(-1) == k), at + np.flatnonzero(pattern)
        inner = cov[np.ix_(rows, o, o)]
        inner += np.eye(len(o)) * (1e-12 * np.trace(inner, axis1=1, axis2=2) + 1e-30)[:, None, None]
        gain = np.linalg.solve(inner, cov[rows][:, o, :]).transpose(0, 2, 1)
        mean[rows] += (gain @ (x[rows][:, pattern] - mean[np.ix_(rows, o)])[:, :, None])[:, :, 0]
        cov[rows] -= gain @ cov[rows][:, o, :]
        mean[np.ix_(rows, o)] = x[rows][:, pattern]
        cov[np.ix_(rows, o)] = 0.0
        cov[np.ix_(rows, np.arange(cov.shape[1]), o)] = 0.0
    return mean, cov


def _expect(x: np.ndarray, size: np.ndarray, later: np.ndarray, d: Dynamics, c: int):
    """Yields ``(start, n, mean, m2)`` of the pairs (first visits with themselves) of sequences of class
    ``c``, NaN for missing, each expected from the visits up to the second one of the pair.

    A sequence that begins ``later`` than its entity starts from a visit at any time."""
    n, steps, p = x.shape
    mean = np.where(later[:, None], d.mean[c], d.start_mean[c])
    cov = np.where(later[:, None, None], d.cov[c], d.start_cov[c])
    mean, cov = _given(mean, cov, x[:, 0], 0)
    if (~later).any():
        m = np.hstack([mean[~later]] * 2)
        v = np.tile(cov[~later].sum(axis=0), (2, 2))
        yield True, len(m), m.mean(axis=0), (m - m.mean(axis=0)).T @ (m - m.mean(axis=0)) + v
    a, q = d.transition[c], d.noise_cov[c]
    for t in range(1, steps):
        go = size > t
        if not go.any():
            return
        before, v = mean[go], cov[go]
        both = np.hstack([before, before @ a.T + d.intercept[c]])
        wide = np.zeros((len(both), 2 * p, 2 * p))
        whole = ~np.isnan(x[go, t]).any(axis=1) & ~v.any(axis=(1, 2))
        both[whole, p:] = x[go, t][whole]
        some = np.flatnonzero(~whole)
        if len(some):
            va = v[some] @ a.T
            joint = np.block([[v[some], va], [va.transpose(0, 2, 1), a @ va + q]])
            both[some], wide[some] = _given(both[some], joint, x[go, t][some], p)
        m = both.mean(axis=0)
        yield False, len(both), m, (both - m).T @ (both - m) + wide.sum(axis=0)
        mean[go], cov[go] = both[:, p:], wide[:, p:, p:]


def _expected_moments(visited: DataFrame, d: Dynamics, label: str) -> list[dict]:
    """As ``_complete_moments``, with the entries that are missing replaced by what ``d`` expects."""
    place = F.array_position(F.array(*[F.lit(c).cast(visited.schema[label].dataType) for c in d.labels]), F.col(label)).cast("int") - 1
    later = (F.col("context") > 0) if "part" in visited.columns else F.lit(False)
    rows = visited.select(place.alias("c"), later.alias("later"), F.slice("seq", F.lit(1), F.col("len")).alias("x")).filter("c >= 0")

    def partial(batches):
        held = {}
        for batch in batches:
            for part in (batch.slice(i, DRAW_ROWS) for i in range(0, batch.num_rows, DRAW_ROWS)):
                c, later = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                size = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                flat = part.column(2).flatten()
                values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1)
                x = np.full((len(size), int(size.max()), values.shape[1]), np.nan)
                x[np.arange(x.shape[1])[None, :] < size[:, None]] = values
                for k in np.unique(c).tolist():
                    own = c == k
                    for start, n, mean, m2 in _expect(x[own], size[own], later[own], d, k):
                        held[k, start] = merge(held.get((k, start)), (n, mean, m2))
        salt = TaskContext.get().partitionId() % SALTS
        out = [(k, start, salt, n, mean.tolist(), m2.reshape(-1).tolist()) for (k, start), (n, mean, m2) in held.items()]
        kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 6, kinds)],
                                         names=["c", "start", "_salt", "n", "mean", "m2"])

    sums = rows.mapInArrow(partial, "c int, start boolean, _salt int, n bigint, mean array<double>, m2 array<double>")
    merged = small_rows(pooled_moments(sums, ["c", "start"]), 2 * MAX_CLASSES)
    return [{label: d.labels[r["c"]], **r} for r in merged]


def fit_sequence_model(seqs: DataFrame, pooled: bool = True, ridge: float = 1e-3,
                       label: str = "label", rounds: int = 0, tolerance: float = 1e-4) -> SequenceModel:
    """Fit from packed training sequences, or from parts of sequences, which cover every visit of
    entities of any length. Rows without a class teach nothing.

    One pass over the sequences gives the moments and one over the lengths their shares; what
    reaches the driver is p x p per class, whatever the number of rows. ``pooled`` shares one ridge transition between the classes
    and keeps the intercepts apart; otherwise each class has its own.

    A null entry leaves out the pairs it is in. With ``rounds`` these are used as well, by expectation
    and maximisation: a forward filter replaces missing entries by their expected values and
    products given the visits so far, and the dynamics are solved anew, until they move less than
    ``tolerance`` or for so many rounds, of one pass each. A part whose repeated visit is incomplete
    takes the rest of it from the class's visits at any time. At least one pair of some class must be
    complete to start from.
    """
    visited = seqs.filter((F.col("len") > 0) & F.col(label).isNotNull())
    d = _solve(_complete_moments(visited, label), label, pooled, ridge)
    for _ in range(rounds):
        new = _solve(_expected_moments(visited, d, label), label, pooled, ridge)
        moved = max(np.abs(new.transition - d.transition).max(), np.abs(new.intercept - d.intercept).max())
        d = new
        if moved < tolerance:
            break
    sized = visited.select(label, "len")
    if "part" in seqs.columns:
        entity = next(c for c in seqs.columns if c not in (label, *PACKED))
        sized = visited.groupBy(entity, label).agg(F.sum(F.col("len") - F.col("context")).cast("int").alias("len"))
    lengths = small_rows(sized.groupBy(label, "len").agg(F.count("*").alias("n")))
    seen, share = [], []
    for c in d.labels:
        own = sorted((r["len"], r["n"]) for r in lengths if r[label] == c)
        seen.append([k for k, _ in own])
        n = np.array([v for _, v in own], dtype=float)
        share.append(np.cumsum(n / n.sum()).tolist())
    return SequenceModel(d.labels, d.count / d.count.sum(), d.start_mean, np.array([root(v) for v in d.start_cov]),
                         d.transition, d.intercept, np.array([root(v) for v in d.noise_cov]), seen, share,
                         max(r["len"] for r in lengths), seqs.schema[label].dataType.simpleString())


def dynamics_table(model: SequenceModel, spark: SparkSession) -> DataFrame:
    """``label, i, j, transition, intercept, noise_cov``: entry (i, j) of a class's matrices; the
    intercept is that of feature i."""
    noise = model.noise_root @ model.noise_root.transpose(0, 2, 1)
    rows = [(c, i, j, float(model.transition[k, i, j]), float(model.intercept[k, i]), float(noise[k, i, j]))
            for k, c in enumerate(model.labels) for i in range(model.width) for j in range(model.width)]
    return spark.createDataFrame(rows, f"label {model.label_type}, i int, j int, transition double, intercept double, noise_cov double")


def candidates(spark: SparkSession, model: SequenceModel, n: int, seed: int,
               start: int = 0) -> DataFrame:
    """``entity_id, label``: ids ``start .. start+n-1``, class drawn from the real shares."""
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n * max(1, model.mean_len * model.width * 8) / RANGE_BYTES))
    running = F.array(*[F.lit(float(s)) for s in np.cumsum(model.share)])
    names = F.array(*[F.lit(c).cast(model.label_type) for c in model.labels])
    at = F.least(search(running, unit_hash("entity_id", f"{seed}|class"), len(model.labels)),
                 F.lit(len(model.labels) - 1))
    return (spark.range(start, start + n, 1, parts).withColumnRenamed("id", "entity_id")
            .withColumn("label", F.get(names, at)))


def draw_parts(ids: DataFrame, model: SequenceModel, seed: int, part_len: int = PART_LEN) -> DataFrame:
    """A sequence for each ``entity_id, label`` as parts: ``entity_id, label, part, context, first,
    seq, len``, laid out as by ``pack_parts``.

    Only the visits that a sequence has are drawn. A step's draw depends on ``(seed, entity_id,
    label, step)`` alone and the last visit is handed from part to part, so the visits are the same
    for any ``part_len`` and a task holds ``DRAW_ROWS`` parts, however long a sequence is.
    """
    if part_len < 2:
        raise ValueError("a part holds two visits at least")
    p, stride = model.width, part_len - 1
    place = F.array_position(F.array(*[F.lit(c).cast(model.label_type) for c in model.labels]),
                             F.col("label")).cast("int") - 1
    u = unit_hash("entity_id", f"{seed}|len")
    seen = F.array(*[F.array(*[F.lit(int(k)) for k in ks]) for ks in model.lengths])
    running = F.array(*[F.array(*[F.lit(float(s)) for s in ss]) for ss in model.length_share])
    own = F.get(running, F.col("_c"))
    length = F.get(F.get(seen, F.col("_c")), F.least(search(own, u, max(map(len, model.lengths))), F.size(own) - 1))
    rows = (ids.select("entity_id", "label").withColumn("_c", place)
            .filter(F.col("_c") >= 0).withColumn("len", length))
    schema = T.StructType([
        T.StructField("entity_id", T.LongType()), T.StructField("label", ids.schema["label"].dataType),
        T.StructField("part", T.LongType()), T.StructField("context", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("seq", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("len", T.IntegerType())])
    start_mean, start_root = model.start_mean, model.start_root
    transition, intercept, noise_root = model.transition, model.intercept, model.noise_root

    def advance(x, entity, place, begin, steps):
        """The ``steps`` visits from number ``begin`` (from 0) on, after visit ``x``."""
        shocks = step_normals(seed, entity, begin, steps, p)
        out = np.empty((len(entity), steps, p))
        for c in np.unique(place):
            rows = np.flatnonzero(place == c)
            now = x[rows] if begin else None
            for t in range(steps):
                if begin + t == 0:
                    now = start_mean[c] + shocks[rows, 0] @ start_root[c].T
                else:
                    now = intercept[c] + now @ transition[c].T + shocks[rows, t] @ noise_root[c].T
                out[rows, t] = now
        return out

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, DRAW_ROWS) for i in range(0, batch.num_rows, DRAW_ROWS)):
                # Longest first: those that go on are the first ones.
                length = rows.column(3).to_numpy(zero_copy_only=False)
                rows = rows.take(pa.array(np.argsort(-length, kind="stable")))
                entity, place, length = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                part, begin, x = 0, 0, None
                while n := int((length > begin).sum()):
                    context = int(part > 0)
                    steps = min(part_len - context, int(length[0]) - begin)
                    out = advance(x, entity[:n], place[:n], begin, steps)
                    if context:
                        out = np.concatenate([x[:n, None], out], axis=1)
                    size = np.minimum(steps, length[:n] - begin) + context
                    flat = out[np.arange(steps + context)[None, :] < size[:, None]]
                    visits = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + p, p, dtype=np.int32)), pa.array(flat.reshape(-1)))
                    ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).slice(0, n), rows.column(1).slice(0, n), pa.array(np.full(n, part, np.int64)),
                         pa.array(np.full(n, context, np.int32)), pa.array(np.full(n, part * stride + 1, np.int64)),
                         pa.ListArray.from_arrays(ends, visits), pa.array(size.astype(np.int32))], names=schema.names)
                    part, begin, x = part + 1, begin + steps, out[:, -1]

    return rows.select("entity_id", "label", "_c", "len").mapInArrow(run, schema)


def draw_sequences(ids: DataFrame, model: SequenceModel, seed: int) -> DataFrame:
    """A sequence for each ``entity_id, label`` in one row, filled with zeros to the longest length
    of the model: ``entity_id, label, seq, mask, len``. The visits are those of ``draw_parts``."""
    whole = draw_parts(ids, model, seed, max(2, model.max_len))
    rest = F.lit(model.max_len) - F.col("len")
    blank = F.array(*[F.lit(0.0)] * model.width)
    return whole.select("entity_id", "label", F.concat("seq", F.array_repeat(blank, rest)).alias("seq"),
                        F.concat(F.array_repeat(F.lit(True), F.col("len")), F.array_repeat(F.lit(False), rest)).alias("mask"), "len")


def _draw(ids: DataFrame, model: SequenceModel, seed: int, part_len: int | None) -> DataFrame:
    return draw_sequences(ids, model, seed) if part_len is None else draw_parts(ids, model, seed, part_len)


def synthesize(spark: SparkSession, model: SequenceModel, n: int, seed: int,
               start: int = 0, part_len: int | None = None) -> DataFrame:
    """``n`` synthetic sequences with the real class shares: ``entity_id, label, seq, mask, len``, or,
    with ``part_len``, their parts."""
    return _draw(candidates(spark, model, n, seed, start), model, seed, part_len)


def decode(synth: DataFrame, limits: ScaleModel, projection: Projection | None = None,
           keep: list[str] = ("entity_id", "label")) -> DataFrame:
    """Sequences of components (or of scaled features) to visit rows in real units, held
    inside the range of the training rows."""
    keep = list(keep)
    if projection is None:
        return limits.clip(limits.inverse(unpack_sequences(synth, limits.features, keep)))
    visits = pca_inverse(unpack_sequences(synth, keep=keep), projection)
    return limits.clip(visits.drop("components"))


def rejection_sample(cands: DataFrame, plan: DataFrame, seed, key: str = "entity_id",
                     label: str = "label") -> DataFrame:
    """The first ``target`` candidates of each class in hash order; other classes are rejected.

    No row is repeated: too few candidates leave a shortfall. Candidates are counted by class
    and hash prefix, then filtered where they are; they are not shuffled or sorted.
    """
    cuts = hash_cuts(cands, label, key, plan, seed)
    return within_cut(cands, label, key, cuts, seed).filter("_in").drop("_in")


def rejection_report(cands: DataFrame, accepted: DataFrame, plan: DataFrame,
                     label: str = "label") -> DataFrame:
    """Per class: candidates, accepted, rejected, target, shortfall. Counts the rows given."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = (cands.select(label, one.alias("c"), none.alias("a"), none.alias("t"))
            .unionByName(accepted.select(label, none.alias("c"), one.alias("a"), none.alias("t")))
            .unionByName(plan.select(label, none.alias("c"), none.alias("a"),
                                     F.col("target").cast("long").alias("t"))))
    return (rows.groupBy(label)
            .agg(F.sum("c").alias("candidates"), F.sum("a").alias("accepted"), F.sum("t").alias("target"))
            .withColumn("rejected", F.col("candidates") - F.col("accepted"))
            .withColumn("shortfall", F.greatest(F.col("target") - F.col("accepted"), F.lit(0).cast("long"))))


@dataclass(frozen=True)
class Population:
    """Synthetic sequences, and per class what was asked for and what is missing."""

    rows: DataFrame
    shortfall: dict
    rounds: int


def populate(spark: SparkSession, model: SequenceModel, plan: DataFrame, seed: int, part_len: int | None = None) -> Population:
    """Draw candidates on fresh id ranges and reject to what is still missing, until the plan is
    met for every class that the model knows. The targets of other classes are the ``shortfall``.
    With ``part_len`` the sequences come in parts.

    A class is a function of the id, so candidates are rejected before their sequences are
    drawn: only accepted ids are simulated. Per round a few rows of counts reach the driver.
    """
    missing = {r["label"]: r["target"] for r in small_rows(plan.select("label", "target"))
               if r["target"] > 0}
    share = dict(zip(model.labels, model.share))
    parts, start, rounds = [], 0, 0
    while any(share.get(c, 0) > 0 and m > 0 for c, m in missing.items()):
        need = max(m / share[c] for c, m in missing.items() if m > 0 and share.get(c, 0) > 0)
        n = math.ceil(1.1 * need + 4.0 * math.sqrt(need)) + 16
        cands = candidates(spark, model, n, seed, start)
        left = spark.createDataFrame([(c, m) for c, m in missing.items()],
                                     f"label {model.label_type}, target bigint")
        cuts = hash_cuts(cands, "label", "entity_id", left, seed)
        parts.append(within_cut(cands, "label", "entity_id", cuts, seed).filter("_in").drop("_in"))
        have = {r["label"]: r["have"] for r in small_rows(cuts)}
        missing = {c: m - min(m, have.get(c, 0)) for c, m in missing.items()}
        start, rounds = start + n, rounds + 1
    if not parts:
        parts = [candidates(spark, model, 0, seed)]
    ids = parts[0]
    for part in parts[1:]:
        ids = ids.unionByName(part)
    return Population(_draw(ids, model, seed, part_len), {c: m for c, m in missing.items() if m}, rounds)
