"""How close a synthetic table is to the real one: marginals, overlap, order, quality."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longitab.functions.ranges import SLICE_ROWS, lagged
from longitab.functions.small import join_small
from longitab.operators.projection import Projection, pca_fit, pca_transform
from longitab.sources.shared import settle


MAX_PHASES = 100
#: Units in which ``in_units`` adds up values; a value holds fewer than 2^30 of each.
UNITS = tuple(2.0**k for k in (30, 0, -30, -60))


def pair(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables on top of each other with ``source`` = ``real`` or ``synth``."""
    return (real.select(*columns, F.lit("real").alias("source"))
            .unionByName(synth.select(*columns, F.lit("synth").alias("source"))))


def long_values(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per value: ``ids..., feature, value``."""
    doubles = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return doubles.unpivot(ids, features, "feature", "value")


def in_units(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``value`` as whole numbers ``_u0, _u1...`` of ``UNITS``, and ``_rest``, what they leave.

    Whole numbers add up to the same sum in any order of rows, which doubles do not. Values from
    2^60 on, infinite ones and those that are no numbers are rest.
    """
    known = F.abs(value) < UNITS[0] * 2.0**30
    left = F.when(known, F.col(value)).when(F.col(value).isNotNull(), 0.0)
    for k, unit in enumerate(UNITS):
        df = df.withColumn(f"_u{k}", (left / unit).cast("long")).withColumn("_rest", left - F.col(f"_u{k}") * unit)
        left = F.col("_rest")
    return df.withColumn("_rest", F.when(known, F.col("_rest")).otherwise(F.col(value)))


def mean_of_units(value: str, there: Column) -> Column:
    """Mean of ``value`` over the rows of ``in_units`` that are ``there``; an ordinary one where a sum of units is too long."""
    at = lambda c: F.when(there, F.col(c))
    total = reduce(Column.__add__, [F.try_sum(at(f"_u{k}")) * u for k, u in enumerate(UNITS)]) + F.sum(at("_rest"))
    return F.coalesce(total / F.nullif(F.count(at(value)), F.lit(0)), F.avg(at(value)))


def running_extremes(counts: DataFrame) -> DataFrame:
    """Per sorted partition and group, the extremes and the end of the running difference.

    ``counts`` is sorted inside range partitions by ``g, value``. One vectorised pass; state
    is one group's running totals.
    """
    schema = "g long, part int, hi double, lo double, s1 bigint, s0 bigint"

    def run(batches):
        part, rows, held = TaskContext.get().partitionId(), [], None
        for batch in batches:
            g, c1, c0, n1, n0 = (batch.column(c).to_numpy() for c in ("g", "c1", "c0", "n1", "n0"))
            edges = np.flatnonzero(np.diff(g)) + 1
            for at, to in zip([0, *edges], [*edges, len(g)]):
                if at == to:
                    continue
                if held is None or held[0] != g[at]:
                    held = [int(g[at]), part, -np.inf, np.inf, 0, 0]
                    rows.append(held)
                r1 = held[4] + np.cumsum(c1[at:to])
                r0 = held[5] + np.cumsum(c0[at:to])
                gap = r1 / n1[at] - r0 / n0[at]
                held[2:] = [max(held[2], float(gap.max())), min(held[3], float(gap.min())),
                            int(r1[-1]), int(r0[-1])]
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)],
                                         names=["g", "part", "hi", "lo", "s1", "s0"])

    return counts.mapInArrow(run, schema)


def ks_statistic(a: DataFrame, b: DataFrame, features: list[str], by: list[str] = (),
                 levels: list[list[str]] | None = None) -> DataFrame:
    """Two-sample distance ``max |F_a - F_b|``: ``by..., feature, n1, n0, nulls, d``. Exact.

    ``levels`` are subsets of ``by`` that are all compared from one scan: the counts of values are
    added up by grouping sets. Then ``level`` names a row's subset (``all`` for none), and the other
    columns of ``by`` are null.

    Values are counted before they are shuffled, so ties cost one row. The counts are then
    range-partitioned by feature and value, so a feature with most of the rows is spread over
    as many tasks as it needs. Each partition reports its extremes of the running difference
    from its own start, and the totals of the partitions before it shift them. Nulls are left
    out and counted; d is null when one side has no value.
    """
    by = list(by)
    group = [*by, "feature"]
    values = long_values(pair(a, b, [*by, *features]), [*by, "source"], list(features))
    is_a = F.col("source") == "real"
    # A group is known by a hash of its keys; null is a key of its own.
    key = F.xxhash64(*[k for c in group for k in (F.col(c).isNull(), F.col(c))])
    counted = values.groupBy(*group, "value").agg(F.count_if(is_a).alias("c1"), F.count_if(~is_a).alias("c0"))
    if levels is not None:
        columns = [*group, "value"]
        sets = [[*level, "feature", "value"] for level in levels]
        numbers = {int("".join("01"[c not in wanted] for c in columns), 2): "+".join(level) or "all" for level, wanted in zip(levels, sets)}
        counted = (counted.groupingSets(sets, *columns).agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"), F.grouping_id().cast("int").alias("_id"))
                   .withColumn("level", F.get(F.array(*[F.lit(numbers.get(i)) for i in range(max(numbers) + 1)]), F.col("_id"))).drop("_id"))
        group = [*by, "level", "feature"]
        key = F.xxhash64(*[k for c in group for k in (F.col(c).isNull(), F.col(c))])
    counted = counted.withColumn("g", key)
    return _distances(counted, group)


def _distances(counted: DataFrame, group: list[str]) -> DataFrame:
    """``group..., n1, n0, nulls, d`` from counts ``group..., value, c1, c0`` of groups known by ``g``.

    The counts are written out: the sizes of the groups, the sample of the ranges and the distances each
    read them, and would else count all values anew.
    """
    counted = settle(counted)
    there = F.col("value").isNotNull()
    sizes = counted.groupBy(*group, "g").agg(
        F.coalesce(F.sum(F.when(there, F.col("c1"))), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.when(there, F.col("c0"))), F.lit(0)).alias("n0"),
        F.coalesce(F.sum(F.when(~there, F.col("c1") + F.col("c0"))), F.lit(0)).alias("nulls"))
    known = sizes.filter("n1 > 0 AND n0 > 0").select("g", "n1", "n0")
    counts = (join_small(counted.filter(there), known, ["g"])
              .select("g", "value", "c1", "c0", "n1", "n0")
              .repartitionByRange("g", "value").sortWithinPartitions("g", "value"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    started = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = (running_extremes(counts)
             .withColumns({"b1": started("s1"), "b0": started("s0")})
             .join(known, "g")
             .withColumn("shift", F.col("b1") / F.col("n1") - F.col("b0") / F.col("n0")))
    distance = parts.groupBy("g").agg(F.max(F.greatest(
        F.abs(F.col("shift") + F.col("hi")), F.abs(F.col("shift") + F.col("lo")))).alias("d"))
    return sizes.join(distance, "g", "left").select(*group, "n1", "n0", "nulls", "d")


def ks_pvalue(d, n1, n0) -> Column:
    """Asymptotic p-value with the small-sample correction, eight series terms.

    The series is of no use near zero, so 1 is given below 0.3.
    """
    d, n1, n0 = (F.col(c) if isinstance(c, str) else c for c in (d, n1, n0))
    m = F.nullif(n1 * n0, F.lit(0)) / F.nullif(n1 + n0, F.lit(0))
    lam = (F.sqrt(m) + 0.12 + 0.11 / F.sqrt(m)) * d
    terms = [F.lit(2.0 * (-1) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * lam * lam)
             for j in range(1, 9)]
    series = F.greatest(F.least(reduce(lambda x, y: x + y, terms), F.lit(1.0)), F.lit(0.0))
    return F.when(d.isNull(), F.lit(None).cast("double")).when(lam < 0.3, 1.0).otherwise(series)


def ks_report(real: DataFrame, synth: DataFrame, features: list[str], by: list[str] = (),
              alpha: float = 0.05) -> DataFrame:
    """Distance and p-value per feature and ``by`` (phase, class), and per ``by`` the share of
    tested features that pass ``p > alpha``."""
    by = list(by)
    same = Window.partitionBy(*(by or [F.lit(1)]))
    return (ks_statistic(real, synth, features, by)
            .withColumn("p_value", ks_pvalue("d", "n1", "n0"))
            .withColumn("passed", F.col("p_value") > alpha)
            .withColumn("share_passed", F.avg(F.col("passed").cast("double")).over(same)))


def phase_ks_report(real: DataFrame, phases: DataFrame, features: list[str], label: str = "label", phase: str = "phase",
                    alpha: float = 0.05) -> DataFrame:
    """Two-sample distance of every generated phase to the real rows, per class and over all its
    classes: ``phase, label, level, feature, n1, n0, nulls, d, p_value,
    passed``.

    ``phases`` holds the rows of all phases. Both tables are scanned once: real rows stand against
    each phase, which is done on the counts of their values.
    """
    names = [r[0] for r in phases.select(phase).distinct().limit(MAX_PHASES + 1).collect()]
    if len(names) > MAX_PHASES:
        raise ValueError(f"more than {MAX_PHASES} phases")
    kind = phases.schema[phase].dataType.simpleString()
    # The real side is a phase of its own, then dealt to all of them after counting.
    both = long_values(pair(real.withColumn(phase, F.lit(None).cast(kind)), phases, [phase, label, *features]), [phase, label, "source"], list(features))
    is_real = F.col("source") == "real"
    counted = both.groupBy("source", phase, label, "feature", "value").agg(F.count("*").alias("n"))
    targets = F.when(is_real, F.array(*[F.lit(n).cast(kind) for n in names])).otherwise(F.array(F.col(phase)))
    dealt = counted.withColumn(phase, F.explode(targets))
    key = F.xxhash64("level", F.col(phase).isNull(), phase, F.col(label).isNull(), label, "feature")
    sides = dealt.groupBy(phase, label, "feature", "value").agg(
        F.coalesce(F.sum(F.when(is_real, F.col("n"))), F.lit(0)).alias("c1"), F.coalesce(F.sum(F.when(~is_real, F.col("n"))), F.lit(0)).alias("c0"))
    sets = [[phase, label, "feature", "value"], [phase, "feature", "value"]]
    leveled = (sides.groupingSets(sets, phase, label, "feature", "value")
               .agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"), F.when(F.grouping(label) == 1, "phase").otherwise("class").alias("level")))
    return _distances(leveled.withColumn("g", key), [phase, label, "level", "feature"]).withColumn("p_value", ks_pvalue("d", "n1", "n0")).withColumn(
        "passed", F.col("p_value") > alpha)


def project_pair(real: DataFrame, synth: DataFrame, features: list[str] | str, k: int = 2,
                 keep: list[str] = (), model: Projection | None = None) -> DataFrame:
    """Axes fitted on the real rows, both tables projected: ``keep..., source, pc1..pck``."""
    columns = [features] if isinstance(features, str) else list(features)
    model = model or pca_fit(real, features, k=k)
    both = pair(real, synth, list(dict.fromkeys([*keep, *columns])))
    projected = pca_transform(both, model)
    return projected.select(*keep, "source", *[F.get("components", F.lit(i)).alias(f"pc{i + 1}")
                                               for i in range(k)])


def grid_overlap(proj: DataFrame, cell: float, x: str = "pc1", y: str = "pc2") -> DataFrame:
    """Shared mass of the two sources' histograms on a square grid, 0 to 1, and cells used.

    Rows without both coordinates are in no cell; they are counted in ``nulls``. The input is
    read once: with n1 and n0 rows in all, a cell shares ``least(c1 * n0, c0 * n1) / (n1 * n0)``,
    and cells are first added up by their pair of counts, so totals and shares come from those.
    """
    is_real = F.col("source") == "real"
    cx, cy = F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)
    there = cx.isNotNull() & cy.isNotNull()
    cells = (proj.groupBy(F.when(there, cx).alias("_cx"), F.when(there, cy).alias("_cy"))
             .agg(F.count_if(is_real).alias("_c1"), F.count_if(~is_real).alias("_c0")))
    used = F.col("_cx").isNotNull()
    kinds = cells.groupBy("_c1", "_c0", used.alias("_used")).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(1))
    total = lambda c: F.sum(F.when(F.col("_used"), F.col(c) * F.col("_n"))).over(every).cast("double")
    shared = F.least(F.col("_c1") / F.nullif(F.col("_t1"), F.lit(0.0)), F.col("_c0") / F.nullif(F.col("_t0"), F.lit(0.0)))
    return (kinds.withColumns({"_t1": total("_c1"), "_t0": total("_c0")}).agg(
        F.sum(F.when(F.col("_used"), shared * F.col("_n"))).alias("overlap"),
        F.coalesce(F.sum(F.when(F.col("_used"), F.col("_n"))), F.lit(0)).alias("cells"),
        F.coalesce(F.sum(F.when(F.col("_used") & (F.col("_c1") > 0) & (F.col("_c0") > 0), F.col("_n"))), F.lit(0)).alias("shared_cells"),
        F.coalesce(F.sum(F.when(~F.col("_used"), (F.col("_c1") + F.col("_c0")) * F.col("_n"))), F.lit(0)).alias("nulls")))


def lag_correlations(visits: DataFrame, entity: str, step: str, features: list[str], by: list[str],
                     max_lag: int, chunk: int = SLICE_ROWS) -> DataFrame:
    """Correlation of each feature with itself ``lag`` visits back: ``by..., feature, lag, n, r``."""
    wanted = {f"_{k}_{f}": (f, k) for k in range(1, max_lag + 1) for f in features}
    back = lagged(visits.select(*by, entity, step, *features), [*by, entity], step, wanted, chunk)
    triples = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"),
                                 F.col(f).cast("double").alias("now"),
                                 F.col(new).cast("double").alias("then"))
                        for new, (f, k) in wanted.items()])
    pairs = (back.select(*by, F.inline(triples))
             .filter(F.col("now").isNotNull() & F.col("then").isNotNull()))
    return pairs.groupBy(*by, "feature", "lag").agg(
        F.count("*").alias("n"), F.corr("now", "then").alias("r"))


def lag_fidelity(real: DataFrame, synth: DataFrame, entity: str, step: str, features: list[str],
                 label: str, max_lag: int = 1, chunk: int = SLICE_ROWS) -> DataFrame:
    """Lag correlations of both tables and their gap per class, feature and lag."""
    both = pair(real, synth, [entity, step, label, *features])
    r = lag_correlations(both, entity, step, features, ["source", label], max_lag, chunk)
    side = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    none = F.lit(0).cast("long")
    return (r.groupBy(label, "feature", "lag")
            .agg(F.coalesce(side("real", "n"), none).alias("n_real"),
                 F.coalesce(side("synth", "n"), none).alias("n_synth"),
                 side("real", "r").alias("r_real"), side("synth", "r").alias("r_synth"))
            .withColumn("gap", F.abs(F.col("r_real") - F.col("r_synth"))))


def moment_gap(real: DataFrame, synth: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """Mean and deviation of both tables per feature and class, and the gaps."""
    values = long_values(pair(real, synth, [*by, *features]), [*by, "source"], list(features))
    at = lambda s: F.when(F.col("source") == s, F.col("value"))
    return (values.groupBy(*by, "feature")
            .agg(F.avg(at("real")).alias("mean_real"), F.avg(at("synth")).alias("mean_synth"),
                 F.stddev_samp(at("real")).alias("sd_real"),
                 F.stddev_samp(at("synth")).alias("sd_synth"))
            .withColumn("mean_gap", F.col("mean_synth") - F.col("mean_real"))
            .withColumn("sd_gap", F.col("sd_synth") - F.col("sd_real")))


def fidelity_report(real: DataFrame, phases: dict[str, DataFrame], features: list[str], entity: str = "entity_id",
                    step: str = "step", label: str = "label") -> DataFrame:
    """Every generated phase against the real training visits: ``phase, check, feature, value``.

    Per feature the two-sample distance ``ks``, the gaps of mean and deviation, nulls and the share
    outside the real range; the gap of the lag-1 correlation, averaged over classes; over all
    features the repeats and the rows copied from real ones.

    The real side is read once for all phases, and every table is written out before: a phase that is
    decoded from drawn components would else be decoded for each check anew.
    """
    columns = list(dict.fromkeys([entity, step, label, *features]))
    real = settle(real.select(*columns))
    phases = {n: settle(s.select(*columns)) for n, s in phases.items()}
    names = list(phases)
    both = stacked([real, *phases.values()], columns)
    gap = lambda f, i: F.abs(f(i) - f(0))

    def every(rows: DataFrame, checks, *there: Column) -> DataFrame:
        """Rows of checks, each an expression of the phase's number, of those phases that are ``there``."""
        found = F.array(*[F.struct(F.lit(n).alias("phase"), F.lit(c).alias("check"), v(i).cast("double").alias("value"),
                                   (there[i - 1] if there else F.lit(True)).alias("there")) for c, v in checks for i, n in enumerate(names, 1)])
        return rows.select("feature", F.inline(found)).filter("there").select("phase", "check", "feature", "value")

    values = in_units(long_values(both, ["source"], list(features)), "value").groupBy("feature").agg(
        *[mean_of_units("value", F.col("source") == i).alias(f"mean{i}") for i in range(len(names) + 1)],
        *[F.stddev_samp(F.when(F.col("source") == i, F.col("value"))).alias(f"sd{i}") for i in range(len(names) + 1)])
    gaps = every(values, [(f"{c}_gap", lambda i, c=c: gap(lambda k: F.col(f"{c}{k}"), i)) for c in ("mean", "sd")])

    r = lag_correlations(both, entity, step, features, ["source", label], 1)
    wide = r.groupBy(label, "feature", "lag").agg(*[f(F.when(F.col("source") == i, F.col("r" if c == "r" else "n"))).alias(f"{c}{i}")
                                                  for i in range(len(names) + 1) for c, f in (("r", F.max), ("n", F.count))])
    lags = wide.groupBy("feature").agg(*[F.avg(gap(lambda k: F.col(f"r{k}"), i)).alias(f"g{i}") for i in range(1, len(names) + 1)],
                                       *[(F.max(F.col("n0") + F.col(f"n{i}")) > 0).alias(f"t{i}") for i in range(1, len(names) + 1)])
    lags = every(lags, [("lag_gap", lambda i: F.col(f"g{i}"))], *[F.col(f"t{i}") for i in range(1, len(names) + 1)])

    def ks(name: str) -> DataFrame:
        return ks_statistic(real, phases[name], features).select(F.lit(name).alias("phase"), F.lit("ks").alias("check"), "feature", F.col("d").alias("value"))

    return reduce(DataFrame.unionByName, [*[ks(n) for n in names], gaps, lags, _quality(real, phases, features)])


def stacked(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """The tables on top of each other with ``source``, their number from 0."""
    return reduce(DataFrame.unionByName, [t.select(*columns, F.lit(i).alias("source")) for i, t in enumerate(tables)])


def _row_key(features: list[str], digits: int) -> Column:
    # Adding 0.0 turns a negative zero into zero.
    values = [F.coalesce((F.round(F.col(f).cast("double"), digits) + F.lit(0.0)).cast("string"),
                         F.lit("null")) for f in features]
    return F.md5(F.concat_ws("|", *values))


def quality_checks(real: DataFrame, synth: DataFrame, features: list[str],
                   digits: int = 6) -> DataFrame:
    """``check, feature, value``: per feature nulls and share outside the real range; over
    all features the exact repeats among synthetic rows and the rows that copy a real row.

    Repeats count every row beyond the first of its kind. Copies and repeats come from one
    grouping of row hashes, counted before the shuffle, so a frequent row is one row there.
    """
    return _quality(real, {"synth": synth}, features, digits).drop("phase")


def _quality(real: DataFrame, phases: dict[str, DataFrame], features: list[str], digits: int = 6) -> DataFrame:
    """``phase, check, feature, value`` as by ``quality_checks`` for every phase; the rows of all are
    grouped once."""
    def per_feature(name: str, value) -> list[Column]:
        return [F.struct(F.lit(name).alias("check"), F.lit(f).alias("feature"),
                         value(f).cast("double").alias("value")) for f in features]

    limits = real.agg(*[F.min(f).cast("double").alias(f"_lo_{f}") for f in features],
                      *[F.max(f).cast("double").alias(f"_hi_{f}") for f in features]).first()

    def outside(f):
        lo, hi = limits[f"_lo_{f}"], limits[f"_hi_{f}"]
        if lo is None:
            return F.lit(None)
        off = (F.col(f) < F.lit(lo)) | (F.col(f) > F.lit(hi))
        return F.count_if(off) / F.nullif(F.count(F.col(f)), F.lit(0))

    checks = per_feature("nulls", lambda f: F.count_if(F.col(f).isNull()))
    checks += per_feature("out_of_range_share", outside)
    parts = [synth.agg(F.explode(F.array(*checks)).alias("c")).select(F.lit(n).alias("phase"), "c.*") for n, synth in phases.items()]

    rows = stacked([real, *phases.values()], features).select("source", _row_key(features, digits).alias("_key"))
    kinds = rows.groupBy("_key").agg(*[F.count_if(F.col("source") == i).alias(f"_n{i}") for i in range(len(phases) + 1)])
    table = []
    for i, name in enumerate(phases, 1):
        n = F.col(f"_n{i}")
        table += [F.struct(F.lit(name).alias("phase"), F.lit(c).alias("check"), F.lit("*").alias("feature"),
                           F.coalesce(F.sum(v), F.lit(0)).cast("double").alias("value"))
                  for c, v in (("repeats", F.greatest(n - 1, F.lit(0))), ("copied_from_real", F.when(F.col("_n0") > 0, n).otherwise(0)))]
    parts.append(kinds.agg(F.explode(F.array(*table)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)
