"""Train on synthetic, test on real: models M1 to M4 in one run."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitab.functions.ranges import number_rows
from longitab.operators.evaluate import class_metrics, compare, confusion, mlp, sequence_mlp, tstr
from longitab.operators.fidelity import fidelity_report
from longitab.operators.prepare import class_profile, fit_scale
from longitab.operators.projection import pca_fit, pca_transform
from longitab.operators.sequences import PART_LEN, order_features, pack_parts, pack_sequences, starts, static_features
from longitab.operators.split import split_entities
from longitab.operators.synthesis import class_plan, decode, fit_sequence_model, populate
from longitab.sources.records import write_phase
from longitab.sources.shared import settle

PHASES = {"phase1": "proportional", "phase2": "near_balanced"}


@dataclass(frozen=True)
class Config:
    """Settings of one run. ``label`` is a dense class index, the same for every visit of an
    entity. Sequences are held in parts of ``part_len`` visits; ``max_len`` cuts them instead, and by
    default every visit stays. ``pairs`` are those of ``order_features``. All models share seed, hidden layers and iterations, so that only rows and
    features differ. Give ``k`` or ``share`` for the number of components."""

    features: list[str]
    n: int
    k: int | None = None
    share: float | None = None
    entity: str = "entity_id"
    label: str = "label"
    order: list[str] = field(default_factory=lambda: ["step"])
    max_len: int | None = None
    part_len: int = PART_LEN
    pairs: str = "all"
    frac: float = 0.7
    lam: float = 0.9
    pooled: bool = True
    seed: int = 42
    hidden: tuple = (16,)
    max_iter: int = 100
    path: str | None = None


@dataclass(frozen=True)
class Prepared:
    """Packed real sequences with their side, and what was fitted on the training side."""

    train: DataFrame
    test: DataFrame
    projection: object
    limits: object


def prepare(visits: DataFrame, cfg: Config) -> Prepared:
    """Split by entity, fit scaling and axes on training entities only, project, pack."""
    train = split_entities(visits, cfg.entity, cfg.frac, cfg.seed).filter("side = 'train'")
    projection = pca_fit(train, cfg.features, k=cfg.k, share=cfg.share)
    limits = fit_scale(train, cfg.features)
    rows = pca_transform(visits, projection)
    if cfg.max_len is None:
        packed = pack_parts(rows, cfg.entity, cfg.order, "components", cfg.part_len, cfg.label)
    else:
        packed = pack_sequences(rows, cfg.entity, cfg.order, "components", cfg.max_len, cfg.label).drop("dropped")
    packed = settle(packed.withColumnsRenamed({cfg.entity: "entity_id", cfg.label: "label"}))
    sided = split_entities(packed, "entity_id", cfg.frac, cfg.seed)
    return Prepared(sided.filter("side = 'train'").drop("side"),
                    sided.filter("side = 'test'").drop("side"), projection, limits)


def generate(prepared: Prepared, cfg: Config) -> dict[str, DataFrame]:
    """Synthetic sequences of both phases; each phase has its own seed."""
    spark = prepared.train.sparkSession
    model = fit_sequence_model(prepared.train, cfg.pooled)
    profile = class_profile(starts(prepared.train), "label")
    out = {}
    for i, (phase, mode) in enumerate(PHASES.items()):
        plan = class_plan(profile, cfg.n, mode, cfg.lam)
        population = populate(spark, model, plan, cfg.seed + i, cfg.part_len if cfg.max_len is None else None)
        if population.shortfall:
            raise ValueError(f"no model for classes of the plan: {population.shortfall}")
        out[phase] = settle(population.rows)
        if cfg.path:
            write_phase(decode(out[phase], prepared.limits, prepared.projection), cfg.path, phase)
    return out


def training_visits(visits: DataFrame, cfg: Config) -> DataFrame:
    """The training side as it was given, in real units: ``entity_id, label, step`` and features."""
    train = split_entities(visits, cfg.entity, cfg.frac, cfg.seed).filter("side = 'train'")
    rows = number_rows(train, [cfg.entity], cfg.order, "step") if cfg.order != ["step"] else train
    return rows.select(F.col(cfg.entity).alias("entity_id"), F.col(cfg.label).alias("label"), "step", *cfg.features)


def phase_fidelity(visits: DataFrame, cfg: Config) -> DataFrame:
    """``fidelity_report`` of both generated phases, decoded to real units, against the training visits
    as they were given: what the projection loses shows as a distance too."""
    prepared = prepare(visits, cfg)
    phases = {p: decode(s, prepared.limits, prepared.projection) for p, s in generate(prepared, cfg).items()}
    return fidelity_report(training_visits(visits, cfg), phases, cfg.features)


def run_experiment(visits: DataFrame, cfg: Config) -> DataFrame:
    """``model, train_source, metric, label, value`` for M1 to M4 on one real test set.

    M1 static on real, M2 static on phase 1, M3 static on phase 2, M4 order features on
    phase 2. Overall metrics have a null label.
    """
    prepared = prepare(visits, cfg)
    phases = generate(prepared, cfg)
    settings = dict(layers=cfg.hidden, seed=cfg.seed, max_iter=cfg.max_iter)
    classes = (prepared.train.select("label").unionByName(prepared.test.select("label"))
               .agg(F.max("label")).first()[0] + 1)
    static, order = mlp(classes=classes, **settings), sequence_mlp(classes=classes, **settings)
    runs = [("M1", "real", static, prepared.train, static_features),
            ("M2", "phase1", static, phases["phase1"], static_features),
            ("M3", "phase2", static, phases["phase2"], static_features),
            ("M4", "phase2", order, phases["phase2"], lambda df: order_features(df, pairs=cfg.pairs))]
    results = []
    for name, source, est, train, features in runs:
        pred = tstr(est, features(train), features(prepared.test))
        scores = class_metrics(confusion(pred))
        results.append(scores.select(F.lit(name).alias("model"), F.lit(source).alias("train_source"),
                                     "metric", "label", "value"))
    return reduce(DataFrame.unionByName, results)


def sequence_gain(results: DataFrame) -> DataFrame:
    """M4 over M3 in points and relative, for the overall metrics."""
    return compare(results.filter(F.col("label").isNull()), "M3", "M4")
