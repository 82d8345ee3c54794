"""The experiment from raw records on, in steps that hand over by files.

A step's folder carries a fingerprint of the input rows, the settings and the steps before it. A
finished step leaves a marker; a run that finds it reads the step instead of doing it again, so an
experiment that was lost goes on where it stopped, and a changed setting redoes what depends on it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longitab.operators.evaluate import centroid, class_metrics, confusion, mlp, sequence_mlp, softmax, tstr
from longitab.operators.fidelity import fidelity_report
from longitab.operators.prepare import carry_forward, class_profile, encode_label, fit_imputer, fit_labels, fit_scale, order_visits, select_numeric
from longitab.operators.projection import pca_fit, pca_transform
from longitab.operators.sequences import order_features, pack_parts, starts, static_features
from longitab.operators.split import split_entities
from longitab.operators.synthesis import class_plan, decode, fit_sequence_model, populate
from longitab.plans.experiment import PHASES, Config

MODELS = ("M1", "M2", "M3", "M4")


def content_hash(df: DataFrame) -> str:
    """Hash of the rows, whatever their order: their number and the sum of their hashes, in one scan."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
    return hashlib.md5(repr((df.schema.simpleString(), row[0], str(row[1]))).encode()).hexdigest()


@dataclass
class Steps:
    """Steps of one run in ``folder``, which all executors must reach. ``done`` and ``reused`` name those
    of this run that were carried out and that were found."""

    spark: SparkSession
    folder: str
    fingerprint: str
    done: list = field(default_factory=list)
    reused: list = field(default_factory=list)

    def run(self, name: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The step's rows: read if its marker is there, else made and written."""
        text = json.dumps([self.fingerprint, name, settings], sort_keys=True, default=str)
        self.fingerprint = hashlib.md5(text.encode()).hexdigest()
        path = f"{self.folder.rstrip('/')}/{name}-{self.fingerprint}"
        try:
            self.spark.read.parquet(f"{path}/marker")
            self.reused.append(name)
        except AnalysisException:
            make().write.mode("overwrite").parquet(f"{path}/rows")
            self.spark.createDataFrame([(name, text)], "step string, settings string").write.mode("overwrite").parquet(f"{path}/marker")
            self.done.append(name)
        return self.spark.read.parquet(f"{path}/rows")


@dataclass(frozen=True)
class Raw:
    """How raw records are read: the visit date as text in format ``fmt`` (or a time already), the
    column that breaks ties of the date, the class name, and how missing values are filled: training
    ``mean`` or ``median``, or ``locf``, with medians where an entity has no value before."""

    ts: str
    tie: str
    label: str
    fmt: str | None = None
    strategy: str = "median"


def prepared_visits(raw: DataFrame, cfg: Config, how: Raw, steps: Steps) -> DataFrame:
    """``entity_id, step, side, label`` and features: numeric, in order, split by entity, without nulls,
    classes numbered. Filling and numbering are fitted on the training side. Visits without a class,
    or of a class that no training entity has, are left out."""
    keep = [c for c in dict.fromkeys([cfg.entity, how.ts, how.tie, how.label]) if c not in cfg.features]
    numeric = steps.run("numeric", {"features": cfg.features}, lambda: select_numeric(raw, cfg.features, keep))
    ordered = steps.run("ordered", asdict(how), lambda: order_visits(numeric, cfg.entity, how.ts, how.tie, how.fmt))
    sided = split_entities(ordered, cfg.entity, cfg.frac, cfg.seed)
    train = sided.filter("side = 'train'")

    def fill():
        rows = sided
        if how.strategy == "locf":
            rows = carry_forward(rows, cfg.features, cfg.entity, ["step"])
        return fit_imputer(train, cfg.features, "mean" if how.strategy == "mean" else "median").transform(rows)

    filled = steps.run("filled", {"frac": cfg.frac, "seed": cfg.seed, "strategy": how.strategy}, fill)

    def code():
        names = fit_labels(filled.filter("side = 'train'"), how.label, "null")
        rows = encode_label(filled, how.label, names, "_class").filter("_class IS NOT NULL")
        return rows.select(F.col(cfg.entity).alias("entity_id"), "step", "side", F.col("_class").alias("label"), *cfg.features)

    return steps.run("coded", {}, code)


def staged_experiment(raw: DataFrame, cfg: Config, how: Raw, folder: str, models: tuple = MODELS,
                      estimator: str = "mlp") -> tuple[DataFrame, Steps]:
    """``model, train_source, metric, label, value`` of the ``models`` from raw records, as by
    ``run_experiment``, and the steps taken. ``estimator`` is ``mlp``, ``softmax`` or ``centroid``, the same
    for all models. Phases are generated for the models that need them, and each leaves the table
    ``fidelity`` in its own step.
    """
    spark = raw.sparkSession
    steps = Steps(spark, folder, content_hash(raw))
    visits = prepared_visits(raw, cfg, how, steps)
    train = visits.filter("side = 'train'")
    fitted = {}

    def axes():
        if "axes" not in fitted:
            fitted["axes"] = pca_fit(train, cfg.features, k=cfg.k, share=cfg.share)
        return fitted["axes"]

    def pack():
        parts = pack_parts(pca_transform(visits, axes()), "entity_id", ["step"], "components", cfg.part_len, "label")
        return parts.join(visits.select("entity_id", "side").distinct(), "entity_id")

    parts = steps.run("packed", {"k": cfg.k, "share": cfg.share, "part_len": cfg.part_len}, pack)
    sides = {s: parts.filter(F.col("side") == s).drop("side") for s in ("train", "test")}

    def model():
        if "model" not in fitted:
            fitted["model"] = fit_sequence_model(sides["train"], cfg.pooled)
        return fitted["model"]

    def draw(phase: str, seed: int):
        plan = class_plan(class_profile(starts(sides["train"]), "label"), cfg.n, PHASES[phase], cfg.lam)
        population = populate(spark, model(), plan, seed, cfg.part_len)
        if population.shortfall:
            raise ValueError(f"no model for classes of the plan: {population.shortfall}")
        return population.rows

    needed = [p for p, used in (("phase1", {"M2"}), ("phase2", {"M3", "M4"})) if used & set(models)]
    phases = {}
    for i, phase in enumerate(needed):
        settings = {"n": cfg.n, "lam": cfg.lam, "pooled": cfg.pooled, "seed": cfg.seed + i}
        phases[phase] = steps.run(phase, settings, lambda: draw(phase, settings["seed"]))
    if phases:
        steps.run("fidelity", {}, lambda: fidelity_report(
            train.select("entity_id", "label", "step", *cfg.features),
            {p: decode(s, fit_scale(train, cfg.features), axes()) for p, s in phases.items()}, cfg.features))
    rows = {"real": sides["train"], **phases}
    plain = {"M1": ("real", static_features), "M2": ("phase1", static_features), "M3": ("phase2", static_features),
             "M4": ("phase2", lambda df: order_features(df, pairs=cfg.pairs))}

    def evaluate():
        classes = parts.agg(F.max("label")).first()[0] + 1
        settings = dict(layers=cfg.hidden, seed=cfg.seed, max_iter=cfg.max_iter, classes=classes)
        out = []
        for name in models:
            source, features = plain[name]
            est = {"centroid": lambda: centroid(), "softmax": lambda: softmax(rounds=cfg.max_iter, classes=classes),
                   "mlp": lambda: (sequence_mlp if name == "M4" else mlp)(**settings)}[estimator]()
            scores = class_metrics(confusion(tstr(est, features(rows[source]), features(sides["test"]))))
            out.append(scores.select(F.lit(name).alias("model"), F.lit(source).alias("train_source"), "metric", "label", "value"))
        return reduce(DataFrame.unionByName, out)

    results = steps.run("results", {"models": models, "estimator": estimator, "hidden": cfg.hidden, "max_iter": cfg.max_iter,
                                    "pairs": cfg.pairs, "seed": cfg.seed}, evaluate)
    return results, steps
