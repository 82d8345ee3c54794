"""The experiment from raw records, in steps that a second run reads."""

from pyspark.sql import functions as F

from longitab.operators import sequences as sq
from longitab.plans.experiment import Config
from longitab.plans.staged import Raw, content_hash, staged_experiment
from planted import ar_order

NAMES = ["down", "flat", "up"]


def raw_visits(spark, n=500):
    """Planted sequences with names, dates as text, a number as text, missing values and visits without class."""
    rows = sq.unpack_sequences(ar_order(spark, n), ["a"], ["entity_id", "label"])
    kind = F.element_at(F.array(*map(F.lit, NAMES)), F.col("label") + 1)
    return rows.select(
        F.col("entity_id").alias("patient"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("step")), "dd/MM/yyyy").alias("seen"),
        F.col("step").alias("nr"), F.when(F.col("entity_id") % 97 != 5, kind).alias("kind"),
        F.when(F.col("entity_id") % 11 + F.col("step") != 7, F.col("a").cast("string")).alias("a"),
        (F.col("a") * 2 + F.col("step")).alias("b"))


def test_steps_are_read_again(spark, tmp_path):
    raw = raw_visits(spark).cache()
    cfg = Config(features=["a", "b"], n=300, k=2, entity="patient", part_len=4, pooled=False, hidden=(8,), max_iter=30)
    how = Raw("seen", "nr", "kind", "dd/MM/yyyy")
    first, steps = staged_experiment(raw, cfg, how, str(tmp_path), estimator="softmax")
    assert steps.reused == [] and steps.done == ["numeric", "ordered", "filled", "coded", "packed", "phase1", "phase2", "fidelity", "results"]
    rows = {(r["model"], r["metric"], r["label"]): r["value"] for r in first.collect()}
    assert {m for m, _, _ in rows} == {"M1", "M2", "M3", "M4"} and {c for _, _, c in rows} == {0, 1, 2, None}
    assert rows["M4", "balanced_accuracy", None] > rows["M3", "balanced_accuracy", None] + 0.1
    again, steps = staged_experiment(raw.repartition(5), cfg, how, str(tmp_path), estimator="softmax")
    assert steps.done == [] and len(steps.reused) == 9
    assert {(r["model"], r["metric"], r["label"]): r["value"] for r in again.collect()} == rows
    other, steps = staged_experiment(raw, cfg, how, str(tmp_path), ("M1",), "centroid")
    assert steps.done == ["results"] and other.count() == 12
    assert staged_experiment(raw.filter("patient > 3"), cfg, how, str(tmp_path), ("M1",), "centroid")[1].reused == []


def test_locf_and_hash_of_rows(spark, tmp_path):
    raw = raw_visits(spark, 60)
    cfg = Config(features=["a", "b"], n=10, k=2, entity="patient")
    results, steps = staged_experiment(raw, cfg, Raw("seen", "nr", "kind", "dd/MM/yyyy", "locf"), str(tmp_path), ("M1",), "centroid")
    assert results.count() > 0 and steps.done[-1] == "results"
    assert content_hash(raw) == content_hash(raw.repartition(7)) != content_hash(raw.limit(100))
