"""The report on generated phases tells order from disorder."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from longitab.operators import fidelity as fi
from longitab.operators import sequences as sq
from longitab.operators import synthesis as sy
from planted import ar_order


def test_lag_gap_shows_shuffled_order(spark):
    seqs = ar_order(spark, 1500)
    real = sq.unpack_sequences(seqs, ["a"], ["entity_id", "label"])
    model = sy.fit_sequence_model(seqs, pooled=False)
    good = sq.unpack_sequences(sy.synthesize(spark, model, 1500, 5), ["a"], ["entity_id", "label"])
    order = Window.partitionBy("entity_id").orderBy(F.xxhash64("entity_id", "a"))
    bad = good.withColumn("step", F.row_number().over(order))
    got = {(r["phase"], r["check"], r["feature"]): r["value"]
           for r in fi.fidelity_report(real, {"right": good, "shuffled": bad}, ["a"]).collect()}
    assert got[("right", "lag_gap", "a")] < 0.1 and got[("shuffled", "lag_gap", "a")] > 0.25, got
    assert got[("right", "ks", "a")] < 0.05 and got[("right", "nulls", "a")] == 0
    assert got[("shuffled", "mean_gap", "a")] == got[("right", "mean_gap", "a")]
    assert got[("right", "copied_from_real", "*")] < 100  # chance, at six digits
