"""Registered queries: each reads the given tables in full.

The driver tables are stand-ins for health records: ``events`` are visits of users,
``embeddings`` are feature vectors, ``labels`` have unevenly spread classes. Real and
synthetic sides are cut from one table by key parity or by a status column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitab.operators import evaluate as ev
from longitab.operators import fidelity as fi
from longitab.operators import moments as mo
from longitab.operators import neighbours as nb
from longitab.operators import prepare as pr
from longitab.operators import projection as pj
from longitab.operators import sequences as sq
from longitab.operators import split as sp
from longitab.operators import synthesis as sy
from longitab.plans.experiment import Config, run_experiment, sequence_gain
from longitab.plans.experiment import phase_fidelity as phase_report
from longitab.plans.staged import Raw, staged_experiment
from longitab.sources.records import read_phase, read_records, split_records, write_phase
from longitab.sources.shared import settle, shared_folder

SEED = 42
POPULATION = 15_904

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType())])
LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType())])
NUMERICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM = T.StructType([T.StructField(c, T.DoubleType()) for c in NUMERICS]
                        + [T.StructField("l_orderkey", T.LongType()),
                           T.StructField("l_linenumber", T.IntegerType()),
                           T.StructField("l_linestatus", T.StringType()),
                           T.StructField("l_returnflag", T.StringType())])
CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()),
                         T.StructField("c_mktsegment", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    return read_records(spark, f"{sf_dir}/{name}.parquet", schema, "parquet")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events", EVENTS)


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings", EMBEDDINGS)


def lineitem(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem", LINEITEM)


def user_class():
    """Three unevenly spread classes of users."""
    tenth = F.expr("user_id div 2") % 10
    return F.when(tenth == 0, 2).when(tenth < 4, 1).otherwise(0)


def visits(spark, sf_dir) -> DataFrame:
    """Events as visits with two numeric features and the class of the user."""
    rows = events(spark, sf_dir).withColumn("k", F.regexp_extract("props", r"(\d+)", 1))
    return pr.select_numeric(rows, ["value", "k"], ["event_id", "ts", "user_id"]).withColumn(
        "label", user_class())


def stepped(df: DataFrame) -> DataFrame:
    return pr.order_visits(df, "user_id", "ts", "event_id")


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Even keys as the real side, odd keys as the synthetic side."""
    return df.filter(F.col(key) % 2 == 0), df.filter(F.col(key) % 2 == 1)


def statuses(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("l_linestatus = 'F'"), df.filter("l_linestatus <> 'F'")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Sources and sinks

def records_read(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "props",
                                        F.unix_micros("ts").alias("ts_us"))


def phase_roundtrip(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", "label", "embedding")
    folder = f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}"
    first, second = halves(rows, "vec_id")
    write_phase(first, folder, "phase1")
    write_phase(second, folder, "phase2")
    back = [read_phase(spark, folder, p, rows.schema).select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "x"), F.lit(p).alias("phase"))
        .withColumn("x", F.round("x", 6)) for p in ("phase1", "phase2")]
    return back[0].unionByName(back[1])


# Preparation

def numeric_select(spark, sf_dir):
    return visits(spark, sf_dir).select("event_id", "value", "k")


def numeric_failures(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("k", F.regexp_extract("props", r"(\d+)", 1))
    return pr.cast_failures(rows, ["value", "k", "props", "event_type"])


def visit_order(spark, sf_dir):
    return stepped(events(spark, sf_dir)).select("event_id", "user_id", "step")


def _gappy(spark, sf_dir):
    return events(spark, sf_dir).withColumn(
        "value", F.when(F.col("event_type") != "error", F.col("value")))


def locf_impute(spark, sf_dir):
    out = pr.impute(_gappy(spark, sf_dir), ["value"], "locf", entity="user_id", order=["ts", "event_id"])
    return out.select("event_id", "user_id", "value")


def mean_impute(spark, sf_dir):
    rows = _gappy(spark, sf_dir)
    train = sp.split_entities(rows, "user_id").filter("side = 'train'")
    out = pr.impute(rows, ["value"], "mean", train=train)
    return rounded(out.select("event_id", "value"), 6, "value")


def median_impute(spark, sf_dir):
    """Nulls of two features filled by the exact medians of the training side."""
    rows = (_gappy(spark, sf_dir).withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("double"))
            .withColumn("k", F.when(F.col("event_type") != "view", F.col("k"))))
    train = sp.split_entities(rows, "user_id").filter("side = 'train'")
    out = pr.impute(rows, ["value", "k"], "median", train=train)
    return rounded(out.select("event_id", "value", "k"), 6, "value", "k")


def label_index(spark, sf_dir):
    rows = table(spark, sf_dir, "customer", CUSTOMER)
    return pr.encode_label(rows, "c_mktsegment").select("c_custkey", "c_mktsegment", "label")


def _profile(df, label):
    return rounded(pr.class_profile(df, label), 9, "share", "ratio")


def class_profile_events(spark, sf_dir):
    return _profile(events(spark, sf_dir), "event_type")


def class_profile_labels(spark, sf_dir):
    return _profile(table(spark, sf_dir, "labels", LABELS), "quality")


def _scaled(spark, sf_dir, kind):
    rows = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", *NUMERICS)
    return rounded(pr.scale(rows, NUMERICS, kind), 6, *NUMERICS)


def zscore(spark, sf_dir):
    return _scaled(spark, sf_dir, "zscore")


def minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


def unscale_roundtrip(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", *NUMERICS)
    model = pr.fit_scale(rows, NUMERICS)
    return rounded(pr.unscale(model.transform(rows), model), 4, *NUMERICS)


def covariance_pairs(spark, sf_dir):
    return rounded(mo.covariance(embeddings(spark, sf_dir), "embedding"), 6, "cov")


def covariance_by_status(spark, sf_dir):
    out = mo.covariance(lineitem(spark, sf_dir), NUMERICS, by="l_linestatus")
    return rounded(out, 3, "cov")


def pca_39(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return pj.pca_transform(rows, pj.pca_fit(rows, "embedding", k=39)).select("vec_id", "components")


def pca_variance(spark, sf_dir):
    return pj.explained_variance(pj.pca_fit(embeddings(spark, sf_dir), "embedding", k=39), spark)


def pca_roundtrip_error(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    model = pj.pca_fit(rows, "embedding", k=64)
    back = pj.pca_inverse(pj.pca_transform(rows, model), model, out="back")
    return (back.select("vec_id", F.posexplode("back").alias("pos", "value"))
            .withColumn("value", F.round("value", 5)))


def pca_total_variance(spark, sf_dir):
    """At full rank the component variances sum to those of the features, around the features' mean."""
    rows = embeddings(spark, sf_dir)
    scores = pj.pca_transform(rows, pj.pca_fit(rows, "embedding", k=64, standardise=False))
    parts = scores.select(F.posexplode("components").alias("pos", "c")).groupBy("pos").agg(
        F.var_samp("c").alias("v"), F.avg("c").alias("m"))
    return parts.agg(F.round(F.sum("v"), 6).alias("total"), F.round(F.max(F.abs("m")), 6).alias("centre"))


def pca_row_norms(spark, sf_dir):
    """At full rank the axes only turn the standardised row, so its length stays."""
    rows = embeddings(spark, sf_dir)
    scores = pj.pca_transform(rows, pj.pca_fit(rows, "embedding", k=64))
    squares = F.aggregate("components", F.lit(0.0), lambda acc, c: acc + c * c)
    return scores.select("vec_id", F.round(squares, 5).alias("norm2"))


TWO = ["l_quantity", "l_extendedprice"]


def _two(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_linestatus", *TWO)
    return rows, pj.pca_fit(rows, TWO, k=2)


def pca_two_axes(spark, sf_dir):
    """Axes and variance shares of two features, which have a closed form."""
    model = _two(spark, sf_dir)[1]
    out = pj.axis_weights(model, spark).join(pj.explained_variance(model, spark), "component")
    return rounded(out, 9, "weight", "share", "running_share")


def pca_two_scores(spark, sf_dir):
    rows, model = _two(spark, sf_dir)
    out = pj.pca_transform(rows, model).select("l_orderkey", "l_linenumber", *[
        F.get("components", F.lit(i)).alias(f"pc{i + 1}") for i in range(2)])
    return rounded(out, 6, "pc1", "pc2")


def pca_two_inverse(spark, sf_dir):
    """Back from one component: what the projection keeps of two features."""
    rows = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", *TWO)
    model = pj.pca_fit(rows, TWO, k=1)
    return rounded(pj.pca_inverse(pj.pca_transform(rows, model), model).drop("components"), 4, *TWO)


def project_pair_lines(spark, sf_dir):
    """Axes of the finished lines; finished and open lines projected."""
    real, synth = statuses(_two(spark, sf_dir)[0])
    out = fi.project_pair(real, synth, TWO, 2, ["l_orderkey", "l_linenumber"])
    return rounded(out, 6, "pc1", "pc2")


def projection_overlap_lines(spark, sf_dir):
    real, synth = statuses(_two(spark, sf_dir)[0])
    return rounded(fi.grid_overlap(fi.project_pair(real, synth, TWO, 2), 0.37), 9, "overlap")


def _packed(spark, sf_dir):
    return sq.pack_sequences(visits(spark, sf_dir), "user_id", ["ts", "event_id"], ["value", "k"],
                             label="label", pad=True)


def _parts(spark, sf_dir):
    return sq.pack_parts(visits(spark, sf_dir), "user_id", ["ts", "event_id"], ["value", "k"], sq.PART_LEN, "label")


def pack_events(spark, sf_dir):
    """Padded sequences laid out by position, padding included."""
    flat = _packed(spark, sf_dir).select("user_id", "label", "len", F.posexplode(
        F.arrays_zip("seq", "mask")).alias("pos", "v"))
    return flat.select("user_id", "label", "len", "pos", F.col("v.mask").alias("mask"),
                       F.get("v.seq", F.lit(0)).alias("value"), F.get("v.seq", F.lit(1)).alias("k"))


def unpack_events(spark, sf_dir):
    return sq.unpack_sequences(_packed(spark, sf_dir), ["value", "k"], ["user_id", "label"])


def split_rows_70_30(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", "label")
    return sp.split_rows(rows, "vec_id", "label", 0.7, SEED).select("vec_id", "label", "side")


def split_rows_hash(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag")
    return (sp.split_rows(rows, ["l_orderkey", "l_linenumber"], "l_returnflag", 0.7, SEED, exact=False)
            .groupBy("l_returnflag", "side").agg(F.count("*").alias("n")))


def split_entities_70_30(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id")
    return sp.split_entities(rows, "user_id", 0.7, SEED)


def static_last_visit(spark, sf_dir):
    out = sq.static_features(_packed(spark, sf_dir))
    return out.select("user_id", "label", F.get("features", F.lit(0)).alias("value"),
                      F.get("features", F.lit(1)).alias("k"))


def sequence_features(spark, sf_dir):
    out = sq.sequence_features(_packed(spark, sf_dir))
    return (out.select("user_id", F.posexplode("features").alias("pos", "value"))
            .withColumn("value", F.round("value", 5)))


def order_features(spark, sf_dir):
    """Iterated sums of the visits of each user, merged over parts of 16 visits; times visits and
    steps, so that they are short decimals."""
    rows = visits(spark, sf_dir)
    out = sq.order_features(sq.pack_parts(rows, "user_id", ["ts", "event_id"], ["value", "k"], 16, "label"))
    sizes = rows.groupBy("user_id").agg((F.count("*") * F.greatest(F.count("*") - 1, F.lit(1))).alias("n"))
    return (out.join(sizes, "user_id").select("user_id", F.posexplode("features").alias("pos", "value"), "n")
            .select("user_id", "pos", F.round(F.col("value") * F.col("n"), 5).alias("value")))


def visit_differences(spark, sf_dir):
    out = sq.visit_differences(stepped(visits(spark, sf_dir)), "user_id", "step", ["value", "k"])
    return rounded(out.select("event_id", "step", "d_value", "d_k"), 6, "d_value", "d_k")


ORDERS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                       T.StructField("o_orderdate", T.DateType()), T.StructField("o_totalprice", T.DoubleType())])


def order_visits_of_customers(spark, sf_dir) -> DataFrame:
    """Customers as patients, orders by date as their visits: natural lengths, the lines of an order
    added up to its features, the market segment as class."""
    orders = table(spark, sf_dir, "orders", ORDERS)
    lines = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").cast("double").alias("n_lines"))
    who = table(spark, sf_dir, "customer", CUSTOMER)
    return (orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
            .select("o_custkey", "o_orderkey", "o_orderdate", "quantity", "n_lines", "o_totalprice", "c_mktsegment"))


ORDER_FEATURES = ["quantity", "n_lines", "o_totalprice"]


def orders_pack(spark, sf_dir):
    """All orders of all customers, packed in parts of eight and read back part by part."""
    parts = sq.pack_parts(order_visits_of_customers(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"], ORDER_FEATURES, 8, "c_mktsegment")
    rows = sq.unpack_sequences(parts, ORDER_FEATURES, ["o_custkey", "c_mktsegment"])
    return rows.select("o_custkey", "c_mktsegment", F.col("step").alias("visit"), *ORDER_FEATURES)


def orders_lags(spark, sf_dir):
    rows = pr.order_visits(order_visits_of_customers(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey")
    out = sq.visit_differences(rows, "o_custkey", "step", ORDER_FEATURES)
    return rounded(out.select("o_orderkey", "step", *[f"d_{f}" for f in ORDER_FEATURES]), 4, *[f"d_{f}" for f in ORDER_FEATURES])


def orders_draws(spark, sf_dir):
    """Class and length of two synthetic customers for each real one, fitted and drawn in parts."""
    seqs = settle(sq.pack_parts(order_visits_of_customers(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"], ORDER_FEATURES, 8, "c_mktsegment")
                  .withColumnRenamed("c_mktsegment", "label"))
    drawn = sy.synthesize(spark, sy.fit_sequence_model(seqs), 2 * sq.starts(seqs).count(), SEED, part_len=8)
    return drawn.groupBy("entity_id", "label").agg(F.sum(F.col("len") - F.col("context")).cast("int").alias("len"))


def split_null_class(spark, sf_dir):
    """One class of events is null and is split like the others."""
    rows = events(spark, sf_dir).select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return sp.split_rows(rows, "event_id", "kind", 0.7, SEED).groupBy("kind", "side").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def phase_fidelity(spark, sf_dir):
    """Both phases generated for the customers, as many as there are, against their orders."""
    rows = pr.encode_label(settle(order_visits_of_customers(spark, sf_dir)), "c_mktsegment")
    n = rows.select("o_custkey").distinct().count()
    return phase_report(rows, Config(features=ORDER_FEATURES, n=n, share=0.95, entity="o_custkey", order=["o_orderdate", "o_orderkey"]))


def csv_roundtrip(spark, sf_dir):
    """Events with empty strings and nulls through CSV files, times to the microsecond."""
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id", F.expr("CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN props END").alias("props"),
                                        "value", (F.col("user_id") % 4).cast("int").alias("label"))
    folder = f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}"
    write_phase(rows, folder, "phase1", "csv")
    back = read_phase(spark, folder, "phase1", rows.schema, "csv")
    return back.select("event_id", F.unix_micros("ts").alias("ts_us"), "user_id", "props", "value", "label")


FAULTY = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType()),
                       T.StructField("day", T.DateType())])


def _faulty(spark, sf_dir):
    """Events as CSV lines with planted faults by id, split into good and bad rows."""
    value = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("x"), F.col("value"))).otherwise(F.col("value").cast("string"))
    day = F.when(~(F.col("event_id") % 50).isin(1, 51), F.date_format("ts", "yyyy-MM-dd")).otherwise("")
    more = F.when(F.col("event_id") % 70 == 2, F.lit(",extra")).otherwise("")
    lines = events(spark, sf_dir).select(F.concat(F.concat_ws(",", F.col("event_id"), F.col("user_id"), value, day), more).alias("line"))
    folder = f"{shared_folder(spark)}/faulty-{uuid.uuid4().hex}"
    lines.write.text(f"{folder}/lines")
    return split_records(spark, f"{folder}/lines", FAULTY, f"{folder}/split", ["day"], header="false")


def csv_bad_rows(spark, sf_dir):
    """Faults of CSV rows by column and kind."""
    bad = _faulty(spark, sf_dir)[1]
    return (bad.select(F.explode("reasons").alias("r")).groupBy(F.col("r.column").alias("column"), F.col("r.kind").alias("kind"))
            .agg(F.count("*").alias("n")))


def csv_good_rows(spark, sf_dir):
    return rounded(_faulty(spark, sf_dir)[0], 6, "value").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def label_index_many(spark, sf_dir):
    """Every customer with an order is a class; a tenth of the orders has none."""
    rows = table(spark, sf_dir, "orders", ORDERS).select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("name"))
    return pr.encode_label(rows, "name").select("o_orderkey", "name", "label")


def plan_many(spark, sf_dir):
    """A plan over as many classes as customers have orders, ten rows for each class on average."""
    rows = table(spark, sf_dir, "orders", ORDERS)
    n = 10 * rows.select("o_custkey").distinct().count()
    return sy.class_plan(pr.class_profile(rows, "o_custkey"), n, "near_balanced", label="o_custkey")


def ks_phases(spark, sf_dir):
    """Odd users' events as two written phases against even users', per class and over all of them."""
    rows = events(spark, sf_dir).select("event_id", "user_id", F.col("event_type").alias("label"), "value")
    real, synth = halves(rows, "user_id")
    folder = f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}"
    for phase, part in (("phase1", synth.filter("event_id % 3 = 0")), ("phase2", synth.filter("event_id % 3 > 0"))):
        write_phase(part, folder, phase)
    phases = [read_phase(spark, folder, p, rows.schema).withColumn("phase", F.lit(p)) for p in ("phase1", "phase2")]
    return rounded(fi.phase_ks_report(real, phases[0].unionByName(phases[1]), ["value"]), 9, "d", "p_value")


# Synthesis

def _plan(spark, sf_dir, mode):
    profile = pr.class_profile(table(spark, sf_dir, "labels", LABELS), "quality")
    return sy.class_plan(profile, POPULATION, mode, label="quality")


def plan_proportional(spark, sf_dir):
    return _plan(spark, sf_dir, "proportional")


def plan_near_balanced(spark, sf_dir):
    return _plan(spark, sf_dir, "near_balanced")


def var1_moments(spark, sf_dir):
    parts = sq.pack_parts(visits(spark, sf_dir), "user_id", ["ts", "event_id"], ["value", "k"], 16, "label")
    pairs = sy.lag_pairs(parts, "label")
    sums = mo.grouped_moments(pairs, "pair", "label")
    flat = sums.select("label", "n", "mean", F.posexplode("m2").alias("pos", "m2"))
    i, j = F.floor(F.col("pos") / 4).cast("int"), F.col("pos") % 4
    return flat.select("label", "n", i.alias("i"), j.alias("j"), F.round(F.get("mean", i), 6).alias("mean_i"),
                       F.round(F.col("m2") / (F.col("n") - 1), 5).alias("cov"))


def var1_fit(spark, sf_dir):
    """Transition, intercept and noise of one feature, a model for each class."""
    parts = sq.pack_parts(visits(spark, sf_dir), "user_id", ["ts", "event_id"], ["value"], 16, "label")
    out = sy.dynamics_table(sy.fit_sequence_model(parts, pooled=False), spark)
    return rounded(out, 6, "transition", "intercept", "noise_cov")


def var1_fit_gappy(spark, sf_dir):
    """The same with a fifth of one feature missing, by expectation and maximisation."""
    rows = visits(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    parts = settle(sq.pack_parts(rows, "user_id", ["ts", "event_id"], ["value", "k"], 16, "label"))
    out = sy.dynamics_table(sy.fit_sequence_model(parts, pooled=False, rounds=20), spark)
    return rounded(out, 6, "transition", "intercept", "noise_cov")


def _population(spark, sf_dir, mode="near_balanced"):
    """Ten synthetic sequences per user in parts, so the work follows the table."""
    seqs = settle(_parts(spark, sf_dir))
    model = sy.fit_sequence_model(seqs)
    profile = pr.class_profile(sq.starts(seqs), "label")
    n = 10 * sq.starts(seqs).count()
    population = sy.populate(spark, model, sy.class_plan(profile, n, mode), SEED, sq.PART_LEN)
    if population.shortfall:
        raise ValueError(f"missing {population.shortfall}")
    return population.rows


def synth_counts(spark, sf_dir):
    rows = sq.starts(_population(spark, sf_dir))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("ids"))


def synth_sequences(spark, sf_dir):
    """Sequences drawn in component space and decoded to real units."""
    rows = visits(spark, sf_dir)
    model = pj.pca_fit(rows, ["value", "k"], k=2)
    seqs = settle(sq.pack_parts(pj.pca_transform(rows, model), "user_id", ["ts", "event_id"],
                                "components", sq.PART_LEN, "label"))
    synth = sy.synthesize(spark, sy.fit_sequence_model(seqs), sq.starts(seqs).count(), SEED, part_len=sq.PART_LEN)
    return sy.decode(synth, pr.fit_scale(rows, ["value", "k"]), model)


def synth_draws(spark, sf_dir):
    """Class and length drawn for each synthetic id, two ids per user; both follow the real
    shares and depend on the id alone."""
    seqs = settle(_packed(spark, sf_dir))
    synth = sy.synthesize(spark, sy.fit_sequence_model(seqs), 2 * seqs.count(), SEED)
    real = F.size(F.filter("seq", lambda v: F.get(v, F.lit(0)) != 0.0))
    return synth.select("entity_id", "label", "len", (real <= F.col("len")).alias("padded"))


def synth_range_check(spark, sf_dir):
    """Every decoded value lies inside the real range and none is null."""
    real = visits(spark, sf_dir).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    outside = (F.col("value") < real.select("lo").scalar()) | (F.col("value") > real.select("hi").scalar())
    return synth_sequences(spark, sf_dir).agg(
        F.count_if(F.col("value").isNull() | F.col("k").isNull()).alias("nulls"),
        F.count_if(outside).alias("outside"))


def decode_clip(spark, sf_dir):
    """Scaled visits, moved away from the mean, decoded to real units inside the real range."""
    rows = visits(spark, sf_dir)
    limits = pr.fit_scale(rows, ["value", "k"])
    wide = limits.transform(rows).withColumns({f: F.col(f) * 1.37 for f in ("value", "k")})
    parts = sq.pack_parts(wide, "user_id", ["ts", "event_id"], ["value", "k"], 16, "label")
    return rounded(sy.decode(parts, limits, keep=["user_id", "label"]), 3, "value", "k")


def _rejection(spark, sf_dir):
    cands = events(spark, sf_dir).select("event_id", "event_type")
    profile = pr.class_profile(events(spark, sf_dir), "event_type")
    plan = profile.select("event_type", F.when(F.col("event_type") == "error", F.col("n") + 100)
                          .when(F.col("event_type") == "view", F.lit(0))
                          .otherwise(F.floor(F.col("n") * F.lit(0.3))).alias("target"))
    return cands, plan, sy.rejection_sample(cands, plan, SEED, "event_id", "event_type")


def reject_to_plan(spark, sf_dir):
    return _rejection(spark, sf_dir)[2]


def reject_report(spark, sf_dir):
    cands, plan, accepted = _rejection(spark, sf_dir)
    return sy.rejection_report(cands, accepted, plan, "event_type")


# Fidelity

def ks_lineitem_status(spark, sf_dir):
    a, b = statuses(lineitem(spark, sf_dir))
    out = fi.ks_report(a, b, NUMERICS)
    return rounded(out, 9, "d", "p_value", "share_passed")


def ks_events_by_type(spark, sf_dir):
    a, b = halves(events(spark, sf_dir), "user_id")
    out = fi.ks_report(a, b, ["value"], ["event_type"])
    return rounded(out, 9, "d", "p_value", "share_passed")


def ks_synthetic(spark, sf_dir):
    """Real visits against decoded synthetic ones, per class."""
    return fi.ks_report(visits(spark, sf_dir), synth_sequences(spark, sf_dir), ["value", "k"], ["label"])


def project_pair(spark, sf_dir):
    real, synth = halves(embeddings(spark, sf_dir), "vec_id")
    return fi.project_pair(real, synth, "embedding", 2, ["vec_id"])


def projection_overlap(spark, sf_dir):
    """Overlap score of the projected pair, in cells of half a deviation."""
    return fi.grid_overlap(project_pair(spark, sf_dir), 0.5)


def grid_overlap(spark, sf_dir):
    a, b = halves(visits(spark, sf_dir), "user_id")
    out = fi.grid_overlap(fi.pair(a, b, ["value", "k"]), 10.0, "value", "k")
    return rounded(out, 9, "overlap")


def neighbour_mix(spark, sf_dir):
    real, synth = halves(embeddings(spark, sf_dir), "vec_id")
    return rounded(nb.neighbour_mix(real, synth, "embedding", 5), 6, "same_share", "expected_share")


def neighbour_mix_events(spark, sf_dir):
    """Two coordinates per event with many exact copies."""
    real, synth = halves(visits(spark, sf_dir), "user_id")
    return rounded(nb.neighbour_mix(real, synth, ["value", "k"], 5), 6, "same_share", "expected_share")


def neighbour_mix_hashed(spark, sf_dir):
    """The hashed search on the three features of orders, even customers against odd ones."""
    rows = order_visits_of_customers(spark, sf_dir)
    scaled = pr.scale(rows, ORDER_FEATURES)
    real, synth = halves(scaled, "o_custkey")
    return rounded(nb.neighbour_mix(real, synth, ORDER_FEATURES, 5, tables=8), 6, "same_share", "expected_share")


def lag_fidelity(spark, sf_dir):
    rows = stepped(visits(spark, sf_dir))
    real, synth = halves(rows, "user_id")
    out = fi.lag_fidelity(real, synth, "user_id", "step", ["value", "k"], "label", 3)
    return rounded(out, 6, "r_real", "r_synth", "gap")


def moment_gap(spark, sf_dir):
    a, b = statuses(lineitem(spark, sf_dir))
    out = fi.moment_gap(a, b, NUMERICS, ["l_returnflag"])
    return rounded(out, 6, "mean_real", "mean_synth", "sd_real", "sd_synth", "mean_gap", "sd_gap")


def quality_checks(spark, sf_dir):
    rows = pr.select_numeric(
        _gappy(spark, sf_dir).withColumn("k", F.regexp_extract("props", r"(\d+)", 1)),
        ["value", "k"], ["user_id"])
    real, synth = halves(rows, "user_id")
    return rounded(fi.quality_checks(real, synth, ["value", "k"]), 9, "value")


# Evaluation

def _vectors(spark, sf_dir, width=64):
    rows = embeddings(spark, sf_dir).select("vec_id", "label",
                                            F.slice("embedding", 1, width).alias("features"))
    return sp.split_rows(rows, "vec_id", "label", 0.7, SEED)


def mlp_trtr(spark, sf_dir):
    pred = ev.trtr(ev.mlp(layers=(16,)), _vectors(spark, sf_dir))
    return ev.confusion(pred)


def softmax_trtr(spark, sf_dir):
    """Predictions of softmax regression after eight rounds, row by row."""
    pred = ev.trtr(ev.softmax(rounds=8, classes=10), _vectors(spark, sf_dir, 8))
    return pred.select("vec_id", "label", "prediction")


def softmax_weights(spark, sf_dir):
    """Its weights on the raw features; input -1 is the bias."""
    train = _vectors(spark, sf_dir, 8).filter("side = 'train'")
    weights = ev.weights_table(ev.softmax(rounds=8, classes=10).fit(train), spark)
    return rounded(weights.select("unit", "input", "weight"), 6, "weight")


def seq_mlp_tstr(spark, sf_dir):
    seqs = _parts(spark, sf_dir)
    test = sp.split_entities(seqs, "user_id").filter("side = 'test'").drop("side")
    synth = _population(spark, sf_dir)
    pred = ev.tstr(ev.sequence_mlp(layers=(8,), classes=3), sq.order_features(synth), sq.order_features(test))
    return ev.confusion(pred)


def _centroid(spark, sf_dir, width=64):
    return ev.confusion(ev.trtr(ev.centroid(), _vectors(spark, sf_dir, width)))


def centroid_confusion(spark, sf_dir):
    return _centroid(spark, sf_dir)


def centroid_metrics(spark, sf_dir):
    return rounded(ev.class_metrics(_centroid(spark, sf_dir)), 9, "value")


def centroid_tstr(spark, sf_dir):
    """Means of the odd (stand-in synthetic) vectors, tested on the even ones."""
    rows = embeddings(spark, sf_dir).select("vec_id", "label", F.col("embedding").alias("features"))
    real, synth = halves(rows, "vec_id")
    return ev.confusion(ev.tstr(ev.centroid(), synth, real))


def compare_models(spark, sf_dir):
    scores = [ev.class_metrics(_centroid(spark, sf_dir, w)).filter("label IS NULL")
              .withColumn("model", F.lit(f"dims{w}")) for w in (8, 64)]
    out = ev.compare(scores[0].unionByName(scores[1]), "dims8", "dims64")
    return rounded(out, 9, "base_value", "other_value", "points", "relative")


def experiment_m1_m4(spark, sf_dir):
    rows = visits(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double"))
    users = rows.agg(F.countDistinct("user_id")).first()[0]
    cfg = Config(features=["value", "k", "hour"], n=4 * users, k=3, entity="user_id",
                 order=["ts", "event_id"], hidden=(8,))
    return run_experiment(rows, cfg)


def _raw_visits(spark, sf_dir):
    """Events as raw records: the date and a number as text, nulls, and the class by name."""
    name = F.element_at(F.array(*map(F.lit, ("common", "seldom", "rare"))), user_class() + 1)
    return _gappy(spark, sf_dir).select(
        "user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("day"), name.alias("kind"), "value",
        F.regexp_extract("props", r"(\d+)", 1).alias("k"))


def _staged(spark, sf_dir, models, estimator, **more):
    cfg = Config(features=["value", "k"], k=2, entity="user_id", part_len=16, **more)
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    how = Raw("day", "event_id", "kind", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return staged_experiment(_raw_visits(spark, sf_dir), cfg, how, folder, models, estimator)[0]


def staged_m1(spark, sf_dir):
    """Raw records to scores of a classifier that SQL can check, in written steps."""
    return rounded(_staged(spark, sf_dir, ("M1",), "centroid", n=0), 9, "value")


def staged_m1_m4(spark, sf_dir):
    users = events(spark, sf_dir).agg(F.countDistinct("user_id")).first()[0]
    return _staged(spark, sf_dir, ("M1", "M2", "M3", "M4"), "softmax", n=2 * users, max_iter=30)


def staged_gain(spark, sf_dir):
    """M4 over M3 on both phases' worth of users, in points and relative."""
    users = events(spark, sf_dir).agg(F.countDistinct("user_id")).first()[0]
    return sequence_gain(_staged(spark, sf_dir, ("M3", "M4"), "softmax", n=2 * users, max_iter=30))


QUERIES = {f.__name__: f for f in (
    records_read, phase_roundtrip, numeric_select, numeric_failures, visit_order, locf_impute,
    mean_impute, median_impute, label_index, class_profile_events, class_profile_labels, zscore, minmax,
    unscale_roundtrip, covariance_pairs, covariance_by_status, pca_39, pca_variance,
    pca_roundtrip_error, pca_total_variance, pca_row_norms, pca_two_axes, pca_two_scores,
    pca_two_inverse, project_pair_lines, projection_overlap_lines, pack_events, unpack_events, split_rows_70_30,
    split_rows_hash, split_entities_70_30, static_last_visit, sequence_features,
    order_features, visit_differences, plan_proportional, plan_near_balanced, var1_moments, var1_fit, var1_fit_gappy, synth_counts,
    synth_sequences, synth_draws, synth_range_check, decode_clip, reject_to_plan, reject_report, ks_lineitem_status,
    ks_events_by_type, ks_synthetic, project_pair, projection_overlap, grid_overlap,
    neighbour_mix, neighbour_mix_events, neighbour_mix_hashed, lag_fidelity, moment_gap, quality_checks, mlp_trtr,
    softmax_trtr, softmax_weights, seq_mlp_tstr, centroid_confusion, centroid_metrics, centroid_tstr, compare_models,
    experiment_m1_m4, orders_pack, orders_lags, orders_draws, split_null_class, csv_roundtrip, phase_fidelity, csv_bad_rows, csv_good_rows, label_index_many,
    plan_many, ks_phases, staged_m1, staged_m1_m4, staged_gain)}
