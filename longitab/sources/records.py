"""Record tables under a fixed schema, and phase outputs between steps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD_ROW = "_corrupt_record"
#: Both ends of the CSV hand-over: microseconds stay, and a null differs from an empty string.
CSV = {"header": "true", "nullValue": "\\N", "escape": "\"", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
       "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def visit_schema(features: list[str]) -> T.StructType:
    """Schema of a visit table with the given feature columns."""
    fields = [T.StructField("entity_id", T.LongType()), T.StructField("step", T.IntegerType()),
              T.StructField("visit_ts", T.TimestampType()), T.StructField("label", T.IntegerType())]
    return T.StructType(fields + [T.StructField(f, T.DoubleType()) for f in features])


def read_records(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                 **options) -> DataFrame:
    """Load records under ``schema``; nothing is inferred.

    CSV rows that do not fit are kept, with nulls where a value failed and the raw line in
    ``_corrupt_record``. Parquet is read under the same schema; a timestamp without zone is
    taken in the session's zone.
    """
    if fmt == "csv":
        if BAD_ROW not in schema.names:
            schema = T.StructType(schema.fields + [T.StructField(BAD_ROW, T.StringType())])
        return (spark.read.schema(schema)
                .options(**{"header": "true", "mode": "PERMISSIVE",
                            "columnNameOfCorruptRecord": BAD_ROW, **options}).csv(path))
    if fmt != "parquet":
        raise ValueError(f"unknown format {fmt}")
    stored = spark.read.options(**options).parquet(path)
    return stored.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def split_records(spark: SparkSession, path: str, schema: T.StructType, folder: str, required: list[str] = (),
                  **options) -> tuple[DataFrame, DataFrame]:
    """CSV records and their faults, written in one pass: good rows under ``schema``, and bad ones as
    ``line, reasons``, the raw line and an array of ``column, kind``.

    Every field is read as text and cast here, so each fault is found, whichever columns are used
    later. Kinds: ``bad_value`` (text that is not of the column's type), ``missing`` (null in a column of
    ``required``) and ``field_count`` (column ``*``: more or fewer fields than the schema). A row is good
    or bad as a whole. ``folder`` must be reachable by all executors and is overwritten.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(BAD_ROW, T.StringType())])
    settings = {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW, **options}
    raw = spark.read.schema(text).options(**settings).csv(path)

    def typed(f: T.StructField):
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and "timestampFormat" in options:
            return F.try_to_timestamp(F.col(f"`{f.name}`"), F.lit(options["timestampFormat"])).cast(f.dataType)
        return F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")

    def reason(column: str, kind: str, fault):
        return F.when(fault, F.struct(F.lit(column).alias("column"), F.lit(kind).alias("kind")))

    found = [reason("*", "field_count", F.col(BAD_ROW).isNotNull())]
    found += [reason(f.name, "bad_value", F.col(f"`{f.name}`").isNotNull() & typed(f).isNull()) for f in schema.fields]
    found += [reason(c, "missing", F.col(f"`{c}`").isNull()) for c in required]
    reasons = F.filter(F.array(*found), lambda r: r.isNotNull())
    line = F.coalesce(F.col(BAD_ROW), F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])))
    told = raw.withColumn("_reasons", reasons).withColumn("_bad", F.size("_reasons") > 0)
    rows = told.select("_bad", F.when(F.col("_bad"), line).alias("_line"), F.when(F.col("_bad"), F.col("_reasons")).alias("_reasons"),
                       *[F.when(~F.col("_bad"), typed(f)).alias(f.name) for f in schema.fields])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bad").parquet(folder)
    stored = spark.read.schema(rows.schema).parquet(folder)
    good = stored.filter("NOT _bad").select(*[f"`{f.name}`" for f in schema.fields])
    return good, stored.filter("_bad").select(F.col("_line").alias("line"), F.col("_reasons").alias("reasons"))


def bad_rows(df: DataFrame) -> DataFrame:
    """Rows of ``read_records`` that did not fit the schema.

    The reader parses only the columns that a query needs, and finds only their faults. The second
    condition always holds and needs every column.
    """
    every = F.xxhash64(*[c for c in df.columns if c != BAD_ROW])
    return df.filter(F.col(BAD_ROW).isNotNull() & (F.coalesce(F.nullif(every, F.lit(0)), F.lit(0)) == every))


def write_phase(df: DataFrame, path: str, phase: str, fmt: str = "parquet",
                label: str = "label", mode: str = "overwrite") -> None:
    """Save one phase's rows under ``phase=.../label=...`` folders.

    Overwriting replaces this phase alone, with all its labels. The partition columns are not
    in the files and come back on read. ``rebalance`` gives evenly sized files and splits the
    rows of a frequent label over several.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt}")
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", phase):
        raise ValueError(f"phase {phase!r} cannot name a folder")
    out = df if label == "label" else df.withColumnRenamed(label, "label")
    writer = (out.hint("rebalance", "label").write.mode(mode)
              .option("partitionOverwriteMode", "static").partitionBy("label"))
    if fmt == "csv":
        writer = writer.options(**CSV, emptyValue='""')
    writer.format(fmt).save(f"{path}/phase={phase}")


def read_phase(spark: SparkSession, path: str, phase: str, schema: T.StructType,
               fmt: str = "parquet") -> DataFrame:
    """Read one phase back; only its folders are scanned. ``schema`` includes ``label``."""
    full = T.StructType(schema.fields + [T.StructField("phase", T.StringType())])
    reader = spark.read.schema(full)
    if fmt == "csv":
        reader = reader.options(**CSV, emptyValue="")
    return reader.format(fmt).load(path).filter(F.col("phase") == phase).drop("phase")
