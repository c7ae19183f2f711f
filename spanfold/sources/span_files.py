"""Span files: annotated-post CSV, prediction TSV (``id<TAB>[o1, o2, ...]``), split loading,
cleaned-output writing and the stored tuning threshold.

Writers target paths in the shared folder (``session.scratch_path``); readers use
explicit schemas (never inference).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanfold.operators.spans import format_offsets, parse_spans
from spanfold.sources.csv_records import csv_records

SPAN_CSV_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("spans", T.StringType()), T.StructField("text", T.StringType())]
)


def write_span_csv(df: DataFrame, path: str) -> None:
    """``(doc_id, spans array<int>, text)`` -> header CSV with quoted multi-line text."""
    out = df.select("doc_id", format_offsets(F.col("spans")).alias("spans"), "text")
    out.write.mode("error").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_span_csv(spark: SparkSession, path: str, gold: bool = True) -> DataFrame:
    """Header CSV ``doc_id,spans,text`` (text may hold quotes and newlines), read by many tasks a file.

    ``spans`` is parsed to ``array<int>``; unparsable literals become ``[]``. For a
    gold-less split (``gold=False``) spans are ``[]`` regardless of the column.
    """
    records = csv_records(spark, path)
    row = F.from_csv("record", SPAN_CSV_SCHEMA.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    df = records.select(row.alias("r")).select("r.*")
    spans = parse_spans(F.col("spans")) if gold else F.array().cast("array<int>")
    return df.select("doc_id", spans.alias("spans"), F.coalesce("text", F.lit("")).alias("text"))


def write_predictions(df: DataFrame, path: str) -> None:
    """``(doc_id, offsets array<int>)`` -> text lines ``id\\t[sorted offsets]``."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), format_offsets(F.sort_array(F.col("offsets"))))
    df.select(line.alias("value")).write.mode("error").text(path)


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Strict ``id<TAB>list`` lines -> ``(predictions(doc_id, offsets), quarantine(line, reason))``.

    A line with a field count other than 2 or a non-integer id goes to quarantine (the
    reference raises); an unparsable offsets literal becomes ``[]`` as in the reference.
    """
    raw = spark.read.text(path)
    parts = F.split(F.col("value"), "\t")
    r = raw.select("value", parts.alias("p"))
    ok_shape = F.size("p") == 2
    id_ = F.expr("try_cast(p[0] AS BIGINT)")
    r = r.withColumn("doc_id", F.when(ok_shape, id_))
    good = r.where(F.col("doc_id").isNotNull()).select("doc_id", parse_spans(F.col("p")[1]).alias("offsets"))
    bad = r.where(F.col("doc_id").isNull()).select(
        F.col("value").alias("line"), F.when(~ok_shape, "field_count").otherwise("bad_id").alias("reason")
    )
    return good, bad


def write_splits(df: DataFrame, path: str, split: str) -> None:
    """All splits in one pass, one folder per value of ``split`` (a null value has a folder too)."""
    df.withColumnRenamed(split, "split").write.mode("error").partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read the splits under ``path`` together, with a ``split`` column (``schema``: the other columns)."""
    whole = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
    return spark.read.schema(whole).parquet(path)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cleaned spans + text per split, partitioned by ``split`` (CSV optional)."""
    w = df.write.mode("error").partitionBy("split")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    else:
        w.parquet(path)


def saved_threshold(spark: SparkSession, path: str, tune: Callable[[], DataFrame]) -> DataFrame:
    """Use the stored ``(threshold, f1)`` if ``path`` holds one, else tune, store, and read back.

    ``tune()`` returns the sweep table ``(threshold, mean_f1, is_best)``; the stored table
    has one row. Reading it back means every consumer uses exactly the stored value.
    """
    try:
        return spark.read.parquet(path).select("threshold", "f1")
    except AnalysisException as missing:  # a first run; anything else, such as a damaged file, is an error
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        best = tune().where(F.col("is_best") == 1).select("threshold", F.col("mean_f1").alias("f1"))
        best.coalesce(1).write.mode("error").parquet(path)
        return spark.read.parquet(path).select("threshold", "f1")
