"""Readers for the driver's parquet tables.

Every reader selects only the columns it needs so Catalyst prunes the parquet
scan (``ReadSchema`` in ``explain``) and pushes filters down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``docs(doc_id, text[, extra...])``; NULL text is read as empty text.

    The scan's own splits are the partitions. A deployment whose input is one unsplittable file may
    set ``spanfold.input.partitions`` in its session to deal the rows over that many tasks."""
    df = table(spark, sf_dir, "documents", "doc_id", "text", *extra)
    dealt = spark.conf.get("spanfold.input.partitions", None)
    if dealt:
        df = df.repartition(int(dealt), "doc_id")
    return df.withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "events", *(cols or ("event_id", "ts", "user_id", "event_type", "value")))
