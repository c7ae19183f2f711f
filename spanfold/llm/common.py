"""Helpers shared by the training-data operators: tokens, held-out folds, written tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanfold.session import scratch_path

#: Characters that end a word, as a regular-expression class: ``[\x20\x09-\x0D]``. ``bytes.split()``
#: with no argument splits on exactly these, and ``bytes.lower()`` changes exactly A-Z.
BLANK = r"[\x20\x09-\x0D]"
BLANK_RUN = re.compile(BLANK + "+")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one Parquet table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def key_hash(*cols) -> Column:
    """60 bits of MD5 over the columns as text: the same in every engine, run and partitioning."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, BLANK + "+"))).cast("long")


def ordinal(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with ``out`` = 0-based position by ``order``, without a one-task window: range
    partitions are numbered by the sizes of those before them (one row per partition)."""
    ranged = written(df.repartitionByRange(F.col(order)).withColumn("_pid", F.spark_partition_id()), "ordinal")
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_pid").orderBy(order)
    return (
        ranged.join(F.broadcast(starts), "_pid")
        .withColumn(out, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_pid", "_start")
    )
