"""A training-data pipeline over ``documents``: each stage calls one operator of ``spanfold.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as
Parquet before the next one reads it. All but the last return the columns of ``documents``.

Ids may be null or repeated: the two dedup stages number their rows and decide by row, so of several
texts under one id (or without one) each is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.llm import exact_dedup, langid, mixing, near_dedup, packing, queries
from spanfold.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``_row``, a number for each row, written once so that every later reading and retry sees the same."""
    return written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), name)


def _first_of_each(keyed: DataFrame, groups: DataFrame, *order) -> DataFrame:
    """The rows of ``keyed`` that come first in their group (``groups``: _row, _group) by ``order``, then by id (null
    ids last); one row a group."""
    by = F.struct(*order, F.col("doc_id").isNull().alias("_none"), "doc_id", "_row")
    narrow = keyed.select("_row", by.alias("_by")).join(groups, "_row")
    first = narrow.groupBy("_group").agg(F.min("_by").alias("_by")).select(F.col("_by._row").alias("_row"))
    return keyed.join(first.hint("shuffle_hash"), "_row", "left_semi").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null text, no letter) go."""
    docs = docs.select(*COLUMNS)
    return langid.keep_identified(docs, langid.train(docs, langid.training_rows()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest one stays, of these the one with the smallest id."""
    keyed = _keyed(docs, "pipeline_exact_rows")
    groups = exact_dedup.exact_dedup(keyed, "_row").select("_row", F.col("keep_id").alias("_group"))
    return _first_of_each(keyed, groups, (-F.length(F.coalesce("text", F.lit("")))).alias("_longest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    keyed = _keyed(docs, "pipeline_near_rows")
    groups = near_dedup.near_dedup(keyed, "_row").select("_row", F.col("component_id").alias("_group"))
    return _first_of_each(keyed, groups)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; the id and the text's digest tell rows apart."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.sha2(F.coalesce("text", F.lit("")), 256))
    return mixing.mix(docs.select(*COLUMNS).withColumn("_row", key), "_row").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the mixed documents, packed into sequences."""
    return packing.pack(packing.cut_pieces(docs, *queries.tokenizer(), queries.END_ID, queries.CAPACITY), queries.CAPACITY)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]

#: Cross-parsing, MinHash tables and the token ids have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
