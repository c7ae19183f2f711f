"""Operator 10, exact dedup: a stateful stream keyed by content digest.

The documents' (digest, stable id, code points, content locator) rows go through a Structured
Streaming aggregation whose keyed state lives in RocksDB (on disk, checkpointed to the shared
folder) and never expires: no watermark, no timeout. Per digest the state retains the best copy
seen so far (code points, id and the locator of its content: the file it was read from) and the number
of copies. ``availableNow`` runs it to the end of the input; the state
is then read with Spark's state data source. A digest with more than one row is a hit: the rows'
whole normalised bytes, fetched by locator and id, are compared, and rows that share a digest but not their bytes are grouped
by the bytes instead. Built-in functions only.

Defined results: null text counts as empty; texts of white space only equal the empty text; ties on
code points go to the smallest id, null ids last; rows that repeat an id and its text count in
``group_size`` and exactly one of them is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfold.llm.common import BLANK, written
from spanfold.session import scratch_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # executors give up a finished stream's stores at the next round of maintenance, by default after a minute
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    # many small stores: no 4 MB set aside on disk for each one's manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def stream_state(facts: DataFrame, path: str) -> DataFrame:
    """Run the keyed stream over the written ``facts`` and return its final state:
    ``_key, _top(n_chars, neg_id, at), _rows``."""
    spark = facts.sparkSession
    ckpt = scratch_path(spark, "exact_dedup_state")
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(facts.schema).parquet(path)
        best = F.max(F.struct("_chars", "_neg_id", "_at")).alias("top")
        state = stream.groupBy("_key").agg(best, F.count("*").alias("rows"))
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
        back = spark.read.format("statestore").load(ckpt)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    top, rows = (F.col("value").getField(n) for n in back.schema["value"].dataType.names)
    return back.select(F.col("key").getField("_key").alias("_key"), top.alias("_top"), rows.alias("_rows"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` for every row of ``docs``; see the module's text.

    ``digest`` maps the normalised text to the state's key. Results don't depend on it: rows with
    one digest and different bytes are told apart by the byte check."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    norm = normalised(F.col("_text"))
    path = scratch_path(spark, "exact_dedup_facts")
    docs.select(
        "_id",
        digest(norm).alias("_key"),
        F.length(F.coalesce("_text", F.lit(""))).cast("long").alias("_chars"),
        F.bitwise_not("_id").alias("_neg_id"),
        F.input_file_name().alias("_at"),
    ).write.parquet(path)
    facts = spark.read.parquet(path)
    if facts.isEmpty():
        groups = facts.select("_key", F.struct("_chars", "_neg_id", "_at").alias("_top"), F.lit(0).cast("long").alias("_rows")).limit(0)
    else:
        groups = written(stream_state(facts, path), "exact_dedup_groups")
    found = facts.select("_id", "_key", "_at").join(groups, "_key")

    # full bytes on hits: fetch the texts of rows whose digest came more than once
    hits = found.where("_rows > 1").select(F.col("_id").alias("_hit"), F.col("_at").alias("_in"), "_key").distinct()
    placed = docs.withColumn("_at", F.input_file_name())
    bytes_of = placed.join(hits.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_hit")) & (F.col("_at") == F.col("_in"))).select("_key", normalised(F.col("_text")).alias("_norm"))
    texts = bytes_of.groupBy("_key", "_norm").agg(F.count("*").alias("_n")).groupBy("_key").agg(F.count("*").alias("_texts"))
    clash = written(texts.where("_texts > 1").select("_key"), "exact_dedup_clash")
    if not clash.isEmpty():
        found = found.join(clash, "_key", "left_anti").unionByName(_by_bytes(docs, clash, digest))

    one = Window.partitionBy("_id", "_key").orderBy("_at")
    return found.select(
        F.col("_id").alias(id_col),
        F.bitwise_not("_top._neg_id").alias("keep_id"),
        F.col("_rows").alias("group_size"),
        (F.col("_id").eqNullSafe(F.bitwise_not("_top._neg_id")) & (F.row_number().over(one) == 1)).alias("kept"),
        F.col("_key").alias("digest"),
    )


def _by_bytes(docs: DataFrame, clash: DataFrame, digest) -> DataFrame:
    """Rows of colliding digests, grouped by their whole bytes."""
    norm = normalised(F.col("_text"))
    rows = docs.select("_id", norm.alias("_norm"), digest(norm).alias("_key"), F.length(F.coalesce("_text", F.lit(""))).cast("long").alias("_chars"), F.input_file_name().alias("_at"))
    rows = rows.join(clash, "_key")
    groups = rows.groupBy("_key", "_norm").agg(F.max(F.struct("_chars", F.bitwise_not("_id").alias("_neg_id"), "_at")).alias("_top"), F.count("*").alias("_rows"))
    return rows.join(groups, ["_key", "_norm"]).select("_key", "_id", "_at", "_top", "_rows")
