"""Structured Streaming: clean span annotations as documents arrive.

The reference is batch-only; what carries over to streams are the stateless per-row
operators. A record holds a document's text and its span literal together, so
parsing, run extraction and cleaning are row-local (no join, no state). Merging a
document's cleaned runs needs a window, which streams do not offer on non-time keys;
``foreachBatch`` applies it per micro-batch, which is exact because a document's
runs all come from its one record. Each batch is written under its own batch id, so
a retried batch overwrites its own output (exactly-once with the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.operators.cleaning import clean_ranges
from spanfold.operators.spans import normalize_spans, offsets_to_ranges, parse_spans
from spanfold.sources.span_files import SPAN_CSV_SCHEMA


def cleaned_runs(records: DataFrame, mode: str = "expand", min_len: int = 3) -> DataFrame:
    """``(doc_id, spans literal, text)`` -> cleaned runs ``(doc_id, start, end)``; works on
    batch and streaming DataFrames alike (only row-local expressions)."""
    parsed = records.select("doc_id", parse_spans(F.col("spans")).alias("offsets"), F.coalesce("text", F.lit("")).alias("text"))
    runs = offsets_to_ranges(parsed, "offsets", keep=("text",))
    return clean_ranges(runs, None, mode=mode, min_len=min_len).select("doc_id", "start", "end")


def start_clean_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str, mode: str = "expand",
                       fmt: str = "csv", trigger_once: bool = False):
    """Watch ``source_dir`` for span CSV files, write merged cleaned runs under ``out_dir``.

    ``checkpoint_dir`` must be on shared storage; the returned query is running.
    """
    reader = spark.readStream.schema(SPAN_CSV_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    stream = reader.format(fmt).load(source_dir)
    runs = cleaned_runs(stream, mode)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        merged = normalize_spans(batch, ["doc_id"])
        merged.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    w = runs.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
