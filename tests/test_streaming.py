"""The row-local cleaning path on a streaming source equals the batch job."""

import tempfile

from pyspark.sql import functions as F

from spanfold.operators import cleaning as C
from spanfold.operators import spans as S
from spanfold.plans import fixtures as X
from spanfold.sources import span_files as SF
from spanfold.streaming.clean_stream import start_clean_stream

from conftest import SF001


def test_stream_cleaning_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="spanfold-stream-", dir="/tmp")
    messy = X.messy_ranges(spark, SF001)
    offs = S.collect_offsets(messy.where(F.col("source") == "C"))
    recs = X.docs(spark, SF001).join(offs, "doc_id").select("doc_id", F.col("offsets").alias("spans"), "text")
    SF.write_span_csv(recs, f"{base}/in")
    q = start_clean_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", trigger_once=True)
    q.awaitTermination(120)
    got = {(r["doc_id"], r["start"], r["end"]) for r in spark.read.parquet(f"{base}/out").collect()}
    # batch: the same offsets, as runs in list order, cleaned and merged
    runs = S.offsets_to_ranges(offs)
    want = {(r["doc_id"], r["start"], r["end"]) for r in C.clean_spans(runs, X.docs(spark, SF001)).collect()}
    assert got == want and len(got) > 0
