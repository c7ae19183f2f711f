"""Operators take any document key: the conversations corpus is keyed by (conv_id, turn)."""

import re

from pyspark.sql import functions as F

from spanfold.operators import cleaning as C
from spanfold.operators import metrics as M
from spanfold.operators import tokens as T
from spanfold.sources import tables

from conftest import SF001

KEYS = ("conv_id", "turn")


def test_conversation_tokens_and_scores(spark):
    conv = tables.conversations(spark, SF001).withColumn("text", F.coalesce("text", F.lit("")))
    rows = conv.select(*KEYS, "text").collect()
    for method in ("rowlocal", "window"):
        toks = T.tokenize_offsets(conv, keys=KEYS, method=method)
        got = sorted((r["conv_id"], r["turn"], r["tok_idx"], r["start"], r["end"]) for r in toks.collect())
        want = sorted(
            (r["conv_id"], r["turn"], i, m.start(), m.end())
            for r in rows for i, m in enumerate(re.finditer(r"[^ \t\n\r\x0b\x0c]+", r["text"]))
        )
        assert got == want
    toks = T.tokenize_offsets(conv, keys=KEYS)
    # spans: every token of length >= 6 is "gold", its first 4 characters are the "prediction"
    gold = toks.where(F.length("tok") >= 6).select(*KEYS, "start", "end")
    pred = gold.select(*KEYS, "start", (F.col("start") + 4).alias("end")).withColumn("source", F.lit("p"))
    sc = M.doc_prf(conv.select(*KEYS), pred, gold, ["p"], keys=KEYS)
    assert sc.count() == conv.count()
    for r in sc.where("n_gold > 0").collect():
        assert r["n_inter"] == r["n_pred"] and r["precision"] == 1.0
    cleaned = C.clean_spans(pred.drop("source"), conv, keys=KEYS)
    assert cleaned.count() > 0
