"""Token decisions -> character spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfold.functions.text import sigmoid
from spanfold.operators.spans import normalize_spans


def token_argmax(logit0: Column, logit1: Column) -> Column:
    """Class 1 only when its logit is strictly larger (ties go to the lower class)."""
    return F.when(logit1 > logit0, 1).otherwise(0)


def decode_tokens(tokens: DataFrame, pred: str = "pred", keys=("doc_id",)) -> DataFrame:
    """Ranges of tokens predicted 1, merged (no gap filling)."""
    keys = list(keys)
    return normalize_spans(tokens.where(F.col(pred) == 1).select(*keys, "start", "end"), keys)


def decode_masked(tokens: DataFrame, mask: Column, pred: str = "pred", keys=("doc_id",)) -> DataFrame:
    """``decode_tokens`` up to each document's first masked token (``mask`` true), which ends its
    sequence. One small aggregate finds the first masked index; documents without one are read whole."""
    keys = list(keys)
    stop = tokens.where(mask).groupBy(*keys).agg(F.min("tok_idx").alias("_stop"))
    hit = tokens.where((F.col(pred) == 1) & ~mask).join(stop, keys, "left")
    return decode_tokens(hit.where(F.col("_stop").isNull() | (F.col("tok_idx") < F.col("_stop"))), pred, keys)


def decode_gap_fill(tokens: DataFrame, pred: str = "pred", keys=("doc_id",)) -> DataFrame:
    """A toxic token adds its range; when the previous token (``tok_idx`` less one) is toxic too, the gap
    between them (whitespace, punctuation) is added as well. Only the toxic tokens are shuffled."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("tok_idx")
    t = tokens.where(F.col(pred) == 1).select(*keys, "tok_idx", "start", "end")
    t = t.withColumn("_pi", F.lag("tok_idx").over(w)).withColumn("_pe", F.lag("end").over(w))
    start = F.when(F.col("_pi") == F.col("tok_idx") - 1, F.least(F.col("_pe"), F.col("start"))).otherwise(F.col("start"))
    return normalize_spans(t.select(*keys, start.alias("start"), F.col("end")), keys)


def pad_tag_decisions(tokens: DataFrame, score: Column, threshold: float = 0.2, maxlen: int = 128,
                      toxic_label: int = 2, not_toxic_label: int = 1) -> DataFrame:
    """Per-token decision ``toxic_label if score > threshold else not_toxic_label`` for the
    first ``maxlen`` tokens (sequences are cut at the end, for both padding sides)."""
    d = F.when(score > F.lit(threshold), toxic_label).otherwise(not_toxic_label)
    return tokens.where(F.col("tok_idx") < maxlen).withColumn("decision", d)


def toxic_token_index(tokens: DataFrame, pred: str = "pred", keys=("doc_id",)) -> DataFrame:
    """Distinct sorted indices of toxic tokens per document."""
    keys = list(keys)
    return tokens.where(F.col(pred) == 1).groupBy(*keys).agg(F.sort_array(F.collect_set("tok_idx")).alias("toxic_idx"))


def score_sigmoid_filter(candidates: DataFrame, threshold: float, score: str = "score", score_is_probability: bool = False,
                         keys=("doc_id",)) -> DataFrame:
    """Keep candidates with sigmoid(score) > threshold (the raw score when it already is a
    probability), drop NULL-start (null/fake) answers, merge their character ranges."""
    keys = list(keys)
    p = F.col(score) if score_is_probability else sigmoid(F.col(score))
    c = candidates.where(F.col("start").isNotNull() & (p > F.lit(threshold)))
    return normalize_spans(c.select(*keys, "start", "end"), keys)
