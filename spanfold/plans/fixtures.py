"""Derived inputs built from the driver's tables (see FIXTURES.md §3).

The corpus ships no annotations, so gold spans are whole-token hits of the planted
lexicon and three rule-based "models" perturb them; token logits are arithmetic on
``(doc_id, tok_idx)``. Everything here is narrow except the tokenizer's one
shuffle on ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanfold.functions.text import LEXICON, MODEL_A_MISSES, core
from spanfold.operators.tokens import tokenize_offsets, with_ranges
from spanfold.sources import tables

MODELS = ("A", "B", "C")


def docs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return tables.documents(spark, sf_dir, *extra)


def tokens(spark: SparkSession, sf_dir: str, method: str = "rowlocal", ranges: DataFrame | None = None, context: bool = False,
           where: Column | None = None, of: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n_chars, tok_idx, tok, start, end, prev_end, next_end, core, hit)``.

    ``method``: see ``tokenize_offsets`` -- row-local (no shuffle) by default; ``"window"``
    for plans that run per-document windows over all tokens, so the one text shuffle
    leaves the tokens clustered by document; ``"gathered"``: row-local, after one shuffle that puts
    the texts of one id next to each other. Nothing is written: a plan that needs tokens in
    two branches derives them in each, which costs less than writing every token.

    ``ranges(doc_id, start, end)``: the texts are gathered with their ranges and ``opens``, ``closes`` and ``covered``
    are added (see ``tokenize_offsets``); with ``context`` also the neighbouring tokens ``prev_tok`` and ``next_tok``.
    ``context`` (also of gathered texts) adds ``n_texts``, the number of texts of the id. ``where`` keeps some ids only,
    ``of(doc_id, ...)`` those that it holds.
    """
    d = docs(spark, sf_dir).withColumn("n_chars", F.length("text"))
    if where is not None:
        d = d.where(where)
    if of is not None:
        d = d.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    if method == "gathered":
        d, method = d.repartition("doc_id"), "rowlocal"
        if context:
            d = d.withColumn("n_texts", F.count("*").over(Window.partitionBy("doc_id")))
        d = d.sortWithinPartitions("doc_id")
    if ranges is not None:
        d = with_ranges(d, ranges, texts="n_texts" if context else None)
    keep = ("n_chars", "n_texts") if context else ("n_chars",)
    t = tokenize_offsets(d, keep=keep, method=method, neighbours=True, ranges=None if ranges is None else "ranges", words=context and ranges is not None)
    t = t.withColumn("core", core(F.col("tok")))
    return t.withColumn("hit", F.col("core").isin(*LEXICON))


def spans_from_tokens(t: DataFrame, keep_len: bool = False) -> DataFrame:
    """``(doc_id, source, start, end)``: gold plus models A (misses words), B (misses some, adds
    false ones) and C (runs one token too far).

    One pass over the tokens: each token emits the (source, range) rows it belongs to
    through a single generator, so the token pipeline is not recomputed per source.
    """
    hit = F.col("hit")
    rows = [
        (hit, "gold", F.col("end")),
        (hit & ~F.col("core").isin(*MODEL_A_MISSES), "A", F.col("end")),
        ((hit & (F.col("tok_idx") % 4 != 0)) | ((F.length("core") == 9) & (F.col("tok_idx") % 50 == 0)), "B", F.col("end")),
        (hit, "C", F.coalesce("next_end", "end")),
    ]
    structs = [F.when(cond, F.struct(F.lit(src).alias("source"), F.col("start").alias("start"), end.alias("end"))) for cond, src, end in rows]
    any_row = hit | ((F.length("core") == 9) & (F.col("tok_idx") % 50 == 0))
    extra = [c for c in ("n_chars",) if c in t.columns and keep_len]
    out = t.where(any_row).select("doc_id", *extra, F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("s"))
    return out.select("doc_id", "s.source", "s.start", "s.end", *extra)


def running_on(t: DataFrame) -> DataFrame:
    """``t`` with the offsets of the window form, where several texts of one id count as one: sums over them
    (``n_texts`` copies; without any, nothing changes)."""
    end = F.col("end") * F.col("n_texts")
    return t.withColumns({"start": end - (F.col("end") - F.col("start")), "end": end})


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_from_tokens(tokens(spark, sf_dir))


def token_scores_from_tokens(t: DataFrame, *carry: str) -> DataFrame:
    """``(doc_id, tok_idx, start, end, logit0, logit1, start_logit, end_logit[, carry...])``."""
    sign = F.when(F.col("hit"), 1).otherwise(-1)
    d, i = F.col("doc_id"), F.col("tok_idx")
    return t.select(
        "doc_id",
        "tok_idx",
        "start",
        "end",
        F.lit(0.0).alias("logit0"),
        (sign * 2 + ((d * 31 + i * 17) % 41 - 20).cast("double") / 10).alias("logit1"),
        (sign * 3 + ((d * 13 + i * 29) % 37 - 18).cast("double") / 10).alias("start_logit"),
        (sign * 3 + ((d * 7 + i * 23) % 31 - 15).cast("double") / 10).alias("end_logit"),
        *carry,
    )


def messy_ranges(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """Noisy annotator ranges for the cleaner: every B and C range widened one character to
    the left (usually onto whitespace) and cut two characters short (usually mid-word),
    clipped to the text. ``(doc_id, source, start, end)`` half-open."""
    t = t if t is not None else tokens(spark, sf_dir)
    # the text length travels with the tokens, so no second read of the documents
    s = spans_from_tokens(t, keep_len=True).where(F.col("source").isin("B", "C"))
    st = F.greatest(F.col("start") - 1, F.lit(0))
    en = F.least(F.col("end") - 2, F.col("n_chars"))
    return s.select("doc_id", "source", st.alias("start"), en.alias("end")).where(F.col("end") > F.col("start"))


def windows(t: DataFrame, max_length: int = 384, stride: int = 128) -> DataFrame:
    """Token windows with the logits of their CLS position (arithmetic on (doc_id, window_id),
    offset by a large constant so the CLS keys never collide with token keys)."""
    from spanfold.operators.tokens import strided_windows

    w = strided_windows(t, max_length, stride)
    d, c = F.col("doc_id"), F.col("window_id") + 1000000
    return w.withColumn("cls_start", F.lit(-3.0) + ((d * 13 + c * 29) % 37 - 18).cast("double") / 10).withColumn(
        "cls_end", F.lit(-3.0) + ((d * 7 + c * 23) % 31 - 15).cast("double") / 10
    )
