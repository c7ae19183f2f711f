"""Candidate spans from start/end token scores: top-k, n-best pairs, ranking, thresholds.

Windows are the overlapping token windows of tokens.strided_windows; a token's
windows are computed arithmetically (tokens.window_tokens), never by a range join.
All per-window work is bounded by the window size, all per-pair work by
``n_best_size``^2 pairs per window (the operator's own parameters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfold.functions.text import sigmoid
from spanfold.operators import rowlocal
from spanfold.operators.spans import normalize_spans, split_blocks
from spanfold.operators.tokens import window_tokens

SCORE_DIGITS = 9  # scores are compared after rounding, so equal scores tie in every engine


def topk_logits(wt: DataFrame, logit: str, k: int = 20, keys=("doc_id", "window_id")) -> DataFrame:
    """``k`` best tokens of each window by ``logit`` (ties: higher token index first)."""
    w = Window.partitionBy(*keys).orderBy(F.col(logit).desc(), F.col("tok_idx").desc())
    return wt.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def window_top(wt: DataFrame, n_best: int = 20, keys=("doc_id", "window_id"), extra=()) -> DataFrame:
    """One row per window with its ``n_best`` best starts and ends as bounded arrays.

    Both rankings run in one pass over the window's tokens (two window functions over
    the same partitioning), plus a running sum of ``logit1`` so a candidate's mean
    token score is two array lookups. Arrays hold at most ``n_best`` entries each.
    """
    keys = list(keys)
    ws = Window.partitionBy(*keys).orderBy(F.col("start_logit").desc(), F.col("tok_idx").desc())
    we = Window.partitionBy(*keys).orderBy(F.col("end_logit").desc(), F.col("tok_idx").desc())
    wc = Window.partitionBy(*keys).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    r = wt.withColumn("rs", F.row_number().over(ws)).withColumn("re", F.row_number().over(we)).withColumn("cum", F.sum("logit1").over(wc))
    r = r.where((F.col("rs") <= n_best) | (F.col("re") <= n_best))
    st = F.struct(F.col("rs").alias("rank"), F.col("tok_idx").alias("tok"), F.col("start_logit").alias("logit"), F.col("start").alias("char"),
                  F.col("cum").alias("cum"), F.col("logit1").alias("val"))
    en = F.struct(F.col("re").alias("rank"), F.col("tok_idx").alias("tok"), F.col("end_logit").alias("logit"), F.col("end").alias("char"),
                  F.col("cum").alias("cum"))
    g = r.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("rs") <= n_best, st))).alias("starts"),
        F.sort_array(F.collect_list(F.when(F.col("re") <= n_best, en))).alias("ends"),
        *[F.first(c).alias(c) for c in extra],
    )
    return g


def window_tops(token_scores: DataFrame, max_length: int = 384, stride: int = 128, n_best: int = 20, in_order: bool = False, by_key: bool = False) -> DataFrame:
    """:func:`window_top` of every overlapping window. ``in_order``: the scores come straight from the
    row-local tokenizer, so windows are cut where the text was read and no token is shuffled. ``by_key``:
    besides, texts of one id lie next to each other and share its windows."""
    if in_order:
        return rowlocal.window_top(token_scores, max_length, stride, n_best, by_key=by_key)
    return window_top(window_tokens(token_scores, max_length, stride), n_best)


def pairs_from_top(top: DataFrame, max_answer_length: int = 30, keys=("doc_id", "window_id"), extra=()) -> DataFrame:
    """The window's start x end candidates (at most n_best^2, expanded in place) with
    ``end >= start`` and at most ``max_answer_length`` tokens."""
    keys = list(keys)
    p = top.select(*keys, *extra, F.explode("starts").alias("s"), "ends").select(*keys, *extra, "s", F.explode("ends").alias("e"))
    p = p.where((F.col("e.tok") >= F.col("s.tok")) & (F.col("e.tok") - F.col("s.tok") + 1 <= max_answer_length))
    return p.select(
        *keys, *extra,
        F.col("s.tok").alias("start_tok"), F.col("e.tok").alias("end_tok"),
        F.col("s.rank").alias("start_rank"), F.col("e.rank").alias("end_rank"),
        F.col("s.logit").alias("start_logit"), F.col("e.logit").alias("end_logit"),
        F.col("s.char").alias("start"), F.col("e.char").alias("end"),
        F.col("s.cum").alias("cum_s"), F.col("s.val").alias("val_s"), F.col("e.cum").alias("cum_e"),
    )


def nbest_pairs(token_scores: DataFrame, n_best: int = 20, max_answer_length: int = 30, max_length: int = 384, stride: int = 128,
                in_order: bool = False, by_key: bool = False) -> DataFrame:
    """Top starts x top ends of each window with ``end >= start`` and at most
    ``max_answer_length`` tokens; at most ``n_best``^2 pairs per window. ``in_order``, ``by_key``: see :func:`window_tops`."""
    return pairs_from_top(window_tops(token_scores, max_length, stride, n_best, in_order, by_key), max_answer_length)


def score_pairs(p: DataFrame, style: str = "token_spans") -> DataFrame:
    """``multi``: start + end logit. ``token_spans``: qa = (start + end)/2 plus the mean toxic
    logit over the candidate's tokens. Scores are rounded to ``SCORE_DIGITS`` so equal
    scores compare equal regardless of summation order."""
    if style == "multi":
        return p.withColumn("score", F.round(F.col("start_logit") + F.col("end_logit"), SCORE_DIGITS))
    n = F.col("end_tok") - F.col("start_tok") + 1
    p = p.withColumn("qa_score", (F.col("start_logit") + F.col("end_logit")) / 2)
    p = p.withColumn("token_score", F.round((F.col("cum_e") - F.col("cum_s") + F.col("val_s")) / n, SCORE_DIGITS))
    return p.withColumn("score", F.round(F.col("qa_score") + F.col("token_score"), SCORE_DIGITS))


def nbest_spans(token_scores: DataFrame, style: str = "token_spans", max_length: int = 384, stride: int = 128,
                n_best: int = 20, max_answer_length: int = 30, in_order: bool = False) -> DataFrame:
    """Scored candidates ``(doc_id, window_id, start_tok, end_tok, start, end, start_rank, end_rank, score[, qa_score, token_score])``.

    One linear pipeline: window tokens -> per-window top starts/ends (bounded arrays)
    -> pairs expanded in place -> scores. ``in_order``: see :func:`window_tops`.
    """
    top = window_tops(token_scores, max_length, stride, n_best, in_order)
    return score_pairs(pairs_from_top(top, max_answer_length), style).drop("cum_s", "cum_e", "val_s")


def answer_rows(token_scores: DataFrame, null_score, style: str = "token_spans", max_length: int = 384, stride: int = 128,
                n_best: int = 20, max_answer_length: int = 30, in_order: bool = False) -> DataFrame:
    """Candidates (``_kind`` 1) and one null answer per window (``_kind`` 0, score =
    ``null_score(doc_id, window_id)``, e.g. start[CLS] + end[CLS]) from one generator over
    the per-window rows: the window's valid (start, end) pairs (at most n_best^2) are built
    on its own row and exploded once together with the null marker, so the token
    pipeline below runs once. ``in_order``: see :func:`window_tops`."""
    top = window_tops(token_scores, max_length, stride, n_best, in_order)
    return rows_of_windows(top, null_score, style, max_answer_length)


def valid_pairs(starts: str, ends: str, max_answer_length: int = 30) -> Column:
    """The (start, end) pairs of a window's top arrays with ``end >= start`` and at most
    ``max_answer_length`` tokens, as an array of ``struct(k = 1, s, e)``."""
    pairs = F.flatten(F.transform(starts, lambda s_: F.transform(ends, lambda e_: F.struct(F.lit(1).alias("k"), s_.alias("s"), e_.alias("e")))))
    return F.filter(pairs, lambda x: (x["e"]["tok"] >= x["s"]["tok"]) & (x["e"]["tok"] - x["s"]["tok"] + 1 <= max_answer_length))


def rows_of_windows(top: DataFrame, null_score, style: str = "token_spans", max_answer_length: int = 30, carry=()) -> DataFrame:
    """Candidates and one null answer per row of :func:`window_top` (see :func:`answer_rows`);
    ``null_score`` may use the keys and the ``carry`` columns, which stay in the output."""
    keys = ["doc_id", "window_id", *carry]
    marker = F.array(F.struct(F.lit(0).alias("k"), F.lit(None).cast(top.schema["starts"].dataType.elementType).alias("s"),
                              F.lit(None).cast(top.schema["ends"].dataType.elementType).alias("e")))
    x = top.select(*keys, F.explode(F.concat(marker, valid_pairs("starts", "ends", max_answer_length))).alias("x"))
    p = x.select(
        *keys, F.col("x.k").alias("_kind"),
        F.col("x.s.tok").alias("start_tok"), F.col("x.e.tok").alias("end_tok"),
        F.col("x.s.rank").alias("start_rank"), F.col("x.e.rank").alias("end_rank"),
        F.col("x.s.logit").alias("start_logit"), F.col("x.e.logit").alias("end_logit"),
        F.col("x.s.char").alias("start"), F.col("x.e.char").alias("end"),
        F.col("x.s.cum").alias("cum_s"), F.col("x.s.val").alias("val_s"), F.col("x.e.cum").alias("cum_e"),
    )
    p = score_pairs(p, style)
    return p.withColumn("score", F.when(F.col("_kind") == 0, null_score).otherwise(F.col("score"))).drop("cum_s", "cum_e", "val_s")


def null_scores(windows: DataFrame, cls_start: Column, cls_end: Column, keys=("doc_id",)) -> DataFrame:
    """Per document, the max over its windows of start[CLS] + end[CLS]."""
    return windows.groupBy(*keys).agg(F.max(cls_start + cls_end).alias("null_score"))


def rank_candidates(rows: DataFrame, docs: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Candidates per document by score desc (ties: start rank, end rank, window).

    ``rows`` come from :func:`answer_rows` (candidates ``_kind`` 1, per-window null
    answers ``_kind`` 0). A document without candidates gets a fake ``(score 0.0, NULL,
    NULL)``; when the best score is at or below the document's null score (max over its
    windows) a null answer ``(null_score, NULL, NULL)`` is ranked first. ``docs`` (ids
    only) adds documents without any window. ``rank`` starts at 1.
    """
    keys = list(keys)
    cols = ["start", "end", "score", "window_id", "start_rank", "end_rank", "start_tok", "end_tok"]
    r = rows.select(*keys, *cols, "_kind").unionByName(docs.select(*keys).withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    d = Window.partitionBy(*keys)
    rsc = F.round("score", SCORE_DIGITS)
    r = r.withColumn("_best", F.max(F.when(F.col("_kind") == 1, rsc)).over(d)).withColumn("_null", F.max(F.when(F.col("_kind") == 0, rsc)).over(d))
    kind = F.col("_kind")
    r = r.withColumn("_nrank", F.when(kind == 0, F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy(F.col("score").desc(), F.col("window_id")))))
    top = F.coalesce(F.col("_best"), F.lit(0.0))
    # one pass: candidates stay, the document marker becomes the fake answer when there is no
    # candidate, the best null answer stays when it is at least as good as the best candidate
    keep = (kind == 1) | ((kind == 2) & F.col("_best").isNull()) | ((kind == 0) & (F.col("_nrank") == 1) & (top <= F.col("_null")))
    real = kind == 1
    out = r.where(keep).select(
        *keys,
        *[F.when(real, F.col(c)).alias(c) for c in ("start", "end", "window_id", "start_rank", "end_rank", "start_tok", "end_tok")],
        F.when(kind == 2, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        F.when(kind == 0, 0).otherwise(1).alias("_ord"),
    )
    w = Window.partitionBy(*keys).orderBy(
        F.col("_ord"), F.round("score", SCORE_DIGITS).desc(), F.col("start_rank").asc_nulls_last(), F.col("end_rank").asc_nulls_last(), F.col("window_id").asc_nulls_last()
    )
    return out.withColumn("rank", F.row_number().over(w)).drop("_ord")


def topk_answers(ranked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best answers per document (a top-k report)."""
    return ranked.where(F.col("rank") <= k)


def _shr(v: Column, n: Column) -> Column:
    return F.call_function("shiftright", v, n)


def _highest_bit(v: Column) -> Column:
    """Index of the highest set bit of a positive long (exact: log2 guess, corrected by shifts)."""
    h = F.floor(F.log2(v.cast("double"))).cast("int")
    h = F.when(_shr(v, h) == 0, h - 1).otherwise(h)
    return F.when(_shr(v, h + 1) > 0, h + 1).otherwise(h)


def tune_score_threshold(cands: DataFrame, gold: DataFrame, docs: DataFrame, n_levels: int = 100, score_is_probability: bool = False,
                         keys=("doc_id",), block: int = 1 << 16, evaluator=None) -> DataFrame:
    """Mean document F1 at every threshold ``t_k = k/(n_levels-1)`` in one sweep (no rescans).

    A candidate (with a start) counts at level ``k`` when sigmoid(score) > t_k, i.e. at all
    levels up to the highest one it passes. Candidates are merged per (document, highest
    level) so ranges of one level are disjoint; a running sum of +-2^level over all range
    endpoints is then exactly the set of active levels (a bitmask in two longs), and gold
    rides in the same sweep as a 0/1 cover. Each elementary segment counts for every level
    up to its highest active one, so sums from above over a document's histogram (its own
    distinct levels) give |pred| and |pred & gold| wherever they change, and only those change
    points leave the document. Documents without a passing candidate score by the
    empty-prediction rule.
    ``(k, threshold, mean_f1, is_best)``; best = highest mean, lowest threshold on ties.
    ``evaluator(n_pred, n_gold, n_inter) -> Column`` is the per-document metric plug-in (default
    F1); a document with neither prediction nor gold counts 1.
    """
    keys = list(keys)
    if n_levels > 126:
        raise ValueError("at most 126 threshold levels (two 63-bit masks)")
    div = float(n_levels - 1)
    p = F.col("score") if score_is_probability else sigmoid(F.col("score"))
    c = cands.where(F.col("start").isNotNull()).select(*keys, "start", "end", pass_level(p, n_levels, div).alias("kmax")).where(F.col("kmax") >= 0)
    GOLD = -2  # gold travels as its own pseudo-level
    r = c.unionByName(gold.select(*keys, "start", "end").withColumn("kmax", F.lit(GOLD)))
    # cut at block boundaries and co-partition once on (document, block): the per-level
    # merge, the per-point sum and the sweep all run inside one block of one document
    r = split_blocks(r, block).repartition(*keys, "_blk")
    merged = normalize_spans(r, keys + ["kmax", "_blk"], block=None)
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    k = F.col("kmax")
    lo = F.when((k >= 0) & (k < 63), F.call_function("shiftleft", one, k)).otherwise(zero)
    hi = F.when(k >= 63, F.call_function("shiftleft", one, k - 63)).otherwise(zero)
    g = F.when(k == GOLD, one).otherwise(zero)

    def ev(x, dl, dh, dg):
        return F.struct(x.alias("x"), dl.alias("dl"), dh.alias("dh"), dg.alias("dg"))

    evs = merged.select(*keys, "_blk", F.explode(F.array(ev(F.col("start"), lo, hi, g), ev(F.col("end"), -lo, -hi, -g))).alias("e"))
    pts = evs.select(*keys, "_blk", "e.*").groupBy(*keys, "_blk", "x").agg(F.sum("dl").alias("dl"), F.sum("dh").alias("dh"), F.sum("dg").alias("dg"))
    w = Window.partitionBy(*keys, "_blk").orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = pts.select(
        *keys, "x", F.lead("x").over(w).alias("nx"),
        F.sum("dl").over(run).alias("lo"), F.sum("dh").over(run).alias("hi"), F.sum("dg").over(run).alias("gc"),
    ).where(F.col("nx").isNotNull())
    level = F.when(F.col("hi") != 0, _highest_bit(F.col("hi")) + 63).when(F.col("lo") != 0, _highest_bit(F.col("lo"))).otherwise(-1)
    seg = seg.select(*keys, (F.col("nx") - F.col("x")).alias("len"), "gc", level.alias("level"))
    hist = seg.groupBy(*keys, "level").agg(F.sum("len").alias("plen"), F.sum(F.col("len") * F.col("gc")).alias("ilen"))
    down = Window.partitionBy(*keys).orderBy(F.col("level").desc())
    sums = down.rowsBetween(Window.unboundedPreceding, 0)
    doc = Window.partitionBy(*keys)
    steps = hist.select(
        *keys, "level", F.sum("plen").over(sums).alias("n_pred"), F.sum("ilen").over(sums).alias("n_inter"), F.sum("ilen").over(doc).alias("n_gold"),
        F.coalesce(F.lead("level").over(down), F.lit(-1)).alias("below"), F.row_number().over(down).alias("nth"),
    )
    n_gold, zero = F.col("n_gold"), F.lit(0)
    if evaluator is None:
        f1 = F.when(n_gold == 0, 0.0).otherwise(2.0 * F.col("n_inter") / (F.col("n_pred") + n_gold))
        nothing = F.when(n_gold == 0, 1.0).otherwise(0.0)
    else:
        f1, nothing = evaluator(F.col("n_pred"), n_gold, F.col("n_inter")), evaluator(zero, n_gold, zero)
    # above its highest level a document predicts nothing
    empty = F.when(F.col("nth") == 1, nothing).otherwise(0.0)
    points = change_points(F.col("level"), F.col("below"), f1) + change_points(F.lit(n_levels - 1), F.col("level"), empty)
    per_k = mean_by_level(steps, points, F.col("nth") == 1, n_levels, docs.agg(F.count("*").alias("n_docs")))
    return _mark_best(per_k.withColumn("threshold", F.col("k") / F.lit(div)))


def change_points(level: Column, below: Column, value: Column) -> list[Column]:
    """A value that holds at the levels ``below < k <= level`` as two points whose sum from above is it."""
    point = lambda k, v: F.struct(k.cast("int").alias("k"), v.alias("v"))
    return [F.when(level > below, point(level, value)), F.when((level > below) & (below >= 0), point(below, -value))]


def mean_by_level(steps: DataFrame, points: list[Column], first_of_doc: Column, n_levels: int, n_docs: DataFrame | None = None) -> DataFrame:
    """``(k, mean_f1)`` for every level from the documents' change points: they are summed by level
    (with map-side combine) and a sum from above over the ``n_levels`` rows gives each level's total.

    ``n_docs``: one row with the number of all documents; those without any step count as 1. Without
    it the mean is over the documents that have steps. ``first_of_doc`` marks one step a document."""
    seen, all_docs = -1, -2  # the rows that count documents with steps and all documents
    doc = F.struct(F.lit(seen).alias("k"), F.lit(1.0).alias("v"))
    every = F.filter(F.array(*points, F.when(first_of_doc, doc)), lambda p: p.isNotNull())
    rows = steps.select(F.explode(every).alias("p")).select("p.k", "p.v")
    rows = rows.unionByName(steps.sparkSession.range(n_levels).select(F.col("id").cast("int").alias("k"), F.lit(0.0).alias("v")))
    if n_docs is not None:
        rows = rows.unionByName(n_docs.select(F.lit(all_docs).alias("k"), F.col("n_docs").cast("double").alias("v")))
    sums = rows.groupBy("k").agg(F.sum("v").alias("v"))  # at most n_levels + 2 rows from here on
    whole, down = Window.partitionBy(), Window.orderBy(F.col("k").desc())
    of = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))).over(whole), F.lit(0.0))
    sums = sums.select("k", F.sum("v").over(down).alias("total"), of(seen).alias("seen"), of(all_docs).alias("docs")).where(F.col("k") >= 0)
    n = F.col("seen") if n_docs is None else F.col("docs")
    return sums.select(F.col("k").cast("long").alias("k"), ((F.col("total") + n - F.col("seen")) / F.greatest(n, F.lit(1.0))).alias("mean_f1"))


def _mark_best(per_k: DataFrame, prefer: Column | None = None) -> DataFrame:
    """``is_best`` = 1 on the best level: highest mean F1 (rounded), then ``prefer``, then lowest k.
    The table has one row per threshold level, so the ranking window is bounded."""
    order = [F.round("mean_f1", SCORE_DIGITS).desc()]
    if prefer is not None:
        order.append(prefer.desc())
    order.append(F.col("k").asc())
    r = F.row_number().over(Window.orderBy(*order))
    return per_k.withColumn("is_best", F.when(r == 1, 1).otherwise(0))


def pass_level(p: Column, n_levels: int, div: float) -> Column:
    """Largest ``k`` in ``[0, n_levels)`` with ``p > k/div`` (-1 if none), with exact
    comparisons at the boundaries so it agrees with testing every level."""
    k0 = F.least(F.greatest(F.ceil(p * div) - 1, F.lit(-1)), F.lit(n_levels - 1)).cast("int")
    up = F.when((k0 + 1 <= n_levels - 1) & (p > (k0 + 1) / F.lit(div)), k0 + 1)
    down = F.when((k0 >= 0) & ~(p > k0 / F.lit(div)), k0 - 1)
    return F.coalesce(up, down, k0)


def tune_token_threshold(token_scores: DataFrame, p: Column, label: str = "label", n_levels: int = 100, div: float = 100.0,
                         keys=("doc_id",), evaluator=None) -> DataFrame:
    """Mean per-document token F1 (0 without any positive) at thresholds ``k/div``; best =
    true argmax, lowest threshold on ties (the reference's loop never updated its best).

    One chain, no token replication: each token gets the highest level it passes; sums from
    above over a document's histogram (its own distinct levels) give tp/fp wherever they change,
    and only those change points leave the document. A level with no passing token has F1 0.
    ``evaluator(tp, fp, fn) -> Column`` is the per-document metric plug-in (default F1);
    it must score 0 when the document has no passing token.
    """
    keys = list(keys)
    t = token_scores.select(*keys, F.col(label).alias("y"), pass_level(p, n_levels, div).alias("kmax"))
    hist = t.groupBy(*keys, "kmax").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    hist = hist.withColumn("n_pos", F.sum("pos").over(Window.partitionBy(*keys)))
    down = Window.partitionBy(*keys).orderBy(F.col("kmax").desc())
    sums = down.rowsBetween(Window.unboundedPreceding, 0)
    steps = hist.select(
        "kmax", F.sum("pos").over(sums).alias("tp"), F.sum("neg").over(sums).alias("fp"), "n_pos",
        F.coalesce(F.lead("kmax").over(down), F.lit(-1)).alias("below"), F.row_number().over(down).alias("nth"),
    )
    fn = F.col("n_pos") - F.col("tp")
    denom = 2 * F.col("tp") + F.col("fp") + fn
    metric = F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(0.0) if evaluator is None else evaluator(F.col("tp"), F.col("fp"), fn)
    per_k = mean_by_level(steps, change_points(F.col("kmax"), F.col("below"), metric), F.col("nth") == 1, n_levels)
    return _mark_best(per_k.withColumn("threshold", F.col("k") / F.lit(div)))


def asof_token_bounds(runs: DataFrame, tokens: DataFrame, keys=("doc_id",)) -> DataFrame:
    """For each run ``[start, end)``: ``s_tok`` = last token starting at or before ``start``,
    ``e_tok`` = first token ending at or after ``end``.

    As-of lookups by a union with the tokens and a running max/min over the document
    (no range join): tokens sort before a probe at an equal position.
    """
    keys = list(keys)
    tk = tokens.select(*keys, "tok_idx", "start", "end")
    rs = runs.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    a = tk.select(*keys, F.col("start").alias("x"), F.lit(0).alias("kind"), "tok_idx", F.lit(None).cast("long").alias("r_start"), F.lit(None).cast("long").alias("r_end"))
    a = a.unionByName(rs.select(*keys, F.col("r_start").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("tok_idx"), "r_start", "r_end"))
    wa = Window.partitionBy(*keys).orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    s = a.withColumn("s_tok", F.max("tok_idx").over(wa)).where(F.col("kind") == 1).select(*keys, "r_start", "r_end", "s_tok")
    b = tk.select(*keys, F.col("end").alias("x"), F.lit(0).alias("kind"), "tok_idx", F.lit(None).cast("long").alias("r_start"), F.lit(None).cast("long").alias("r_end"))
    b = b.unionByName(rs.select(*keys, F.col("r_end").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("tok_idx"), "r_start", "r_end"))
    wb = Window.partitionBy(*keys).orderBy(F.col("x").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    e = b.withColumn("e_tok", F.min("tok_idx").over(wb)).where(F.col("kind") == 1).select(*keys, "r_start", "r_end", "e_tok")
    return s.join(e, keys + ["r_start", "r_end"]).withColumnRenamed("r_start", "start").withColumnRenamed("r_end", "end")


def window_answer_positions(runs: DataFrame, tokens: DataFrame, windows: DataFrame, keys=("doc_id",)) -> DataFrame:
    """One feature per (run, window of its document): start/end token positions inside the
    window (CLS = position 0, tokens from 1), or CLS for both when the window does not hold
    the whole run."""
    keys = list(keys)
    b = asof_token_bounds(runs, tokens, keys)
    tk = tokens.select(*keys, "tok_idx", "start", "end")
    w = windows.join(tk.select(*keys, F.col("tok_idx").alias("first_tok"), F.col("start").alias("first_start")), keys + ["first_tok"])
    w = w.join(tk.select(*keys, F.col("tok_idx").alias("last_tok"), F.col("end").alias("last_end")), keys + ["last_tok"])
    j = b.join(w, keys)
    cov = (F.col("first_start") <= F.col("start")) & (F.col("last_end") >= F.col("end"))
    return j.select(
        *keys, F.col("start").alias("span_start"), "window_id",
        F.when(cov, F.col("s_tok") - F.col("first_tok") + 1).otherwise(0).alias("start_position"),
        F.when(cov, F.col("e_tok") - F.col("first_tok") + 1).otherwise(0).alias("end_position"),
    )


def window_multi_positions(runs: DataFrame, tokens: DataFrame, max_length: int = 384, stride: int = 128, keys=("doc_id",)) -> DataFrame:
    """Sparse 0/1 start and end flags per window token for every run the window holds whole
    (runs cut by the window are skipped). The windows holding a run follow from its token
    bounds arithmetically. ``(keys..., window_id, pos, start_flag, end_flag)``, flagged positions only."""
    keys = list(keys)
    step = max_length - stride
    b = asof_token_bounds(runs, tokens, keys)
    n = tokens.groupBy(*keys).agg(F.count("*").alias("_n"))
    nwin = F.lit(1) + F.greatest(F.lit(0), F.ceil((F.col("_n") - max_length) / F.lit(step)))
    b = b.join(n, keys)
    lo = F.greatest(F.lit(0), F.ceil((F.col("e_tok") - max_length + 1) / F.lit(step))).cast("long")
    hi = F.least(F.floor(F.col("s_tok") / F.lit(step)), nwin - 1).cast("long")
    b = b.where(hi >= lo).withColumn("window_id", F.explode(F.sequence(lo, hi)))
    s = b.select(*keys, "window_id", (F.col("s_tok") - F.col("window_id") * step + 1).alias("pos"), F.lit(1).alias("start_flag"), F.lit(0).alias("end_flag"))
    e = b.select(*keys, "window_id", (F.col("e_tok") - F.col("window_id") * step + 1).alias("pos"), F.lit(0).alias("start_flag"), F.lit(1).alias("end_flag"))
    return s.unionByName(e).groupBy(*keys, "window_id", "pos").agg(F.max("start_flag").alias("start_flag"), F.max("end_flag").alias("end_flag"))
