"""Span scoring: per-document precision/recall/F1 on character sets, macro means, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfold.operators.spans import BLOCK, normalize_spans, split_blocks
from spanfold.operators.tokens import overlap_join

#: Rows of a range of scores that one task ranks, and the most ranges.
RANGE_ROWS, MAX_RANGES = 1 << 20, 1024


def prf_columns(n_pred: Column, n_gold: Column, n_inter: Column) -> list[Column]:
    """The reference's per-document rule: empty gold scores 1 iff the prediction is empty too."""
    p = F.when(n_gold == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when(n_pred == 0, 0.0).otherwise(n_inter / n_pred)
    r = F.when(n_gold == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when(n_pred == 0, 0.0).otherwise(n_inter / n_gold)
    f = F.when(n_gold == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when(n_pred == 0, 0.0).otherwise(2.0 * n_inter / (n_pred + n_gold))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def doc_prf(docs: DataFrame, pred: DataFrame, gold: DataFrame, sources, keys=("doc_id",), source: str = "source", block: int = BLOCK) -> DataFrame:
    """Per document and source: precision, recall, F1 on character sets.

    Starts from ``docs`` (every document scored, zero-span ones included) times the
    given ``sources`` (a short list of model names, expanded in place, no join).
    Prediction and gold ranges are two inputs; when both come from one table use
    :func:`doc_prf_from_spans`, which reads that table once.
    """
    keys = list(keys)
    p = pred.select(*keys, F.col(source).alias("_src"), "start", "end", F.lit("p").alias("_role"))
    g = gold.select(*keys, "start", "end").withColumn("_src", F.explode(F.array(*[F.lit(s) for s in sources]))).withColumn("_role", F.lit("g"))
    return _prf_from_roles(docs, p.unionByName(g), sources, keys, source, block)


def doc_prf_from_spans(docs: DataFrame, spans: DataFrame, sources, gold: str = "gold", keys=("doc_id",), source: str = "source") -> DataFrame:
    """:func:`doc_prf` for one spans table holding both gold (``source == gold``) and the
    predictions: one generator replicates each gold range to every scored source, so the
    table (and whatever produced it) is read once and the plan stays a single pipeline."""
    keys = list(keys)
    is_gold = F.col(source) == F.lit(gold)
    tagged = F.when(is_gold, F.array(*[F.struct(F.lit(s).alias("_src"), F.lit("g").alias("_role")) for s in sources])).otherwise(
        F.array(F.struct(F.col(source).alias("_src"), F.lit("p").alias("_role")))
    )
    r = spans.where(is_gold | F.col(source).isin(*sources)).select(*keys, "start", "end", F.explode(tagged).alias("_t"))
    return _prf_from_roles(docs, r.select(*keys, "_t._src", "_t._role", "start", "end"), sources, keys, source)


def _prf_from_roles(docs: DataFrame, roles: DataFrame, sources, keys, source: str, block: int = BLOCK) -> DataFrame:
    """Sizes of pred, gold and their intersection per (document, source) from one sweep.

    Each (source, role) is normalized; pred counts 1 and gold 2 in a coverage sweep over
    the (document, source) group, so a segment with cover 3 is in both. No join pairs
    ranges, so the cost follows the number of ranges even for one huge document.
    """
    # set sizes add up over character blocks, so every step runs per (document, source,
    # block) and no stitching is needed: a huge document is spread over its blocks
    # one shuffle on (document, source, block) serves the per-role merge, the per-point sum
    # and the sweep below (each groups by a superset of these keys)
    blk = split_blocks(roles, block).repartition(*keys, "_src", "_blk")
    norm = normalize_spans(blk, keys + ["_src", "_role", "_blk"], block=None)
    w = F.when(F.col("_role") == "p", 1).otherwise(2)
    ev = norm.select(
        *keys, "_src", "_blk", F.explode(F.array(F.struct(F.col("start").alias("x"), w.alias("d")), F.struct(F.col("end").alias("x"), (-w).alias("d")))).alias("e")
    ).select(*keys, "_src", "_blk", "e.x", "e.d")
    pts = ev.groupBy(*keys, "_src", "_blk", "x").agg(F.sum("d").alias("d"))
    win = Window.partitionBy(*keys, "_src", "_blk").orderBy("x")
    seg = pts.withColumn("cover", F.sum("d").over(win.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nx", F.lead("x").over(win))
    seg = seg.where(F.col("nx").isNotNull() & (F.col("cover") > 0)).withColumn("len", F.col("nx") - F.col("x"))
    c = F.col("cover")
    sizes = seg.groupBy(*keys, "_src").agg(
        F.sum(F.when((c == 1) | (c == 3), F.col("len")).otherwise(0)).alias("n_pred"),
        F.sum(F.when(c >= 2, F.col("len")).otherwise(0)).alias("n_gold"),
        F.sum(F.when(c == 3, F.col("len")).otherwise(0)).alias("n_inter"),
    )
    base = docs.select(*keys).withColumn("_src", F.explode(F.array(*[F.lit(s) for s in sources])))
    j = base.join(sizes, on=keys + ["_src"], how="left")
    n_pred, n_gold, n_inter = (F.coalesce(F.col(x), F.lit(0)).cast("long") for x in ("n_pred", "n_gold", "n_inter"))
    return j.select(*keys, F.col("_src").alias(source), n_pred.alias("n_pred"), n_gold.alias("n_gold"), n_inter.alias("n_inter"), *prf_columns(n_pred, n_gold, n_inter))


def doc_f1(docs, pred, gold, sources, keys=("doc_id",), source="source") -> DataFrame:
    return doc_prf(docs, pred, gold, sources, keys, source).select(*keys, source, "f1")


def system_prf(scores: DataFrame, source: str = "source") -> DataFrame:
    """Macro means over documents, plus the mean F1 over documents with non-empty gold."""
    return scores.groupBy(source).agg(
        F.count("*").alias("n_docs"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.avg(F.when(F.col("n_gold") > 0, F.col("f1"))).alias("f1_nonempty_gold"),
    )


def system_f1_sem(scores: DataFrame, group: str = "source") -> DataFrame:
    """(mean F1, standard error of the mean = sd(ddof=1)/sqrt(n)); one document -> NULL sem."""
    return scores.groupBy(group).agg(
        F.avg("f1").alias("mean_f1"),
        (F.stddev_samp("f1") / F.sqrt(F.count("f1"))).alias("sem_f1"),
    )


def f1_box_summary(scores: DataFrame, group: str = "source") -> DataFrame:
    """Exact box-plot numbers (linear interpolation) of per-document F1.

    Documents are counted per distinct score first (with map-side combine), so the quantiles see one
    row per score, weighted by its count, whatever the number of documents."""
    counts = scores.groupBy(group, "f1").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(
        F.min("f1").alias("f1_min"),
        F.percentile("f1", 0.25, F.col("n")).alias("f1_q1"),
        F.percentile("f1", 0.5, F.col("n")).alias("f1_median"),
        F.percentile("f1", 0.75, F.col("n")).alias("f1_q3"),
        F.max("f1").alias("f1_max"),
    )


def pairwise_agreement(docs: DataFrame, codes: DataFrame, coders, keys=("doc_id",), coder: str = "coder", method=None) -> DataFrame:
    """Per document and unordered coder pair ``a < b``: F1 of a against b (b as reference).

    Every coder's ranges are replicated in place to the pairs it belongs to (as the
    prediction of pairs where it is ``a``, as the reference where it is ``b``), and all pairs
    are scored by one coverage sweep (the same as :func:`doc_prf`), so no range is ever
    paired with another. Averaging the rows per document gives the agreement; with fewer
    than two coders there is no pair (the reference's mean of nothing).
    ``method(n_a, n_b, n_inter) -> Column`` is the pairwise metric plug-in (default F1).
    """
    keys = list(keys)
    coders = sorted(coders)
    pairs = [(a, b) for i, a in enumerate(coders) for b in coders[i + 1 :]]
    if not pairs:
        return docs.select(*keys).withColumn("coder_a", F.lit(None).cast("string")).withColumn("coder_b", F.lit(None).cast("string")).withColumn("f1", F.lit(None).cast("double"))
    labels = [f"{a}\u0001{b}" for a, b in pairs]
    c = F.col(coder)
    tags = F.array(*[
        F.when(c == F.lit(x), F.struct(F.lit(lab).alias("_src"), F.lit("p" if x == a else "g").alias("_role")))
        for lab, (a, b) in zip(labels, pairs) for x in (a, b)
    ])
    r = codes.where(c.isin(*coders)).select(*keys, "start", "end", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("_t"))
    scored = _prf_from_roles(docs, r.select(*keys, "_t._src", "_t._role", "start", "end"), labels, keys, "_pair")
    parts = F.split(F.col("_pair"), "\u0001")
    value = F.col("f1") if method is None else method(F.col("n_pred"), F.col("n_gold"), F.col("n_inter")).alias("f1")
    return scored.select(*keys, parts.getItem(0).alias("coder_a"), parts.getItem(1).alias("coder_b"), value)


def token_f1(tokens: DataFrame, keys=("doc_id",), label: str = "label", pred: str = "pred") -> DataFrame:
    """Per document binary F1 over non-ignored tokens (NULL label = ignored); 0 with no positives at all."""
    keys = list(keys)
    t = tokens.where(F.col(label).isNotNull())
    agg = t.groupBy(*keys).agg(
        F.sum(F.when((F.col(label) == 1) & (F.col(pred) == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col(label) == 0) & (F.col(pred) == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col(label) == 1) & (F.col(pred) == 0), 1).otherwise(0)).alias("fn"),
    )
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return agg.withColumn("f1", F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(0.0))


def classification_metrics(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """F1, precision, recall, accuracy (score > threshold), ROC-AUC (average ranks), MSE; rows without
    label or score (null or NaN) don't count.

    Everything follows from one table, a row per distinct score with its counts. AUC is the Mann-Whitney statistic from average ranks, see ``score_ranks``.
    """
    d = df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    missed = (F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))
    ties = d.groupBy("s").agg(
        F.count("y").alias("c"), F.sum("y").alias("pos"), F.count_if(F.col("y") == 1).alias("c1"), F.count_if(F.col("y") == 0).alias("c0"), F.sum(missed).alias("err")
    )
    ranks = score_ranks(ties.where("c > 0 and s is not null and not isnan(s)"))
    said = F.col("s") > F.lit(threshold)

    def total(name, when=None):
        x = F.col(name) if when is None else F.when(when, F.col(name)).otherwise(0)
        return F.coalesce(F.sum(x), F.lit(0))

    m = ranks.agg(
        total("c1", said).alias("tp"), total("c0", said).alias("fp"), total("c1", ~said).alias("fn"), total("c0", ~said).alias("tn"),
        total("pos").alias("n_pos"), total("c").alias("n"), F.sum("err").alias("err"), F.sum(F.col("avg_rank") * F.col("pos")).alias("rank_sum_pos"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n_pos = F.col("n_pos")
    n_neg = F.col("n") - n_pos
    return m.select(
        F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
        F.when(F.col("n") > 0, (tp + tn) / F.col("n")).alias("accuracy"),
        F.when((n_pos > 0) & (n_neg > 0), (F.col("rank_sum_pos") - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)).alias("roc_auc"),
        F.when(F.col("n") > 0, F.col("err") / F.col("n")).alias("mse"),
    )


def score_ranges(ties: DataFrame, rows: int | None = None) -> DataFrame:
    """``ties`` (a row per distinct score ``s``) with ``b``, the number of its range of scores.

    The splitters are even quantiles of the distinct scores, from Spark's mergeable quantile sketch
    at sixteen times the resolution of the finest ranges (one pass, with the count), so ranges hold about equally many rows however the
    scores lie. There are a power of two of them, of about ``rows`` (``RANGE_ROWS``) rows and ``MAX_RANGES`` at most;
    a row finds its range by binary search in the list of splitters."""
    rows = rows or RANGE_ROWS
    sketch = F.percentile_approx("s", [k / MAX_RANGES for k in range(1, MAX_RANGES)], 16 * MAX_RANGES)
    n, finest = ties.agg(F.count("*"), sketch).first()
    ranges = 1
    while ranges < MAX_RANGES and ranges * rows < n:
        ranges *= 2
    if ranges == 1:
        return ties.withColumn("b", F.lit(0))
    each = MAX_RANGES // ranges
    cuts = finest[each - 1 :: each]
    limits = F.array(*map(F.lit, cuts))
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(ranges.bit_length() - 1))])
    b = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.element_at(limits, low + step) < F.col("s"), low + step).otherwise(low))
    return ties.withColumn("b", b)


def score_ranks(ties: DataFrame, rows: int | None = None) -> DataFrame:
    """``ties`` (a row per distinct score ``s``, ``c`` rows each) with ``avg_rank``, the average rank of the tied rows.

    Ranks need a global prefix count. It has two levels, so no task sees all scores: the totals of the
    ranges (at most ``MAX_RANGES`` rows) in one small window, and the rows inside each range."""
    ranged = score_ranges(ties, rows)
    total = ranged.groupBy("b").agg(F.sum("c").alias("_c"))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select("b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0))
    # average rank of tied scores = (rows below) + (ties + 1) / 2
    return ranged.join(F.broadcast(before), "b").withColumn("avg_rank", below + (F.col("c") + 1) / 2.0).drop("b", "_before")
