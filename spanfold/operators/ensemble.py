"""Combining several annotators/models: union, intersection, k-of-n vote, majority, file fold.

All are one coverage sweep (spans.coverage) plus a rule on the cover count, so any
number of models costs one shuffle of range endpoints; nothing is exploded to characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.operators.spans import BLOCK, coverage, merge_segments, normalize_spans


def _keep(ranges: DataFrame, rule, keys, source, block=BLOCK) -> DataFrame:
    keys = list(keys)
    seg = coverage(ranges.select(*keys, source, "start", "end"), keys, source, block=block)
    return merge_segments(seg.where(rule(F.col("cover"))), keys, block)


def span_union(ranges: DataFrame, keys=("doc_id",), source: str = "source") -> DataFrame:
    """Characters predicted by any source."""
    return normalize_spans(ranges.select(*keys, "start", "end"), list(keys))


def span_intersect(ranges: DataFrame, n_models: int, keys=("doc_id",), source: str = "source") -> DataFrame:
    """Characters predicted by all ``n_models`` sources."""
    return _keep(ranges, lambda c: c >= n_models, keys, source)


def span_vote(ranges: DataFrame, k: int = 2, keys=("doc_id",), source: str = "source", block: int | None = BLOCK) -> DataFrame:
    """Characters predicted by at least ``k`` sources (the reference: 2 of 3)."""
    return _keep(ranges, lambda c: c >= k, keys, source, block)


def span_majority(ranges: DataFrame, n_models: int, keys=("doc_id",), source: str = "source") -> DataFrame:
    """``count / n_models >= 0.5`` (with two models this is a union)."""
    return _keep(ranges, lambda c: c * 2 >= n_models, keys, source)


def combine_files(ranges: DataFrame, presence: DataFrame, how: str = "union", strict: bool = False, keys=("doc_id",), source: str = "source") -> DataFrame:
    """Fold union/intersection per id over prediction files.

    ``presence(keys..., source)`` lists which file holds which id. A file lacking an id
    is ignored for that id (so the intersection is over the files holding it); with
    ``strict=True`` the intersection requires every file. Any ``how`` other than
    ``"union"`` means intersection, as in the reference.
    """
    keys = list(keys)
    if how == "union":
        return span_union(ranges, keys, source)
    held = presence.groupBy(*keys).agg(F.countDistinct(source).alias("_n"))
    if strict:
        n_all = presence.select(source).distinct().count()
        held = held.withColumn("_n", F.lit(n_all))
    seg = coverage(ranges.select(*keys, source, "start", "end"), keys, source).join(held, on=keys, how="inner")
    return merge_segments(seg.where(F.col("cover") >= F.col("_n")), keys)


def span_except(a: DataFrame, b: DataFrame, keys=("doc_id",), block: int | None = BLOCK) -> DataFrame:
    """Characters of ``a`` not in ``b`` (signed sweep: a counts +1, b counts -2; keep cover == 1)."""
    keys = list(keys)
    r = a.select(*keys, "start", "end").withColumn("_src", F.lit("a")).unionByName(
        b.select(*keys, "start", "end").withColumn("_src", F.lit("b"))
    )
    seg = coverage(r, keys, "_src", weight=F.when(F.col("_src") == "a", 1).otherwise(-2), block=block)
    return merge_segments(seg.where(F.col("cover") == 1), keys, block)
