"""Span algebra on half-open character ranges.

Canonical long table: ``(keys..., [source,] start, end)`` with ``start < end``.
Boundary format (files, reference compatibility): ``array<int>`` of character offsets.
Never explode ranges to characters for set algebra: the coverage sweep works on
range endpoints only, so cost follows the number of ranges, not characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def empty_int_array() -> Column:
    return F.array().cast("array<int>")


# ---------------------------------------------------------------- boundary format
def parse_spans(literal: Column) -> Column:
    """String literal ``"[1, 2]"`` -> ``array<int>``; anything unparsable -> ``[]`` (never ``eval``)."""
    return F.coalesce(F.from_json(literal, "array<int>"), empty_int_array())


def format_offsets(offsets: Column) -> Column:
    """``array<int>`` -> ``"[a, b, c]"`` in the reference's Python-list rendering."""
    return F.concat(F.lit("["), F.array_join(F.transform(offsets, lambda x: x.cast("string")), ", "), F.lit("]"))


def sorted_offsets(offsets: Column) -> Column:
    """Distinct offsets ascending."""
    return F.sort_array(F.array_distinct(offsets))


def offsets_to_ranges(df: DataFrame, offsets: str = "offsets", keys=("doc_id",), keep=()) -> DataFrame:
    """Runs of consecutive offsets in list order -> half-open ranges.

    A run continues while each offset is its predecessor + 1 (list order, as a
    group-by on value - index would give). Row-local: no shuffle, linear in the list.
    """
    keys = list(keys)
    a = F.col("_a")
    n = F.size(a)
    idx = F.sequence(F.lit(0), n - 1)
    heads = F.filter(idx, lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1) + 1))
    tails = F.filter(idx, lambda i: (i == n - 1) | (F.get(a, i + 1) != F.get(a, i) + 1))
    d = df.withColumn("_a", F.col(offsets)).where(F.size("_a") > 0)
    d = d.withColumn("_h", heads).withColumn("_t", tails)
    runs = F.transform("_h", lambda h, k: F.struct(k.alias("run_idx"), F.get(a, h).alias("start"), (F.get(a, F.get(F.col("_t"), k)) + 1).alias("end")))
    return d.select(*keys, *keep, F.inline(runs)).select(
        *keys, *keep, F.col("run_idx").cast("long"), F.col("start").cast("long"), F.col("end").cast("long")
    )


def ranges_to_offsets(ranges: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Every character offset of every range (``end > start`` guarded: ``sequence`` counts down)."""
    r = ranges.where(F.col("end") > F.col("start"))
    return r.withColumn("offset", F.explode(F.sequence(F.col("start"), F.col("end") - 1))).drop("start", "end")


def collect_offsets(ranges: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Ranges -> one row per key with sorted distinct ``array<int>`` offsets (for writing files).

    Only ranges are shuffled: they are merged and gathered per key, and the offsets are spelled out
    on that row."""
    keys = list(keys)
    merged = normalize_spans(ranges.select(*keys, "start", "end"), keys)
    r = merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_r"))
    offsets = F.flatten(F.transform("_r", lambda x: F.sequence(x["start"], x["end"] - 1)))
    return r.select(*keys, offsets.cast("array<int>").alias("offsets"))


def span_text(ranges: DataFrame, docs: DataFrame, keys=("doc_id",), text: str = "text") -> DataFrame:
    keys = list(keys)
    j = ranges.join(docs.select(*keys, text), on=keys, how="inner")
    return j.withColumn("span_text", F.expr(f"substring({text}, start + 1, `end` - start)")).drop(text)


# ---------------------------------------------------------------- normalisation and sweep
BLOCK = 1 << 16  # characters per block: the unit that bounds every per-group sweep


def split_blocks(ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cut each range at multiples of ``block``, adding ``_blk``: a range covering k blocks
    becomes k pieces. Sweeps keyed by (document, ..., _blk) then never hold more than one
    block of one document, however large the document is."""
    r = ranges.where(F.col("end") > F.col("start"))
    r = r.withColumn("_blk", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    lo, hi = F.col("_blk") * block, (F.col("_blk") + 1) * block
    return r.withColumn("start", F.greatest("start", lo)).withColumn("end", F.least("end", hi))


def _islands(r: DataFrame, keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    prev_end = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_new", F.when(prev_end.isNull() | (F.col("start") > prev_end), 1).otherwise(0))
    r = r.withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_isl").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_isl")


def normalize_spans(ranges: DataFrame, keys=("doc_id",), block: int | None = BLOCK) -> DataFrame:
    """Overlapping or adjacent ranges -> disjoint, non-adjacent ranges (per key group).

    Gaps-and-islands: a range opens a new island when it starts after the running
    maximum end of all earlier ranges (ordered by start). With ``block`` the ranges are
    first cut into blocks and merged per (group, block); only pieces touching a block
    boundary (at most two per block) are then stitched per group, so no window holds
    more than one block of a huge document or its boundary pieces.
    """
    keys = list(keys)
    r = ranges.where(F.col("end") > F.col("start")).select(*keys, "start", "end")
    if block is None:
        return _islands(r, keys)
    local = _islands(split_blocks(r, block), keys + ["_blk"]).drop("_blk")
    # one consumer: pieces touching a block boundary share one stitch bucket per group (at
    # most two pieces per block); every other piece is final and forms its own bucket
    edge = (F.col("start") % block == 0) | (F.col("end") % block == 0)
    local = local.withColumn("_bkt", F.when(edge, F.lit(-1)).otherwise(F.col("start")))
    return _islands(local, keys + ["_bkt"]).drop("_bkt")


def coverage(ranges: DataFrame, keys=("doc_id",), source: str = "source", weight: Column | None = None, block: int | None = BLOCK) -> DataFrame:
    """Coverage sweep: elementary segments ``(keys..., start, end, cover)`` with ``cover != 0``.

    Each source is normalized first so it counts once per character; every range
    becomes ``(start, +w)``, ``(end, -w)``; deltas are summed per point (map-side
    combine), a running sum over the points gives the cover of each segment up to the
    next point. One shuffle for any number of sources. With ``block`` the sweep runs per
    (group, character block), so segments are cut at block boundaries (merge them with
    :func:`merge_segments`).
    """
    keys = list(keys)
    r = ranges.select(*keys, source, "start", "end")
    r = split_blocks(r, block) if block is not None else r.where(F.col("end") > F.col("start")).withColumn("_blk", F.lit(0))
    # one shuffle on (group, block) serves the per-source merge, the per-point sum and the
    # sweep; merging inside a block is enough to count each source once per character
    r = r.repartition(*keys, "_blk")
    per_source = normalize_spans(r, keys + [source, "_blk"], block=None)
    per_source = per_source.withColumn("_w", F.lit(1) if weight is None else weight)
    ev = per_source.select(
        *keys, "_blk", F.explode(F.array(F.struct(F.col("start").alias("x"), F.col("_w").alias("d")), F.struct(F.col("end").alias("x"), (-F.col("_w")).alias("d")))).alias("e")
    ).select(*keys, "_blk", "e.x", "e.d")
    pts = ev.groupBy(*keys, "_blk", "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys, "_blk").orderBy("x")
    seg = pts.withColumn("cover", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nx", F.lead("x").over(w))
    return seg.where(F.col("nx").isNotNull() & (F.col("cover") != 0)).select(*keys, F.col("x").alias("start"), F.col("nx").alias("end"), "cover")


def merge_segments(segments: DataFrame, keys=("doc_id",), block: int | None = BLOCK) -> DataFrame:
    """Adjacent kept segments -> maximal ranges (they are already disjoint)."""
    return normalize_spans(segments, keys, block)
