"""Span cleaning: trim whitespace, snap to word limits (expand or collapse), drop short runs.

A document's ranges are gathered and meet its text once: the limits of the text's words and of its
white space are read off in one pass, as sorted arrays, and every range end finds its run by binary
search (``n log n`` for n ranges). Ranges that already carry their text, as on a stream, are cleaned where they
stand by the same rules as column expressions.
Ranges are half-open ``[start, end)``; the formulas use the inclusive last char.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.functions.text import ALNUM_CLASS, WHITESPACE_CHARS, WS_CLASS
from spanfold.operators.spans import normalize_spans


def _run_len(s: Column, pattern: str) -> Column:
    return F.length(F.regexp_extract(s, pattern, 0))


def _sub(text: Column, b: Column, e: Column) -> Column:
    """Inclusive code-point slice ``text[b..e]`` (0-based)."""
    return F.substring(text, b + 1, e - b + 1)


def trim_cols(text: Column, b: Column, e: Column) -> tuple[Column, Column]:
    """Shrink ``[b..e]`` off leading and trailing whitespace, never past one character."""
    b1 = F.least(b + _run_len(_sub(text, b, e), f"^{WS_CLASS}*"), e)
    e1 = F.greatest(e - _run_len(_sub(text, b1, e), f"{WS_CLASS}*\\z"), b1)
    return b1, e1


def expand_cols(text: Column, b: Column, e: Column) -> tuple[Column, Column]:
    """Grow both ends while the outside neighbour is alphanumeric (only when ``b < e``)."""
    left_run = _run_len(F.reverse(F.substring(text, F.lit(1), b)), f"^{ALNUM_CLASS}*")
    right_run = _run_len(F.substring(text, e + 2, F.length(text)), f"^{ALNUM_CLASS}*")
    grow = b < e
    return F.when(grow, b - left_run).otherwise(b), F.when(grow, e + right_run).otherwise(e)


def collapse_begin(text: Column, b: Column, e: Column) -> Column:
    """Begin moves right past a word cut at the left end and its delimiter (``collapse=True``)."""
    prev_alnum = F.substring(text, b, 1).rlike(ALNUM_CLASS)
    r = _run_len(F.substring(text, b + 1, F.length(text)), f"^{ALNUM_CLASS}*")
    return F.when((b < e) & (b > 0) & prev_alnum, F.least(b + r + 1, e)).otherwise(b)


def collapse_end(text: Column, b: Column, e: Column) -> Column:
    """End moves left past a word cut at the right end and its delimiter (after the begin moved)."""
    n = F.length(text)
    next_alnum = F.substring(text, e + 2, 1).rlike(ALNUM_CLASS)
    q = _run_len(F.reverse(F.substring(text, F.lit(1), e + 1)), f"^{ALNUM_CLASS}*")
    return F.when((e > b) & (e < n - 1) & next_alnum, F.greatest(e - q - 1, b)).otherwise(e)


def clip_ranges(ranges: DataFrame, docs: DataFrame | None, keys=("doc_id",), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Attach the text (unless ``docs`` is None and the ranges already carry it, as on a
    stream); clip ranges to it. Returns ``(clipped, violations)`` where violations lists
    ranges that reached past the text (the reference would raise ``IndexError``)."""
    keys = list(keys)
    j = ranges if docs is None else ranges.join(docs.select(*keys, text), on=keys, how="inner")
    j = j.withColumn("_n", F.length(text))
    bad = j.where((F.col("end") > F.col("_n")) | (F.col("start") < 0)).select(*keys, "start", "end", F.lit("beyond_text").alias("kind"))
    c = j.withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", "_n")).where(F.col("end") > F.col("start"))
    return c.drop("_n"), bad


_WORDS = re.compile(r"[^\W_]+")
_BLANKS = re.compile("[" + re.escape(WHITESPACE_CHARS) + "]+")


class RunIndex:
    """The limits of a text's words (letters and digits) or of its white space, found by binary search."""

    def __init__(self, text: str, pattern: re.Pattern):
        limits = np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)
        self.start, self.end = limits[:, 0], limits[:, 1]

    def around(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, end) of the run that holds each place; ``(place + 1, place)`` where there is none."""
        if not len(self.start):
            return place + 1, place
        k = np.searchsorted(self.start, place, "right") - 1
        inside = (k >= 0) & (place < self.end[k])
        return np.where(inside, self.start[k], place + 1), np.where(inside, self.end[k], place)


def clean_bounds(text: str, start: np.ndarray, end: np.ndarray, mode: str = "expand", steps=("trim", "snap")) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned bounds of ranges of one text; a range without a character of the text gets ``(0, 0)``."""
    n = len(text)
    b, e = np.maximum(start, 0), np.minimum(end, n) - 1
    some = b <= e
    b, e = np.where(some, b, 0), np.where(some, e, 0)
    if n and "trim" in steps:
        blanks = RunIndex(text, _BLANKS)
        b = np.minimum(np.maximum(blanks.around(b)[1], b), e)
        first = np.minimum(blanks.around(e)[0], e + 1)  # of the white space that e ends, e + 1 if e isn't white space
        e = np.maximum(np.maximum(first, b) - 1, b)
    if n and "snap" in steps and mode != "trim":
        words = RunIndex(text, _WORDS)
        before, behind = words.around(b - 1), words.around(e + 1)
        cut_left, cut_right = (before[0] < b) & (b > 0), (behind[1] > e + 1) & (e < n - 1)
        grow = b < e
        if mode == "expand":
            b, e = np.where(grow & cut_left, before[0], b), np.where(grow & cut_right, behind[1] - 1, e)
        else:
            b = np.where(grow & cut_left, np.minimum(np.maximum(words.around(b)[1], b) + 1, e), b)
            e = np.where((e > b) & cut_right, np.maximum(np.minimum(words.around(e)[0], e + 1) - 2, b), e)
    return np.where(some, b, 0), np.where(some, e + 1, 0)


def _clean_by_text(ranges: DataFrame, docs: DataFrame, mode: str, keys: list[str], text: str, steps) -> DataFrame:
    """Every document's ranges, gathered (a part of the input at a time, so no document's ranges need fit one row), cleaned on its text."""
    extra = [c for c in ranges.columns if c not in keys]
    part = ranges.withColumn("_part", F.spark_partition_id()).groupBy(*keys, "_part").agg(F.collect_list(F.struct(*extra)).alias("_items"))
    rows = part.join(docs.select(*keys, text), keys).select(F.col(text).alias("_text"), *keys, "_items")
    at = [extra.index("start"), extra.index("end")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(batch.num_columns - 1)
            flat = items.flatten()
            fields = flat.flatten()
            start, end = (fields[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in at)
            edge = np.append(0, np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False)))
            for k in range(batch.num_rows):
                own = slice(edge[k], edge[k + 1])
                start[own], end[own] = clean_bounds(batch.column(0)[k].as_py() or "", start[own], end[own], mode, steps)
            for k, bounds in zip(at, (start, end)):
                fields[k] = pa.array(bounds).cast(fields[k].type)
            cleaned = pa.ListArray.from_arrays(edge.astype(np.int32), pa.StructArray.from_arrays(fields, fields=list(flat.type)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:-1], cleaned], names=batch.schema.names[1:])

    cleaned = rows.mapInArrow(run, schema).select(*keys, F.inline("_items")).where(F.col("end") > F.col("start"))
    return cleaned.withColumns({c: F.col(c).cast("long") for c in ("start", "end")}).select(*ranges.columns)


def clean_ranges(ranges: DataFrame, docs: DataFrame | None, mode: str = "expand", min_len: int = 3, keys=("doc_id",), text: str = "text",
                 steps=("trim", "snap", "drop")) -> DataFrame:
    """Trim -> expand | collapse | none -> drop runs shorter than ``min_len`` characters.

    ``mode``: ``"expand"`` (reference default), ``"collapse"`` or ``"trim"`` (trim only).
    Ranges are clipped to the text; one without a character of the text is left out.
    Output ranges keep any extra columns of the input; they are not normalized (see
    :func:`clean_spans`).
    """
    keys = list(keys)
    d = _clean_on_row(ranges, mode, keys, text, steps) if docs is None else _clean_by_text(ranges, docs, mode, keys, text, steps)
    return drop_short_runs(d, min_len) if "drop" in steps else d


def _clean_on_row(ranges: DataFrame, mode: str, keys: list[str], text: str, steps) -> DataFrame:
    """Ranges that carry their text, by column expressions."""
    d, _ = clip_ranges(ranges, None, keys, text)
    t = F.col(text)
    b, e = F.col("start"), F.col("end") - 1
    if "trim" in steps:
        b, e = trim_cols(t, b, e)
        d = d.withColumn("_b", b).withColumn("_e", e)
        b, e = F.col("_b"), F.col("_e")
    if "snap" in steps and mode == "expand":
        b, e = expand_cols(t, b, e)
    elif "snap" in steps and mode == "collapse":
        d = d.withColumn("_b2", collapse_begin(t, b, e))
        b = F.col("_b2")
        e = collapse_end(t, b, e)
    d = d.withColumn("start", b.cast("long")).withColumn("end", (e + 1).cast("long"))
    return d.drop(text, "_b", "_e", "_b2")


def drop_short_runs(ranges: DataFrame, min_len: int = 3) -> DataFrame:
    """Keep a run only if it has at least ``min_len`` characters (inclusive ``end - begin > 1``)."""
    return ranges.where(F.col("end") - F.col("start") >= min_len)


def clean_spans(ranges: DataFrame, docs: DataFrame, mode: str = "expand", min_len: int = 3, keys=("doc_id",), text: str = "text", group=()) -> DataFrame:
    """Flagship cleaning job: clean every run, then merge duplicates/overlaps per
    ``keys + group`` (two runs expanded into one word would otherwise repeat offsets)."""
    keys = list(keys)
    c = clean_ranges(ranges, docs, mode, min_len, keys, text)
    return normalize_spans(c.select(*keys, *group, "start", "end"), keys + list(group))
