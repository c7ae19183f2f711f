"""Operator 6, quality classifier by importance resampling.

Two generative models over hashed n-grams (words and word pairs in ``BUCKETS`` buckets) are counted:
one over the target text and one over all raw text. A document's log weight is the sum over its
n-grams of log(target share / raw share), the log ratio of the two models; with a Gumbel number drawn by
a keyed hash of its id added, the ``share`` of all documents with the largest sums is a sample without
replacement in proportion to the ratios (Gumbel top-k).

The raw model counts every document. The target documents are a documented, bounded sample: the
``TARGETS`` ids with the smallest key hash among those given as target. The cut for the top k is
found exactly by counting scores per bin and refining the bin that holds it; nothing is sorted as a
whole or collected.

Defined results: null or blank text has no n-grams and log weight 0; ties at the cut go to the
smaller id, null last, and among rows of one id to the earlier one, so that exactly ``share`` of all rows is kept; without target documents both models are equal and the sample is uniform; repeated rows
get the same score; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import fresh, key_hash, written
from spanfold.llm.words import hashed_words, scramble

BUCKETS, TARGETS, SMOOTH = 1 << 16, 20_000, 1.0
BINS = 4096


def grams(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and word pair."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair = scramble(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    inside = row[:-1] == row[1:]
    bucket = np.concatenate([hashes, pair[inside]]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([row, row[:-1][inside]])


def models(docs: DataFrame, targets: list[int], id_col: str, text_col: str) -> np.ndarray:
    """log(target share / raw share) of each bucket."""
    chosen = np.array(sorted(targets), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            wanted = np.isin(ids, chosen) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, hashes, bounds in hashed_words(batch.column(1), lower=True):
                bucket, row = grams(hashes, bounds)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[wanted[first + row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(target[at])], names=["at", "raw", "target"])

    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "at long, raw long, target long")
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for r in counted.groupBy("at").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["at"]] += r["raw"]
        target[r["at"]] += r["target"]
    if not targets:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id, n_grams, log_weight`` of every row; row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, hashes, bounds in hashed_words(batch.column(1), lower=True):
                bucket, row = grams(hashes, bounds)
                rows = len(bounds) - 1
                n[first : first + rows] = np.bincount(row, minlength=rows)
                total[first : first + rows] = np.bincount(row, weights=ratio[bucket], minlength=rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total)], names=[id_col, "n_grams", "log_weight"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, n_grams long, log_weight double")


def gumbel(id_col: str, seed: int) -> Column:
    """A Gumbel number that depends on the id and the seed only."""
    u = (key_hash(F.col(id_col), F.lit(seed)) + 0.5) / F.lit(float(2**60))
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, k: int, score: str, tie: str, number: str) -> Column:
    """Is a row among the ``k`` with the largest score? Ties: smallest ``tie``, null last, then smallest ``number`` (different
    in every row), so exactly ``k`` rows are. Refines one bin after another."""
    low, high, total = rows.agg(F.min(score), F.max(score), F.count("*")).first()
    if k >= (total or 0):
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    above = 0  # rows over the current range
    value = F.col(score)
    while low < high:
        width = (high - low) / BINS
        bin_of = F.least(F.floor((value - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        counted = rows.where((value >= low) & (value <= high)).groupBy(bin_of.cast("int").alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        for r in sorted(counted.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["lo"], r["hi"]) == (low, high):  # equal up to rounding
            break
        low, high = r["lo"], r["hi"]
    # the rows left are equal in score: the smallest ids among them, then row numbers, fill the rest
    need = k - above
    tied = rows.where((value >= low) & (value <= high))
    known = tied.where(F.col(tie).isNotNull())
    n_known = known.count()
    if need <= n_known:
        last = _nth(known, tie, need)
        same = F.col(tie) == last
        first, need = F.col(tie) < last, need - known.where(F.col(tie) < last).count()
    else:
        same = F.col(tie).isNull()
        first, need = F.col(tie).isNotNull(), need - n_known
    rest = same & (F.col(number) <= _nth(tied.where(same), number, need)) if need else F.lit(False)
    return F.coalesce((value > high) | ((value >= low) & (first | rest)), F.lit(False))


def _nth(rows: DataFrame, col: str, n: int) -> int:
    """The n-th smallest value of an integer column, by halving its range."""
    low, high = rows.agg(F.min(col), F.max(col)).first()
    while low < high:
        middle = (low + high) // 2
        if rows.where(F.col(col) <= middle).count() >= n:
            high = middle
        else:
            low = middle + 1
    return low


def resample(docs: DataFrame, targets: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``id, n_grams, log_weight, score, kept`` of every row; ``targets``: ids (``id_col``) of the target documents."""
    ids = targets.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    chosen = [r["id"] for r in ids.orderBy(key_hash(F.col("id")), "id").limit(TARGETS).collect()]
    ratio = models(docs, chosen, id_col, text_col)
    scored = weights(docs, ratio, id_col, text_col).withColumn("score", F.col("log_weight") + gumbel(id_col, seed))
    number = fresh(scored, "_number")[0]
    rows = written(scored.withColumn(number, F.monotonically_increasing_id()), "dsir_scores")
    return rows.withColumn("kept", top_k(rows, round(share * rows.count()), "score", id_col, number)).drop(number)
