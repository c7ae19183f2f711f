"""Ranks over ranges of scores: exact average ranks and AUC, evenly filled ranges however the scores lie."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanfold.operators import metrics as M


def average_ranks(values):
    order = np.sort(values)
    return (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right") + 1) / 2


def crowded(n, seed=3):
    """Nearly all scores in one thousandth of the range, a few far off, ties, both zeros and infinities."""
    rng = np.random.default_rng(seed)
    s = 0.5 + rng.random(n) / 1000
    s[: n // 50] = rng.normal(0, 300, n // 50)
    s[n // 50 : n // 10] = np.round(s[n // 50 : n // 10], 5)
    s[:4] = [0.0, -0.0, math.inf, -math.inf]
    return s


def frame(spark, s, y):
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")


@pytest.mark.parametrize("rows", [1 << 20, 500, 7])
def test_ranks_equal_a_sort_at_every_size_of_range(spark, rows):
    s = crowded(2000)
    ties = frame(spark, s, s > 0).groupBy(F.col("score").alias("s")).agg(F.count("*").alias("c"))
    got = {r["s"]: r["avg_rank"] for r in M.score_ranks(ties, rows).collect()}
    assert [got[v] for v in s.tolist()] == average_ranks(s).tolist()


def test_ranges_are_even_on_crowded_scores(spark):
    s = crowded(20_000)
    ties = frame(spark, s, s > 0).select(F.col("score").alias("s")).distinct().withColumn("c", F.lit(1))
    sizes = [r["count"] for r in M.score_ranges(ties, 500).groupBy("b").count().collect()]
    assert len(sizes) >= 32 and max(sizes) <= 1.25 * sum(sizes) / len(sizes)


def test_metrics_equal_counting_on_crowded_scores(spark, monkeypatch):
    s = crowded(3000)[4:]
    y = (np.random.default_rng(5).random(len(s)) < 0.3).astype(int)
    monkeypatch.setattr(M, "RANGE_ROWS", 100)
    got = M.classification_metrics(frame(spark, s, y)).first()
    ranks, n1 = average_ranks(s), y.sum()
    auc = (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    p = s > 0.5
    tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
    assert math.isclose(got["roc_auc"], auc, rel_tol=1e-12)
    assert math.isclose(got["f1"], 2 * tp / (2 * tp + fp + fn)) and math.isclose(got["accuracy"], (p == y).mean())
    assert math.isclose(got["precision"], tp / (tp + fp)) and math.isclose(got["recall"], tp / (tp + fn))
    assert math.isclose(got["mse"], ((s - y) ** 2).mean())


def test_rows_without_label_or_score_do_not_count(spark):
    rows = [(0.9, 1), (0.2, 0), (None, 1), (0.7, None), (float("nan"), 0), (0.2, 1)]
    got = M.classification_metrics(spark.createDataFrame(rows, "score double, label int")).first()
    assert (got["precision"], got["recall"], got["roc_auc"]) == (1.0, 0.5, 0.75)
    none = M.classification_metrics(spark.createDataFrame([], "score double, label int")).first()
    assert none["f1"] == 0.0 and none["roc_auc"] is None and none["mse"] is None
    one = M.classification_metrics(spark.createDataFrame([(0.1, 0)], "score double, label int")).first()
    assert one["accuracy"] == 1.0 and one["roc_auc"] is None
