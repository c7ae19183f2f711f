"""The span cleaner's run index against the column expressions, and its cost."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanfold.operators import cleaning as C

ALPHABET = list("abZ09éß中文😀_") + list(" \t\n\r\x0b\x0c") + list(".,-'")


@pytest.mark.parametrize("mode", ["expand", "collapse", "trim"])
@pytest.mark.parametrize("steps", [("trim", "snap", "drop"), ("snap",), ("trim",), ("drop",)])
def test_equal_to_expressions_on_the_row(spark, mode, steps):
    rng = random.Random(3)
    docs = [(d, "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 30])))) for d in range(60)]
    rows = [(rng.randrange(62), rng.choice("ABC"), a := rng.randrange(-2, 34), a + rng.randrange(-1, 12)) for _ in range(1500)]
    ranges = spark.createDataFrame(rows, "doc_id long, source string, start int, end int")
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    got = C.clean_ranges(ranges, texts, mode, steps=steps)
    want = C.clean_ranges(ranges.join(texts, "doc_id"), None, mode, steps=steps)
    assert got.columns == want.columns and got.schema["start"].dataType == want.schema["start"].dataType
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_ranges_in_a_long_text():
    """Ten thousand ranges in a megabyte: one pass over the text, then binary searches."""
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefg   .\n"), 1_000_000))
    start = rng.integers(0, len(text), 10_000)
    end = start + rng.integers(1, 50, 10_000)
    began = time.time()
    for mode in ("expand", "collapse"):
        C.clean_bounds(text, start, end, mode)
    first = time.time() - began
    began = time.time()
    C.clean_bounds("x" * 1_000_000, start, end)
    assert first < 4 and time.time() - began < 1


def test_text_is_shuffled_once_a_document(spark):
    ranges = spark.range(1000).select((F.col("id") % 3).alias("doc_id"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
    docs = spark.createDataFrame([(d, "some words here " * 100) for d in range(3)], "doc_id long, text string")
    cleaned = C.clean_ranges(ranges, docs)
    assert cleaned.count() > 900
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "Cartesian" not in plan
