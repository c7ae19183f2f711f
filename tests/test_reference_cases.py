"""The reference's own unit tests and doctests, re-created as small DataFrames (FIXTURES.md §2)."""

import pytest
from pyspark.sql import functions as F

from spanfold.operators import cleaning as C
from spanfold.operators import joins as J
from spanfold.operators import metrics as M
from spanfold.operators import spans as S

from conftest import ranges_df

GOLD = {0: [(12, 22)], 1: [(55, 61)], 2: [(80, 90), (176, 181)], 3: []}


def _gold_df(spark):
    rows = [(d, s, e) for d, rs in GOLD.items() for s, e in rs]
    return spark.createDataFrame(rows, "doc_id long, start long, end long")


def _docs(spark, ids=(0, 1, 2, 3)):
    return spark.createDataFrame([(i,) for i in ids], "doc_id long")


def _score(spark, pred_rows):
    pred = spark.createDataFrame(pred_rows, "doc_id long, source string, start long, end long")
    sc = M.doc_prf(_docs(spark), pred, _gold_df(spark), ["sys"])
    return M.system_f1_sem(sc).collect()[0]


def test_perfect_predictions(spark):
    rows = [(d, "sys", s, e) for d, rs in GOLD.items() for s, e in rs]
    r = _score(spark, rows)
    assert r["mean_f1"] == pytest.approx(1.0) and r["sem_f1"] == pytest.approx(0.0)


def test_all_empty_predictions(spark):
    r = _score(spark, [])
    assert r["mean_f1"] == pytest.approx(0.25) and r["sem_f1"] == pytest.approx(0.25)


def test_wrong_id_is_a_violation(spark):
    pred_ids = spark.createDataFrame([(8,), (1,), (2,), (3,)], "doc_id long")
    v = {(r["kind"], r["doc_id"]) for r in J.validate_submission(pred_ids, _docs(spark)).collect()}
    assert v == {("unknown_id", 8), ("missing_id", 0)}


def test_f1_doctest(spark):
    # F1 of offsets [0,1,4,5] against [0,1,6]
    pred = ranges_df(spark, [(0, "p", 0, 2), (0, "p", 4, 6)])
    gold = spark.createDataFrame([(0, 0, 2), (0, 6, 7)], "doc_id long, start long, end long")
    f1 = M.doc_prf(_docs(spark, [0]), pred, gold, ["p"]).collect()[0]["f1"]
    assert f1 == 0.5714285714285714


def test_agreement_of_three_empty_coders_is_one(spark):
    codes = spark.createDataFrame([], "doc_id long, coder string, start long, end long")
    r = M.pairwise_agreement(_docs(spark, [0]), codes, ["a", "b", "c"]).groupBy("doc_id").agg(F.avg("f1").alias("a")).collect()
    assert r[0]["a"] == 1.0


def test_contiguous_ranges(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 5, 6, 7])], "doc_id long, offsets array<int>")
    got = [(r["start"], r["end"] - 1) for r in S.offsets_to_ranges(df).orderBy("start").collect()]
    assert got == [(1, 3), (5, 7)]


# (text, input inclusive runs, expected inclusive runs) -- trim mode, runs of < 3 chars dropped
TRIM_CASES = [
    ("To infinity and    beyond.", [(2, 10), (12, 14)], [(3, 10), (12, 14)]),
    ("To infinity and   beyond.", [(3, 14)], [(3, 14)]),
    ("To infinity and   beyond.", [(3, 10), (12, 17), (19, 24)], [(3, 10), (12, 14), (19, 24)]),
    ("To infinity and    beyond.", [(3, 10), (13, 13), (19, 24)], [(3, 10), (19, 24)]),
    ("To \tinfinity and\n   beyond.", [(3, 11), (13, 19), (21, 26)], [(4, 11), (13, 15), (21, 26)]),
]


@pytest.mark.parametrize("text,runs,expected", TRIM_CASES)
def test_trim_cleaner_cases(spark, text, runs, expected):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    r = spark.createDataFrame([(0, b, e + 1) for b, e in runs], "doc_id long, start long, end long")
    got = C.clean_ranges(r, docs, mode="trim", steps=("trim", "drop")).orderBy("start").collect()
    assert [(x["start"], x["end"] - 1) for x in got] == expected
