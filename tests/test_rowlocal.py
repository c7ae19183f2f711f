"""Row-local windows and sums against the window forms, with batches that cut documents anywhere."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from spanfold.operators import candidates as K
from spanfold.operators import rowlocal as R
from spanfold.operators import tokens as T

from conftest import SF001


@pytest.fixture(params=[1, 3, 10, 10000])
def batch(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def scores(spark, parts=3):
    rng = random.Random(7)
    rows = []
    for doc in range(12):
        n = rng.choice([1, 2, 9, 10, 31])
        for i in range(n):
            logit = lambda: rng.choice([-1.5, 0.0, 2.25, rng.uniform(-3, 3)])
            rows.append((None if doc == 5 else doc // 2, doc % 2, i, 6 * i, 6 * i + 4, logit(), logit(), logit()))
    df = spark.createDataFrame(rows, "doc_id long, turn long, tok_idx long, start long, end long, start_logit double, end_logit double, logit1 double")
    # documents whole and in order inside a partition, as the row-local tokenizer leaves them
    return df.repartitionByRange(parts, "doc_id", "turn").sortWithinPartitions("doc_id", "turn", "tok_idx")


KEYS = ("doc_id", "turn")


def flat(top):
    return sorted((str(r["doc_id"]), r["turn"], r["window_id"], r["starts"], r["ends"]) for r in top.collect())


def test_windows_equal_the_window_form(spark, batch):
    s = scores(spark)
    for length, stride, n_best in ((10, 4, 3), (8, 0, 20), (400, 128, 5)):
        want = K.window_top(T.window_tokens(s, length, stride, KEYS), n_best, (*KEYS, "window_id"))
        assert flat(R.window_top(s, length, stride, n_best, KEYS)) == flat(want)


def test_document_sums(spark, batch):
    s = scores(spark).withColumn("v", F.when(F.col("tok_idx") % 3 != 1, F.col("logit1")))
    want = {}
    for r in s.collect():
        want[r["doc_id"], r["turn"]] = want.get((r["doc_id"], r["turn"]), 0.0) + (r["v"] or 0.0)
    got = R.document_sum(s, "v", "total", KEYS)
    assert got.columns == [*s.columns, "total"]
    rows = got.collect()
    assert len(rows) == s.count()
    assert all(abs(r["total"] - want[r["doc_id"], r["turn"]]) < 1e-9 for r in rows)


def test_empty_input(spark):
    s = scores(spark).where("false")
    assert R.window_top(s, keys=KEYS).collect() == [] and R.document_sum(s, "logit1", "total", KEYS).collect() == []


def test_neighbouring_documents_with_one_id(spark, batch):
    """Two rows of one id next to each other stay two documents: each begins at token 0."""
    rows = [(1, i, i, i + 1, 1.0, 1.0, 1.0) for n in (2, 3) for i in range(n)]
    s = spark.createDataFrame(rows, "doc_id long, tok_idx long, start long, end long, start_logit double, end_logit double, logit1 double").coalesce(1)
    assert [len(r["starts"]) for r in R.window_top(s).collect()] == [2, 3]
    assert [r["total"] for r in R.document_sum(s, "logit1", "total").collect()] == [2.0, 2.0, 3.0, 3.0, 3.0]


def test_texts_of_one_id_share_its_windows(spark, batch):
    """Repeated and null ids (null logits) give the window form's pairs: tokens of equal number tie."""
    rng = random.Random(3)
    rows = []
    for doc, sizes in ((1, (31, 31, 4)), (None, (9, 17)), (2, (1,)), (3, (40,)), (4, (12, 12))):
        logits = [(None,) * 3 if doc is None else tuple(rng.choice([-1.0, 0.5, rng.uniform(-3, 3)]) for _ in range(3)) for _ in range(max(sizes))]
        rows += [(doc, turn, i, 6 * i, 6 * i + 4, *logits[i]) for turn, n in enumerate(sizes) for i in range(n)]
    s = spark.createDataFrame(rows, "doc_id long, turn long, tok_idx long, start long, end long, start_logit double, end_logit double, logit1 double")
    s = s.repartition(3, "doc_id").sortWithinPartitions("doc_id", "turn", "tok_idx").drop("turn")
    cols = ("doc_id", "window_id", "start_tok", "end_tok", "start_rank", "end_rank")
    listed = lambda pairs: sorted(map(str, pairs.select(*cols).collect()))
    for length, stride, n_best in ((10, 4, 3), (8, 0, 20), (400, 128, 5)):
        want = listed(K.nbest_pairs(s, n_best, 6, length, stride))
        assert want and listed(K.nbest_pairs(s, n_best, 6, length, stride, in_order=True, by_key=True)) == want
    empty = s.where("false")
    assert K.nbest_pairs(empty, in_order=True, by_key=True).collect() == []


def test_nbest_pairs_shuffle_texts_only(spark):
    plan = E.queries()["nbest_pairs"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan


@pytest.mark.parametrize("name", ["nbest_spans", "erasure_scores"])
def test_no_token_is_shuffled(spark, name):
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
