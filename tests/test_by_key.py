"""Ablations and words of pieces in document order against the window forms; texts of one id are one group."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from spanfold.operators import attribution as A
from spanfold.operators import tokens as T
from spanfold.plans import q_model as Q

from conftest import SF001

DOCS = [(0, "one two  three"), (1, "x"), (2, "x"), (3, " lead"), (3, " lead"), (4, ""), (5, "世界 🙂 and-a-long-one b"), (6, "a b c"), (6, "a b c"), (6, "a b c"), (7, "end ")]


@pytest.fixture(params=[1, 4, 10000])
def tokens(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    d = spark.createDataFrame([*DOCS, (None, "no id"), (None, "none")], "doc_id long, text string")
    yield T.tokenize_offsets(d.repartition(2, "doc_id").sortWithinPartitions("doc_id"))
    spark.conf.set(name, before)


def rows(df):
    return sorted(map(str, df.collect()))


def test_ablations(tokens):
    t = tokens.select("doc_id", "tok_idx", "tok")
    cols = ["doc_id", "tok_idx", "tok", "ss_start", "ablated_len"]
    got = A.erasure_ablations(t, in_order=True).select(cols)
    assert rows(got) == rows(A.erasure_ablations(t).select(cols))
    three = sorted((r["tok_idx"], r["ss_start"], r["ablated_len"]) for r in got.where("doc_id = 0").collect())
    assert three == [(0, 0, 16), (1, 4, 16), (2, 8, 14)]  # "one two three" with a word masked


def test_words_of_pieces(tokens):
    p = Q.pieces(tokens)
    got = A.words_from_pieces(p, in_order=True)
    want = A.words_from_pieces(p)
    key = lambda df: sorted((str(r["doc_id"]), r["word_idx"], r["start"], r["end"], str(r["weight"])[:12]) for r in df.collect())
    # without an id the weights of the pieces are null; texts that share none differ, so which of them comes first is open
    assert key(got.where("doc_id is not null")) == key(want.where("doc_id is not null"))
    lost = lambda df: [(r["word_idx"], r["weight"]) for r in df.where("doc_id is null").orderBy("word_idx").collect()]
    assert lost(got) == lost(want)
    some = p.withColumn("word_start", F.col("tok_idx") % 2 == 0).where("doc_id is not null")
    some = some.withColumn("weight", F.when(F.col("tok_idx") > 0, F.col("weight")))
    assert key(A.words_from_pieces(some, in_order=True)) == key(A.words_from_pieces(some))


@pytest.mark.parametrize("name", ["erasure_ablations", "words_from_pieces"])
def test_no_word_is_shuffled(spark, name):
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window \[[^\]]*tok_idx", plan) and plan.count("Exchange") <= 1


def test_positions_read_tokens_of_documents_with_runs(spark):
    plan = E.queries()["window_answer_positions"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 1
