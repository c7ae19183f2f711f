"""Vectors are looked up once a word of the vocabulary; tokens get what the look-up by id gives them."""

from pyspark.sql import functions as F

from spanfold.operators import joins as J
from spanfold.plans import q_tokens as Q

from conftest import SF001


def test_norms_are_those_of_the_tokens_ids(spark):
    from spanfold.sources.tables import embeddings

    got = Q._token_vectors(spark, SF001)
    want = J.vector_lookup(Q._ids(spark, SF001), embeddings(spark, SF001)).select("doc_id", "tok_idx", "word_id", J.l2_norm(F.col("vector")).alias("norm"))
    rows = lambda df: sorted((r["doc_id"], r["tok_idx"], r["word_id"], round(r["norm"], 9)) for r in df.collect())
    assert rows(got) == rows(want)


def test_carried_columns(spark):
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "new"), (1, 3, None)], "doc_id long, tok_idx long, tok string")
    vocab = spark.createDataFrame([("a", 2, 0.5), ("b", 3, None)], "word string, idx long, norm double")
    got = sorted(tuple(r) for r in J.vocab_lookup(tokens, vocab, carry=("norm",)).select("tok_idx", "word_id", "norm").collect())
    assert got == [(0, 2, 0.5), (1, 3, None), (2, 1, None), (3, 1, None)]


def test_no_token_carries_its_id_through_a_shuffle(spark):
    plan = Q.q_vector_lookup(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word_id" not in plan
