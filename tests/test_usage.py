"""The README's 'own data' example runs end to end and gives the hand-checked numbers."""

import pytest
from pyspark.sql import functions as F

from spanfold.operators import cleaning as C
from spanfold.operators import ensemble as E
from spanfold.operators import joins as J
from spanfold.operators import metrics as M
from spanfold.operators import spans as S
from spanfold.session import scratch_path
from spanfold.sources import span_files as SF


def test_readme_flow(spark):
    docs = spark.createDataFrame([(0, "You are a total   idiot, really."), (1, "Nice day.")], "doc_id long, text string")
    gold = spark.createDataFrame([(0, [10, 11, 12, 13, 14, 18, 19, 20, 21, 22]), (1, [])], "doc_id long, spans array<int>")
    path = scratch_path(spark, "train_csv")
    SF.write_span_csv(gold.join(docs, "doc_id"), path)
    posts = SF.read_span_csv(spark, path)
    clean = C.clean_spans(S.offsets_to_ranges(posts, "spans"), posts, mode="expand")
    assert sorted((r["start"], r["end"]) for r in clean.collect()) == [(10, 15), (18, 23)]
    preds = spark.createDataFrame([(0, "A", 16, 23), (0, "B", 18, 30), (0, "C", 18, 23)], "doc_id long, source string, start long, end long")
    vote = E.span_vote(preds, 2).withColumn("source", F.lit("vote"))
    scores = M.doc_prf(posts, preds.unionByName(vote), clean, ["A", "B", "C", "vote"])
    got = {r["source"]: r["f1"] for r in M.system_prf(scores).collect()}
    # doc 0: gold "total" + "idiot" (10 chars); C and the vote find "idiot" (F1 2*5/15); doc 1: empty/empty = 1
    assert got["C"] == pytest.approx((2 * 5 / 15 + 1) / 2)
    assert got["vote"] == pytest.approx(got["C"])
    # A covers 16..22 (5 of its 7 chars in gold) -> F1 2*5/(7+10)
    assert got["A"] == pytest.approx((2 * 5 / 17 + 1) / 2)


def test_prediction_file_round_trip_with_quarantine(spark):
    path = scratch_path(spark, "preds_txt")
    lines = spark.createDataFrame([("0\t[1, 2, 3]",), ("1\t[]",), ("2\toops",), ("bad line",), ("x\t[1]",)], "value string")
    lines.write.text(path)
    good, bad = SF.read_predictions(spark, path)
    assert sorted((r["doc_id"], r["offsets"]) for r in good.collect()) == [(0, [1, 2, 3]), (1, []), (2, [])]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_id", "field_count"]


def test_stored_threshold_is_reused(spark):
    path = scratch_path(spark, "stored")
    sweep = spark.createDataFrame([(0.25, 0.5, 0), (0.5, 0.75, 1)], "threshold double, mean_f1 double, is_best int")
    assert [tuple(r) for r in SF.saved_threshold(spark, path, lambda: sweep).collect()] == [(0.5, 0.75)]

    def fail():
        raise AssertionError("the stored value must be used")

    assert [tuple(r) for r in SF.saved_threshold(spark, path, fail).collect()] == [(0.5, 0.75)]


def test_split_without_gold_and_null_split(spark):
    path = scratch_path(spark, "no_gold")
    SF.write_span_csv(spark.createDataFrame([(1, [0, 1], 'a "b",\nc')], "doc_id long, spans array<int>, text string"), path)
    assert [tuple(r) for r in SF.read_span_csv(spark, path, gold=False).collect()] == [(1, [], 'a "b",\nc')]
    path = scratch_path(spark, "splits")
    rows = spark.createDataFrame([(1, "x", "en"), (2, "y", None), (3, "z", "7")], "doc_id long, text string, lang string")
    SF.write_splits(rows, path, "lang")
    back = SF.load_splits(spark, path, rows.drop("lang").schema)
    assert sorted(map(tuple, back.collect())) == [(1, "x", "en"), (2, "y", None), (3, "z", "7")]


def test_keyed_values_look_independent(spark):
    """Runs of kept characters and bands of one split are as short as independent draws give."""
    from pyspark.sql import functions as F

    from spanfold.operators.modeling import keyed_uniform

    ids = [r[0] for r in spark.range(5000).orderBy("id").select(keyed_uniform(F.col("id"), F.lit(0))).collect()]
    by_pos = [r[0] for r in spark.range(5000).orderBy("id").select(keyed_uniform(F.lit(77), F.col("id"))).collect()]

    def mean_run(flags):
        return len(flags) / (1 + sum(a != b for a, b in zip(flags, flags[1:])))

    assert 0.78 < sum(u < 800 for u in ids) / 5000 < 0.82 and 2.8 < mean_run([u < 800 for u in ids]) < 3.5
    assert 0.47 < sum(u < 500 for u in by_pos) / 5000 < 0.53 and 1.85 < mean_run([u < 500 for u in by_pos]) < 2.15


def test_unknown_words_have_zero_vectors(spark):
    tokens = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 9)], "doc_id long, tok_idx long, word_id long")
    vectors = spark.createDataFrame([(1, [9.0, 9.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    got = sorted((r["tok_idx"], r["vector"]) for r in J.vector_lookup(tokens, vectors).collect())
    assert got == [(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])]
