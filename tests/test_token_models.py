"""Token models where the texts are read: feature numbers, margins and window summaries against the plain forms."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as E
from spanfold.operators import modeling as ML
from spanfold.operators import span_model as N
from spanfold.plans import fixtures as X
from spanfold.plans import q_model as Q

from conftest import SF001


def test_hashes_are_those_of_the_hasher(spark):
    from pyspark.ml.feature import FeatureHasher

    words = ["", "a", "ab", "abc", "abcd", "abcde", "bé", "世界", "🙂", "x" * 1001, "<s>"]
    df = spark.createDataFrame([(w,) for w in words], "f_w string")
    out = FeatureHasher(inputCols=["f_w"], outputCol="v", numFeatures=1 << 18).transform(df).select("f_w", "v").collect()
    got = ML.murmur3(pa.array([f"f_w={r['f_w']}" for r in out])).astype(np.int64) % (1 << 18)
    assert got.tolist() == [int(r["v"].indices[0]) for r in out]
    assert ML.murmur3(pa.array(["skip", "abc", "abcde"]).slice(1)).tolist() == ML.murmur3(pa.array(["abc", "abcde"])).tolist()


def test_margins_are_those_of_the_pipeline(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["good", "bad", "fine", "", "odd", "very", "longest"])
    rows = [(k, w := word(), word(), word(), rng.choice(["cap", "low"]), int(w == "bad")) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, f_w string, f_prev string, f_next string, f_shape string, label int")
    # 16 features: most collide
    for size in (16, 1 << 18):
        model = ML.fit_token_model(df, "label", num_features=size, max_iter=5)
        hashed = ML.fit_token_model(ML.hashed_features(df, size), "label", num_features=size, max_iter=5)
        assert np.allclose(model.stages[-1].coefficients.toArray(), hashed.stages[-1].coefficients.toArray(), atol=1e-9)
        want = {r["k"]: (r["p"], r["z"]) for r in model.transform(df).select("k", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("z")).collect()}
        for r in ML.apply_token_model(model, df, "t").collect():
            assert abs(r["t_prob"] - want[r["k"]][0]) < 1e-9 and abs(r["t_logit"] - want[r["k"]][1]) < 1e-9


@pytest.mark.parametrize("batch", [3, 10000])
def test_window_summaries_in_order(spark, batch):
    rng = random.Random(11)
    rows = []
    for doc in range(9):
        toks = [(doc, i, 5 * i, 5 * i + 4, rng.uniform(-3, 3), rng.uniform(-3, 3), 0.0, int(rng.random() < 0.1), int(rng.random() < 0.1)) for i in range(rng.choice([1, 8, 9, 40]))]
        rows += [r for r in toks for _ in range(1 + doc % 2)]  # every other id has two texts
    cols = "doc_id long, tok_idx long, start long, end long, start_logit double, end_logit double, logit1 double, is_start int, is_end int"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        df = spark.createDataFrame(rows, cols).repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id", "tok_idx")
        for frame in (df, df.drop("is_start", "is_end")):
            look = lambda **kw: {(r["doc_id"], r["window_id"]): r for r in N.window_summaries(frame, 8, 3, 4, 3, **kw).collect()}  # noqa: E731, B023
            want, got = look(), look(in_order=True)
            assert set(got) == set(want)
            for k, r in want.items():
                assert all(got[k][c] == r[c] for c in ("n_tokens", "answered", "best", "log_tokens"))
                assert all(abs(got[k][c] - r[c]) < 1e-9 for c in ("mean_start", "mean_end"))
    finally:
        spark.conf.set(name, before)


def test_frames_shuffle_no_token(spark):
    feats, _ = Q.span_frames(spark, SF001)
    plan = feats()._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(tok_idx|start|end)", plan)
    assert "MapInArrow" in plan and not re.search(r"Window \[.*tok_idx", plan)
