"""Token labels from texts that carry their ranges, against the joined form; no token is shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from spanfold.operators import tokens as T

from conftest import SF001


@pytest.fixture(params=[1, 3, 10000])
def batch(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def rows(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bcé", "d", "世界", "longer", "x.", "🙂🙂"])
    text = lambda: rng.choice(["", " "]) + rng.choice([" ", "  "]).join(word() for _ in range(rng.choice([0, 1, 2, 7, 30])))
    docs = [(i, text()) for i in range(n)]
    docs += [docs[3], docs[7], docs[7], (None, text()), (None, text()), (n, None), (n + 1, " ".join(["word"] * 40000))]
    gold = []
    for i, t in docs:
        at = 0
        while t and at < len(t) and at < 300:
            a = at + rng.randrange(0, 6)
            b = a + rng.randrange(1, 9)
            gold.append((i, a, b))
            at = b + 1
    return docs, gold


def labelled(spark, docs, gold, threshold, words=False):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    g = spark.createDataFrame(gold, "doc_id long, start long, end long")
    t = T.tokenize_offsets(T.with_ranges(d, g), ranges="ranges", words=words)
    return T.token_label_overlap(t, None, threshold, covered="covered")


@pytest.mark.parametrize("threshold", [0.0, 0.5])
def test_labels_equal_the_joined_form(spark, batch, threshold):
    docs, gold = rows(5)
    once = sorted({(d, t) for d, t in docs if d is not None}, key=lambda r: r[0]) if threshold else docs
    gold = sorted(set(gold), key=str) if threshold else gold
    gold = [g for g in gold if g[0] is not None]
    # ranges of an id are disjoint: texts that come twice give theirs once
    seen, apart = {}, []
    for d, a, b in sorted(gold):
        if a >= seen.get(d, 0):
            apart.append((d, a, b))
            seen[d] = b
    got = labelled(spark, once, apart, threshold).select("doc_id", "tok_idx", "tok", "start", "end", "label")
    t = T.tokenize_offsets(spark.createDataFrame(once, "doc_id long, text string"))
    want = T.token_label_overlap(t, spark.createDataFrame(apart, "doc_id long, start long, end long"), threshold)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["tok_idx"])
    with_id = lambda df: sorted((tuple(r) for r in df.where("doc_id is not null").collect()))
    assert with_id(got) == with_id(want.select(*got.columns))
    # without an id: one row a number, never labelled
    lost = [(r["tok_idx"], r["label"]) for r in sorted(got.where("doc_id is null").collect(), key=key)]
    longest = max([len((t or "").split()) for d, t in once if d is None], default=0)
    assert lost == [(i, 0) for i in range(longest)]


def test_neighbours_and_borders(spark, batch):
    docs, _ = rows(9)
    docs = [d for d in dict.fromkeys(docs) if d[0] is not None] + [(-1, "one two"), (-1, "one two")]
    gold = [(d, m.start(), m.end()) for d, t in set(docs) for k, m in enumerate(re.finditer(r"\S+", t or "")) if k % 3 == 1]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    g = spark.createDataFrame(gold, "doc_id long, start long, end long")
    got = {}
    for r in T.tokenize_offsets(T.with_ranges(d, g), ranges="ranges", words=True).collect():
        got.setdefault(r["doc_id"], {})[r["tok_idx"]] = r
    for i, text in dict(docs).items():
        words = (text or "").split()
        assert len(got.get(i, {})) == len(words)
        for k, w in enumerate(words):
            r = got[i][k]
            assert (r["tok"], r["prev_tok"], r["next_tok"]) == (w, words[k - 1] if k else None, words[k + 1] if k + 1 < len(words) else None)
            assert (r["opens"], r["closes"]) == (int(k % 3 == 1),) * 2
            assert r["covered"] == (len(w) * (1 + (i == -1)) if k % 3 == 1 else 0)


@pytest.mark.parametrize("name", ["token_f1", "smoothed_ce", "tune_token_threshold", "ignore_mask", "plain_losses"])
def test_no_token_is_shuffled(spark, name):
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().sparkPlan().toString()
    full = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*tok_idx", full)
    assert not re.search(r"Join \[doc_id#\d+L?, (tok_idx|start|end)", plan)
