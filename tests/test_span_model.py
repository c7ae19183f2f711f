"""The learned null answer: window summaries against a plain loop, the cut on planted windows, held-out documents."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from spanfold.operators import candidates as K
from spanfold.operators import span_model as N
from spanfold.plans import fixtures as X

from conftest import SF01

SCORES = "doc_id long, tok_idx long, start long, end long, start_logit double, end_logit double, logit1 double, is_start int, is_end int"


def test_window_summaries_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc, n in enumerate([1, 7, 23, 40]):
        gold = sorted(rng.sample(range(n), min(n, 6)))
        runs = list(zip(gold[::2], gold[1::2]))
        toks = [(doc, i, 5 * i, 5 * i + 4, rng.choice([-1.0, 0.5, rng.random()]), rng.random() - 0.5, 0.0,
                 int(i in gold[: 2 * len(runs) : 2]), int(i in gold[1 : 2 * len(runs) : 2])) for i in range(n)]
        rows += toks
        for w in range(1 + max(0, -(-(n - 8) // 5))):
            part = toks[w * 5 : w * 5 + 8]
            rank = lambda c: sorted(part, key=lambda t: (-t[c], -t[1]))[:4]
            pairs = [s[4] + e[5] for s in rank(4) for e in rank(5) if 0 <= e[1] - s[1] < 3]
            held = any(part[0][1] <= a and b <= part[-1][1] for a, b in runs)
            want[doc, w] = (len(part), int(held), round(max(pairs), 9) if pairs else None, sum(t[4] for t in part) / len(part))
    df = spark.createDataFrame(rows, SCORES).repartition(3)
    got = N.window_summaries(df, 8, 3, 4, 3).select("doc_id", "window_id", "n_tokens", "answered", "best", "mean_start").collect()
    assert {(r[0], r[1]) for r in got} == set(want)
    for r in got:
        n, held, best, mean = want[r["doc_id"], r["window_id"]]
        assert (r["n_tokens"], r["answered"]) == (n, held) and abs(r["mean_start"] - mean) < 1e-9
        assert r["best"] == best if best is None else abs(r["best"] - best) < 1e-8


SUMMARY = "best double, mean_start double, mean_end double, log_tokens double, answered int"


def test_cut_parts_planted_windows(spark):
    """Answered windows score above 2 plus their logarithm of tokens: the cut finds both parts."""
    rng = random.Random(9)
    rows = []
    for _ in range(600):
        log_n, answered = rng.uniform(0, 6), rng.randrange(2)
        gap = rng.uniform(0.2, 3) * (1 if answered else -1)
        rows.append((2 + log_n + gap, rng.random(), rng.random(), log_n, answered))
    base, weights = N.fit_cut(spark.createDataFrame(rows + [(None, 0.0, 0.0, 1.0, 0)], SUMMARY))
    cut = lambda r: base + sum(w * x for w, x in zip(weights, r[1:4]))
    assert sum((r[0] > cut(r)) == bool(r[4]) for r in rows) > 0.97 * len(rows)
    assert abs(weights[2] - 1) < 0.2


def test_cut_of_one_kind_of_window(spark):
    frame = lambda kinds: spark.createDataFrame([(0.5, 0.0, 0.0, 1.0, k) for k in kinds], SUMMARY)
    assert N.fit_cut(frame([1, 1]))[0] == float("-inf")
    assert N.fit_cut(frame([0, 0]))[0] == float("inf")
    assert N.fit_cut(frame([]))[0] == float("-inf")
    # scores that tell nothing (or the wrong thing) never make the null answer likelier by a higher score
    wrong = [(float(k % 2), 0.0, 0.0, 1.0, 1 - k % 2) for k in range(40)]
    base, weights = N.fit_cut(spark.createDataFrame(wrong, SUMMARY))
    assert base == base and all(w == w for w in weights)


def test_null_answer_on_held_out_documents(spark):
    best = E.queries()["span_scorer"](spark, SF01)
    gold = X.spans(spark, SF01).where("source = 'gold'").select("doc_id").distinct().withColumn("has", F.lit(1))
    rows = best.join(gold, "doc_id", "left").where("split = 'validation'").collect()
    none = [r for r in rows if r["has"] is None]
    some = [r for r in rows if r["has"]]
    assert len(none) > 20 and len(some) > 5  # few documents of the table have a gold range
    assert sum(r["start"] is None for r in none) > 0.8 * len(none)
    assert sum(r["start"] is not None for r in some) > 0.8 * len(some)
    assert best.count() == X.docs(spark, SF01).count()


def test_margins_rank_between_windows(spark):
    """A lower plain score far above its own window's cut beats a higher one below its cut; at margin 0 the null answer is first."""
    tok = lambda rank, at, logit: (rank, at, logit, at * 5, 0.0, 0.0)
    end = lambda rank, at, logit: (rank, at, logit, at * 5 + 4, 0.0)
    rows = [(1, 0, [tok(1, 0, 5.0)], [end(1, 0, 5.0)], 12.0), (1, 1, [tok(1, 300, 2.0)], [end(1, 300, 2.0)], 1.0), (2, 0, [tok(1, 3, 1.0)], [end(1, 4, 1.0)], 2.0)]
    st, en = "rank int, tok long, logit double, char long, cum double, val double", "rank int, tok long, logit double, char long, cum double"
    st, en = (", ".join(f"{a}:{b}" for a, b in (c.split() for c in x.split(", "))) for x in (st, en))
    top = spark.createDataFrame(rows, f"doc_id long, window_id long, starts array<struct<{st}>>, ends array<struct<{en}>>, null_score double")
    r = K.rows_of_windows(top, F.lit(0.0), "multi", carry=("null_score",))
    r = r.withColumn("score", F.when(F.col("_kind") == 1, F.col("score") - F.col("null_score")).otherwise(F.col("score")))
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    first = {x["doc_id"]: (x["start"], x["score"]) for x in K.topk_answers(K.rank_candidates(r, docs), 1).collect()}
    assert first == {1: (1500, 3.0), 2: (None, 0.0), 3: (None, 0.0)}
