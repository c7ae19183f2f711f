"""Learned operators have no SQL oracle: planted-signal quality floors instead."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from spanfold.operators import metrics as M
from spanfold.plans import fixtures as X

from conftest import SF01


def test_token_tagger_beats_random_baseline(spark):
    pred = E.queries()["token_tagger"](spark, SF01).withColumn("source", F.lit("tagger"))
    t = X.tokens(spark, SF01)
    gold = X.spans_from_tokens(t).where("source = 'gold'").drop("source")
    docs = X.docs(spark, SF01)
    tagged = M.doc_prf(docs, pred, gold, ["tagger"]).where("n_gold > 0").agg(F.avg("f1")).first()[0]
    rnd = E.queries()["random_spans"](spark, SF01)
    assert rnd.count() == docs.count()
    assert tagged > 0.5  # a coin-flip per character scores ~0.1 on these sparse spans


def test_doc_classifier_ranks_toxic_documents_higher(spark):
    s = E.queries()["doc_classifier"](spark, SF01)
    lab = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    m = M.classification_metrics(s.join(lab, "doc_id"), "label", "score").first()
    assert m["roc_auc"] > 0.8


def test_surrogate_flags_planted_words(spark):
    w = E.queries()["surrogate_attribution"](spark, SF01)
    t = X.tokens(spark, SF01).select("doc_id", "tok_idx", "hit")
    j = w.join(t, ["doc_id", "tok_idx"])
    hit_w = j.where("hit").agg(F.avg("weight")).first()[0]
    other_w = j.where("not hit").agg(F.avg("weight")).first()[0]
    assert hit_w > 10 * abs(other_w) and hit_w > 0


def test_classifier_erasure_is_exact_and_finds_planted_words(spark):
    """Score falls equal those of scoring the masked text; insult words fall most."""
    from spanfold.functions.text import MASK_TOKEN
    from spanfold.operators import attribution as A
    from spanfold.operators import modeling as ML
    from spanfold.functions.text import sigmoid

    docs = spark.createDataFrame([(k, w) for k, w in enumerate(["a fine day", "you idiot now", "what a fine idiot", "now a day", "fine fine day", "idiot you"] * 4)], "doc_id long, text string")
    model = ML.doc_classifier(docs.withColumn("toxic", F.col("text").contains("idiot").cast("int")), "toxic", num_features=512)
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("tok_idx", "tok")).withColumn("word", F.lower("tok"))
    shares = ML.word_contributions(model, words.select("word"))
    mask = ML.word_contributions(model, spark.range(1).select(F.lit(MASK_TOKEN).alias("word"))).first()["contrib"]
    got = A.erasure_scores(words.join(shares, "word"), F.col("contrib"), sigmoid, mask_contrib=mask, base=model.stages[-1].intercept).where("doc_id = 2").orderBy("tok_idx").collect()
    texts = ["what a fine idiot"] + [" ".join(MASK_TOKEN if j == k else w for j, w in enumerate("what a fine idiot".split())) for k in range(4)]
    score = [r["score"] for r in ML.score_documents(model, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for k, r in enumerate(got):
        assert abs(r["score_dec"] - (score[0] - score[k + 1]) / (score[0] + 1e-4)) < 1e-6
    assert max(got, key=lambda r: r["score_dec"])["tok"] == "idiot"


def test_surrogate_draws_differ_between_documents(spark):
    """Two documents with the same words are perturbed differently, and repeats share a weight."""
    from spanfold.operators import attribution as A

    rows = [(d, k, w, float(w == "bad")) for d in (1, 2) for k, w in enumerate("some bad words and bad words again here".split())]
    t = spark.createDataFrame(rows, "doc_id long, tok_idx long, tok string, c double")
    for block in (4096, 3):
        got = {(r["doc_id"], r["tok_idx"]): r["weight"] for r in A.surrogate_attribution(t, "c", lambda h: h / (h + 1.0), block=block).collect()}
        assert got[(1, 1)] == got[(1, 4)] and got[(1, 1)] == max(v for (d, _), v in got.items() if d == 1)
        assert got[(1, 1)] != got[(2, 1)]
