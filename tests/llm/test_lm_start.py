"""The language model starts from all training texts, not from a sample of them."""

import numpy as np
from pyspark.sql import functions as F

from spanfold.llm import hmm


def test_every_training_text_may_start_a_state(spark, monkeypatch):
    """One text unlike all others becomes a seed, wherever it stands in the corpus; a held-out one never does."""
    monkeypatch.setattr(hmm, "STATES", 2)
    odd = next(i for i in range(150, 400) if not hmm.held_out(i))
    held = next(i for i in range(odd + 1, 400) if hmm.held_out(i))
    texts = [(i, "plain words again " * 30) for i in range(400)]
    texts[odd], texts[held] = (odd, "zyx " * 90), (held, "qqq " * 90)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    chunks = hmm.encode(docs, "doc_id", "text").cache()
    share = np.full(hmm.CLASSES + 1, 1 / (hmm.CLASSES + 1))
    model = hmm.first_model(chunks.select(*hmm._TEXTS), share)
    place = {w: int(hmm._classes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([3]))[0]) for w in ("zyx", "qqq")}
    assert model.emit[1, place["zyx"]] > 0.7
    assert model.emit[:, place["qqq"]].max() < 0.1
    assert chunks.agg(F.sum("n_tokens")).first()[0] > 30_000


def test_worst_fit_prefers_long_texts_then_small_ids():
    a, b = np.array([0] * 60), np.array([1] * 60)
    short = np.array([2] * 5)
    logs = np.log(np.array([[0.8, 0.1, 0.1]]))
    assert hmm.worst_fit([short, a, b, b], [1, 2, 9, 4], logs)[1] == 3
    assert hmm.worst_fit([short], [1], logs)[1] == 0
    assert hmm.worst_fit([a, b], [5, 3], logs[:0])[1] == 1
    assert hmm.worst_fit([], [], logs) is None
