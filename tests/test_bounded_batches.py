"""The row-local tokenizer hands on small batches, whatever it reads."""

import re

import pyarrow as pa

from spanfold.operators import tokens as T


def test_tokens_leave_in_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 7, "a")], "doc_id long, n_chars int, text string")
    seen, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema, *more: seen.append(fn) or real(self, fn, schema, *more))
    T.tokenize_offsets(docs, keep=("n_chars",), neighbours=True)
    long = " x" * (2 * T.TOGETHER + 5)
    texts = [f"one two{k}  three " for k in range(T.TOGETHER)] + [None, "", " \t", long, "last"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([None if k == 3 else k for k in range(len(texts))], pa.int64()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())],
        names=["doc_id", "n_chars", "_text"])
    got = list(seen[0](iter([batch])))
    assert max(b.num_rows for b in got) < 2 * T.TOGETHER
    want = []
    for k, text in enumerate(texts):
        found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^ \t]+", text or "")]
        for i, (a, b, tok) in enumerate(found):
            want.append((None if k == 3 else k, k, i, tok, a, b, found[i - 1][1] if i else -1, found[i + 1][1] if i + 1 < len(found) else -1))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
