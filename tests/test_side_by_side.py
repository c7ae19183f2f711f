"""Short texts are tokenized side by side as arrays of bytes, with the results of the regex, and in its place."""

import re

import pyarrow as pa

from spanfold.operators import tokens as T

TEXTS = ["", None, " \t\n\r\x0b\x0c", "one", " é ü  中文 b \x0bc\x0c", "a\u0085b 😀 x😀y\x1fz", "", "last ", "x" * 40 + " tail", "\r\nä", None]


def runner(spark, monkeypatch, **options):
    docs = spark.createDataFrame([(1, 7, "a")], "doc_id long, n_chars int, text string")
    seen, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema, *more: seen.append(fn) or real(self, fn, schema, *more))
    T.tokenize_offsets(docs, keep=("n_chars",), neighbours=True, **options)
    return seen[0]


def wanted(texts):
    for k, text in enumerate(texts):
        found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text or "")]
        for i, (a, b, tok) in enumerate(found):
            yield k, -k, i, tok, a, b, found[i - 1][1] if i else -1, found[i + 1][1] if i + 1 < len(found) else -1


def batch_of(texts, kind=pa.string()):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([-k for k in range(n)], pa.int32()), pa.array(texts, kind)],
                                      names=["doc_id", "n_chars", "_text"])


def test_borders_offsets_and_neighbours_equal_the_regex(spark, monkeypatch):
    run = runner(spark, monkeypatch)
    long = "ä  b " * T.BYTES  # longer than what is searched at once
    texts = [*TEXTS, long, *TEXTS * 3]
    for kind in (pa.string(), pa.large_string()):
        for bytes_together in (1, 7, 30, T.BYTES):
            monkeypatch.setattr(T, "BYTES", bytes_together)
            for some in (TEXTS, [None], [""], []) if bytes_together < 100 else (texts, texts[3:]):
                got = [tuple(r.values()) for b in run(iter([batch_of(some, kind)])) for r in b.to_pylist()]
                assert got == list(wanted(some))
    rows = batch_of(["skipped words", *TEXTS]).slice(1)
    got = [tuple(r.values())[2:] for b in run(iter([rows])) for r in b.to_pylist()]
    assert got == [w[2:] for w in wanted(TEXTS)]
