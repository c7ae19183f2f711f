"""Seeded property tests: Spark operators against brute-force Python on random inputs."""

import random
import re

import pytest

from spanfold.operators import cleaning as C
from spanfold.operators import ensemble as E
from spanfold.operators import metrics as M
from spanfold.operators import spans as S
from spanfold.operators import tokens as T

from conftest import char_set, ranges_df

WS = " \t\n\r\x0b\x0c"
ALPHABET = list("abcXYZ019éüß中文😀") + list(WS) + list(".,-'!?")


def rand_ranges(rng, n_docs=30, sources=("A", "B", "C"), max_len=60):
    rows = []
    for d in range(n_docs):
        for s in sources:
            for _ in range(rng.randint(0, 5)):
                a = rng.randint(0, max_len)
                b = a + rng.randint(0, 12)
                rows.append((d, s, a, b))
    return rows


def runs_of(numbers):
    """Half-open ranges of a list of offsets: a new one wherever a value isn't its predecessor plus one."""
    cuts = [k for k in range(len(numbers)) if k == 0 or numbers[k] != numbers[k - 1] + 1] + [len(numbers)]
    return [(numbers[a], numbers[b - 1] + 1) for a, b in zip(cuts, cuts[1:])]


def islands(chars):
    return {(d, a, b) for d, offs in chars.items() for a, b in runs_of(sorted(offs))}


def spark_set(df):
    return {(r["doc_id"], r["start"], r["end"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return rand_ranges(random.Random(7))


def test_normalize_matches_sets(spark, rows):
    got = {(r["doc_id"], r["source"], r["start"], r["end"]) for r in S.normalize_spans(ranges_df(spark, rows), ["doc_id", "source"]).collect()}
    want = set()
    for (d, s), offs in char_set(rows, (0, 1)).items():
        want |= {(d, s, a, b) for (_, a, b) in islands({0: offs})}
    assert got == want


@pytest.mark.parametrize("k", [1, 2, 3])
def test_k_of_n_vote_matches_sets(spark, rows, k):
    per = char_set(rows, (0, 1))
    chars = {}
    for d in range(30):
        cnt = {}
        for s in "ABC":
            for o in per.get((d, s), ()):
                cnt[o] = cnt.get(o, 0) + 1
        chars[d] = {o for o, c in cnt.items() if c >= k}
    got = spark_set(E.span_vote(ranges_df(spark, rows), k))
    assert got == islands({d: o for d, o in chars.items() if o})


def test_except_matches_sets(spark, rows):
    df = ranges_df(spark, rows)
    a, b = df.where("source = 'A'"), df.where("source = 'B'")
    per = char_set(rows, (0, 1))
    want = {d: per.get((d, "A"), set()) - per.get((d, "B"), set()) for d in range(30)}
    assert spark_set(E.span_except(a, b)) == islands({d: o for d, o in want.items() if o})


def test_doc_prf_matches_sets(spark, rows):
    df = ranges_df(spark, rows)
    docs = spark.createDataFrame([(d,) for d in range(30)], "doc_id long")
    pred, gold = df.where("source IN ('A', 'B')"), df.where("source = 'C'").drop("source")
    got = {(r["doc_id"], r["source"]): r["f1"] for r in M.doc_prf(docs, pred, gold, ["A", "B"]).collect()}
    per = char_set(rows, (0, 1))
    for (d, s), f1 in got.items():
        p, g = per.get((d, s), set()), per.get((d, "C"), set())
        want = (1.0 if not p else 0.0) if not g else (0.0 if not p else 2 * len(p & g) / (len(p) + len(g)))
        assert f1 == pytest.approx(want)


def test_offsets_to_ranges_list_order(spark):
    rng = random.Random(3)
    lists = [(d, [rng.randint(0, 20) for _ in range(rng.randint(1, 15))]) for d in range(40)]
    df = spark.createDataFrame(lists, "doc_id long, offsets array<int>")
    got = sorted((r["doc_id"], r["run_idx"], r["start"], r["end"]) for r in S.offsets_to_ranges(df).collect())
    want = []
    for d, offs in lists:
        want += [(d, i, a, b) for i, (a, b) in enumerate(runs_of(offs))]
    assert got == sorted(want)


def stretches(text, inside):
    """Half-open maximal stretches of characters for which ``inside`` holds."""
    return runs_of([k for k, ch in enumerate(text) if inside(ch)])


def expected_clean(offsets, text, collapse=False, snap=True, min_len=3):
    """The cleaning rules read off the text's stretches of letters and digits and of blanks."""
    words, blanks = stretches(text, str.isalnum), stretches(text, lambda ch: ch in WS)
    around = lambda spans, at: next((s for s in spans if s[0] <= at < s[1]), None)
    out = []
    for first, end in runs_of(offsets):
        last = end - 1
        if blank := around(blanks, first):
            first = min(blank[1], last)
        if (blank := around(blanks, last)) and first < last:
            last = max(blank[0] - 1, first)
        if snap and first < last:
            # the stretch that holds the neighbour outside; its near edge must be that neighbour
            before = around(words, first - 1) if first else None
            if before and collapse:
                first = min(_behind(text, first), last)
            elif before:
                first = before[0]
            after = around(words, last + 1) if last + 1 < len(text) else None
            if after and first < last:
                last = max(_ahead(text, last), first) if collapse else after[1] - 1
        if last - first + 1 >= min_len:
            out.append((first, last + 1))
    return out


def _behind(text, at):
    """First place from ``at`` on whose left neighbour is neither letter nor digit."""
    return next((k for k in range(at, len(text)) if not text[k - 1].isalnum()), len(text))


def _ahead(text, at):
    """Last place up to ``at`` whose right neighbour is neither letter nor digit."""
    return next((k for k in range(at, -1, -1) if not text[k + 1].isalnum()), -1)


@pytest.mark.parametrize("mode", ["expand", "collapse", "trim"])
def test_cleaner_matches_stretches(spark, mode):
    rng = random.Random(11)
    docs, rows, want = [], [], set()
    for d in range(60):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(5, 50)))
        docs.append((d, text))
        offs = []
        for _ in range(rng.randint(1, 3)):
            a = rng.randint(0, len(text) - 1)
            b = min(len(text) - 1, a + rng.randint(0, 10))
            offs.extend(range(a, b + 1))
        for b, e in expected_clean(offs, text, collapse=(mode == "collapse"), snap=(mode != "trim")):
            want.add((d, b, e))
        rows += [(d, a, b) for a, b in runs_of(offs)]
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    rdf = spark.createDataFrame(rows, "doc_id long, start long, end long")
    steps = ("trim", "drop") if mode == "trim" else ("trim", "snap", "drop")
    got = {(r["doc_id"], r["start"], r["end"]) for r in C.clean_ranges(rdf, ddf, mode=mode, steps=steps).collect()}
    assert got == want


def test_tokenizer_matches_regex(spark):
    rng = random.Random(5)
    texts = [(d, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80)))) for d in range(50)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["doc_id"], r["tok_idx"], r["tok"], r["start"], r["end"]) for r in T.tokenize_offsets(df).collect())
    want = []
    for d, t in texts:
        for i, m in enumerate(re.finditer(r"[^ \t\n\r\x0b\x0c]+", t)):
            want.append((d, i, m.group(), m.start(), m.end()))
    assert got == sorted(want)


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_blocked_overlap_join_matches_pairs(spark, block):
    rng = random.Random(block)
    a = [(d, i, s, s + rng.randint(1, 15)) for d in range(10) for i, s in enumerate(rng.sample(range(80), 12))]
    b = [(d, s, s + rng.randint(1, 25)) for d in range(10) for s in rng.sample(range(80), 6)]
    A = spark.createDataFrame(a, "doc_id long, tok_idx long, start long, end long")
    B = spark.createDataFrame(b, "doc_id long, start long, end long")
    got = sorted((r["doc_id"], r["tok_idx"], r["r_start"], r["r_end"], r["overlap"]) for r in T.overlap_join(A, B, block=block).collect())
    want = sorted(
        (d, i, s2, e2, min(e1, e2) - max(s1, s2)) for (d, i, s1, e1) in a for (d2, s2, e2) in b if d == d2 and s1 < e2 and s2 < e1
    )
    assert got == want


def test_two_level_running_mean(spark):
    from spanfold.operators.modeling import running_mean

    rng = random.Random(2)
    rows = [(i, rng.choice([1, 2, 3]), float(rng.randint(0, 100))) for i in range(400)]
    df = spark.createDataFrame(rows, "step long, run long, loss double")
    got = {r["step"]: r["running_mean"] for r in running_mean(df, ["run"], "step", "loss", block=16).collect()}
    sums = {}
    for step, run, loss in rows:
        s, c = sums.get(run, (0.0, 0))
        sums[run] = (s + loss, c + 1)
        assert got[step] == pytest.approx(sums[run][0] / sums[run][1])


@pytest.mark.parametrize("block", [3, 7])
def test_block_split_normalize_and_vote(spark, rows, block):
    df = ranges_df(spark, rows)
    got = {(r["doc_id"], r["source"], r["start"], r["end"]) for r in S.normalize_spans(df, ["doc_id", "source"], block).collect()}
    want = set()
    for (d, s), offs in char_set(rows, (0, 1)).items():
        want |= {(d, s, a, b) for (_, a, b) in islands({0: offs})}
    assert got == want
    per = char_set(rows, (0, 1))
    chars = {}
    for d in range(30):
        cnt = {}
        for s in "ABC":
            for o in per.get((d, s), ()):
                cnt[o] = cnt.get(o, 0) + 1
        chars[d] = {o for o, c in cnt.items() if c >= 2}
    assert spark_set(E.span_vote(df, 2, block=block)) == islands({d: o for d, o in chars.items() if o})


@pytest.mark.parametrize("block", [3, 7])
def test_block_split_doc_prf(spark, rows, block):
    df = ranges_df(spark, rows)
    docs = spark.createDataFrame([(d,) for d in range(30)], "doc_id long")
    pred, gold = df.where("source IN ('A', 'B')"), df.where("source = 'C'").drop("source")
    got = {(r["doc_id"], r["source"]): (r["n_pred"], r["n_gold"], r["n_inter"]) for r in M.doc_prf(docs, pred, gold, ["A", "B"], block=block).collect()}
    per = char_set(rows, (0, 1))
    for (d, s), (npred, ngold, ninter) in got.items():
        p, g = per.get((d, s), set()), per.get((d, "C"), set())
        assert (npred, ngold, ninter) == (len(p), len(g), len(p & g))


@pytest.mark.parametrize("method", ["rowlocal", "window"])
def test_custom_token_pattern(spark, method):
    rng = random.Random(9)
    texts = [(d, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))) for d in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    pat = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\x0b\x0c]"  # explicit classes: same in Java and Python regex
    got = sorted((r["doc_id"], r["tok_idx"], r["tok"], r["start"], r["end"]) for r in T.tokenize_offsets(df, method=method, pattern=pat).collect())
    want = [(d, i, m.group(), m.start(), m.end()) for d, t in texts for i, m in enumerate(re.finditer(pat, t))]
    assert got == sorted(want)


def test_pairwise_method_plugin(spark, rows):
    from pyspark.sql import functions as F

    df = ranges_df(spark, rows).withColumnRenamed("source", "coder")
    docs = spark.createDataFrame([(d,) for d in range(30)], "doc_id long")
    jac = lambda a, b, i: F.when(a + b - i > 0, i / (a + b - i)).otherwise(F.lit(1.0))
    got = {(r["doc_id"], r["coder_a"], r["coder_b"]): r["f1"] for r in M.pairwise_agreement(docs, df, ["A", "B", "C"], method=jac).collect()}
    per = char_set(rows, (0, 1))
    for (d, a, b), v in got.items():
        x, y = per.get((d, a), set()), per.get((d, b), set())
        assert v == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_threshold_sweep_independent_of_block_size(spark):
    from pyspark.sql import functions as F

    from spanfold.operators import candidates as K
    from spanfold.plans import fixtures as X

    from conftest import SF001

    t = X.tokens(spark, SF001, "window")
    c = K.nbest_spans(X.token_scores_from_tokens(t))
    gold = X.spans_from_tokens(t).where(F.col("source") == "gold").select("doc_id", "start", "end")
    docs = X.docs(spark, SF001)
    a = {r["k"]: r["mean_f1"] for r in K.tune_score_threshold(c, gold, docs).collect()}
    b = {r["k"]: r["mean_f1"] for r in K.tune_score_threshold(c, gold, docs, block=5).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_word_offsets_two_level_prefix(spark, block):
    rng = random.Random(block)
    texts = [(d, " ".join("x" * rng.randint(1, 6) for _ in range(rng.randint(0, 30)))) for d in range(20)]
    toks = T.tokenize_offsets(spark.createDataFrame(texts, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["tok_idx"], r["ss_start"]) for r in T.word_offsets(toks, block=block).collect())
    want = []
    for d, t in texts:
        off = 0
        for i, w in enumerate(t.split()):
            want.append((d, i, off))
            off += len(w) + 1
    assert got == sorted(want)
