"""Operators 5 and 8 and the pipeline, held against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanfold.llm import near_dedup, packing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(data, threshold=75):
    sets = [(doc, shingles(text)) for doc, text in data]
    root = {doc: doc for doc, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {doc: (len(s), find(doc)) for doc, s in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_near_dedup_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = result(queries.op5_near_dedup(spark, SF))
    assert got == brute_near([tuple(r) for r in docs.collect()])


def variants(seed=9):
    """Chains of edits, groups about the threshold, exact copies, shared passages, short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    data = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(8):
            data.append(" ".join(text).title() if rng.random() < 0.3 else " ".join(text))
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = rng.choice(words)
    data += [passage + " " + " ".join(rng.choice(words) for _ in range(n)) for n in (5, 10, 20, 40, 80) * 8]
    data += ["one two", "One  two", "one two three four five", "", None, " \n ", "a", "a"]
    rng.shuffle(data)
    return list(enumerate(data))


@pytest.mark.parametrize("blocks", [3, 1500])
def test_near_dedup_variants(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", blocks)
    data = variants()
    df = spark.createDataFrame(data, "doc_id long, text string")
    for name in ("id", "a", "b", "comp", "rep", "key", "n_shingles", "halves"):
        df = df.withColumn(name, F.lit("x"))
    assert result(near_dedup.near_dedup(df)) == brute_near(data)


def test_near_dedup_large_group_and_edges(spark):
    base = [f"w{k}" for k in range(200)]
    data = [(k, " ".join(base[:17] + [f"x{k}"] + base[18:])) for k in range(400)] + [(k + 1000, " ".join(base[100:] + [f"y{k}_{j}" for j in range(60)])) for k in range(50)]
    got = result(near_dedup.near_dedup(spark.createDataFrame(data, "doc_id long, text string")))
    assert got == brute_near(data)
    odd = spark.createDataFrame([(None, "a b c"), (None, None), (5, "a b c"), (3, "A b  c"), (3, "A b  c")], "doc_id long, text string")
    rows = near_dedup.near_dedup(odd).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == Counter([(None, None, True), (None, None, True), (5, 3, False), (3, 3, True), (3, 3, True)])
    assert near_dedup.near_dedup(odd.limit(0)).collect() == []


def test_near_dedup_of_ids_with_several_texts(spark):
    """Texts under one id are one document: it links what each of them links, in whatever order the rows come."""
    words = [f"w{k}" for k in range(300)]
    base, other, third = " ".join(words[:100]), " ".join(words[100:200]), " ".join(words[200:])
    near = base + " end"
    cases = [
        [(5, other), (5, near), (9, base)], [(5, near), (5, other), (9, base)], [(5, near), (5, other), (8, other + " k"), (9, base)],
        [(7, base), (7, base), (4, near), (4, near), (6, third)], [(1, third), (2, base), (2, third + " x"), (3, near), (3, ""), (8, None), (8, third)],
    ]
    for data in cases:
        for rows in (data, data[::-1]):
            got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
            want = brute_near(rows)
            comp = [(d, len(shingles(t)), want[d][1] if shingles(t) else d) for d, t in rows]  # a row without words is linked with nothing
            assert Counter(tuple(r) for r in got) == Counter((*c, c[0] == c[2]) for c in comp)


def test_pair_meets_in_a_table():
    """At the threshold a pair shares a left and a right half nearly always."""
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(400):
        both, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
        a, b = (near_dedup.minhashes(np.unique(np.concatenate([both, x]))).reshape(-1, near_dedup.PER_HALF) for x in own)
        same = (a == b).all(axis=1)
        met += same[: near_dedup.HALVES].any() and same[near_dedup.HALVES :].any()
    assert met >= 399


def test_common_shingles_matches_sets():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: rng.choice([20, 400])], rng.integers(1, 120))) for _ in range(60)]
    got = near_dedup.common_shingles(sets)
    for a in range(60):
        for b in range(60):
            if a != b:
                assert got[a, b] == len(set(sets[a].tolist()) & set(sets[b].tolist()))


# ---------------------------------------------------------------------------- packing
@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    return lambda text, t=Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")): t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "it's  John's", "é ñ 日本 x", "x y z", "tab\there now", "a b" * 300, "123 45\r\n6 !? q w", "\x1c a b"]


def test_ids_equal_the_tokenizer(spark, reference_ids):
    enc = packing._encoder(*queries.tokenizer())
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(80).collect()]
    for text in texts:
        assert np.frombuffer(enc(text), "<u4").tolist() == reference_ids(text), text[:60]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", " x<|endoftext|>y ", "it's  <|endoftext|>\n a<|endoftext|", "<|endoftext|>'s a b <|endoftext|>  ", "x<|<|endoftext|>|> y <|ENDOFTEXT|>"])
def test_ids_of_added_tokens(reference_ids, text):
    got = np.frombuffer(packing._encoder(*queries.tokenizer())(text), "<u4").tolist()
    assert got == reference_ids(text) and (text.count("<|endoftext|>") == got.count(50256))


def check_packing(packed, docs, reference_ids, capacity):
    """Pieces cover each document, carry its ids, and lie in sequences without gap or overlap."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, texts in docs.items():
        want = Counter()
        for text in texts:
            ids = [*reference_ids(text or ""), 2]
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc.pop(doc)) == want
    assert not by_doc
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_packing_of_the_table(spark, reference_ids):
    docs = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    packed = queries.op8_pack(spark, SF).collect()
    n = check_packing(packed, docs, reference_ids, 1024)
    assert n <= 1.03 * sum(r["length"] for r in packed) / 1024 + 2


def test_packing_edges(spark, reference_ids, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 5)
    docs = {1: [None], 2: [""], 3: ["x " * 3000], 4: ["same", "same"], 5: TEXTS}
    df = spark.createDataFrame([(k, t) for k, ts in docs.items() for t in ts], "doc_id long, text string").withColumn("offset", F.lit("x")).withColumn("_g", F.lit(1))
    pieces = packing.cut_pieces(df, *queries.tokenizer(), 2, 64)
    check_packing(packing.pack(pieces, 64).collect(), docs, reference_ids, 64)
    assert packing.pack(packing.cut_pieces(df.limit(0), *queries.tokenizer(), 2, 64), 64).collect() == []


def brute_sum_of_squares(lengths, capacity):
    """The rule read literally: try every place and keep the smallest sum of squared counts."""
    gaps, out = [], []
    score = lambda g: sum(v * v for k, v in Counter(g).items() if k)
    for n in lengths:
        best = None
        for gap in sorted({g for g in gaps if g >= n}) + [capacity]:
            after = list(gaps)
            if gap in after and gap != capacity:
                after.remove(gap)
            after.append(gap - n)
            if best is None or score(after) < best[0] or (score(after) == best[0] and best[2] == capacity):
                best = (score(after), after, gap) if best is None or score(after) < best[0] else best
        out.append(capacity - best[2])
        gaps = best[1]
    return out, len(gaps)


def test_sum_of_squares_rule():
    rng = random.Random(5)
    for _ in range(40):
        capacity = rng.choice([7, 12, 20])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
        seq, offset = packing.sum_of_squares(np.array(lengths), capacity)
        want, n = brute_sum_of_squares(lengths, capacity)
        assert offset.tolist() == want and len(set(seq.tolist())) == n


# ---------------------------------------------------------------------------- pipeline
def test_pipeline(spark, reference_ids):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = corpus_pipeline.run(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {doc: t for doc, t in texts.items() if t and any(map(str.isalpha, t))}
    groups = defaultdict(list)
    for doc, t in kept.items():
        groups[re.sub(r"[\x20\x09-\x0d]", "", t)].append((-len(t), doc))
    kept = {min(g)[1]: texts[min(g)[1]] for g in groups.values()}
    near = brute_near(list(kept.items()))
    kept = {doc: t for doc, t in kept.items() if near[doc][1] == doc}
    copies = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert set(copies) <= set(kept) and set(copies.values()) <= {1, 2}
    check_packing(packed, {doc: [kept[doc]] * n for doc, n in copies.items()}, reference_ids, 1024)
    total = sum(len(WORD.findall(t)) for t in kept.values())
    assert abs(sum(len(WORD.findall(kept[d])) * n for d, n in copies.items()) - 1.5 * total) < 0.1 * total


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "word one", None, None, None), (3, "word  one", "fr", "s", 9), (4, "123", "en", "s", 3), (5, "Eine Katze sitzt hier und ruht", "de", "t", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {2, 3, 5}
    assert {r["doc_id"] for r in corpus_pipeline.exact(spark, docs, SF).collect()} == {1, 3, 4, 5}
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, SF).collect()} == {1, 2, 4, 5}


def test_stages_decide_by_row(spark, reference_ids):
    """Null ids, one id with several texts: exactly the rejected copies go."""
    long = [" ".join(f"{'abcdefgh'[k]}w{j}" for j in range(30)) for k in range(8)]
    rows = [(None, long[0]), (None, long[1]), (None, long[2]), (1, long[3]), (1, long[4]), (1, long[0] + " "), (2, long[3].replace(" ", "  ")), (3, long[5]), (4, long[5]), (4, long[6]), (4, long[6]), (None, long[7]), (None, long[7])]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        got = corpus_pipeline.exact(spark, docs.repartition(parts), SF)
        want = [(None, long[1]), (None, long[2]), (None, long[7]), (1, long[4]), (1, long[0] + " "), (2, long[3].replace(" ", "  ")), (3, long[5]), (4, long[6])]
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want)
    edited = [(d, t) for d, t in want] + [(0, long[4] + " end"), (None, long[5] + " end"), (1, "123"), (1, "456"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in edited], docs.schema)
    want = [(d, t) for d, t in edited if (d, t) not in ((1, long[4]), (None, long[5] + " end"))]
    near = corpus_pipeline.near(spark, docs.repartition(3), SF)
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter(want)
    mixed = corpus_pipeline.mix(spark, near, SF).collect()
    words = sum(len(WORD.findall(t or "")) for _, t in want)
    assert abs(sum(len(WORD.findall(r["text"] or "")) for r in mixed) - 1.5 * words) <= 60
    texts = defaultdict(list)
    for r in mixed:
        texts[r["doc_id"]].append(r["text"])
    assert len({(r["doc_id"], r["text"]) for r in mixed}) > 6 and max(Counter((r["doc_id"], r["text"]) for r in mixed).values()) == 2
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    check_packing(packed, texts, reference_ids, 1024)
