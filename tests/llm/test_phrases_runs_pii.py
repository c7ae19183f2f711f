"""Operators 11 to 13, held against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from spanfold.llm import phrases, pii, queries, runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- operator 11


def brute_phrases(rows, least, longest, top):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for d in range(1, longest + 1):
                for i in range(len(words) - d + 1):
                    counts[lang, tuple(words[i : i + d])] += 1
    counts = {k: f for k, f in counts.items() if f >= least}
    out = []
    for lang in sizes:
        mine = {p: f for (x, p), f in counts.items() if x == lang}
        found = []
        for p, a in mine.items():
            if len(p) < 2 or any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in mine.items()):
                continue
            cut = min((1000 * a * sizes[lang] // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
            l, r = mine[p[: cut[1]]], mine[p[cut[1] :]]
            found.append((-cut[0], -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -s))
    return sorted(out)


def got_phrases(spark, rows, **kw):
    docs = spark.createDataFrame([(t, x, 1, "b") for t, x in rows], "text string, lang string, score int, phrase string")
    found = phrases.collocations(docs, **kw)
    return sorted(tuple(r)[:8] for r in found.collect())


def texts(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "Dd", "é", "日本", "x\xa0y", "w" * 40]
    out = []
    for _ in range(60):
        n = rng.choice([0, 1, 3, 20, 80])
        out.append((" ".join(rng.choice(words[: rng.choice([1, 3, 8])]) + rng.choice(["", "", "", ".", ",", "\t", "\n", "\x0b", "?!"]) for _ in range(n)), rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*out, (None, "en"), ("", None), *[("one two three four five six", "fr")] * 5]


@pytest.mark.parametrize("seed, shard, top", [(1, 1 << 21, 2000), (2, 50, 2000), (3, 7, 9)])
def test_phrases_against_brute_force(spark, seed, shard, top):
    rows = texts(seed)
    assert got_phrases(spark, rows, least=4, top=top, shard_words=shard) == brute_phrases(rows, 4, 5, top)


def test_phrases_of_a_long_text_cut_into_stretches(spark, monkeypatch):
    rng = random.Random(4)
    long = " ".join(rng.choice("abcdef") * rng.choice([1, 3]) + ("." if rng.random() < 0.01 else "") for _ in range(4000))
    rows = [(long, "en"), ("a b. c", "en"), (long[:500], "en")]
    whole = list(phrases.word_stretches(phrases.pa.array([t for t, _ in rows])))
    monkeypatch.setattr(phrases, "STRETCH", 64)
    cut = list(phrases.word_stretches(phrases.pa.array([t for t, _ in rows])))
    assert len(cut) > 50
    for k in (0, 1):
        assert np.array_equal(np.concatenate([x[k] for x in whole]), np.concatenate([x[k] for x in cut]))
    monkeypatch.undo()
    assert got_phrases(spark, rows, least=20, shard_words=300) == brute_phrases(rows, 20, 5, 2000)


def test_phrases_with_every_bit_shared(spark, monkeypatch):
    """The bit table only saves counting: with one word of bits the counts stay exact."""
    monkeypatch.setattr(phrases, "BITS", 64)
    rows = texts(5)
    assert got_phrases(spark, rows, least=5) == brute_phrases(rows, 5, 5, 2000)


def test_phrases_of_nothing(spark):
    assert got_phrases(spark, []) == []
    assert got_phrases(spark, [(None, None), ("a", "en")], least=1) == []


def test_index_intervals_and_extensions():
    rng = np.random.default_rng(6)
    seq = np.where(rng.random(400) < 0.15, 0, rng.integers(1, 5, 400))
    seq[0] = seq[-1] = 0
    index = phrases.FMIndex(seq, 5)
    found = index.words()
    for size in range(2, 6):
        found = index.extend(*found, left=size % 2 == 1)
        want = Counter(tuple(seq[i : i + size].tolist()) for i in range(len(seq) - size + 1) if (seq[i : i + size] > 0).all())
        assert {tuple(p): c for p, c in zip(found[0].tolist(), found[2].tolist())} == want
    for side, s in ((1, seq), (0, seq[::-1])):  # each interval holds the rows of its phrase, on both sides
        rows = sorted(range(len(s)), key=lambda i: np.roll(s, -i)[:8].tolist() + [i])
        for p, lo, n in zip(found[0].tolist(), found[1][side].tolist(), found[2].tolist()):
            read = p if side else p[::-1]
            assert all(np.roll(s, -rows[k])[:5].tolist() == read for k in range(lo, lo + n))


# --- operator 12


def brute_runs(w, least=12):
    n, found = len(w), {}
    for q in range(n // 2, 0, -1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found[i, j + q - i] = q  # smaller periods come later
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def fast_runs(docs, least=12):
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    words = np.array([x for d in docs for x in d], np.uint64)
    s, n, q = runs.find_runs(words, bounds, least)
    which = np.searchsorted(bounds, s, "right") - 1
    return [sorted(zip((s - bounds[which])[which == k].tolist(), n[which == k].tolist(), q[which == k].tolist())) for k in range(len(docs))]


def period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


@pytest.mark.parametrize("least", [2, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    docs = [[], [1], [1] * 50, [1, 2] * 30, [1, 2, 1, 2, 1, 2, 1] * 2, [2, 1, 2, 1, 1, 2, 1, 2] * 3]
    fib = [[1], [1, 2]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    docs += [fib[-1], [bin(k).count("1") % 2 for k in range(256)], ([2, 1] * 20) + ([1, 2] * 20)]
    for _ in range(400):
        n, letters = rng.randrange(150), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 4:
                a, p = rng.randrange(n), rng.randrange(1, 20)
                b = rng.randrange(a, n)
                w[a:b] = [w[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, b)]
        docs.append(w)
    got = fast_runs(docs, least)
    for d, g in zip(docs, got):
        assert g == brute_runs(d, least)
        assert all(period(d[s : s + n]) == q for s, n, q in g[:5])


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    return (doc_id, len(found), *top, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = [d for d in docs if len(d[1] or "") < 12_000]  # brute force is quadratic
    got = {r["doc_id"]: tuple(r) for r in queries.op12_runs(spark, SF).collect()}
    assert len(got) == 200 and sum(r[1] > 0 for r in got.values()) > 10
    for doc in docs:
        assert got[doc[0]] == brute_row(*doc)


def test_runs_of_odd_rows(spark, tmp_path):
    rep = "go \t go\ngo  " * 6
    rows = [(1, rep), (1, rep), (None, "a b " * 9), (2, None), (3, ""), (4, " \n"), (5, "é日 " * 20), (6, "x" * 100_000 + " y" * 40), (7, "a\xa0b " * 14)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, runs string, start int").write.parquet(str(path))
    got = sorted((tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_row(*r) for r in rows), key=str)
    assert queries.op12_runs(spark, str(tmp_path)).schema["collapsed_sha256"].dataType.simpleString() == "string"


def test_runs_of_long_periodic_texts_stay_quick():
    began = time.time()
    n = 200_000
    assert fast_runs([[1] * n])[0] == [(0, n, 1)]
    assert fast_runs([list(range(1000)) * 200])[0] == [(0, n, 1000)]
    two = fast_runs([[1, 2] * (n // 4) + [2, 1] * (n // 4)])[0]
    assert (0, n // 2, 2) in two and len(two) > 10_000
    assert time.time() - began < 30


# --- operator 13

EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute_spans(text):
    return [(kind, m.start(), m.end()) for kind, e in EXPRESSIONS.items() for m in re.finditer(e, text or "") if valid(kind, m[0])]


def base(text):
    return [s[:3] for s in pii.find(text) if s[3]]


def test_base_spans_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    kinds = Counter()
    for r in queries.op13_pii(spark, "/root/testdata/sf0.01").collect():
        want = brute_spans(docs[r["doc_id"]])
        kinds.update(k for k, _, _ in want)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in want) for k in EXPRESSIONS]
        said = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(filter(None, r["spans"].split(",")))
        if not re.search(r"[@=:+]|[0-9]{4}|[0-9]\.[0-9]", docs[r["doc_id"]] or ""):
            assert r["spans"] == ""
    assert len(kinds) == 4


def test_base_spans_on_random_texts():
    rng = random.Random(13)
    cards = ["4111111111111111", "4111 1111-1111 1111", "5500005555555559", "4111111111111112"]
    bits = [*"@@..++--  ()%_", *"0123456789ab", "1.2.3.4", "255.256.1.1", "+1 (555) 010-9999", "a.b@c.de", "é", "日", "000", " 12", *cards, "://", "password=", "IBAN ", "\n", "İ"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert base(text) == brute_spans(text), text


def test_added_spans():
    def added(text):
        return [(k, text[a:b]) for k, a, b, known in pii.find(text) if not known]

    assert added("pay 4111111111111111 5500005555555559 now") == [("card", "4111111111111111"), ("card", "5500005555555559")]
    assert added("call +1 (499) 555-6503 4111111111111111 x") == [("card", "4111111111111111"), ("phone", "+1 (499) 555-6503")]
    assert added('Token = "1eb9c654e721" and password: hunter22x, tokens = 123456789') == [("account", "1eb9c654e721"), ("account", "hunter22x")]
    assert added("iban: DE89 3704 0044 0532 0130 00 ok") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert added("iban: DE88 3704 0044 0532 0130 00 ok") == []
    assert added("see https://anna:pw@host.org/x, http://x.org/~bob. or http://x.org/users/carl)") == [("address", "https://anna:pw@host.org/x"), ("address", "http://x.org/~bob"), ("address", "http://x.org/users/carl")]
    assert added("https://news.org/users and a secret = love, the account was closed: 3 times") == []


def test_spans_of_odd_rows(spark, tmp_path):
    rows = [(1, "a@b.cd 1.2.3.4"), (1, "a@b.cd 1.2.3.4"), (None, "+1 555 010 9999"), (2, None), (3, ""), (4, "é" * 50_000 + "x@y.z")]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, spans string").write.parquet(str(path))
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in queries.op13_pii(spark, str(tmp_path)).collect())
    assert got == [(0, "phone:0:15"), (1, "email:0:6,ip:7:14"), (1, "email:0:6,ip:7:14"), (2, ""), (3, ""), (4, "email:50000:50005")]


@pytest.mark.parametrize("text", ["@" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "1 " * 100_000, "+1" * 100_000, "+1" + "(" * 200_000, "a@b" * 60_000, "http://" * 30_000, "a://" * 50_000, "iban" * 50_000, "password=" * 20_000, "1" * 200_000])
def test_spans_of_hostile_texts_are_linear(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 5
