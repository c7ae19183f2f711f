"""Operators 7, 9 and 10: built-in functions only, held against DuckDB, plain Python and edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from spanfold.llm import chat, exact_dedup, mixing, queries
from spanfold.llm.common import ordinal, word_count

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b", "x"), (2, "ab", "x"), (3, " a  b ", None), (4, None, "y"), (5, " ", "y"), (6, "x y", "é"), (6, "x y", "é"), (None, "ab  ", "z"), (8, "y" * 50_000 + " z", "z")]
CLASH = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows, and columns named like the operators' own."""
    df = spark.createDataFrame(ODD, CLASH)
    for name in ("_id", "_key", "_text", "size", "copies", "_src", "digest", "kept", "_mixed", "_times"):
        df = df.withColumn(name, F.lit(7))
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert rows(got) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def test_native_plans_have_no_python(spark):
    for name in ("op7_mix", "op9_chat", "op10_exact_dedup"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan), name


# ---------------------------------------------------------------------------- exact dedup
def brute_dedup(data):
    groups = defaultdict(list)
    for doc, text, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = Counter()
    for norm, members in groups.items():
        keep = min(members)[3]
        for *_, doc in members:
            out[(doc, keep, len(members), hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.substring(n, 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup_edges(spark, odd, digest):
    got = exact_dedup.exact_dedup(odd, digest=digest).withColumn("d", F.sha2(F.lit(""), 256)).collect()
    want = brute_dedup(ODD)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter({k[:3]: 0 for k in want}) + Counter([k[:3] for k, n in want.items() for _ in range(n)])
    # exactly one row of each group stays
    assert sum(r["kept"] for r in got) == len({k[3] for k in want})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_empty(spark, odd):
    assert exact_dedup.exact_dedup(odd.limit(0)).collect() == []


def test_exact_dedup_state_is_on_disk_without_expiry(spark, odd, tmp_path, monkeypatch):
    assert "RocksDB" in exact_dedup.STATE_CONF["spark.sql.streaming.stateStore.providerClass"]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    exact_dedup.exact_dedup(odd).count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


# ---------------------------------------------------------------------------- mixing
def test_word_count(spark):
    texts = [None, "", " ", "a", " a\tb \n", "a\x0bb\x0cc", "a\xa0b", "x" * 10_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in texts]


def test_ordinal_is_a_global_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert sorted(map(tuple, ordinal(df, "v", "n").collect())) == [(k, k) for k in range(1000)]


def brute_targets(sizes, budget=1.5, cap=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if cap * sizes[s] < level * w[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_targets_and_copies(spark):
    docs = [(k, "w " * (k * 37 % 90), None if k % 17 == 0 else f"s{k % 5}") for k in range(3000)]
    got = mixing.mix_copies(spark.createDataFrame(docs, CLASH)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, src in docs:
        sizes[src] += len(text.split())
    target = brute_targets(sizes)
    by_id = {k: s for k, _, s in docs}
    assert len(got) == len(docs)
    for r in got:
        src = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[src] and math.isclose(r["target"], target[src])
        rate = target[src] / sizes[src]
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate) <= 2
        taken[src] += r["copies"] * r["size"]
    for src, want in target.items():
        assert abs(taken[src] - want) <= 0.01 * want + 90, (src, taken[src], want)
    again = mixing.mix_copies(spark.createDataFrame(docs, CLASH).repartition(3)).collect()
    assert sorted(got) == sorted(again)


def test_mix_hot_source_is_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") < 1500, "hot").otherwise("cold").alias("source"))
    got = {r[0]: (r[1], r[2]) for r in mixing.mix_copies(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.col("copies") * F.col("size")), F.max("target")).collect()}
    for taken, target in got.values():
        assert abs(taken - target) < 0.02 * target


def test_mix_edges(spark, odd):
    got = mixing.mix_copies(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["copies"] <= 2 for r in got)
    assert all(r["copies"] == 0 for r in got if r["size"] == 0 and r["source_size"] == 0)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() >= 1
    assert mixing.mix_copies(odd.limit(0)).collect() == []
    empty = odd.withColumn("text", F.lit(None).cast("string"))
    assert all(r["copies"] == 0 and r["target"] == 0 for r in mixing.mix_copies(empty).collect())


# ---------------------------------------------------------------------------- chat
TEXTS = ["", "plain", "\\### Assistant: </turn> ok", "<|end|>", "\\<|turn|>", "<", "|", "<<|", "a<\\|b\\", "\\\\", "é\n<|text|>x", None]


def test_chat_round_trip(spark):
    talk = [(c, t, ("user", "assistant", "sys<|end|>tem\\", None)[(c + t) % 4], TEXTS[(c * 5 + t * 7) % len(TEXTS)]) for c in range(12) for t in range(c % 5)]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    got = chat.format_chats(df).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("said")).collect()
    assert len(got) == len({c for c, *_ in talk})
    for r in got:
        mine = sorted((t, role or "", text or "") for c, t, role, text in talk if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [m[1:] for m in mine]
        assert r["said"] == [text for _, role, text in mine if role == "assistant"]


def test_chat_parts_and_edges(spark):
    part = lambda kind, **x: (kind, *(x.get(k) for k in ("text", "ref", "width", "height", "seconds", "pages")))
    data = [
        (1, 0, "user", [part("text", text="see "), part("image", ref="i1", width=56, height=57), part("audio", ref="a", seconds=1.5), part("document", ref="d", pages=2)]),
        (1, 0, "user", [part("text", text="see ")]),
        (None, None, None, None),
        (2, 0, "assistant", []),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn int, role string, parts array<{chat.PART}>").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    one = got[1]
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "i1", 6), ("audio", "a", 38), ("document", "d", 3000)]
    assert one["expanded_tokens"] == 3044 and "<|image|><|audio|><|document|>" in one["formatted"] and one["formatted"].count(chat.END) == 2
    assert got[None]["formatted"] == chat.TURN + chat.TEXT + chat.END and got[2]["loss_spans"][0]["len"] == 0
    assert chat.format_chats(df.limit(0)).collect() == []


def test_exact_dedup_of_the_smallest_and_largest_ids(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (0, "a b"), (-1, "c"), (None, "c")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(-(2**63), -(2**63), True), (2**63 - 1, -(2**63), False), (0, -(2**63), False), (-1, -1, True), (None, -1, False)}
