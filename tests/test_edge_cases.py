"""Edge cases listed in FIXTURES.md §2 (not covered by the reference's own tests)."""

from pyspark.sql import functions as F

from spanfold.operators import cleaning as C
from spanfold.operators import ensemble as E
from spanfold.operators import metrics as M
from spanfold.operators import spans as S
from spanfold.operators import tokens as T


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _runs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, start long, end long")


def _clean(spark, text, runs, mode="expand"):
    out = C.clean_spans(_runs(spark, [(0, s, e) for s, e in runs]), _docs(spark, [(0, text)]), mode=mode)
    return sorted((r["start"], r["end"]) for r in out.collect())


def test_empty_text_and_no_spans(spark):
    docs = _docs(spark, [(0, ""), (1, "no spans here")])
    assert T.tokenize_offsets(docs).where("doc_id = 0").count() == 0
    pred = spark.createDataFrame([], "doc_id long, source string, start long, end long")
    gold = _runs(spark, [])
    sc = {r["doc_id"]: r["f1"] for r in M.doc_prf(docs.select("doc_id"), pred, gold, ["m"]).collect()}
    assert sc == {0: 1.0, 1: 1.0}  # empty gold and empty prediction score 1


def test_short_runs_dropped_and_kept(spark):
    text = "ab cd efg hij"
    assert _clean(spark, text, [(0, 1)], mode="trim") == []  # one character
    assert _clean(spark, text, [(0, 2)], mode="trim") == []  # two characters go too
    assert _clean(spark, text, [(6, 9)], mode="trim") == [(6, 9)]


def test_whitespace_only_run(spark):
    assert _clean(spark, "a    b", [(1, 5)], mode="trim") == []


def test_two_runs_in_one_word_merge_under_expansion(spark):
    # runs "ord" and "wor" inside "wordy" both expand to the whole word: one range, no duplicates
    text = "a wordy day"
    assert _clean(spark, text, [(3, 6), (2, 5)]) == [(2, 7)]


def test_run_beyond_text_is_clipped_and_reported(spark):
    docs = _docs(spark, [(0, "short text")])
    runs = _runs(spark, [(0, 6, 40)])
    clipped, bad = C.clip_ranges(runs, docs)
    assert [(r["start"], r["end"]) for r in clipped.collect()] == [(6, 10)]
    assert [r["kind"] for r in bad.collect()] == ["beyond_text"]


def test_emoji_and_cjk_neighbours(spark):
    text = "x😀abc中文 de"
    # "bc" cut from "abc": expands left over "a" (a letter), stops at the emoji; CJK letters
    # are alphanumeric, so the right side grows over 中文
    got = _clean(spark, text, [(3, 5)])
    assert got == [(2, 7)]
    toks = T.tokenize_offsets(_docs(spark, [(0, text)])).collect()
    assert [(r["tok"], r["start"], r["end"]) for r in toks] == [("x😀abc中文", 0, 7), ("de", 8, 10)]


def test_duplicate_and_unsorted_offsets(spark):
    df = spark.createDataFrame([(0, [5, 6, 7, 5, 6, 1, 2, 3])], "doc_id long, offsets array<int>")
    runs = sorted((r["start"], r["end"]) for r in S.offsets_to_ranges(df).collect())
    assert runs == [(1, 4), (5, 7), (5, 8)]  # runs in list order, duplicates allowed
    norm = sorted((r["start"], r["end"]) for r in S.normalize_spans(S.offsets_to_ranges(df)).collect())
    assert norm == [(1, 4), (5, 8)]
    lit = spark.createDataFrame([("[3, 1, 2, 2]",), ("oops",), ("(1,)",), (None,)], "s string")
    parsed = [r[0] for r in lit.select(S.parse_spans(F.col("s"))).collect()]
    assert parsed == [[3, 1, 2, 2], [], [], []]
    fmt = spark.createDataFrame([([3, 1, 2, 2],)], "o array<int>").select(S.format_offsets(S.sorted_offsets(F.col("o")))).first()[0]
    assert fmt == "[1, 2, 3]"


def test_document_missing_from_one_model(spark):
    # file A holds docs 0 and 1, file B only doc 0: the fold ignores B for doc 1
    ranges = spark.createDataFrame([(0, "A", 0, 10), (0, "B", 5, 15), (1, "A", 0, 4)], "doc_id long, source string, start long, end long")
    presence = spark.createDataFrame([(0, "A"), (1, "A"), (0, "B")], "doc_id long, source string")
    got = sorted((r["doc_id"], r["start"], r["end"]) for r in E.combine_files(ranges, presence, "intersect").collect())
    assert got == [(0, 5, 10), (1, 0, 4)]
    strict = sorted((r["doc_id"], r["start"], r["end"]) for r in E.combine_files(ranges, presence, "intersect", strict=True).collect())
    assert strict == [(0, 5, 10)]


def test_majority_with_two_models_is_union(spark):
    ranges = spark.createDataFrame([(0, "A", 0, 3), (0, "B", 5, 8)], "doc_id long, source string, start long, end long")
    got = sorted((r["start"], r["end"]) for r in E.span_majority(ranges, 2).collect())
    assert got == [(0, 3), (5, 8)]
    assert E.span_vote(ranges, 2).count() == 0


def test_sem_of_one_document_is_null(spark):
    sc = spark.createDataFrame([("m", 0.5)], "source string, f1 double")
    r = M.system_f1_sem(sc).first()
    assert r["mean_f1"] == 0.5 and r["sem_f1"] is None
