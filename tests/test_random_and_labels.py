"""The random baseline without an expression per character, labels without a second shuffle of every token."""

from pyspark.sql import functions as F

from spanfold.operators import tokens as T
from spanfold.operators.modeling import HASH_MOD, keyed_uniform, random_offsets


def test_random_offsets_are_the_keyed_values(spark):
    rows = [(0, 300), (7, 1), (-5, 50), (2**62 + 11, 120), (None, 40), (3, 0), (4, -1), (9, None)]
    d = spark.createDataFrame(rows, "doc_id long, n int").coalesce(1)
    got = {(r["doc_id"], r["n"]): r["o"] for r in d.withColumn("o", random_offsets(F.col("doc_id"), F.greatest("n", F.lit(0)))).collect()}
    each = d.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.where(keyed_uniform(F.col("doc_id"), F.col("i")) < HASH_MOD // 2)
    want = {(r["doc_id"], r["n"]): r["o"] for r in each.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list("i")).alias("o")).collect()}
    assert got == {(k, n): want.get((k, n), []) for k, n in got}
    plan = d.select(random_offsets(F.col("doc_id"), F.col("n")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_labels_shuffle_whole_tokens_once(spark):
    block = T.BLOCK
    tokens = spark.createDataFrame(
        [(1, 0, 0, 4, "a"), (1, 1, 5, 9, "b"), (1, 2, block - 3, block + 7, "c"), (1, 3, block + 8, 3 * block, "d"), (2, 0, 0, 4, "e"), (2, 0, 0, 4, "e"),
         (None, 0, 0, 4, "f"), (3, 0, 2, 2, "g")], "doc_id long, tok_idx long, start long, end long, tok string")
    gold = spark.createDataFrame([(1, 2, 7), (1, block - 1, 2 * block + 8), (2, 3, 4), (None, 0, 4), (3, 0, 9)], "doc_id long, start long, end long")
    for threshold, ones in ((0.0, {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}), (0.49, {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}), (0.6, {(1, 2)})):
        got = T.token_label_overlap(tokens, gold, threshold).collect()
        assert sorted((r["tok"], r["label"]) for r in got) == [(t, int(k in ones)) for t, k in zip("abcdefg", [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (None, 0), (3, 0)])]
    plan = T.token_label_overlap(tokens, gold)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan
