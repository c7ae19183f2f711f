"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.llm import chat, dsir, exact_dedup, hmm, html_text, langid, mixing, near_dedup, packing, phrases, pii, rules, runs
from spanfold.llm.common import fold, table

RANKS, END_ID, CAPACITY = "byte_bpe_50k.tiktoken", 2, 1024


def tokenizer() -> tuple[str, str]:
    """(path of the vocabulary as ranks, pattern that splits text) of the public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rules.quality_rules(docs, labels).select(*columns)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.predict(docs, langid.train(docs, langid.training_rows()))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target text: labelled good documents that aren't toxic; the sample is as large as their share of the labels."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    share = labels.agg(F.avg(F.when(good, 1.0).otherwise(0.0))).first()[0]
    return dsir.resample(docs, labels.where(good).select("doc_id"), 1.0 if share is None else share)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT src, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w
  FROM docs GROUP BY src
), total AS (SELECT sum(source_size)::DOUBLE AS t FROM per
), lev(k, level) AS (
  SELECT 0, -1.0::DOUBLE
  UNION ALL
  SELECT k + 1, (SELECT (1.5 * any_value(t) - sum(CASE WHEN 2.0 * source_size < lev.level * w THEN 2.0 * source_size ELSE 0 END))
                        / sum(CASE WHEN 2.0 * source_size < lev.level * w THEN 0 ELSE w END) FROM per, total)
  FROM lev WHERE k < 40
), target AS (
  SELECT src, n, source_size, least(2.0 * source_size, greatest((SELECT max(level) FROM lev), 0) * w)::DOUBLE AS target FROM per
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END::DOUBLE AS rate, ceil(n / 8192)::BIGINT AS buckets,
         ('0x' || substr(md5(src || '|42'), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS off
  FROM target
), hashed AS (
  SELECT d.doc_id, d.size, r.*, ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|42'), 1, 15))::BIGINT AS h FROM docs d JOIN rates r USING (src)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h % buckets, CASE WHEN (h % buckets) % 2 = 0 THEN size ELSE -size END, h, doc_id) AS i FROM hashed
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(off + i * rate) - floor(off + (i - 1) * rate), 2) AS BIGINT) * size AS taken
FROM ranked
"""


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), *tokenizer(), END_ID, CAPACITY)
    return packing.pack(pieces, CAPACITY)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("m"))
    extra = extra.select("conv_id", "m.turn", "m.role", F.lit(hard).alias("text"))
    chats = chat.format_chats(talks.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text"))))
    turns, said = chat.read_back(F.col("formatted")), F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_spans")), "")
    return chats.withColumn("turns", turns).withColumn("said", said).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body, replace(replace(role, '\', '\\'), '<|', '<\|') AS head FROM m
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, body)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(head) + length(body) + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumnRenamed("digest", "text_sha256")


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars FROM documents
), k AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), said AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), sizes AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM said GROUP BY lang
), places AS (
  SELECT lang, d, ws, unnest(range(1, len(ws) - d + 2)) AS i FROM said, (VALUES (1), (2), (3), (4), (5)) v(d) WHERE len(ws) >= d
), counts AS (
  SELECT lang, d, array_to_string(ws[i:i + d - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM places GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, d)) AS k FROM counts WHERE d > 1
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, h.f AS l, t.f AS r, s.n, ((1000::HUGEINT * c.f * s.n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN sizes s ON s.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (
    SELECT 1 FROM counts y WHERE y.lang = x.lang AND y.phrase <> x.phrase AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.f >= 100 * x.a)
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
), grown AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[2:], ' ') AS phrase, 1 AS on_left FROM counts WHERE d > 2
  UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[:d - 1], ' '), 0 FROM counts WHERE d > 2
), kinds AS (
  SELECT lang, phrase, sum(on_left)::BIGINT AS left_kinds, sum(1 - on_left)::BIGINT AS right_kinds FROM grown GROUP BY ALL
)
SELECT r.*, coalesce(left_kinds, 0) AS left_kinds, coalesce(right_kinds, 0) AS right_kinds
FROM ranked r LEFT JOIN kinds USING (lang, phrase) WHERE rank <= 2000
"""


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.runs(table(spark, sf_dir, "documents", "doc_id", "text"), rewrite=runs.repeated_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    row = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.back")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.less")).alias("period"),
        F.expr("(1000 * top.length) div -top.less").alias("exponent_milli"),
        F.sha2(F.array_join(row, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_text, op2_lm_score, op3_quality_rules, op4_langid, op5_near_dedup, op6_importance_resampling, op7_mix, op8_pack, op9_chat, op10_exact_dedup, op11_phrases, op12_runs, op13_pii)
}
ORACLE_SQL: dict[str, str] = {"op7_mix": OP7_SQL, "op9_chat": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_phrases": OP11_SQL}
