"""Registered token-alignment, join, decode and metric queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanfold.functions.text import SPAN_QUESTION, sigmoid
from spanfold.operators import decode as D
from spanfold.operators import joins as J
from spanfold.operators import metrics as M
from spanfold.operators import spans as S
from spanfold.operators import tokens as T
from spanfold.operators import vectors as V
from spanfold.operators.modeling import keyed_uniform_sql, train_val_split
from spanfold.plans import fixtures as X
from spanfold.plans.oracle import DOC_PRF_CTES, islands, prf_sql, with_base
from spanfold.plans.registry import register

# ---------------------------------------------------------------------------- shared oracle CTEs
MC = """mc AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range("start", "end")) AS off FROM messy WHERE source = 'C'),
tch AS (SELECT doc_id, tok_idx, unnest(range("start", "end")) AS off FROM tokens),
tc AS (SELECT t.doc_id, t.tok_idx, count(m.off) AS covered FROM tch t LEFT JOIN mc m USING (doc_id, off) GROUP BY t.doc_id, t.tok_idx)"""
GC = """gch AS (SELECT doc_id, tok_idx, unnest(range("start", "end")) AS off FROM tokens),
gc AS (SELECT t.doc_id, t.tok_idx, count(g.off) AS covered FROM gch t LEFT JOIN gold_chars g USING (doc_id, off) GROUP BY t.doc_id, t.tok_idx)"""
ARGMAX = "am AS (SELECT doc_id, tok_idx, \"start\", \"end\", CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS pred FROM token_scores)"


def _tokens(spark, sf_dir, method="rowlocal"):
    return X.tokens(spark, sf_dir, method)


def _gold(s):
    return S.normalize_spans(s.where(F.col("source") == "gold").select("doc_id", "start", "end"))


def _met(spark, sf_dir):
    """Tokens with the characters that gold covers: the texts pass one shuffle with their gold ranges, no token does."""
    return X.tokens(spark, sf_dir, ranges=_gold(X.spans(spark, sf_dir)))


def _messy_c(spark, sf_dir, t):
    m = X.messy_ranges(spark, sf_dir, t).where(F.col("source") == "C")
    return S.normalize_spans(m.select("doc_id", "start", "end"))


def _scores(t):
    s = X.token_scores_from_tokens(t, *[c for c in ("opens", "closes", "covered") if c in t.columns])
    return s.withColumn("pred", D.token_argmax(F.col("logit0"), F.col("logit1")))


# ---------------------------------------------------------------------------- labels
@register(
    "token_label_overlap",
    with_base(MC, 'SELECT t.doc_id, t.tok_idx, CASE WHEN t."end" > t."start" AND CAST(c.covered AS DOUBLE) / (t."end" - t."start") > 0.5 THEN 1 ELSE 0 END AS label FROM tokens t JOIN tc c USING (doc_id, tok_idx)'), bigint=('label',))
def q_token_label_overlap(spark, sf_dir):
    """Token labels against the noisy annotator's ranges, majority-of-characters rule (threshold 0.5)."""
    t = _tokens(spark, sf_dir)
    return T.token_label_overlap(t.select("doc_id", "tok_idx", "start", "end"), _messy_c(spark, sf_dir, t), 0.5).select("doc_id", "tok_idx", "label")


@register(
    "token_label_first_char",
    with_base(MC, 'SELECT t.doc_id, t.tok_idx, CASE WHEN m.off IS NULL THEN 0 ELSE 1 END AS label FROM tokens t LEFT JOIN mc m ON t.doc_id = m.doc_id AND m.off = t."start"'), bigint=('label',))
def q_token_label_first_char(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return T.token_label_first_char(t.select("doc_id", "tok_idx", "start", "end"), _messy_c(spark, sf_dir, t)).select("doc_id", "tok_idx", "label")


@register(
    "doc_label_fraction",
    with_base(
        "g AS (SELECT doc_id, count(*) AS n FROM gold_chars GROUP BY doc_id)",
        """SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars, CAST(coalesce(g.n, 0) AS BIGINT) AS gold_chars,
       round(CASE WHEN length(d.text) > 0 THEN CAST(coalesce(g.n, 0) AS DOUBLE) / length(d.text) END, 6) AS fraction,
       CASE WHEN length(d.text) > 0 AND CAST(coalesce(g.n, 0) AS DOUBLE) / length(d.text) > 0.3 THEN 1 ELSE 0 END AS label
FROM docs d LEFT JOIN g USING (doc_id)""",
    ), bigint=('label',))
def q_doc_label_fraction(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return T.doc_label_fraction(X.docs(spark, sf_dir), _gold(X.spans_from_tokens(t)), 0.3)


@register(
    "ignore_mask",
    with_base(
        GC,
        """SELECT t.doc_id, count(*) AS n_kept, CAST(sum(CASE WHEN g.covered > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos
FROM tokens t JOIN gc g USING (doc_id, tok_idx) WHERE t.core <> '' GROUP BY t.doc_id""",
    ),
)
def q_ignore_mask(spark, sf_dir):
    """Punctuation-only tokens play the special/padding positions: label NULL, dropped before scoring."""
    lab = T.token_label_overlap(_met(spark, sf_dir), None, 0.0, covered="covered")
    lab = lab.withColumn("label", F.when(F.col("core") != "", F.col("label")))
    kept = lab.where(F.col("label").isNotNull())
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum("label").alias("n_pos"))


@register(
    "pad_tag_decisions",
    with_base("", "SELECT doc_id, tok_idx, CASE WHEN 1 / (1 + exp(-logit1)) > 0.2 THEN 2 ELSE 1 END AS decision FROM token_scores WHERE tok_idx < 128"), bigint=('decision',))
def q_pad_tag_decisions(spark, sf_dir):
    s = _scores(_tokens(spark, sf_dir))
    return D.pad_tag_decisions(s, sigmoid(F.col("logit1")), 0.2, 128).select("doc_id", "tok_idx", "decision")


# ---------------------------------------------------------------------------- examples
GOLD_ISL = "gi AS (" + islands("gold_chars", "doc_id") + ")"


@register(
    "span_examples",
    with_base(
        GOLD_ISL,
        f"""SELECT g.doc_id, g."start" AS answer_start, substring(d.text, g."start" + 1, g."end" - g."start") AS answer_text,
       '{SPAN_QUESTION}' AS question, split_part(d.text, ' ', 1) AS title FROM gi g JOIN docs d USING (doc_id)""",
    ),
)
def q_span_examples(spark, sf_dir):
    """Question-answering training rows: one per gold run; span-less documents give none."""
    t = _tokens(spark, sf_dir)
    g = _gold(X.spans_from_tokens(t))
    d = X.docs(spark, sf_dir)
    j = g.join(d, "doc_id")
    return j.select(
        "doc_id",
        F.col("start").alias("answer_start"),
        F.expr("substring(text, start + 1, `end` - start)").alias("answer_text"),
        F.lit(SPAN_QUESTION).alias("question"),
        F.split("text", " ").getItem(0).alias("title"),
    )


@register(
    "multi_span_examples",
    with_base(
        GOLD_ISL + ",\nl AS (SELECT doc_id, list(\"start\" ORDER BY \"start\") AS s, list(\"end\" - 1 ORDER BY \"start\") AS e FROM gi GROUP BY doc_id)",
        """SELECT d.doc_id, '[' || coalesce(array_to_string(l.s, ', '), '') || ']' AS answer_starts,
       '[' || coalesce(array_to_string(l.e, ', '), '') || ']' AS answer_ends FROM docs d LEFT JOIN l USING (doc_id)""",
    ),
)
def q_multi_span_examples(spark, sf_dir):
    """One row per document (span-less ones kept) with all run starts and inclusive ends."""
    t = _tokens(spark, sf_dir)
    g = _gold(X.spans_from_tokens(t))
    l = g.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("r"))
    d = X.docs(spark, sf_dir).select("doc_id").join(l, "doc_id", "left")
    r = F.coalesce(F.col("r"), F.array().cast("array<struct<start:long,end:long>>"))
    return d.select(
        "doc_id",
        S.format_offsets(F.transform(r, lambda x: x["start"])).alias("answer_starts"),
        S.format_offsets(F.transform(r, lambda x: x["end"] - 1)).alias("answer_ends"),
    )


RANDOM_KEEP_SQL = keyed_uniform_sql("doc_id", "off") + " < 500"


@register(
    "random_spans",
    with_base(
        f"""ro AS (SELECT doc_id, unnest(range(0, length(text))) AS off FROM docs),
rk AS (SELECT doc_id, off FROM ro WHERE {RANDOM_KEEP_SQL}),
rr AS ({islands('rk', 'doc_id')}),
agg AS (SELECT doc_id, count(*) AS n_ranges, sum("end" - "start") AS n_chars, sum("start") AS sum_starts FROM rr GROUP BY doc_id)""",
        """SELECT d.doc_id, CAST(coalesce(a.n_ranges, 0) AS BIGINT) AS n_ranges, CAST(coalesce(a.n_chars, 0) AS BIGINT) AS n_chars,
       CAST(coalesce(a.sum_starts, 0) AS BIGINT) AS sum_starts FROM docs d LEFT JOIN agg a USING (doc_id)""",
    ),
)
def q_random_spans(spark, sf_dir):
    """Random baseline: each character kept with p = 1/2 by a keyed hash of (doc_id, offset).

    Row-local: the kept offsets of a document are filtered from ``sequence`` on its own
    row and cut into runs there; only the per-document summary leaves the row."""
    from spanfold.operators.modeling import random_offsets

    d = X.docs(spark, sf_dir)
    r = d.select("doc_id", random_offsets(F.col("doc_id"), F.length("text")).alias("offsets"))
    rr = S.offsets_to_ranges(r, "offsets")
    agg = rr.groupBy("doc_id").agg(F.count("*").alias("n_ranges"), F.sum(F.col("end") - F.col("start")).alias("n_chars"), F.sum("start").alias("sum_starts"))
    out = d.select("doc_id").join(agg, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_ranges", "n_chars", "sum_starts")])


# ---------------------------------------------------------------------------- windows over tokens
@register(
    "word_offsets",
    with_base("", "SELECT doc_id, tok_idx, CAST(coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ss_start FROM tokens"),
)
def q_word_offsets(spark, sf_dir):
    return T.word_offsets(_tokens(spark, sf_dir, "window")).select("doc_id", "tok_idx", "ss_start")


@register(
    "spans_to_entities",
    with_base(
        MC + ",\ntouch AS (SELECT t.doc_id, t.tok_idx, t.\"start\", t.\"end\", t.tok_idx - row_number() OVER (PARTITION BY t.doc_id ORDER BY t.tok_idx) AS isl FROM tokens t JOIN tc c USING (doc_id, tok_idx) WHERE c.covered > 0)",
        "SELECT doc_id, min(\"start\") AS \"start\", max(\"end\") AS \"end\", 'TOXIC' AS label FROM touch GROUP BY doc_id, isl",
    ),
)
def q_spans_to_entities(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return T.spans_to_entities(t.select("doc_id", "tok_idx", "start", "end"), _messy_c(spark, sf_dir, t))


# ---------------------------------------------------------------------------- joins
@register(
    "join_pred_gold",
    with_base(
        """gn AS (SELECT doc_id, count(*) AS n FROM gold_chars GROUP BY doc_id),
pn AS (SELECT doc_id, count(*) AS n FROM chars WHERE source = 'B' GROUP BY doc_id)""",
        "SELECT d.doc_id, CAST(coalesce(gn.n, 0) AS BIGINT) AS n_gold, CAST(coalesce(pn.n, 0) AS BIGINT) AS n_pred FROM docs d LEFT JOIN gn USING (doc_id) LEFT JOIN pn USING (doc_id)",
    ),
)
def q_join_pred_gold(spark, sf_dir):
    """Gold (every document, empty or not) LEFT JOIN model B's predictions on the id."""
    t = _tokens(spark, sf_dir)
    s = X.spans_from_tokens(t)

    def size(src):
        n = S.normalize_spans(s.where(F.col("source") == src).select("doc_id", "start", "end"))
        return n.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))

    gold = X.docs(spark, sf_dir).select("doc_id").join(size("gold").withColumnRenamed("n", "n_gold"), "doc_id", "left")
    j = J.join_pred_gold(gold, size("B").withColumnRenamed("n", "n_pred"))
    return j.select("doc_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


@register(
    "validate_submission",
    with_base(
        """p AS (SELECT doc_id, count(*) AS n FROM spans WHERE source = 'B' GROUP BY doc_id),
e AS (SELECT doc_id FROM docs WHERE text = ''),
m AS (SELECT count(*) AS n FROM e), tot AS (SELECT (SELECT sum(n) FROM p) + (SELECT n FROM m) AS lines, (SELECT count(*) FROM docs) AS ids)""",
        """SELECT 'missing_id' AS kind, doc_id, CAST(0 AS BIGINT) AS n_lines FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM p)
UNION ALL SELECT 'unknown_id', doc_id, CAST(n AS BIGINT) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM docs)
UNION ALL SELECT 'repeated_id', doc_id, CAST(n AS BIGINT) FROM p WHERE n > 1
UNION ALL SELECT 'malformed_line', NULL, CAST(n AS BIGINT) FROM m WHERE n > 0
UNION ALL SELECT 'line_count', NULL, CAST(lines AS BIGINT) FROM tot WHERE lines <> ids""",
    ),
)
def q_validate_submission(spark, sf_dir):
    """Model B as one line per range, and a line without an id for each empty text, checked against
    the id list of every document."""
    d = X.docs(spark, sf_dir)
    lines = X.spans(spark, sf_dir).where(F.col("source") == "B").select("doc_id")
    malformed = d.where(F.col("text") == "").select(F.lit("").alias("line"))
    return J.validate_submission(lines, d.select("doc_id"), malformed)


@register(
    "overlap_join",
    with_base(
        MC + ",\nmi AS (" + islands("mc", "doc_id") + ")",
        """SELECT t.doc_id, t.tok_idx, m."start" AS r_start, m."end" AS r_end,
       least(t."end", m."end") - greatest(t."start", m."start") AS overlap
FROM tokens t JOIN mi m ON t.doc_id = m.doc_id AND t."start" < m."end" AND m."start" < t."end\"""",
    ),
)
def q_overlap_join(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return T.overlap_join(t.select("doc_id", "tok_idx", "start", "end"), _messy_c(spark, sf_dir, t)).select("doc_id", "tok_idx", "r_start", "r_end", "overlap")


PAIRS_CTES = f"""
pairs AS (SELECT * FROM (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C')) p(coder_a, coder_b)),
pb AS (SELECT d.doc_id, p.coder_a, p.coder_b FROM docs d CROSS JOIN pairs p),
cl AS (SELECT doc_id, source, count(*) AS n FROM chars GROUP BY doc_id, source),
ci AS (SELECT a.doc_id, a.source AS coder_a, b.source AS coder_b, count(*) AS n FROM chars a JOIN chars b
       ON a.doc_id = b.doc_id AND a.off = b.off AND a.source < b.source
       WHERE a.source <> 'gold' AND b.source <> 'gold' GROUP BY a.doc_id, a.source, b.source),
pf AS (SELECT pb.doc_id, pb.coder_a, pb.coder_b, coalesce(la.n, 0) AS na, coalesce(lb.n, 0) AS nb, coalesce(ci.n, 0) AS ni
       FROM pb LEFT JOIN cl la ON la.doc_id = pb.doc_id AND la.source = pb.coder_a
       LEFT JOIN cl lb ON lb.doc_id = pb.doc_id AND lb.source = pb.coder_b
       LEFT JOIN ci ON ci.doc_id = pb.doc_id AND ci.coder_a = pb.coder_a AND ci.coder_b = pb.coder_b),
pf1 AS (SELECT doc_id, coder_a, coder_b, {prf_sql('na', 'nb', 'ni')} FROM pf)
"""


def _pair_f1(spark, sf_dir):
    s = X.spans(spark, sf_dir).where(F.col("source") != "gold").withColumnRenamed("source", "coder")
    return M.pairwise_agreement(X.docs(spark, sf_dir), s, X.MODELS)


@register("coder_pairs", with_base(PAIRS_CTES, "SELECT doc_id, coder_a, coder_b, round(f1, 6) AS f1 FROM pf1"))
def q_coder_pairs(spark, sf_dir):
    return _pair_f1(spark, sf_dir)


@register("pairwise_agreement", with_base(PAIRS_CTES, "SELECT doc_id, round(avg(f1), 6) AS agreement FROM pf1 GROUP BY doc_id"))
def q_pairwise_agreement(spark, sf_dir):
    return _pair_f1(spark, sf_dir).groupBy("doc_id").agg(F.avg("f1").alias("agreement"))


VOCAB_CTES = f"""
tr AS (SELECT tok FROM tokens WHERE {keyed_uniform_sql("doc_id", "0")} < 800),
vocab AS MATERIALIZED (SELECT tok AS word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tok) + 1 AS idx FROM tr GROUP BY tok),
ids AS MATERIALIZED (SELECT t.doc_id, t.tok_idx, CAST(coalesce(v.idx, 1) AS BIGINT) AS word_id FROM tokens t LEFT JOIN vocab v ON t.tok = v.word)
"""


def _vocab(t):
    """Vocabulary of the training split's tokens (the split is a function of the id: no join)."""
    return J.vocab_build(train_val_split(t).where(F.col("split") == "train").select(F.col("tok").alias("word")))


def _ids(spark, sf_dir, first=None):
    """Ids of every token, or of each document's ``first`` tokens (the vocabulary is built from all)."""
    t = _tokens(spark, sf_dir)
    wanted = t if first is None else t.where(F.col("tok_idx") < first)
    return J.vocab_lookup(wanted.select("doc_id", "tok_idx", "tok"), _vocab(t))


@register("vocab_build", with_base(VOCAB_CTES, "SELECT word, CAST(idx AS BIGINT) AS idx, n FROM vocab"))
def q_vocab_build(spark, sf_dir):
    """Vocabulary of the training split: ids from 2 by frequency, then word."""
    return _vocab(_tokens(spark, sf_dir)).select("word", "idx", "n")


@register("vocab_lookup", with_base(VOCAB_CTES, "SELECT * FROM ids"))
def q_vocab_lookup(spark, sf_dir):
    return _ids(spark, sf_dir).select("doc_id", "tok_idx", "word_id")


VEC_CTES = VOCAB_CTES + """,
vn AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings),
tv AS (SELECT i.doc_id, i.tok_idx, coalesce(vn.norm, 0.0) AS norm FROM ids i LEFT JOIN vn ON vn.vec_id = i.word_id AND i.word_id > 1)"""


def _token_vectors(spark, sf_dir):
    from spanfold.sources.tables import embeddings

    # a word's vector is that of its id: looked up once a word of the vocabulary, not once a token
    t = _tokens(spark, sf_dir)
    v = J.vector_lookup(_vocab(t).select("word", "idx"), embeddings(spark, sf_dir), "idx")
    v = v.select("word", "idx", J.l2_norm(F.col("vector")).alias("norm"))
    ids = J.vocab_lookup(t.select("doc_id", "tok_idx", "tok"), v, carry=("norm",))
    return ids.withColumn("norm", F.coalesce("norm", F.lit(0.0)))  # the unknown word's zero vector


@register("vector_lookup", with_base(VEC_CTES, "SELECT doc_id, tok_idx, round(norm, 6) AS vec_norm FROM tv"))
def q_vector_lookup(spark, sf_dir):
    """Token -> pre-trained vector of its vocabulary id (unknown -> zero vector); reported as its L2 norm."""
    return _token_vectors(spark, sf_dir).select("doc_id", "tok_idx", F.col("norm").alias("vec_norm"))


@register("word_vectors", None)
def q_word_vectors(spark, sf_dir):
    """Vectors of the corpus' words (20 co-occurrences and more) by shifted PPMI and randomised factorisation."""
    return V.word_vectors(V.shifted_ppmi(V.cooccurrences(X.docs(spark, sf_dir))))


@register(
    "importance_norm",
    with_base(VEC_CTES, "SELECT doc_id, tok_idx, round(CASE WHEN sum(norm) OVER (PARTITION BY doc_id) > 0 THEN norm / sum(norm) OVER (PARTITION BY doc_id) ELSE 0 END, 6) AS weight FROM tv"),
)
def q_importance_norm(spark, sf_dir):
    """Token weight = ||vector|| / sum of ||vector|| in the document (vectors as attributions)."""
    v = _token_vectors(spark, sf_dir)
    tot = F.sum("norm").over(Window.partitionBy("doc_id"))
    return v.select("doc_id", "tok_idx", F.when(tot > 0, F.col("norm") / tot).otherwise(0.0).alias("weight"))


@register(
    "param_cross",
    "SELECT CAST(row_number() OVER (ORDER BY lang, source) AS BIGINT) AS param_id, lang, source FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s",
)
def q_param_cross(spark, sf_dir):
    """Sweep grid over the corpus' languages x sources, numbered 1..n."""
    d = X.docs(spark, sf_dir, "lang", "source")
    return J.param_cross(spark, {"lang": d, "source": d}).select("param_id", "lang", "source")


def _seq_sql(pre: bool) -> str:
    pad = "list_concat(list_resize([]::BIGINT[], 128 - len(s), 0), s)" if pre else "list_resize(s, 128, 0)"
    return with_base(
        VOCAB_CTES + ",\nsq AS (SELECT doc_id, list(word_id ORDER BY tok_idx) AS s0 FROM ids GROUP BY doc_id),\nsc AS (SELECT d.doc_id, coalesce(s0[1:128], []::BIGINT[]) AS s FROM docs d LEFT JOIN sq USING (doc_id))",
        f"SELECT doc_id, '[' || array_to_string({pad}, ', ') || ']' AS sequence FROM sc",
    )


def _sequences(spark, sf_dir, padding):
    from spanfold.operators.modeling import pad_sequence

    ids = _ids(spark, sf_dir, 128)
    sq = ids.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tok_idx", "word_id"))).alias("s"))
    d = X.docs(spark, sf_dir).select("doc_id").join(sq, "doc_id", "left")
    seq = F.transform(F.coalesce(F.col("s"), F.array().cast("array<struct<tok_idx:long,word_id:long>>")), lambda x: x["word_id"])
    return d.select("doc_id", S.format_offsets(pad_sequence(seq, 128, padding)).alias("sequence"))


@register("text_to_sequence", _seq_sql(False))
def q_text_to_sequence(spark, sf_dir):
    """Token ids in order, cut to 128 and zero-padded at the end."""
    return _sequences(spark, sf_dir, "post")


@register("pad_sequence", _seq_sql(True))
def q_pad_sequence(spark, sf_dir):
    """The same ids padded in front ("pre"); long sequences are cut at the end on both sides."""
    return _sequences(spark, sf_dir, "pre")


# ---------------------------------------------------------------------------- decoding
@register("token_argmax", with_base(ARGMAX, "SELECT doc_id, tok_idx, pred FROM am"), bigint=('pred',))
def q_token_argmax(spark, sf_dir):
    return _scores(_tokens(spark, sf_dir)).select("doc_id", "tok_idx", "pred")


DEC_CTES = ARGMAX + """,
dc AS (SELECT DISTINCT doc_id, unnest(range("start", "end")) AS off FROM am WHERE pred = 1)"""


@register("decode_tokens", with_base(DEC_CTES, islands("dc", "doc_id")))
def q_decode_tokens(spark, sf_dir):
    return D.decode_tokens(_scores(_tokens(spark, sf_dir)))


@register(
    "decode_masked",
    with_base(
        ARGMAX
        + """,
st AS (SELECT doc_id, min(tok_idx) AS stop FROM tokens WHERE core = '' GROUP BY doc_id),
dm AS (SELECT DISTINCT a.doc_id, unnest(range(a."start", a."end")) AS off FROM am a LEFT JOIN st USING (doc_id)
       WHERE a.pred = 1 AND (st.stop IS NULL OR a.tok_idx < st.stop))""",
        islands("dm", "doc_id"),
    ),
)
def q_decode_masked(spark, sf_dir):
    """Decoding that stops at the first masked position; punctuation-only tokens play the padding."""
    t = _tokens(spark, sf_dir)
    s = X.token_scores_from_tokens(t, "core").withColumn("pred", D.token_argmax(F.col("logit0"), F.col("logit1")))
    return D.decode_masked(s, F.col("core") == "")


@register(
    "decode_gap_fill",
    with_base(
        ARGMAX
        + """,
lg AS (SELECT *, lag(pred) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS pp, lag("end") OVER (PARTITION BY doc_id ORDER BY tok_idx) AS pe FROM am),
gf AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN pp = 1 THEN least(pe, "start") ELSE "start" END, "end")) AS off FROM lg WHERE pred = 1)""",
        islands("gf", "doc_id"),
    ),
)
def q_decode_gap_fill(spark, sf_dir):
    return D.decode_gap_fill(_scores(_tokens(spark, sf_dir)))


@register(
    "offset_f1_from_tokens",
    with_base(
        DEC_CTES
        + f""",
np AS (SELECT doc_id, count(*) AS n FROM dc GROUP BY doc_id),
ng AS (SELECT doc_id, count(*) AS n FROM gold_chars GROUP BY doc_id),
ni AS (SELECT p.doc_id, count(*) AS n FROM dc p JOIN gold_chars g USING (doc_id, off) GROUP BY p.doc_id),
c AS (SELECT d.doc_id, coalesce(np.n, 0) AS n_pred, coalesce(ng.n, 0) AS n_gold, coalesce(ni.n, 0) AS n_inter
      FROM docs d LEFT JOIN np USING (doc_id) LEFT JOIN ng USING (doc_id) LEFT JOIN ni USING (doc_id))""",
        f"SELECT doc_id, round(f1, 6) AS f1 FROM (SELECT doc_id, {prf_sql('n_pred', 'n_gold', 'n_inter')} FROM c) x",
    ),
)
def q_offset_f1_from_tokens(spark, sf_dir):
    """Argmax tokens -> character ranges -> document F1 against gold (every document)."""
    t = _tokens(spark, sf_dir)
    pred = D.decode_tokens(_scores(t)).withColumn("source", F.lit("argmax"))
    gold = X.spans_from_tokens(t).where(F.col("source") == "gold").drop("source")
    return M.doc_prf(X.docs(spark, sf_dir), pred, gold, ["argmax"]).select("doc_id", "f1")


@register(
    "token_f1",
    with_base(
        ARGMAX + ",\n" + GC,
        """SELECT doc_id, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM (
  SELECT a.doc_id, CAST(sum(CASE WHEN g.covered > 0 AND a.pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN g.covered = 0 AND a.pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN g.covered > 0 AND a.pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM am a JOIN gc g USING (doc_id, tok_idx) GROUP BY a.doc_id) x""",
    ),
)
def q_token_f1(spark, sf_dir):
    lab = T.token_label_overlap(_scores(_met(spark, sf_dir)), None, 0.0, covered="covered")
    return M.token_f1(lab)


@register(
    "toxic_token_index",
    with_base(ARGMAX, "SELECT doc_id, '[' || array_to_string(list(tok_idx ORDER BY tok_idx), ', ') || ']' AS toxic_idx FROM am WHERE pred = 1 GROUP BY doc_id"),
)
def q_toxic_token_index(spark, sf_dir):
    r = D.toxic_token_index(_scores(_tokens(spark, sf_dir)))
    return r.select("doc_id", S.format_offsets(F.col("toxic_idx")).alias("toxic_idx"))


# ---------------------------------------------------------------------------- classification and losses
CLS_CTES = """
ds AS (SELECT doc_id, max(logit1) AS m FROM token_scores GROUP BY doc_id),
lab AS (SELECT l.doc_id, l.toxic AS y, 1 / (1 + exp(-coalesce(ds.m, 0.0))) AS s FROM labels l JOIN docs d USING (doc_id) LEFT JOIN ds USING (doc_id)),
cnt AS (SELECT sum(y) AS npos, count(*) - sum(y) AS nneg, count(*) AS n,
  sum(CASE WHEN y = 1 AND s > 0.5 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND s > 0.5 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND s <= 0.5 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND s <= 0.5 THEN 1 ELSE 0 END) AS tn,
  avg((s - y) * (s - y)) AS mse FROM lab),
pairs AS (SELECT sum(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END) AS wins FROM lab p JOIN lab q ON p.y = 1 AND q.y = 0)
"""


@register(
    "classification_metrics",
    with_base(
        CLS_CTES,
        """SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy,
       round(CASE WHEN npos > 0 AND nneg > 0 THEN wins / (npos * nneg) END, 6) AS roc_auc, round(mse, 6) AS mse
FROM cnt, pairs""",
    ),
)
def q_classification_metrics(spark, sf_dir):
    """Document score = sigmoid(max token logit) against ``labels.toxic``."""
    from spanfold.sources.tables import labels

    s = _scores(_tokens(spark, sf_dir)).groupBy("doc_id").agg(F.max("logit1").alias("m"))
    l = labels(spark, sf_dir).join(X.docs(spark, sf_dir).select("doc_id"), "doc_id").join(s, "doc_id", "left")
    l = l.select(F.col("toxic").alias("label"), sigmoid(F.coalesce(F.col("m"), F.lit(0.0))).alias("score"))
    return M.classification_metrics(l)


LOSS_CTES = ARGMAX + ",\n" + GC + """,
tl AS (SELECT s.doc_id, s.tok_idx, s."start", s."end", s.logit0, s.logit1, s.start_logit, s.end_logit, CASE WHEN g.covered > 0 THEN 1 ELSE 0 END AS y, t.core
       FROM token_scores s JOIN gc g USING (doc_id, tok_idx) JOIN tokens t USING (doc_id, tok_idx)),
ls AS (SELECT *, greatest(logit0, logit1) + ln(exp(logit0 - greatest(logit0, logit1)) + exp(logit1 - greatest(logit0, logit1))) AS lse FROM tl)"""


@register(
    "smoothed_ce",
    with_base(
        LOSS_CTES,
        """SELECT doc_id, round(sum(-((CASE WHEN y = 0 THEN 0.9 ELSE 0.1 END) * (logit0 - lse) + (CASE WHEN y = 1 THEN 0.9 ELSE 0.1 END) * (logit1 - lse))) / count(*), 6) AS loss
FROM ls WHERE core <> '' GROUP BY doc_id""",
    ),
)
def q_smoothed_ce(spark, sf_dir):
    """Label-smoothed (0.1) cross-entropy per document over unmasked tokens."""
    from spanfold.operators.modeling import smoothed_ce

    lab = T.token_label_overlap(X.token_scores_from_tokens(_met(spark, sf_dir), "core", "covered"), None, 0.0, covered="covered")
    lab = lab.withColumn("mask", F.when(F.col("core") != "", 1).otherwise(0))
    return smoothed_ce(lab, ["logit0", "logit1"], "label", 0.1, "mask")


@register(
    "plain_losses",
    with_base(
        LOSS_CTES
        + """,
gs AS (SELECT DISTINCT doc_id, "start" AS st FROM (""" + islands("gold_chars", "doc_id") + """) q),
ge AS (SELECT DISTINCT doc_id, "end" AS en FROM (""" + islands("gold_chars", "doc_id") + """) q),
fl AS (SELECT l.*, CASE WHEN gs.st IS NULL THEN 0 ELSE 1 END AS ys, CASE WHEN ge.en IS NULL THEN 0 ELSE 1 END AS ye
       FROM ls l LEFT JOIN gs ON gs.doc_id = l.doc_id AND gs.st = l."start" LEFT JOIN ge ON ge.doc_id = l.doc_id AND ge.en = l."end")""",
        """SELECT round(avg(lse - CASE WHEN y = 1 THEN logit1 ELSE logit0 END), 6) AS ce_token,
       round(avg(greatest(start_logit, 0) - start_logit * ys + ln(1 + exp(-abs(start_logit)))), 6) AS bce_start,
       round(avg(greatest(end_logit, 0) - end_logit * ye + ln(1 + exp(-abs(end_logit)))), 6) AS bce_end,
       round(avg(power(1 / (1 + exp(-logit1)) - y, 2)), 6) AS mse FROM fl""",
    ),
)
def q_plain_losses(spark, sf_dir):
    """Token cross-entropy, start/end BCE-with-logits (flags at gold run boundaries), MSE of sigmoid(logit1)."""
    from spanfold.operators.modeling import bce_with_logits, cross_entropy

    lab = T.token_label_overlap(_scores(_met(spark, sf_dir)), None, 0.0, covered="covered")
    ys, ye = F.col("opens"), F.col("closes")
    return lab.agg(
        F.avg(cross_entropy([F.col("logit0"), F.col("logit1")], F.col("label"))).alias("ce_token"),
        F.avg(bce_with_logits(F.col("start_logit"), ys)).alias("bce_start"),
        F.avg(bce_with_logits(F.col("end_logit"), ye)).alias("bce_end"),
        F.avg(F.pow(sigmoid(F.col("logit1")) - F.col("label"), 2)).alias("mse"),
    )


# ---------------------------------------------------------------------------- split scores and counts
@register(
    "split_scores",
    with_base(
        DOC_PRF_CTES,
        "SELECT d.lang AS split, count(*) AS n_docs, round(avg(p.f1), 6) AS mean_f1 FROM doc_prf p JOIN documents d USING (doc_id) WHERE p.source = 'B' GROUP BY d.lang",
    ),
)
def q_split_scores(spark, sf_dir):
    """One score row per split (language): mean F1 of model B."""
    from spanfold.plans.q_metrics import model_scores

    s = model_scores(spark, sf_dir).where(F.col("source") == "B")
    s = s.join(X.docs(spark, sf_dir, "lang").select("doc_id", F.col("lang").alias("split")), "doc_id")
    return s.groupBy("split").agg(F.count("*").alias("n_docs"), F.avg("f1").alias("mean_f1"))
