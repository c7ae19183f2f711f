"""Registered window, n-best, ranking and threshold-tuning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfold.functions.text import sigmoid
from spanfold.operators import candidates as K
from spanfold.operators import decode as D
from spanfold.operators import spans as S
from spanfold.operators import tokens as T
from spanfold.plans import fixtures as X
from spanfold.plans.oracle import islands, with_base
from spanfold.plans.registry import register
from spanfold.session import scratch_path

L, STRIDE, STEP, NBEST, MAXLEN_ANS, TOPK, THR = 384, 128, 256, 20, 30, 3, 0.5

WIN_CTES = f"""
nt AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
win AS (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - {L}) / {STEP}.0) AS BIGINT)))) AS window_id FROM nt),
wins AS (SELECT doc_id, window_id, window_id * {STEP} AS first_tok, least(window_id * {STEP} + {L}, n) - 1 AS last_tok FROM win),
cls AS (SELECT doc_id, window_id,
  -3 + CAST((doc_id * 13 + (1000000 + window_id) * 29) % 37 - 18 AS DOUBLE) / 10 AS cls_start,
  -3 + CAST((doc_id * 7 + (1000000 + window_id) * 23) % 31 - 15 AS DOUBLE) / 10 AS cls_end FROM wins),
nulls AS (SELECT doc_id, max(cls_start + cls_end) AS null_score FROM cls GROUP BY doc_id),
wt AS (SELECT w.doc_id, w.window_id, s.tok_idx, s."start", s."end", s.start_logit, s.end_logit
       FROM wins w JOIN token_scores s ON s.doc_id = w.doc_id AND s.tok_idx BETWEEN w.first_tok AND w.last_tok),
ts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, window_id ORDER BY start_logit DESC, tok_idx DESC) AS rk FROM wt),
te AS (SELECT *, row_number() OVER (PARTITION BY doc_id, window_id ORDER BY end_logit DESC, tok_idx DESC) AS rk FROM wt),
pairs AS (SELECT s.doc_id, s.window_id, s.tok_idx AS start_tok, e.tok_idx AS end_tok, s.rk AS start_rank, e.rk AS end_rank,
                 s."start", e."end", s.start_logit, e.end_logit
          FROM ts s JOIN te e ON s.doc_id = e.doc_id AND s.window_id = e.window_id
          WHERE s.rk <= {NBEST} AND e.rk <= {NBEST} AND e.tok_idx >= s.tok_idx AND e.tok_idx - s.tok_idx + 1 <= {MAXLEN_ANS}),
rmean AS (SELECT p.doc_id, p.window_id, p.start_tok, p.end_tok, avg(x.logit1) AS token_score
          FROM pairs p JOIN token_scores x ON x.doc_id = p.doc_id AND x.tok_idx BETWEEN p.start_tok AND p.end_tok
          GROUP BY p.doc_id, p.window_id, p.start_tok, p.end_tok),
cand AS (SELECT p.*, (p.start_logit + p.end_logit) / 2 AS qa_score, round(r.token_score, 9) AS token_score,
                round((p.start_logit + p.end_logit) / 2 + round(r.token_score, 9), 9) AS score
         FROM pairs p JOIN rmean r USING (doc_id, window_id, start_tok, end_tok)),
best AS (SELECT doc_id, max(round(score, 9)) AS b FROM cand GROUP BY doc_id),
base AS (SELECT d.doc_id, best.b, nulls.null_score FROM docs d LEFT JOIN best USING (doc_id) LEFT JOIN nulls USING (doc_id)),
allc AS (
  SELECT doc_id, "start", "end", score, window_id, start_rank, end_rank, 1 AS kind, start_tok, end_tok FROM cand
  UNION ALL SELECT doc_id, NULL, NULL, 0.0, NULL, NULL, NULL, 1, NULL, NULL FROM base WHERE b IS NULL
  UNION ALL SELECT doc_id, NULL, NULL, null_score, NULL, NULL, NULL, 0, NULL, NULL FROM base
            WHERE null_score IS NOT NULL AND coalesce(b, 0.0) <= round(null_score, 9)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, round(score, 9) DESC, start_rank NULLS LAST,
                                         end_rank NULLS LAST, window_id NULLS LAST) AS rank FROM allc)
"""


def _ctx(spark, sf_dir):
    t = X.tokens(spark, sf_dir, "window")
    return t, X.token_scores_from_tokens(t)


def _ordered_scores(spark, sf_dir):
    """Token scores as the row-local tokenizer leaves them: documents whole and in order, nothing shuffled."""
    return X.token_scores_from_tokens(X.tokens(spark, sf_dir))


def _cands(spark, sf_dir):
    return K.nbest_spans(_ordered_scores(spark, sf_dir), "token_spans", L, STRIDE, NBEST, MAXLEN_ANS, in_order=True)


def cls_null_score() -> F.Column:
    """start[CLS] + end[CLS] of a window: the fixture's CLS logits (arithmetic on (doc_id, window_id))."""
    d, c = F.col("doc_id"), F.col("window_id") + 1000000
    cls_start = F.lit(-3.0) + ((d * 13 + c * 29) % 37 - 18).cast("double") / 10
    cls_end = F.lit(-3.0) + ((d * 7 + c * 23) % 31 - 15).cast("double") / 10
    return cls_start + cls_end


def _ranked(spark, sf_dir):
    rows = K.answer_rows(_ordered_scores(spark, sf_dir), cls_null_score(), "token_spans", L, STRIDE, NBEST, MAXLEN_ANS, in_order=True)
    return K.rank_candidates(rows, X.docs(spark, sf_dir).select("doc_id"))


def _gold(t):
    return S.normalize_spans(X.spans_from_tokens(t).where(F.col("source") == "gold").select("doc_id", "start", "end"))


# ---------------------------------------------------------------------------- windows
@register("strided_windows", with_base(WIN_CTES, "SELECT doc_id, window_id, first_tok, last_tok, last_tok - first_tok + 1 AS n_tok FROM wins"))
def q_strided_windows(spark, sf_dir):
    return T.strided_windows(X.tokens(spark, sf_dir), L, STRIDE)


@register(
    "feature_to_example",
    with_base(WIN_CTES, "SELECT doc_id, count(DISTINCT window_id) AS n_windows, count(*) AS n_window_tokens FROM wt GROUP BY doc_id"),
)
def q_feature_to_example(spark, sf_dir):
    """Window tokens (features) rolled back up to their document."""
    w = T.strided_windows(X.tokens(spark, sf_dir), L, STRIDE)
    return w.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.sum("n_tok").alias("n_window_tokens"))


@register(
    "corpus_counts",
    with_base(WIN_CTES, "SELECT (SELECT count(*) FROM docs) AS n_examples, (SELECT count(*) FROM tokens) AS n_tokens, (SELECT count(*) FROM wins) AS n_features"),
)
def q_corpus_counts(spark, sf_dir):
    t = X.tokens(spark, sf_dir)
    n_docs = X.docs(spark, sf_dir).agg(F.count("*").alias("n_examples"))
    n_tok = t.agg(F.count("*").alias("n_tokens"))
    n_win = T.strided_windows(t, L, STRIDE).agg(F.count("*").alias("n_features"))
    return n_docs.crossJoin(n_tok).crossJoin(n_win)


@register(
    "topk_logits",
    with_base(
        WIN_CTES,
        f"""SELECT doc_id, window_id, 'start' AS kind, rk AS rank, tok_idx FROM ts WHERE rk <= {NBEST}
UNION ALL SELECT doc_id, window_id, 'end', rk, tok_idx FROM te WHERE rk <= {NBEST}""",
    ),
)
def q_topk_logits(spark, sf_dir):
    _, s = _ctx(spark, sf_dir)
    wt = T.window_tokens(s, L, STRIDE)
    a = K.topk_logits(wt, "start_logit", NBEST).select("doc_id", "window_id", F.lit("start").alias("kind"), "rank", "tok_idx")
    b = K.topk_logits(wt, "end_logit", NBEST).select("doc_id", "window_id", F.lit("end").alias("kind"), "rank", "tok_idx")
    return a.unionByName(b)


@register("nbest_pairs", with_base(WIN_CTES, "SELECT doc_id, window_id, start_tok, end_tok FROM pairs"))
def q_nbest_pairs(spark, sf_dir):
    """The texts are gathered by id, since those of one id share its windows; no token is shuffled."""
    s = X.token_scores_from_tokens(X.tokens(spark, sf_dir, "gathered"))
    return K.nbest_pairs(s, NBEST, MAXLEN_ANS, L, STRIDE, in_order=True, by_key=True).select("doc_id", "window_id", "start_tok", "end_tok")


@register(
    "nbest_spans",
    with_base(
        WIN_CTES,
        'SELECT doc_id, window_id, start_tok, end_tok, "start", "end", round(qa_score, 6) AS qa_score, round(token_score, 6) AS token_score, round(score, 6) AS score FROM cand',
    ),
)
def q_nbest_spans(spark, sf_dir):
    """Token-span style candidates: qa = mean of start/end logits, plus the mean toxic logit of the range."""
    return _cands(spark, sf_dir).select("doc_id", "window_id", "start_tok", "end_tok", "start", "end", "qa_score", "token_score", "score")


@register("null_score", with_base(WIN_CTES, "SELECT doc_id, round(null_score, 6) AS null_score FROM nulls"))
def q_null_score(spark, sf_dir):
    w = X.windows(X.tokens(spark, sf_dir), L, STRIDE)
    return K.null_scores(w, F.col("cls_start"), F.col("cls_end"))


@register("rank_candidates", with_base(WIN_CTES, 'SELECT doc_id, rank, "start", "end", round(score, 6) AS score FROM ranked'))
def q_rank_candidates(spark, sf_dir):
    return _ranked(spark, sf_dir).select("doc_id", "rank", "start", "end", "score")


@register("topk_answers", with_base(WIN_CTES, f'SELECT doc_id, rank, "start", "end", round(score, 6) AS score FROM ranked WHERE rank <= {TOPK}'))
def q_topk_answers(spark, sf_dir):
    return K.topk_answers(_ranked(spark, sf_dir), TOPK).select("doc_id", "rank", "start", "end", "score")


@register(
    "score_sigmoid_filter",
    with_base(
        WIN_CTES + f""",
sf AS (SELECT DISTINCT doc_id, unnest(range("start", "end")) AS off FROM ranked WHERE "start" IS NOT NULL AND 1 / (1 + exp(-score)) > {THR})""",
        islands("sf", "doc_id"),
    ),
)
def q_score_sigmoid_filter(spark, sf_dir):
    """Candidates with sigmoid(score) > 0.5 merged (the rule needs no rank, so none is computed)."""
    return D.score_sigmoid_filter(_cands(spark, sf_dir), THR)


TUNE_SCORE_CTES = WIN_CTES + """,
cp AS (SELECT doc_id, "start", "end", 1 / (1 + exp(-score)) AS p FROM cand),
cc AS (SELECT doc_id, off, max(p) AS p FROM (SELECT doc_id, unnest(range("start", "end")) AS off, p FROM cp) u GROUP BY doc_id, off),
ck0 AS (SELECT doc_id, off, p, CAST(least(greatest(ceil(p * 99) - 1, -1), 99) AS BIGINT) AS k0 FROM cc),
ck AS (SELECT c.doc_id, c.off,
         CASE WHEN k0 + 1 <= 99 AND p > (k0 + 1) / 99.0 THEN k0 + 1 WHEN k0 >= 0 AND NOT (p > k0 / 99.0) THEN k0 - 1 ELSE k0 END AS kmax,
         CASE WHEN g.off IS NULL THEN 0 ELSE 1 END AS hit
       FROM ck0 c LEFT JOIN gold_chars g USING (doc_id, off)),
hist AS (SELECT doc_id, kmax, count(*) AS n, sum(hit) AS h FROM ck GROUP BY doc_id, kmax),
ng AS (SELECT doc_id, count(*) AS n FROM gold_chars GROUP BY doc_id),
grid AS (SELECT d.doc_id, r.k FROM docs d CROSS JOIN range(0, 100) r(k)),
lvl AS (SELECT g.doc_id, g.k, coalesce(sum(h.n), 0) AS n_pred, coalesce(sum(h.h), 0) AS n_inter
        FROM grid g LEFT JOIN hist h ON h.doc_id = g.doc_id AND h.kmax >= g.k GROUP BY g.doc_id, g.k),
f AS (SELECT l.k, CASE WHEN coalesce(ng.n, 0) = 0 THEN (CASE WHEN l.n_pred = 0 THEN 1.0 ELSE 0.0 END)
                       WHEN l.n_pred = 0 THEN 0.0 ELSE 2.0 * l.n_inter / (l.n_pred + ng.n) END AS f1
      FROM lvl l LEFT JOIN ng USING (doc_id)),
perk AS (SELECT k, avg(f1) AS mean_f1 FROM f GROUP BY k),
tuned AS (SELECT k, k / 99.0 AS threshold, mean_f1,
            CASE WHEN row_number() OVER (ORDER BY round(mean_f1, 9) DESC, k) = 1 THEN 1 ELSE 0 END AS is_best FROM perk)
"""


def _tuned(spark, sf_dir):
    c = _cands(spark, sf_dir)
    gold = X.spans(spark, sf_dir).where(F.col("source") == "gold").select("doc_id", "start", "end")
    return K.tune_score_threshold(c, gold, X.docs(spark, sf_dir), 100)


@register(
    "tune_score_threshold",
    with_base(TUNE_SCORE_CTES, "SELECT CAST(k AS BIGINT) AS k, round(threshold, 6) AS threshold, round(mean_f1, 6) AS mean_f1, is_best FROM tuned"), bigint=('is_best',))
def q_tune_score_threshold(spark, sf_dir):
    """Validation sweep over 100 thresholds linspace(0, 1, 100) of sigmoid(candidate score)."""
    return _tuned(spark, sf_dir).select("k", "threshold", "mean_f1", "is_best")


@register("saved_threshold", with_base(TUNE_SCORE_CTES, "SELECT round(threshold, 6) AS threshold, round(mean_f1, 6) AS f1 FROM tuned WHERE is_best = 1"))
def q_saved_threshold(spark, sf_dir):
    """Tune once, store ``(threshold, f1)`` as a one-row table in the shared folder, read it back."""
    from spanfold.sources.span_files import saved_threshold

    return saved_threshold(spark, scratch_path(spark, "thresh"), lambda: _tuned(spark, sf_dir))


@register(
    "tune_token_threshold",
    with_base(
        """gc AS (SELECT t.doc_id, t.tok_idx, count(g.off) AS covered FROM tokens t LEFT JOIN gold_chars g
       ON t.doc_id = g.doc_id AND g.off >= t."start" AND g.off < t."end" GROUP BY t.doc_id, t.tok_idx),
tl AS (SELECT s.doc_id, 1 / (1 + exp(-s.logit1)) AS p, CASE WHEN g.covered > 0 THEN 1 ELSE 0 END AS y FROM token_scores s JOIN gc g USING (doc_id, tok_idx)),
lv AS (SELECT t.doc_id, r.k, sum(CASE WHEN t.p > r.k / 100.0 AND y = 1 THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN t.p > r.k / 100.0 AND y = 0 THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN NOT (t.p > r.k / 100.0) AND y = 1 THEN 1 ELSE 0 END) AS fn
       FROM tl t CROSS JOIN range(0, 100) r(k) GROUP BY t.doc_id, r.k),
perk AS (SELECT k, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS mean_f1 FROM lv GROUP BY k)""",
        """SELECT CAST(k AS BIGINT) AS k, round(k / 100.0, 6) AS threshold, round(mean_f1, 6) AS mean_f1,
       CASE WHEN row_number() OVER (ORDER BY round(mean_f1, 9) DESC, k) = 1 THEN 1 ELSE 0 END AS is_best FROM perk""",
    ), bigint=('is_best',))
def q_tune_token_threshold(spark, sf_dir):
    """Token-score threshold sweep 0.00..0.99: decisions sigmoid(logit1) > t, mean per-document token F1."""
    t = X.tokens(spark, sf_dir, ranges=_gold(X.tokens(spark, sf_dir)))
    lab = T.token_label_overlap(X.token_scores_from_tokens(t, "covered"), None, 0.0, covered="covered")
    return K.tune_token_threshold(lab, sigmoid(F.col("logit1")), "label", 100, 100.0).select("k", "threshold", "mean_f1", "is_best")


POS_CTES = WIN_CTES + """,
gi AS (""" + islands("gold_chars", "doc_id") + """),
bnd AS (SELECT g.doc_id, g."start", g."end",
          (SELECT max(t.tok_idx) FROM tokens t WHERE t.doc_id = g.doc_id AND t."start" <= g."start") AS s_tok,
          (SELECT min(t.tok_idx) FROM tokens t WHERE t.doc_id = g.doc_id AND t."end" >= g."end") AS e_tok FROM gi g),
wb AS (SELECT w.*, f."start" AS first_start, l."end" AS last_end FROM wins w
       JOIN tokens f ON f.doc_id = w.doc_id AND f.tok_idx = w.first_tok JOIN tokens l ON l.doc_id = w.doc_id AND l.tok_idx = w.last_tok)
"""


@register(
    "window_answer_positions",
    with_base(
        POS_CTES,
        """SELECT b.doc_id, b."start" AS span_start, w.window_id,
       CASE WHEN w.first_start <= b."start" AND w.last_end >= b."end" THEN b.s_tok - w.first_tok + 1 ELSE 0 END AS start_position,
       CASE WHEN w.first_start <= b."start" AND w.last_end >= b."end" THEN b.e_tok - w.first_tok + 1 ELSE 0 END AS end_position
FROM bnd b JOIN wb w USING (doc_id)""",
    ),
)
def q_window_answer_positions(spark, sf_dir):
    """One feature per (gold run, window): answer token positions in the window, CLS (0) when not held."""
    gold = _gold(X.tokens(spark, sf_dir))
    t = X.tokens(spark, sf_dir, of=gold)  # documents without a run have no feature
    return K.window_answer_positions(gold, t.select("doc_id", "tok_idx", "start", "end"), T.strided_windows(t, L, STRIDE))


@register(
    "window_multi_positions",
    with_base(
        POS_CTES
        + """,
held AS (SELECT b.doc_id, w.window_id, b.s_tok - w.first_tok + 1 AS sp, b.e_tok - w.first_tok + 1 AS ep
         FROM bnd b JOIN wb w ON b.doc_id = w.doc_id AND w.first_start <= b."start" AND w.last_end >= b."end"),
fl AS (SELECT doc_id, window_id, sp AS pos, 1 AS s, 0 AS e FROM held UNION ALL SELECT doc_id, window_id, ep, 0, 1 FROM held)""",
        "SELECT doc_id, window_id, pos, max(s) AS start_flag, max(e) AS end_flag FROM fl GROUP BY doc_id, window_id, pos",
    ), bigint=('start_flag', 'end_flag'))
def q_window_multi_positions(spark, sf_dir):
    t = X.tokens(spark, sf_dir)
    return K.window_multi_positions(_gold(t), t.select("doc_id", "tok_idx", "start", "end"), L, STRIDE)
