"""Registered attribution, modelling, run-tracking and file round-trip queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanfold.functions.text import LEXICON, MASK_TOKEN, sigmoid
from spanfold.operators import attribution as A
from spanfold.operators import blackbox as B
from spanfold.operators import candidates as K
from spanfold.operators import cleaning as C
from spanfold.operators import ensemble as E
from spanfold.operators import metrics as M
from spanfold.operators import modeling as ML
from spanfold.operators import span_model as N
from spanfold.operators import spans as S
from spanfold.operators import tagger as G
from spanfold.operators import tokens as T
from spanfold.plans import fixtures as X
from spanfold.plans.oracle import islands, prf_sql, with_base
from spanfold.plans.q_candidates import WIN_CTES
from spanfold.plans.q_spans import CLEAN_CTES
from spanfold.plans.q_tokens import VEC_CTES
from spanfold.plans.registry import register
from spanfold.session import scratch_path, written
from spanfold.sources import span_files as SF
from spanfold.sources import tables

# ---------------------------------------------------------------------------- erasure (rule scorer: s = hits / (hits + 1))
ERASE_CTES = """
ew AS (SELECT doc_id, tok_idx, tok, "start", "end", CASE WHEN hit THEN 1 ELSE 0 END AS c FROM hits),
eh AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS tot FROM ew),
es AS (SELECT *, tot / (tot + 1.0) AS s0, (tot - c) / (tot - c + 1.0) AS si FROM eh),
ed AS (SELECT *, (s0 - si) / (s0 + 0.0001) AS score_dec FROM es),
ef AS (SELECT *, CASE WHEN score_dec > 0.2 THEN 1 ELSE 0 END AS flagged FROM ed)
"""


def _erasure(spark, sf_dir):
    return A.erasure_scores(X.tokens(spark, sf_dir), F.col("hit").cast("int"), lambda h: h / (h + F.lit(1.0)), in_order=True)


@register(
    "erasure_ablations",
    with_base(
        "",
        f"""SELECT doc_id, tok_idx, tok AS word,
       CAST(coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ss_start,
       CAST(sum(length(tok)) OVER (PARTITION BY doc_id) + count(*) OVER (PARTITION BY doc_id) - 1 - length(tok) + {len(MASK_TOKEN)} AS BIGINT) AS ablated_len
FROM tokens""",
    ),
)
def q_erasure_ablations(spark, sf_dir):
    """Every word's ablation of every document, as (offset, length) descriptors of the masked text."""
    t = X.tokens(spark, sf_dir, "gathered")
    return A.erasure_ablations(t.select("doc_id", "tok_idx", "tok"), in_order=True).select("doc_id", "tok_idx", F.col("tok").alias("word"), "ss_start", "ablated_len")


@register("erasure_scores", with_base(ERASE_CTES, "SELECT doc_id, tok_idx, round(score_dec, 6) AS score_dec, flagged FROM ef"), bigint=('flagged',))
def q_erasure_scores(spark, sf_dir):
    return _erasure(spark, sf_dir).select("doc_id", "tok_idx", "score_dec", "flagged")


@register(
    "erasure_spans",
    with_base(ERASE_CTES + ',\nfc AS (SELECT DISTINCT doc_id, unnest(range("start", "end")) AS off FROM ef WHERE flagged = 1)', islands("fc", "doc_id")),
)
def q_erasure_spans(spark, sf_dir):
    return A.erasure_spans(_erasure(spark, sf_dir))


@register(
    "mitigated_text",
    with_base(
        ERASE_CTES,
        f"""SELECT d.doc_id, coalesce(m.mitigated, '') AS mitigated FROM docs d LEFT JOIN
  (SELECT doc_id, string_agg(CASE WHEN flagged = 1 THEN '{MASK_TOKEN}' ELSE tok END, ' ' ORDER BY tok_idx) AS mitigated FROM ef GROUP BY doc_id) m USING (doc_id)""",
    ),
)
def q_mitigated_text(spark, sf_dir):
    return A.mitigated_text(_erasure(spark, sf_dir), X.docs(spark, sf_dir))


@register("blacklist_semi", with_base(ERASE_CTES, "SELECT doc_id, tok_idx, tok FROM ef WHERE flagged = 1"))
def q_blacklist_semi(spark, sf_dir):
    return A.blacklist(_erasure(spark, sf_dir)).select("doc_id", "tok_idx", "tok")


@register(
    "rank_words",
    with_base(ERASE_CTES, "SELECT doc_id, tok_idx, round(score_dec, 6) AS score_dec, row_number() OVER (PARTITION BY doc_id ORDER BY score_dec, tok_idx) AS rank FROM ef"),
)
def q_rank_words(spark, sf_dir):
    return A.rank_words(_erasure(spark, sf_dir)).select("doc_id", "tok_idx", "score_dec", "rank")


@register(
    "surrogate_attribution",
    None,
)
def q_surrogate_attribution(spark, sf_dir):
    """LIME-style weights per word (256 keyed perturbations per document, one weight per distinct word, weighted ridge); rows-only check."""
    t = X.tokens(spark, sf_dir, "window").withColumn("c", F.col("hit").cast("double"))
    return A.surrogate_attribution(t, "c", lambda h: h / (h + 1.0), 256, 0.2)


# ---------------------------------------------------------------------------- pieces, importances, report
PIECE_CTES = """
pc AS (SELECT doc_id, tok_idx, "start", "end", unnest(range(0, CAST(ceil(("end" - "start") / 4.0) AS BIGINT))) AS piece_idx FROM tokens),
pw AS (SELECT doc_id, tok_idx, piece_idx, "start" + 4 * piece_idx AS ps, least("start" + 4 * piece_idx + 4, "end") AS pe,
              CAST((doc_id * 7 + tok_idx * 13 + piece_idx * 3) % 11 AS DOUBLE) AS w, CASE WHEN piece_idx = 0 THEN 1 ELSE 0 END AS ws FROM pc),
pwi AS (SELECT *, CAST(sum(ws) OVER (PARTITION BY doc_id ORDER BY tok_idx, piece_idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS word_idx FROM pw),
wd AS (SELECT doc_id, word_idx, min(ps) AS "start", max(pe) AS "end", sum(w) AS raw FROM pwi GROUP BY doc_id, word_idx)
"""


def pieces(t):
    """Sub-word pieces of at most 4 characters with an attribution weight (arithmetic fixture;
    whole numbers, so sums are exact in any order and only the final normalisation divides)."""
    n = F.ceil((F.col("end") - F.col("start")) / F.lit(4.0)).cast("long")
    p = t.select("doc_id", "tok_idx", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece_idx"))
    weight = ((F.col("doc_id") * 7 + F.col("tok_idx") * 13 + F.col("piece_idx") * 3) % 11).cast("double")
    return p.select(
        "doc_id",
        "tok_idx",
        "piece_idx",
        (F.col("start") + 4 * F.col("piece_idx")).alias("start"),
        F.least(F.col("start") + 4 * F.col("piece_idx") + 4, F.col("end")).alias("end"),
        weight.alias("weight"),
        (F.col("piece_idx") == 0).alias("word_start"),
    )


@register(
    "words_from_pieces",
    with_base(PIECE_CTES, 'SELECT doc_id, word_idx, "start", "end", round(CASE WHEN sum(raw) OVER (PARTITION BY doc_id) <> 0 THEN raw / sum(raw) OVER (PARTITION BY doc_id) ELSE 0 END, 6) AS weight FROM wd'),
)
def q_words_from_pieces(spark, sf_dir):
    p = pieces(X.running_on(X.tokens(spark, sf_dir, "gathered", context=True)))
    return A.words_from_pieces(p, in_order=True).select("doc_id", "word_idx", "start", "end", "weight")


def _importance(spark, sf_dir):
    from spanfold.plans.q_tokens import _token_vectors

    v = _token_vectors(spark, sf_dir)
    tot = F.sum("norm").over(Window.partitionBy("doc_id"))
    return v.select("doc_id", "tok_idx", "tok", F.when(tot > 0, F.col("norm") / tot).otherwise(0.0).alias("weight"))


@register(
    "span_report",
    with_base(
        VEC_CTES
        + """,
iw AS (SELECT v.doc_id, v.tok_idx, t.tok, CASE WHEN sum(v.norm) OVER (PARTITION BY v.doc_id) > 0 THEN v.norm / sum(v.norm) OVER (PARTITION BY v.doc_id) ELSE 0 END AS w
       FROM tv v JOIN tokens t USING (doc_id, tok_idx)),
cw AS (SELECT *, greatest(-1.0, least(1.0, w)) AS a FROM iw)""",
        """SELECT doc_id, tok_idx,
       CASE WHEN starts_with(tok, '<') AND ends_with(tok, '>') THEN '#' || trim(tok, '<>') ELSE tok END AS word,
       'hsl(220, 100%, ' || CAST(CASE WHEN a > 0 THEN 100 - CAST(trunc(a * 90) AS INTEGER) ELSE 100 - CAST(trunc(a * -125) AS INTEGER) END AS VARCHAR) || '%)' AS color
FROM cw""",
    ),
)
def q_span_report(spark, sf_dir):
    """Per word its display form and colour by importance (the report's colour column)."""
    return A.span_report(_importance(spark, sf_dir)).select("doc_id", "tok_idx", "word", "color")


@register(
    "span_report_html",
    with_base(
        VEC_CTES
        + """,
iw AS (SELECT v.doc_id, v.tok_idx, t.tok, CASE WHEN sum(v.norm) OVER (PARTITION BY v.doc_id) > 0 THEN v.norm / sum(v.norm) OVER (PARTITION BY v.doc_id) ELSE 0 END AS w
       FROM tv v JOIN tokens t USING (doc_id, tok_idx)),
cw AS (SELECT *, greatest(-1.0, least(1.0, w)) AS a FROM iw),
sw AS (SELECT doc_id, tok_idx, CASE WHEN starts_with(tok, '<') AND ends_with(tok, '>') THEN '#' || trim(tok, '<>') ELSE tok END AS word,
       'hsl(220, 100%, ' || CAST(CASE WHEN a > 0 THEN 100 - CAST(trunc(a * 90) AS INTEGER) ELSE 100 - CAST(trunc(a * -125) AS INTEGER) END AS VARCHAR) || '%)' AS color FROM cw),
ht AS (SELECT doc_id, string_agg('<mark style="background-color: ' || color || '"> ' || replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</mark>', '' ORDER BY tok_idx) AS marks FROM sw GROUP BY doc_id),
gi AS (""" + islands("gold_chars", "doc_id") + """),
gt AS (SELECT g.doc_id, '[' || string_agg(substring(d.text, g."start" + 1, g."end" - g."start"), ', ' ORDER BY g."start") || ']' AS texts FROM gi g JOIN docs d USING (doc_id) GROUP BY g.doc_id),
pi AS (""" + islands("(SELECT doc_id, off FROM chars WHERE source = 'B')", "doc_id") + """),
pt AS (SELECT p.doc_id, '[' || string_agg(substring(d.text, p."start" + 1, p."end" - p."start"), ', ' ORDER BY p."start") || ']' AS texts FROM pi p JOIN docs d USING (doc_id) GROUP BY p.doc_id)""",
        """SELECT ht.doc_id, '<div><b>Text</b>: ' || marks || '</div>' AS html, coalesce(gt.texts, '[]') AS gold_texts, coalesce(pt.texts, '[]') AS predicted_texts
FROM ht LEFT JOIN gt USING (doc_id) LEFT JOIN pt USING (doc_id)""",
    ),
)
def q_span_report_html(spark, sf_dir):
    """One report row per document: its coloured HTML line, the gold and model B's span texts."""
    html = A.report_html(A.span_report(_importance(spark, sf_dir)))
    d = X.docs(spark, sf_dir)

    def texts(source, name):
        r = S.normalize_spans(X.spans(spark, sf_dir).where(F.col("source") == source).select("doc_id", "start", "end"))
        r = r.join(d, "doc_id").select("doc_id", "start", F.expr("substring(text, start + 1, `end` - start)").alias("t"))
        g = r.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "t"))).alias("r"))
        return g.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["t"]), ", "), F.lit("]")).alias(name))

    out = html.join(texts("gold", "gold_texts"), "doc_id", "left").join(texts("B", "predicted_texts"), "doc_id", "left")
    return out.select("doc_id", "html", *[F.coalesce(c, F.lit("[]")).alias(c) for c in ("gold_texts", "predicted_texts")])


@register(
    "mean_importance",
    with_base(
        WIN_CTES
        + ",\n"
        + VEC_CTES
        + """,
iw AS (SELECT doc_id, tok_idx, CASE WHEN sum(norm) OVER (PARTITION BY doc_id) > 0 THEN norm / sum(norm) OVER (PARTITION BY doc_id) ELSE 0 END AS w FROM tv),
ans AS (SELECT doc_id, rank, start_tok, end_tok FROM ranked WHERE start_tok IS NOT NULL AND 1 / (1 + exp(-score)) > 0.5),
ax AS (SELECT doc_id, rank, unnest(range(start_tok, end_tok + 1)) AS tok_idx FROM ans),
atk AS (SELECT a.doc_id, a.rank, i.tok_idx, i.w, sum(i.w) OVER (PARTITION BY a.doc_id, a.rank) AS tw
       FROM ax a JOIN iw i USING (doc_id, tok_idx))""",
        "SELECT doc_id, tok_idx, round(avg(CASE WHEN tw > 0 THEN w / tw ELSE 0 END), 6) AS mean_importance FROM atk GROUP BY doc_id, tok_idx",
    ),
)
def q_mean_importance(spark, sf_dir):
    """Token importance inside each predicted span (sigmoid(score) > 0.5), re-normalised per span and
    averaged per token."""
    from spanfold.plans.q_candidates import _ranked

    r = _ranked(spark, sf_dir).where(F.col("start_tok").isNotNull() & (sigmoid(F.col("score")) > 0.5))
    toks = r.select("doc_id", "rank", F.explode(F.sequence("start_tok", "end_tok")).alias("tok_idx"))
    j = toks.join(_importance(spark, sf_dir).select("doc_id", "tok_idx", "weight"), ["doc_id", "tok_idx"])
    tw = F.sum("weight").over(Window.partitionBy("doc_id", "rank"))
    j = j.withColumn("rel", F.when(tw > 0, F.col("weight") / tw).otherwise(0.0))
    return j.groupBy("doc_id", "tok_idx").agg(F.avg("rel").alias("mean_importance"))


# ---------------------------------------------------------------------------- run tracking (events: run = user, step = event, metric = value)
EPOCH_SQL = "CAST(floor(epoch(ts) / 86400) AS BIGINT)"


def _epoch(df):
    """Day number of ``ts`` since 1970-01-01, independent of the session time zone."""
    from pyspark.sql import types as TT

    if isinstance(df.schema["ts"].dataType, TT.TimestampNTZType):
        return F.datediff(F.to_date("ts"), F.to_date(F.lit("1970-01-01"))).cast("long")
    return F.floor(F.unix_seconds(F.col("ts")) / 86400).cast("long")


@register(
    "running_loss",
    f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, {EPOCH_SQL} ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running_loss FROM events",
)
def q_running_loss(spark, sf_dir):
    """Running mean of the metric by step, restarting each epoch (day) of each run (user)."""
    from spanfold.operators.modeling import running_mean

    e = tables.events(spark, sf_dir)
    e = e.withColumn("epoch", _epoch(e))
    return running_mean(e, ["user_id", "epoch"], "event_id", "value").select("event_id", F.col("running_mean").alias("running_loss"))


@register(
    "best_run",
    """SELECT user_id, min(event_id) FILTER (WHERE value = mx) AS best_step_max, max(mx) AS best_value_max,
       min(event_id) FILTER (WHERE value = mn) AS best_step_min, max(mn) AS best_value_min
FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS mx, min(value) OVER (PARTITION BY user_id) AS mn FROM events) e
GROUP BY user_id""",
)
def q_best_run(spark, sf_dir):
    """Best step per run under max and min direction; the first step wins ties (strict comparison)."""
    e = tables.events(spark, sf_dir)
    key_max = F.struct(F.col("value"), (-F.col("event_id")).alias("neg_step"))
    key_min = F.struct((-F.col("value")).alias("neg_value"), (-F.col("event_id")).alias("neg_step"))
    return e.groupBy("user_id").agg(
        F.max_by("event_id", key_max).alias("best_step_max"),
        F.max("value").alias("best_value_max"),
        F.max_by("event_id", key_min).alias("best_step_min"),
        F.min("value").alias("best_value_min"),
    )


@register("top_runs", "SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events ORDER BY value DESC, event_id LIMIT 3")
def q_top_runs(spark, sf_dir):
    """The 3 best steps by metric (a top-k report); ties by step."""
    e = tables.events(spark, sf_dir).select("event_id", "value").orderBy(F.col("value").desc(), F.col("event_id").asc()).limit(3)
    return e.withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc(), F.col("event_id").asc())))


# ---------------------------------------------------------------------------- ensembles and splits
ENS_CTES = f"""
mcnt AS (SELECT doc_id, off, count(DISTINCT source) AS c FROM chars WHERE source IN ('A', 'B', 'C') GROUP BY doc_id, off),
allp AS (SELECT doc_id, source, off FROM chars WHERE source <> 'gold' UNION ALL SELECT doc_id, 'majority', off FROM mcnt WHERE c * 2 >= 3),
m4 AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('majority')) m(source)),
b4 AS (SELECT d.doc_id, m.source FROM docs d CROSS JOIN m4 m),
np4 AS (SELECT doc_id, source, count(*) AS n FROM allp GROUP BY doc_id, source),
ng4 AS (SELECT doc_id, count(*) AS n FROM gold_chars GROUP BY doc_id),
ni4 AS (SELECT p.doc_id, p.source, count(*) AS n FROM allp p JOIN gold_chars g USING (doc_id, off) GROUP BY p.doc_id, p.source),
c4 AS (SELECT b.doc_id, b.source, coalesce(np4.n, 0) AS n_pred, coalesce(ng4.n, 0) AS n_gold, coalesce(ni4.n, 0) AS n_inter
       FROM b4 b LEFT JOIN np4 USING (doc_id, source) LEFT JOIN ng4 USING (doc_id) LEFT JOIN ni4 USING (doc_id, source)),
f4 AS (SELECT doc_id, source, {prf_sql('n_pred', 'n_gold', 'n_inter')} FROM c4)
"""


@register(
    "checkpoint_ensemble",
    with_base(ENS_CTES, "SELECT source, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f4 GROUP BY source"),
)
def q_checkpoint_ensemble(spark, sf_dir):
    """Score each model, their majority vote (>= half), and report all four."""
    t = X.tokens(spark, sf_dir)
    s = X.spans_from_tokens(t)
    models = s.where(F.col("source") != "gold")
    maj = E.span_majority(models, 3).withColumn("source", F.lit("majority"))
    pred = models.unionByName(maj.select("doc_id", "source", "start", "end"))
    gold = s.where(F.col("source") == "gold").drop("source")
    sc = M.doc_prf(X.docs(spark, sf_dir), pred, gold, ["A", "B", "C", "majority"])
    return sc.groupBy("source").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


CLEAN_ROWS = CLEAN_CTES + """,
kept AS (SELECT doc_id, source, unnest(range(xb, xe + 1)) AS off FROM x3 WHERE xe - xb > 1),
cl AS (""" + islands("kept", "doc_id, source") + ")"


@register(
    "train_val_split",
    with_base(
        CLEAN_ROWS
        + ",\nsp AS (SELECT doc_id, CASE WHEN " + ML.keyed_uniform_sql("doc_id", "0") + " < 800 THEN 'train' ELSE 'validation' END AS split FROM docs)",
        """SELECT s.split, count(DISTINCT s.doc_id) AS n_docs, count(c.doc_id) AS n_clean_ranges
FROM sp s LEFT JOIN cl c USING (doc_id) GROUP BY s.split""",
    ),
)
def q_train_val_split(spark, sf_dir):
    """Keyed 80/20 split of documents; the noisy annotations of both sides cleaned."""
    d = ML.train_val_split(X.docs(spark, sf_dir), 0.8)
    cl = C.clean_spans(X.messy_ranges(spark, sf_dir), X.docs(spark, sf_dir), group=("source",))
    j = d.select("doc_id", "split").join(cl, "doc_id", "left")
    return j.groupBy("split").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("start").alias("n_clean_ranges"))


# ---------------------------------------------------------------------------- file round trips (written to the shared folder)
GOLD_LIT = "gl AS (SELECT doc_id, '[' || array_to_string(list(off ORDER BY off), ', ') || ']' AS lit FROM gold_chars GROUP BY doc_id)"


def _gold_offsets(spark, sf_dir):
    g = S.collect_offsets(X.spans(spark, sf_dir).where(F.col("source") == "gold"))
    d = X.docs(spark, sf_dir)
    return d.join(g, "doc_id", "left").select("doc_id", F.coalesce("offsets", S.empty_int_array()).alias("spans"), "text")


@register(
    "read_span_csv",
    with_base(GOLD_LIT, "SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars, coalesce(g.lit, '[]') AS spans, d.text FROM docs d LEFT JOIN gl g USING (doc_id)"),
)
def q_read_span_csv(spark, sf_dir):
    """Documents with gold offsets written as a header CSV (quoted multi-line text) and read back."""
    path = scratch_path(spark, "span_csv")
    SF.write_span_csv(_gold_offsets(spark, sf_dir), path)
    r = SF.read_span_csv(spark, path)
    return r.select("doc_id", F.length("text").alias("n_chars"), S.format_offsets(F.col("spans")).alias("spans"), "text")


@register(
    "read_predictions",
    with_base(
        "pb AS (SELECT doc_id, count(*) AS n, sum(off) AS s FROM chars WHERE source = 'B' GROUP BY doc_id)",
        "SELECT d.doc_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_offsets, CAST(coalesce(p.s, 0) AS BIGINT) AS sum_offsets FROM docs d LEFT JOIN pb p USING (doc_id)",
    ),
)
def q_read_predictions(spark, sf_dir):
    """Model B written as ``id<TAB>[offsets]`` lines for every document, read back strictly."""
    path = scratch_path(spark, "preds")
    b = S.collect_offsets(X.spans(spark, sf_dir).where(F.col("source") == "B"))
    d = X.docs(spark, sf_dir).select("doc_id").join(b, "doc_id", "left").select("doc_id", F.coalesce("offsets", S.empty_int_array()).alias("offsets"))
    SF.write_predictions(d, path)
    good, _bad = SF.read_predictions(spark, path)
    return good.select("doc_id", F.size("offsets").alias("n_offsets"), F.aggregate("offsets", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_offsets"))


@register(
    "write_clean",
    with_base(
        CLEAN_ROWS,
        """SELECT d.lang AS split, count(DISTINCT c.doc_id) AS n_docs, count(*) AS n_ranges, CAST(sum(c."end" - c."start") AS BIGINT) AS n_chars
FROM cl c JOIN documents d USING (doc_id) GROUP BY d.lang""",
    ),
)
def q_write_clean(spark, sf_dir):
    """Cleaned spans per split (language) written partitioned by split and read back."""
    path = scratch_path(spark, "clean")
    cl = C.clean_spans(X.messy_ranges(spark, sf_dir), X.docs(spark, sf_dir), group=("source",))
    out = cl.join(X.docs(spark, sf_dir, "lang").select("doc_id", F.col("lang").alias("split")), "doc_id")
    SF.write_clean(out, path)
    r = spark.read.parquet(path)
    return r.groupBy("split").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_ranges"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


@register(
    "load_splits",
    "SELECT lang AS split, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM documents GROUP BY lang",
)
def q_load_splits(spark, sf_dir):
    """Each language written as its own split (one pass), then all splits loaded together."""
    d = X.docs(spark, sf_dir, "lang").select("doc_id", "text", "lang")
    path = scratch_path(spark, "splits")
    SF.write_splits(d, path, "lang")
    u = SF.load_splits(spark, path, d.drop("lang").schema)
    return u.groupBy("split").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


# ---------------------------------------------------------------------------- learned models (rows-only checks)
@register("doc_classifier", None)
def q_doc_classifier(spark, sf_dir):
    """Logistic regression on hashed TF-IDF, trained on ``labels.toxic``, scoring every document."""
    d = X.docs(spark, sf_dir)
    train = d.join(tables.labels(spark, sf_dir), "doc_id")
    model = ML.doc_classifier(train, "toxic")
    return ML.score_documents(model, d)


@register("erasure_classifier", None)
def q_erasure_classifier(spark, sf_dir):
    """Word erasure on the fitted document classifier: how much its probability falls when a word is
    masked. The words' shares of the margin come from the model, so no text is scored again."""
    d = X.docs(spark, sf_dir)
    model = ML.doc_classifier(d.join(tables.labels(spark, sf_dir), "doc_id"), "toxic")
    t = X.tokens(spark, sf_dir).select("doc_id", "tok_idx", "tok", F.lower("tok").alias("word"))
    shares = ML.word_contributions(model, t.select("word"))
    mask = ML.word_contributions(model, spark.range(1).select(F.lit(MASK_TOKEN).alias("word"))).first()["contrib"]
    words = t.join(shares, "word", "left")
    scored = A.erasure_scores(words, F.col("contrib"), sigmoid, mask_contrib=mask, base=model.stages[-1].intercept)
    return scored.select("doc_id", "tok_idx", "tok", "score_dec", "flagged")


def _gold_written(spark, sf_dir):
    """Gold ranges, written once: several frames below carry them to the texts."""
    return written(S.normalize_spans(X.spans(spark, sf_dir).where(F.col("source") == "gold").select("doc_id", "start", "end")), "gold")


def _token_frame(spark, sf_dir, gold, where=None):
    """Token features with label, border flags and split as they lie in the texts, which pass one shuffle with their gold
    ranges; no token does. Several texts of one id count as one that runs on over all of them, as in the window form: a
    token comes as often as its id has texts, and its offsets are sums over them."""
    known = F.col("doc_id").isNotNull()
    t = X.tokens(spark, sf_dir, ranges=gold, context=True, where=known if where is None else known & where)
    lab = T.token_label_overlap(t, None, 0.0, covered="covered")
    feats = ML.token_features(lab, words=("prev_tok", "next_tok"))
    feats = X.running_on(feats)
    feats = feats.withColumn("_text", F.explode(F.array_repeat(F.lit(0), F.col("n_texts").cast("int")))).drop("_text")
    return ML.train_val_split(feats, 0.8)


def _in_train():
    """Of an id: the split function that ``train_val_split`` applies."""
    return ML.keyed_uniform(F.col("doc_id"), F.lit(0)) < int(ML.HASH_MOD * 0.8)


@register("token_tagger", None)
def q_token_tagger(spark, sf_dir):
    """Token tagger trained on the train split; predicted spans (gap-filled) for every document."""
    from spanfold.operators.decode import decode_gap_fill

    gold = _gold_written(spark, sf_dir)
    train = _token_frame(spark, sf_dir, gold, _in_train()).where(F.col("split") == "train")
    model = ML.fit_token_model(written(ML.hashed_features(train).select("_features", "label"), "token_features"), "label")
    scored = ML.apply_token_model(model, _token_frame(spark, sf_dir, gold), "tox").withColumn("pred", F.when(F.col("tox_prob") > 0.5, 1).otherwise(0))
    return decode_gap_fill(scored)


WINDOW_CTES = """
sw AS (SELECT doc_id, tok_idx, tok, "start", "end", CASE WHEN hit THEN 1 ELSE 0 END AS c,
              coalesce(sum(CASE WHEN right(tok, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM hits),
sx AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, sent ORDER BY tok_idx) - 1) // 256 AS part FROM sw),
st AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, sent, part) AS tot FROM sx),
sd AS (SELECT *, (tot / (tot + 1.0) - (tot - c) / (tot - c + 1.0)) / (tot / (tot + 1.0) + 0.0001) AS score_dec FROM st)
"""


class _Hits(dict):
    """Whether a word is an insult word, worked out once for a word that comes again (2^18 words are kept)."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = hit = "".join(c for c in word if c.isalnum()).lower() in LEXICON
        return hit


_HITS = _Hits()


def insult_share(texts: list[str]) -> list[float]:
    """The rule scorer as a black box: h / (h + 1) of a text with h insult words."""
    hits = [sum(map(_HITS.__getitem__, t.split())) for t in texts]
    return [h / (h + 1.0) for h in hits]


@register(
    "erasure_sentences",
    with_base(WINDOW_CTES, 'SELECT doc_id, tok_idx, tok, "start", "end", round(score_dec, 6) AS score_dec, CASE WHEN score_dec > 0.2 THEN 1 ELSE 0 END AS flagged FROM sd'),
    bigint=("flagged",),
)
def q_erasure_sentences(spark, sf_dir):
    """Every word of every document masked in its sentence, the masked texts scored by a black box."""
    return B.erasure(X.docs(spark, sf_dir), B.batched(insult_share))


@register("surrogate_classifier", None)
def q_surrogate_classifier(spark, sf_dir):
    """Local linear model of the fitted document classifier around every document (64 perturbed texts each, scored by the pipeline)."""
    d = X.docs(spark, sf_dir)
    model = ML.doc_classifier(d.join(tables.labels(spark, sf_dir), "doc_id"), "toxic")
    return B.surrogate(d, B.scored_by(model), samples=64, threshold=0.01)


def chain_documents(spark, sf_dir):
    """(doc_id, text, split, spans): documents with their split and gold spans as an array."""
    gold = S.normalize_spans(X.spans(spark, sf_dir).where(F.col("source") == "gold").select("doc_id", "start", "end"))
    gold = gold.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return ML.train_val_split(X.docs(spark, sf_dir), 0.8).join(gold, "doc_id", "left")


@register("sequence_tagger", None)
def q_sequence_tagger(spark, sf_dir):
    """Linear-chain tagger trained on the train split; Viterbi spans of every document."""
    path = scratch_path(spark, "chain_features")
    G.encode(chain_documents(spark, sf_dir).where(F.col("split") == "train")).write.parquet(path)
    return G.tag(G.fit(spark.read.parquet(path)), X.docs(spark, sf_dir))


def span_frames(spark, sf_dir):
    """A function that gives the flagged token features of every document (or of some ids) with ``split``, and the documents with theirs."""
    gold = _gold_written(spark, sf_dir)
    feats = lambda where=None: N.answer_flags(_token_frame(spark, sf_dir, gold, where), None, borders=("opens", "closes"))
    return feats, ML.train_val_split(X.docs(spark, sf_dir).select("doc_id"), 0.8)


def fit_span_model(feats):
    """Token models on the train split; a keyed fifth of its documents is kept for the null answer's cut.

    The token models' features are written once: two models go over them, each several times. The windows of the null
    answer are cut where the texts are read."""
    part = ML.keyed_uniform(F.col("doc_id"), F.lit(1)) < ML.HASH_MOD // 5
    own = feats(_in_train() & ~part).where(F.col("split") == "train")
    own = ML.hashed_features(own).select("doc_id", "_features", "is_start", "is_end")
    return N.fit(written(own, "span_features"), part, ordered=feats(_in_train() & part).where(F.col("split") == "train"))


@register("span_scorer", None)
def q_span_scorer(spark, sf_dir):
    """Start, end and null models -> n-best by margin over the window's null answer -> best answer per document."""
    feats, docs = span_frames(spark, sf_dir)
    flags = ("is_start", "is_end", "label", "split")
    ranked = N.answers(fit_span_model(feats), feats().drop(*flags), docs, in_order=True)
    return K.topk_answers(ranked, 1).select("doc_id", "rank", "start", "end", "score").join(docs, "doc_id")


@register("span_null_scores", None)
def q_span_null_scores(spark, sf_dir):
    """Per window the learned null answer's score beside the best span's, and whether the window holds a gold range."""
    feats, _ = span_frames(spark, sf_dir)
    model = fit_span_model(feats)
    scores = N.token_logits(model.start, model.end, feats())
    w = N.null_scores(model, N.window_summaries(scores, in_order=True))
    return w.select("doc_id", "window_id", "n_tokens", "best", "null_score", "answered")
