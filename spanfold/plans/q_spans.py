"""Registered span-algebra, cleaning and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfold.operators import cleaning as C
from spanfold.operators import ensemble as E
from spanfold.operators import spans as S
from spanfold.plans import fixtures as X
from spanfold.plans.oracle import islands, with_base
from spanfold.plans.registry import register

_WS = "[ \\t\\n\\r\\x0b\\x0c]"
_AN = "[\\pL\\pN]"


def _spans(spark, sf_dir):
    return X.spans(spark, sf_dir)


def _models(spark, sf_dir):
    return _spans(spark, sf_dir).where(F.col("source") != "gold")


# ------------------------------------------------------------------ tokens and ranges
@register("tokenize_offsets", with_base("", 'SELECT doc_id, tok_idx, tok, "start", "end" FROM tokens'))
def q_tokenize_offsets(spark, sf_dir):
    return X.tokens(spark, sf_dir).select("doc_id", "tok_idx", "tok", "start", "end")


@register("normalize_spans", with_base("", islands("chars", "doc_id, source")))
def q_normalize_spans(spark, sf_dir):
    return S.normalize_spans(_spans(spark, sf_dir), ["doc_id", "source"])


OFFSETS_TO_RANGES_SQL = with_base(
    """
lists AS (SELECT doc_id, flatten(list(range("start", "end") ORDER BY "start", "end")) AS offs FROM spans WHERE source = 'C' GROUP BY doc_id),
u AS (SELECT doc_id, unnest(offs) AS off, generate_subscripts(offs, 1) AS i FROM lists),
f AS (SELECT *, CASE WHEN lag(off) OVER (PARTITION BY doc_id ORDER BY i) = off - 1 THEN 0 ELSE 1 END AS brk FROM u),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS run_idx FROM f)
""",
    'SELECT doc_id, CAST(run_idx AS BIGINT) AS run_idx, CAST(min(off) AS BIGINT) AS "start", CAST(max(off) + 1 AS BIGINT) AS "end" FROM g GROUP BY doc_id, run_idx',
)


def c_offset_lists(spark, sf_dir):
    """Per document: model C's offsets concatenated range by range (overlapping ranges repeat offsets)."""
    c = _spans(spark, sf_dir).where(F.col("source") == "C")
    lists = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("r"))
    return lists.select("doc_id", F.flatten(F.transform("r", lambda x: F.sequence(x["start"], x["end"] - 1))).alias("offsets"))


@register("offsets_to_ranges", OFFSETS_TO_RANGES_SQL)
def q_offsets_to_ranges(spark, sf_dir):
    return S.offsets_to_ranges(c_offset_lists(spark, sf_dir), "offsets")


@register("ranges_to_offsets", with_base("", "SELECT doc_id, unnest(range(\"start\", \"end\")) AS char_offset FROM spans WHERE source = 'C'"))
def q_ranges_to_offsets(spark, sf_dir):
    c = _spans(spark, sf_dir).where(F.col("source") == "C")
    return S.ranges_to_offsets(c).select("doc_id", F.col("offset").alias("char_offset"))


@register("span_text", with_base("", "SELECT s.doc_id, s.\"start\", s.\"end\", substring(d.text, s.\"start\" + 1, s.\"end\" - s.\"start\") AS span_text FROM spans s JOIN docs d USING (doc_id) WHERE s.source = 'gold'"))
def q_span_text(spark, sf_dir):
    g = _spans(spark, sf_dir).where(F.col("source") == "gold").select("doc_id", "start", "end")
    return S.span_text(g, X.docs(spark, sf_dir))


# ------------------------------------------------------------------ cleaning
CLEAN_CTES = f"""
m AS (SELECT m.doc_id, m.source, m."start" AS b, m."end" - 1 AS e, d.text FROM messy m JOIN docs d USING (doc_id)),
t1 AS (SELECT *, least(b + length(regexp_extract(substring(text, b + 1, e - b + 1), '^{_WS}*')), e) AS b1 FROM m),
t2 AS (SELECT *, greatest(e - length(regexp_extract(substring(text, b1 + 1, e - b1 + 1), '{_WS}*$')), b1) AS e1 FROM t1),
x3 AS (SELECT *,
  CASE WHEN b1 < e1 THEN b1 - length(regexp_extract(substring(text, 1, b1), '{_AN}*$')) ELSE b1 END AS xb,
  CASE WHEN b1 < e1 THEN e1 + length(regexp_extract(substring(text, e1 + 2, length(text)), '^{_AN}*')) ELSE e1 END AS xe FROM t2),
c1 AS (SELECT *, CASE WHEN b1 < e1 AND b1 > 0 AND regexp_matches(substring(text, b1, 1), '{_AN}')
  THEN least(b1 + length(regexp_extract(substring(text, b1 + 1, length(text)), '^{_AN}*')) + 1, e1) ELSE b1 END AS cb FROM t2),
c2 AS (SELECT *, CASE WHEN e1 > cb AND e1 < length(text) - 1 AND regexp_matches(substring(text, e1 + 2, 1), '{_AN}')
  THEN greatest(e1 - length(regexp_extract(substring(text, 1, e1 + 1), '{_AN}*$')) - 1, cb) ELSE e1 END AS ce FROM c1)
"""


def _messy(spark, sf_dir):
    return X.messy_ranges(spark, sf_dir)


@register("trim_spans", with_base(CLEAN_CTES, 'SELECT doc_id, source, CAST(b1 AS BIGINT) AS "start", CAST(e1 + 1 AS BIGINT) AS "end" FROM t2'))
def q_trim_spans(spark, sf_dir):
    return C.clean_ranges(_messy(spark, sf_dir), X.docs(spark, sf_dir), mode="trim", steps=("trim",))


@register("expand_to_words", with_base(CLEAN_CTES, 'SELECT doc_id, source, CAST(xb AS BIGINT) AS "start", CAST(xe + 1 AS BIGINT) AS "end" FROM x3'))
def q_expand_to_words(spark, sf_dir):
    return C.clean_ranges(_messy(spark, sf_dir), X.docs(spark, sf_dir), mode="expand", steps=("trim", "snap"))


@register("collapse_to_words", with_base(CLEAN_CTES, 'SELECT doc_id, source, CAST(cb AS BIGINT) AS "start", CAST(ce + 1 AS BIGINT) AS "end" FROM c2'))
def q_collapse_to_words(spark, sf_dir):
    return C.clean_ranges(_messy(spark, sf_dir), X.docs(spark, sf_dir), mode="collapse", steps=("trim", "snap"))


@register("drop_short_runs", with_base("", 'SELECT doc_id, source, "start", "end" FROM messy WHERE "end" - "start" >= 3'))
def q_drop_short_runs(spark, sf_dir):
    return C.drop_short_runs(_messy(spark, sf_dir))


CLEAN_SPANS_SQL = with_base(
    CLEAN_CTES + ",\nkept AS (SELECT doc_id, source, unnest(range(xb, xe + 1)) AS off FROM x3 WHERE xe - xb > 1)",
    islands("kept", "doc_id, source"),
)


@register("clean_spans", CLEAN_SPANS_SQL)
def q_clean_spans(spark, sf_dir):
    return C.clean_spans(_messy(spark, sf_dir), X.docs(spark, sf_dir), mode="expand", group=("source",))


# ------------------------------------------------------------------ boundary format
FMT_SQL = "'[' || coalesce(array_to_string(list(off ORDER BY off), ', '), '') || ']'"


@register(
    "sorted_offsets",
    with_base("", f"SELECT doc_id, {FMT_SQL} AS offsets FROM (SELECT DISTINCT doc_id, off FROM chars WHERE source IN ('A', 'B', 'C')) u GROUP BY doc_id"),
)
def q_sorted_offsets(spark, sf_dir):
    o = S.collect_offsets(_models(spark, sf_dir))
    return o.select("doc_id", S.format_offsets(S.sorted_offsets(F.col("offsets"))).alias("offsets"))


@register(
    "format_predictions",
    with_base(
        "a AS (SELECT doc_id, off FROM chars WHERE source = 'A')",
        f"SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) || chr(9) || '[' || coalesce((SELECT array_to_string(list(off ORDER BY off), ', ') FROM a WHERE a.doc_id = d.doc_id), '') || ']' AS line FROM docs d",
    ),
)
def q_format_predictions(spark, sf_dir):
    a = S.collect_offsets(_spans(spark, sf_dir).where(F.col("source") == "A"))
    d = X.docs(spark, sf_dir).select("doc_id").join(a, "doc_id", "left")
    offs = F.coalesce(F.col("offsets"), S.empty_int_array())
    return d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\t"), S.format_offsets(offs)).alias("line"))


@register(
    "parse_spans",
    with_base(
        "g AS (SELECT doc_id, count(*) AS n, sum(off) AS s FROM gold_chars GROUP BY doc_id)",
        "SELECT d.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_offsets, CAST(coalesce(g.s, 0) AS BIGINT) AS sum_offsets FROM docs d LEFT JOIN g USING (doc_id)",
    ),
)
def q_parse_spans(spark, sf_dir):
    """Gold offsets rendered as list literals (``[]`` when none), then parsed back."""
    g = S.collect_offsets(_spans(spark, sf_dir).where(F.col("source") == "gold"))
    d = X.docs(spark, sf_dir).select("doc_id").join(g, "doc_id", "left")
    lit = S.format_offsets(F.coalesce(F.col("offsets"), S.empty_int_array()))
    p = d.select("doc_id", S.parse_spans(lit).alias("parsed"))
    return p.select(
        "doc_id",
        F.size("parsed").alias("n_offsets"),
        F.aggregate("parsed", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("sum_offsets"),
    )


# ------------------------------------------------------------------ set operations
CNT = "cnt AS (SELECT doc_id, off, count(DISTINCT source) AS c FROM chars WHERE source IN ('A', 'B', 'C') GROUP BY doc_id, off)"


def _set_sql(cond: str) -> str:
    return with_base(CNT + f",\nkeep AS (SELECT doc_id, off FROM cnt WHERE {cond})", islands("keep", "doc_id"))


@register("span_union", _set_sql("c >= 1"))
def q_span_union(spark, sf_dir):
    return E.span_union(_models(spark, sf_dir))


@register("span_intersect", _set_sql("c = 3"))
def q_span_intersect(spark, sf_dir):
    return E.span_intersect(_models(spark, sf_dir), 3)


@register("span_vote", _set_sql("c >= 2"))
def q_span_vote(spark, sf_dir):
    return E.span_vote(_models(spark, sf_dir), 2)


@register("span_majority", _set_sql("c * 2 >= 3"))
def q_span_majority(spark, sf_dir):
    return E.span_majority(_models(spark, sf_dir), 3)


@register(
    "combine_files",
    with_base(
        CNT
        + ",\nheld AS (SELECT doc_id, count(DISTINCT source) AS n FROM spans WHERE source IN ('A', 'B', 'C') GROUP BY doc_id)"
        + ",\nkeep AS (SELECT c.doc_id, c.off FROM cnt c JOIN held h USING (doc_id) WHERE c.c >= h.n)",
        islands("keep", "doc_id"),
    ),
)
def q_combine_files(spark, sf_dir):
    """Intersection fold where each model's file only holds the ids it predicted something for."""
    m = _models(spark, sf_dir)
    presence = m.select("doc_id", "source").distinct()
    return E.combine_files(m, presence, how="intersect")


@register(
    "combine_files_union",
    with_base("u AS (SELECT DISTINCT doc_id, off FROM chars WHERE source IN ('A', 'B', 'C'))", islands("u", "doc_id")),
)
def q_combine_files_union(spark, sf_dir):
    """Union fold: an id's ranges from every file that holds it."""
    m = _models(spark, sf_dir)
    return E.combine_files(m, m.select("doc_id", "source").distinct(), how="union")


@register(
    "span_except",
    with_base(
        "keep AS (SELECT doc_id, off FROM chars WHERE source = 'C' EXCEPT SELECT doc_id, off FROM gold_chars)",
        islands("keep", "doc_id"),
    ),
)
def q_span_except(spark, sf_dir):
    """Characters model C predicts beyond gold."""
    s = _spans(spark, sf_dir)
    return E.span_except(s.where(F.col("source") == "C"), s.where(F.col("source") == "gold"))
