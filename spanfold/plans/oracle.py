"""DuckDB oracle SQL: the same fixtures as plans/fixtures.py, computed independently.

The oracle side is deliberately brute force: ranges are exploded to characters and
set algebra is plain GROUP BY/JOIN on ``(doc_id, off)``, so it shares no logic with the
Spark side (which never explodes ranges). Floats are rounded to 6 decimals and
integers cast to BIGINT on both sides.
"""

from __future__ import annotations

from spanfold.functions.text import LEXICON, MODEL_A_MISSES

_WS = "[ \\t\\n\\r\\x0b\\x0c]"
_NWS = "[^ \\t\\n\\r\\x0b\\x0c]"
LEX_SQL = "(" + ", ".join(f"'{w}'" for w in LEXICON) + ")"
A_MISS_SQL = "(" + ", ".join(f"'{w}'" for w in MODEL_A_MISSES) + ")"

BASE_CTES = f"""
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_NWS}+|{_WS}+')) AS t,
         generate_subscripts(regexp_extract_all(text, '{_NWS}+|{_WS}+'), 1) AS i
  FROM docs),
pieces_e AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM pieces),
tokens AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS tok_idx, t AS tok,
         CAST(e - length(t) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end",
         lower(regexp_replace(t, '[^\\pL\\pN]', '', 'g')) AS core
  FROM pieces_e WHERE regexp_matches(t, '{_NWS}')),
hits AS MATERIALIZED (
  SELECT *, core IN {LEX_SQL} AS hit,
         lead("end") OVER (PARTITION BY doc_id ORDER BY tok_idx) AS next_end
  FROM tokens),
spans AS (
  SELECT doc_id, 'gold' AS source, "start", "end" FROM hits WHERE hit
  UNION ALL SELECT doc_id, 'A', "start", "end" FROM hits WHERE hit AND core NOT IN {A_MISS_SQL}
  UNION ALL SELECT doc_id, 'B', "start", "end" FROM hits WHERE (hit AND tok_idx % 4 <> 0) OR (length(core) = 9 AND tok_idx % 50 = 0)
  UNION ALL SELECT doc_id, 'C', "start", coalesce(next_end, "end") FROM hits WHERE hit),
chars AS (SELECT DISTINCT doc_id, source, unnest(range("start", "end")) AS off FROM spans WHERE "end" > "start"),
gold_chars AS (SELECT doc_id, off FROM chars WHERE source = 'gold'),
token_scores AS (
  SELECT doc_id, tok_idx, "start", "end", CAST(0 AS DOUBLE) AS logit0,
    (CASE WHEN hit THEN 2 ELSE -2 END) + CAST((doc_id*31 + tok_idx*17) % 41 - 20 AS DOUBLE)/10 AS logit1,
    (CASE WHEN hit THEN 3 ELSE -3 END) + CAST((doc_id*13 + tok_idx*29) % 37 - 18 AS DOUBLE)/10 AS start_logit,
    (CASE WHEN hit THEN 3 ELSE -3 END) + CAST((doc_id*7  + tok_idx*23) % 31 - 15 AS DOUBLE)/10 AS end_logit
  FROM hits),
messy AS (
  SELECT s.doc_id, s.source, greatest(s."start" - 1, 0) AS "start", least(s."end" - 2, length(d.text)) AS "end"
  FROM spans s JOIN docs d USING (doc_id)
  WHERE s.source IN ('B', 'C') AND least(s."end" - 2, length(d.text)) > greatest(s."start" - 1, 0))
"""


def islands(rel: str, keys: str, off: str = "off") -> str:
    """Maximal runs of consecutive distinct offsets of ``rel`` per ``keys`` -> half-open ranges."""
    return f"""SELECT {keys}, CAST(min({off}) AS BIGINT) AS "start", CAST(max({off}) + 1 AS BIGINT) AS "end"
FROM (SELECT {keys}, {off}, {off} - row_number() OVER (PARTITION BY {keys} ORDER BY {off}) AS grp
      FROM (SELECT DISTINCT {keys}, {off} FROM {rel}) u) v
GROUP BY {keys}, grp"""


def prf_sql(n_pred: str, n_gold: str, n_inter: str) -> str:
    def one(expr: str) -> str:
        return (
            f"CASE WHEN {n_gold} = 0 THEN (CASE WHEN {n_pred} = 0 THEN 1.0 ELSE 0.0 END) "
            f"WHEN {n_pred} = 0 THEN 0.0 ELSE {expr} END"
        )

    return (
        f"{one(f'CAST({n_inter} AS DOUBLE) / {n_pred}')} AS precision, "
        f"{one(f'CAST({n_inter} AS DOUBLE) / {n_gold}')} AS recall, "
        f"{one(f'2.0 * {n_inter} / ({n_pred} + {n_gold})')} AS f1"
    )


def with_base(extra_ctes: str, body: str) -> str:
    extra = f",\n{extra_ctes.strip().rstrip(',')}" if extra_ctes.strip() else ""
    return f"WITH {BASE_CTES.strip()}{extra}\n{body.strip()}"


# Per-document P/R/F1 of models A, B, C against gold, every document included.
DOC_PRF_CTES = f"""
models AS (SELECT * FROM (VALUES ('A'), ('B'), ('C')) m(source)),
base AS (SELECT d.doc_id, m.source FROM docs d CROSS JOIN models m),
np AS (SELECT doc_id, source, count(*) AS n FROM chars WHERE source <> 'gold' GROUP BY doc_id, source),
ng AS (SELECT doc_id, count(*) AS n FROM gold_chars GROUP BY doc_id),
ni AS (SELECT c.doc_id, c.source, count(*) AS n FROM chars c JOIN gold_chars g ON c.doc_id = g.doc_id AND c.off = g.off
       WHERE c.source <> 'gold' GROUP BY c.doc_id, c.source),
prf AS (
  SELECT b.doc_id, b.source, CAST(coalesce(np.n, 0) AS BIGINT) AS n_pred, CAST(coalesce(ng.n, 0) AS BIGINT) AS n_gold,
         CAST(coalesce(ni.n, 0) AS BIGINT) AS n_inter
  FROM base b LEFT JOIN np ON b.doc_id = np.doc_id AND b.source = np.source
  LEFT JOIN ng ON b.doc_id = ng.doc_id LEFT JOIN ni ON b.doc_id = ni.doc_id AND b.source = ni.source),
doc_prf AS (SELECT doc_id, source, n_pred, n_gold, n_inter, {prf_sql('n_pred', 'n_gold', 'n_inter')} FROM prf)
"""
