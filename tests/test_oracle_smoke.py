"""A sample of registered queries against their DuckDB oracles on sf0.001 (the full set runs
in tools/check_oracle.py at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF001

TABLES = "documents labels events embeddings".split()
SAMPLE = ["system_prf", "doc_prf", "clean_spans", "span_vote", "combine_files", "token_label_overlap", "decode_gap_fill",
          "rank_candidates", "tune_score_threshold", "tune_token_threshold", "window_answer_positions", "erasure_scores",
          "classification_metrics", "vocab_lookup", "running_loss", "best_run", "read_span_csv"]


def norm(rows):
    out = []
    for r in rows:
        t = []
        for v in r:
            if isinstance(v, float):
                v = None if v != v else round(v, 6)
            t.append(v)
        out.append(tuple(t))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = norm([tuple(r[c] for c in cols) for r in df.collect()])
    res = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = norm([tuple(r[names.index(c)] for c in cols) for r in res.fetchall()])
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) == {"source", "n_docs", "precision", "recall", "f1", "f1_nonempty_gold"}
