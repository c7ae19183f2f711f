"""Plan-shape tests: built-in expressions only, no pairing joins, pruned scans, one tokenization."""

from pathlib import Path

import pytest

import __spark_entry__ as E
from spanfold.plans import catalog

from conftest import SF001

ML_OR_PANDAS = {"doc_classifier", "token_tagger", "span_scorer", "surrogate_attribution", "erasure_classifier", "sequence_tagger", "surrogate_classifier",
                 "span_null_scores", "word_vectors"}


@pytest.fixture(scope="module")
def plans(spark):
    qs = E.queries()
    out = {}
    for name in ["system_prf", "doc_prf", "span_vote", "clean_spans", "overlap_join", "rank_candidates", "tune_score_threshold",
                 "pairwise_agreement", "token_label_overlap", "decode_gap_fill", "erasure_scores", "vocab_lookup"]:
        out[name] = qs[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_python_udfs_outside_models(plans):
    for name, p in plans.items():
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_no_cartesian_or_nested_loop_joins(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


#: Plans that set tokens against spans of the same tokens derive the tokens in both branches.
TWO_BRANCHES = {"overlap_join", "token_label_overlap", "tune_score_threshold"}


def test_tokenizer_runs_once_per_branch(plans):
    for name, p in plans.items():
        assert p.count("posexplode(regexp_extract_all") + p.count("MapInPandas") <= 1 + (name in TWO_BRANCHES), name


#: Queries whose builder writes: file round trips, the global rank of a vocabulary or grid, fitted models.
WRITING = {
    "read_span_csv", "read_predictions", "write_clean", "load_splits", "saved_threshold", "vocab_build", "vocab_lookup", "vector_lookup", "importance_norm",
    "span_report", "span_report_html", "mean_importance", "text_to_sequence", "pad_sequence", "param_cross", "doc_classifier", "token_tagger", "span_scorer", "erasure_classifier",
    "sequence_tagger", "surrogate_classifier", "span_null_scores", "word_vectors",
}


def test_builders_write_nothing(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    for name, build in catalog.queries().items():
        if name not in WRITING:
            before = set(root.rglob("*"))
            build(spark, SF001)
            assert set(root.rglob("*")) == before, name


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["system_prf"](spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    # documents is read for doc_id and text only, never lang/source/n_chars
    import re

    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", p))
    assert "struct<doc_id:bigint,text:string>" in schemas
    assert all(not any(c in s for c in ("lang", "source", "n_chars")) for s in schemas)


def test_registry_contract():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    own = catalog.queries()
    assert set(own) - set(sql) == ML_OR_PANDAS
