"""Registered scoring queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfold.operators import metrics as M
from spanfold.plans import fixtures as X
from spanfold.plans.oracle import DOC_PRF_CTES, with_base
from spanfold.plans.registry import register


def model_scores(spark, sf_dir):
    """Per-document P/R/F1 of the three fixture models against gold, all documents."""
    return M.doc_prf_from_spans(X.docs(spark, sf_dir), X.spans(spark, sf_dir), X.MODELS)


@register(
    "doc_prf",
    with_base(DOC_PRF_CTES, "SELECT doc_id, source, n_pred, n_gold, n_inter, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM doc_prf"),
)
def q_doc_prf(spark, sf_dir):
    return model_scores(spark, sf_dir)


@register("doc_f1", with_base(DOC_PRF_CTES, "SELECT doc_id, source, round(f1, 6) AS f1 FROM doc_prf"))
def q_doc_f1(spark, sf_dir):
    return model_scores(spark, sf_dir).select("doc_id", "source", "f1")


SYSTEM_PRF_SQL = with_base(
    DOC_PRF_CTES,
    """SELECT source, count(*) AS n_docs, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1, round(avg(CASE WHEN n_gold > 0 THEN f1 END), 6) AS f1_nonempty_gold
FROM doc_prf GROUP BY source""",
)


@register("system_prf", SYSTEM_PRF_SQL)
def q_system_prf(spark, sf_dir):
    return M.system_prf(model_scores(spark, sf_dir))


@register(
    "system_f1_sem",
    with_base(DOC_PRF_CTES, "SELECT source, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1) / sqrt(count(f1)), 6) AS sem_f1 FROM doc_prf GROUP BY source"),
)
def q_system_f1_sem(spark, sf_dir):
    return M.system_f1_sem(model_scores(spark, sf_dir))


@register(
    "batch_f1",
    with_base(DOC_PRF_CTES, "SELECT source, doc_id // 16 AS batch, count(*) AS n_docs, round(avg(f1), 6) AS f1 FROM doc_prf GROUP BY source, doc_id // 16"),
)
def q_batch_f1(spark, sf_dir):
    """Mean F1 per batch of 16 consecutive document ids (the training loop's batch size)."""
    s = model_scores(spark, sf_dir).withColumn("batch", (F.col("doc_id") / 16).cast("long"))
    return s.groupBy("source", "batch").agg(F.count("*").alias("n_docs"), F.avg("f1").alias("f1"))


@register(
    "f1_box_summary",
    with_base(
        DOC_PRF_CTES,
        """SELECT source, round(min(f1), 6) AS f1_min, round(quantile_cont(f1, 0.25), 6) AS f1_q1, round(quantile_cont(f1, 0.5), 6) AS f1_median,
       round(quantile_cont(f1, 0.75), 6) AS f1_q3, round(max(f1), 6) AS f1_max FROM doc_prf GROUP BY source""",
    ),
)
def q_f1_box_summary(spark, sf_dir):
    return M.f1_box_summary(model_scores(spark, sf_dir))
