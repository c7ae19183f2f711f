"""Operator 7, mixing sources to target weights: systematic sampling inside each source.

Each source has a weight; the targets share ``budget`` (a multiple of all sizes) by weight, but none
passes ``cap`` times its source's size: what is over is shared again by weight among the others
until none is above. A document's expected copies are target / size of its source. Inside a source
the documents stand in one order, their expected copies are summed up, one keyed random offset is
added, and a document is emitted once for every whole number its stretch crosses.

The order is by (keyed bucket, size, key hash, id), sizes going up in even and down in odd buckets, so
that neighbours are of like size and the words taken stay near the target. A bucket holds about
``BUCKET_ROWS`` rows: the prefix sum is two-level (rows inside a bucket, buckets inside a source) and
a source with a third of all rows is spread over many tasks. Built-in functions only.

Defined results: a null source is a source of its own, placed last; a null text has size 0; a source
of size 0 has target 0 and none of its rows is taken; equal rows are sampled one by one; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanfold.llm.common import fresh, key_hash, ordinal, word_count, written

WEIGHTS = (3, 1, 2)
BUCKET_ROWS = 8192


def source_targets(sizes: DataFrame, budget: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """``_src, _rows, source_size, target`` from rows ``_src, size``.

    The level (target per unit of weight) only rises as sources reach their caps, so each round is
    one small aggregate over the source table, repeated until no further source is capped."""
    per = sizes.groupBy("_src").agg(F.count("*").alias("_rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    per = written(ordinal(per, "_src", "_pos").withColumn("_w", weight).withColumn("_cap", F.lit(float(cap)) * F.col("source_size")), "mix_sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, capped = -1.0, -1
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("_w")
        n, spent, open_w = per.agg(
            F.sum(full.cast("int")), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))
        ).first()
        if n in (None, capped) or not open_w:
            break
        level, capped = (budget * total - spent) / open_w, n
    return per.select("_src", "_rows", "source_size", F.least(F.col("_cap"), F.greatest(F.lit(level), F.lit(0.0)) * F.col("_w")).alias("target"))


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """``id, size, source_size, target, copies`` for every row of ``docs``."""
    src = F.when(F.col(source_col).isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    base = written(docs.select(F.col(id_col).alias("_id"), src.alias("_src"), word_count(F.col(text_col)).alias("size")), "mix_base")
    targets = source_targets(base, budget, cap, weights)
    targets = written(
        targets.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_buckets", F.ceil(F.col("_rows") / BUCKET_ROWS))
        .withColumn("_offset", key_hash(F.col("_src"), F.lit(seed)) / F.lit(float(2**60))),
        "mix_targets",
    )
    rows = base.join(targets, "_src").withColumn("_hash", key_hash(F.col("_id"), F.lit(seed)))
    rows = rows.withColumn("_bucket", F.pmod("_hash", "_buckets"))
    cells = rows.groupBy("_src", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_src", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_src", "_bucket").orderBy(F.when(F.col("_bucket") % 2 == 0, F.col("size")).otherwise(-F.col("size")), "_hash", "_id")
    placed = rows.join(cells, ["_src", "_bucket"]).withColumn("_i", F.col("_before") + F.row_number().over(inside))
    crossed = F.floor(F.col("_offset") + F.col("_i") * F.col("_rate")) - F.floor(F.col("_offset") + (F.col("_i") - 1) * F.col("_rate"))
    copies = F.least(crossed, F.lit(int(cap))).cast("long")
    return placed.select(F.col("_id").alias(id_col), "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken (ids must be unique)."""
    mixed, times, nth = fresh(docs, "_mixed", "_times", "_nth")
    copies = mix_copies(docs, id_col, **options).where("copies > 0").groupBy(F.col(id_col).alias(mixed)).agg(F.max("copies").cast("int").alias(times))
    taken = docs.join(copies, F.col(id_col).eqNullSafe(F.col(mixed)))
    return taken.withColumn(nth, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)
