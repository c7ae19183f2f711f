"""Records of quoted multi-line CSV, read in parallel from the blocks of each file.

A newline ends a record only outside quotes, and whether a block of a file begins inside quotes
depends on everything before it. Quotes inside a quoted field are doubled, so only the parity of the
number of quotes counts:

1. every block's parity of quotes is counted (JVM, partial sums; one row a block remains);
2. the parity of all blocks before a block says whether it begins inside quotes;
3. each block is walked once: whole records leave it as they are, the lines before its first record
   and its unfinished last record leave it as fragments (two a block at most);
4. fragments of one record, which may lie in any number of blocks, are joined by its number.

Blocks are the scan's own splits of the files at newlines; texts stay in the tasks that read them,
but for the fragments. The parities (a few bytes a block: some 800,000 blocks for 100 TB at Spark's
default of 128 MB) are sent to the tasks.

Files must follow the quoting rules: quotes only around whole fields, doubled inside. A file whose
last quote is open ends with its last record unfinished, which is kept as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PART = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("head", pa.bool_()), ("goes_on", pa.bool_()), ("record", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of all files, a block's lines in order; only newlines end lines, so carriage returns stay."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _starts_inside(lines: DataFrame) -> dict[str, dict[int, bool]]:
    """By file and block: whether the block begins inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")).toArrow()
    inside: dict[str, dict[int, bool]] = {}
    for file, block, is_inside in zip(*(starts.column(c).to_pylist() for c in ("file", "block", "inside"))):
        inside.setdefault(file, {})[block] = is_inside
    return inside


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``record``: every record's text without the newline that ends it; blank records and, with ``header``, each file's first record
    are left out. Records come in no particular order. Line ends inside quotes stay as they are."""
    lines = _lines(spark, path)
    told = spark.sparkContext.broadcast(_starts_inside(lines))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records and fragments of each block: ``head`` began in an earlier block, ``goes_on`` doesn't end in this one."""
        known = told.value
        place, quoted, head, first, held = None, False, False, False, []
        for batch in batches:
            out = []
            for file, block, line in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, block) != place:
                    if held:
                        out.append((*place, first, head, True, "\n".join(held)))
                    place, held, first = (file, block), [], block == 0
                    quoted = head = known[file][block]
                held.append(line)
                quoted ^= line.count('"') % 2 == 1
                if not quoted:
                    out.append((*place, first, head, False, "\n".join(held)))
                    held, head, first = [], False, False
            yield _batch(out)
        if held:
            yield _batch([(*place, first, head, True, "\n".join(held))])

    parts = lines.mapInArrow(walk, "file string, block long, first boolean, head boolean, goes_on boolean, record string")
    cut = F.col("head") | F.col("goes_on")
    wanted = ~F.col("first") if header else F.lit(True)
    # fragments by their record: it begins with a fragment that isn't a head, and there are one of each kind a block at most
    pieces = parts.where(cut)
    order = Window.partitionBy("file").orderBy("block", (~F.col("head")).cast("int"))
    numbers = pieces.select("file", "block", "head").withColumn("number", F.sum((~F.col("head")).cast("int")).over(order))
    joined = pieces.join(numbers, ["file", "block", "head"]).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"), F.max("first").alias("first"))
    joined = joined.withColumn("record", F.array_join(F.transform("p", lambda p: p["record"]), "\n"))
    records = parts.where(~cut & wanted).select("record").unionByName(joined.where(wanted).select("record"))
    return records.select(F.regexp_replace("record", "\r\\z", "").alias("record")).where(F.col("record") != "")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PART)], schema=_PART)
