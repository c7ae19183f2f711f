"""Operator 5, MinHash near-dedup with tensored banding.

A document's set holds its distinct shingles of ``SHINGLE`` words. Instead of computing a fresh group
of minhashes for every table, two small collections of ``HALVES`` half keys (``PER_HALF`` minhashes
each) are computed, and table (i, j) is keyed by the pair (left half i, right half j): HALVES**2
tables from 2 * HALVES * PER_HALF = 48 minhashes. A pair at the threshold 0.75 meets in some table
with probability (1 - (1 - 0.75**2)**12)**2 = 0.9999. Candidates are confirmed on the full sets, so
nothing but that chance is approximate.

How the work stays linear and spread:
* documents with equal sets form a class, known by a number; only its first row's text goes on;
* a pair key can only repeat where both of its halves repeat, so halves (24 rows a document) are
  counted first and only repeated halves are combined into pair keys;
* a bucket's members go to the group of its smallest member, its lead, once per lead: two documents
  that share a bucket share its lead's group, and the near-identical buckets that a group of copies
  has in every table fall together. A group is compared inside a task, on full sets, by counting
  common shingles; only one link per member leaves the task, never the pairs;
* a group of more than ``BLOCK_DOCS`` documents or ``BLOCK_SHINGLES`` shingles is dealt to blocks by a
  hash of the id, and every pair of blocks is compared by a task of its own;
* only documents that share a bucket have their full sets computed, once;
* components come from repeated smallest-neighbour steps with pointer jumping on written tables.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z; with fewer than five words the
whole sequence is one shingle; without words or with null text the set is empty and the document
is linked with nothing; texts under one id are one document, so they link what each of them links;
rows with a null id are returned unlinked; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import written
from spanfold.llm.words import hashed_words, scramble, windows

SHINGLE = 5
HALVES, PER_HALF = 12, 2
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 300_000
_HASHES = 2 * HALVES * PER_HALF
_SKETCH = "id long, text_hash long, n_shingles long, set_hash binary, halves array<long>"


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles."""
    for _, hashes, bounds in hashed_words(texts, lower=True):
        shingles, at = windows(hashes, bounds, SHINGLE)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            s = np.sort(shingles[a:b])
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


#: One odd multiplier per minhash function: shingle hashes are already scrambled, a product modulo 2**64 orders them anew.
_MUL = np.random.default_rng(20_240_501).integers(1, 2**63, _HASHES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the 48 hash functions over the set."""
    best = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 512):
        np.minimum(best, (shingles[a : a + 512] * _MUL).min(axis=1), out=best)
    return best


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row a document: set size, hash of the set, 2 * HALVES half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ns, sets, halves = [], [], []
            for s in shingle_sets(batch.column(2)):
                ns.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minhashes(s) if len(s) else None
                if m is None:
                    halves.append([])
                else:
                    with np.errstate(over="ignore"):
                        key = np.arange(2 * HALVES, dtype=np.uint64)
                        for part in m.reshape(2 * HALVES, PER_HALF).T:
                            key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + part)
                    halves.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(sets, pa.binary()), pa.array(halves, pa.list_(pa.int64()))],
                names=["id", "text_hash", "n_shingles", "set_hash", "halves"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, _SKETCH)


def lead_groups(reps: DataFrame) -> DataFrame:
    """``lead, id``: each document with the smallest document of every bucket that it shares (``reps``: id, halves)."""
    halves = reps.select("id", F.posexplode("halves").alias("half", "h"))
    again = halves.groupBy("half", "h").agg(F.count("*").alias("n")).where("n > 1").select("half", "h")
    live = halves.join(again, ["half", "h"], "left_semi")
    side = lambda cond: F.collect_list(F.when(cond, F.col("h")))
    both = live.groupBy("id").agg(side(F.col("half") < HALVES).alias("left"), side(F.col("half") >= HALVES).alias("right"))
    # a half key's hash includes its number, so the pair of hashes names the table too
    keys = both.select("id", F.explode("left").alias("l"), "right").select("id", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("key"), "id")
    keys = written(keys, "near_keys")
    leads = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1").select("key", "lead")
    return written(keys.join(leads, "key").select("lead", "id").distinct(), "near_groups")


def full_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, shingles`` of the classes in ``wanted`` (id, rep, text_hash), from the text of each one's first row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # a few at a time: a long text's set is large
                part = batch.slice(k, 64)
                found = pa.array([s.view(np.int64) for s in shingle_sets(part.column(1))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["id", "shingles"])

    texts = _texts(docs, id_col, text_col).withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    mine = (F.col("_id") == F.col("rep")) & (F.col("_hash") == F.col("text_hash"))
    found = texts.join(wanted.hint("shuffle_hash"), mine).select("id", "text").mapInArrow(sets, "id long, shingles array<long>")
    found = written(found, "near_sets")
    # a row that is repeated as a whole came more than once
    again = written(found.groupBy("id").count().where("count > 1").select("id"), "near_again")
    if again.isEmpty():
        return found
    return found.join(again, "id", "left_anti").unionByName(found.join(again, "id", "left_semi").dropDuplicates(["id"]))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, text`` of the documents."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two of the sets (a square matrix)."""
    n = len(sets)
    both = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    owner, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    holders = np.diff(start)
    # shingles that few documents hold: pair their holders at each distance
    few = np.flatnonzero((holders > 1) & (holders <= 8))
    for gap in range(1, 8):
        first = np.concatenate([start[few[holders[few] > gap + k]] + k for k in range(8 - gap)])
        both += np.bincount(owner[first] * n + owner[first + gap], minlength=n * n).reshape(n, n).astype(np.float32)
    both += both.T
    # the others: products of blocks of their incidence matrix
    many = np.flatnonzero(holders > 8)
    for a in range(0, len(many), 2048):
        part = many[a : a + 2048]
        held = np.zeros((n, len(part)), np.float32)
        at = np.repeat(np.arange(len(part)), holders[part])
        held[owner[np.concatenate([np.arange(start[k], start[k + 1]) for k in part])], at] = 1
        both += held @ held.T
    return both


def linked(ids: np.ndarray, sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Per document the smallest id that it reaches through links inside the group."""
    size = np.array([len(s) for s in sets])
    exact = np.float32 if size.max() < 50_000 else np.float64  # every number below stays exact
    both, size = common_shingles(sets).astype(exact), size.astype(exact)
    near = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, True)
    label = np.argsort(np.argsort(ids))  # ranks, so that the smallest id has the smallest label
    while True:
        new = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            return np.sort(ids)[label]
        label = new


def group_links(groups: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: documents that links connect inside a group, one row a document at most per pair of blocks."""
    sized = groups.join(full.select("id", F.size("shingles").alias("n")), "id")
    blocks = sized.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = groups.join(blocks, "lead").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lead", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id")

    def compare(t: pa.Table) -> pa.Table:
        ids, sets = t.column("id").to_numpy(), [np.asarray(v.values).view(np.uint64) for v in t.column("shingles")]
        root = linked(ids, sets, threshold) if len(ids) > 1 else ids
        moved = root != ids
        return pa.table({"a": pa.array(root[moved], pa.int64()), "b": pa.array(ids[moved], pa.int64())})

    return dealt.join(full, "id").groupBy("lead", "i", "j").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` for every id in ``links`` (a, b): the smallest id it can reach."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "near_edges")
    label = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    label = written(label, "near_labels")
    while True:
        # a node takes the smallest label among its neighbours and itself, then the label of its label
        seen = edges.join(label, edges["b"] == label["id"]).groupBy("a").agg(F.min("comp").alias("seen"))
        step = label.join(seen, label["id"] == seen["a"]).select("id", F.least("comp", "seen").alias("comp"), F.col("comp").alias("old"))
        step = written(step, "near_step")
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        step = written(step.join(jump, "comp").select("id", F.least("comp", "root").alias("comp"), "old"), "near_labels")
        label = step.select("id", "comp")
        if step.where("comp < old").isEmpty():
            return label


def set_classes(sketch: DataFrame) -> DataFrame:
    """One row for each different set: ``id`` (a number), ``set_hash, n_shingles, halves, rows``, and its first row (smallest id):
    ``rep, text_hash``."""
    first = F.min(F.struct("id", "text_hash")).alias("row")
    classes = sketch.where("n_shingles > 0 and id is not null").groupBy("set_hash", "n_shingles").agg(first, F.first("halves").alias("halves"), F.count("*").alias("rows"))
    numbered = classes.select(F.monotonically_increasing_id().alias("id"), "set_hash", "n_shingles", "halves", "rows", F.col("row.id").alias("rep"), "row.text_hash")
    return written(numbered, "near_classes")


def same_document(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: classes that hold texts of one id."""
    which = F.xxhash64("set_hash", "n_shingles")
    rows = sketch.where("n_shingles > 0 and id is not null").select(F.col("id").alias("doc"), "set_hash", "n_shingles")
    several = rows.groupBy("doc").agg(F.min(which).alias("low"), F.max(which).alias("high")).where("low < high").select("doc")
    held = rows.join(several, "doc", "left_semi").join(classes.select("id", "set_hash", "n_shingles"), ["set_hash", "n_shingles"]).select("doc", "id").distinct()
    return held.join(held.groupBy("doc").agg(F.min("id").alias("a")), "doc").where("id <> a").select("a", F.col("id").alias("b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``."""
    sketch = written(sketches(docs, id_col, text_col), "near_sketch")
    classes = set_classes(sketch)
    groups = lead_groups(classes.select("id", "halves"))
    wanted = classes.select("id", "rep", "text_hash").join(groups.select("id").distinct(), "id", "left_semi")
    full = full_sets(wanted, docs, id_col, text_col)
    links = group_links(groups, full, threshold).unionByName(same_document(sketch, classes))
    comp = components(written(links, "near_links"))

    linked = classes.select("id", "rep").join(comp, "id")
    least = linked.groupBy("comp").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "comp").select("id", "least")
    key = ["set_hash", "n_shingles"]
    labels = classes.select("id", *key, "rep", "rows").join(linked, "id", "left").select(*key, "rows", F.coalesce("least", "rep").alias("_comp"), F.lit(True).alias("_known"))
    labels = written(labels, "near_labelled")

    rows = sketch.select("id", *key)
    # at most 1,000 classes hold a thousandth of the rows each; theirs are told to every task, the others' go by a shuffle
    large = labels.where(F.col("rows") * 1000 >= rows.count()).drop("rows")
    told = rows.join(F.broadcast(large), key, "left")
    rest = told.where("_known is null").drop("_comp", "_known").join(labels.drop("rows"), key, "left")
    out = told.where("_known").unionByName(rest)
    comp_id = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("_comp")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp_id.alias("component_id"), F.col("id").eqNullSafe(comp_id).alias("kept"))
