"""Operator 12, periodic runs of words by the dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
``max(12, 2 * q)`` long, that no neighbouring word extends. All runs of many documents are found side by
side in arrays:

1. Level k of the dictionary names every stretch of m = 2**k words of a document; equal stretches get
   equal names (a level's names are the pairs of the level below). A stretch that occurs once in its
   document has no name: nothing longer that holds it can occur twice.
2. At each level the occurrences of a name, in order, fall into arithmetic progressions: successors at
   most m / 2 apart (they all have the stretch's own period as difference). The first of the next
   three progressions can lie within 2 * m; between two progressions the differences of their members
   form one arithmetic progression too. All those from m to 2 * m - 1 are proposed as periods.
   No run is missed: with m <= q < 2 * m its first m words occur again q later, and in another
   progression, because one progression would give the run a smaller period than q. A level
   proposes a number of periods in proportion to its stretches.
3. A proposal (place, period) is extended to both sides by binary steps down the levels, comparing names.
4. Equal stretches are listed once, with their smallest period.

A word is dropped from the collapsed text if some run holds it after that run's first q words.

Words are told apart by 64-bit hashes (with V words two share one with probability V**2 / 2**65).
Defined results: null text and text without words have no run and an empty collapsed text; a
null id counts as empty text where the id's checksum is taken; repeated rows are read each by itself;
extra columns don't matter (only the id and the text are read); an empty table gives no rows. Whole
texts are read; memory is a few numbers a word and level, of levels that still have repeats.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.words import hashed_words

LEAST = 12
#: Words that are looked at side by side; a longer text is taken alone.
TOGETHER = 1 << 20
_ROW = "id {}, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Factors:
    """The dictionary of basic factors of several documents: per level the places that have a name, and the names."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        """``words``: any numbers, equal for equal words; document d has ``words[bounds[d] : bounds[d + 1]]``."""
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        _, ids = np.unique(words, return_inverse=True)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at, key = np.arange(len(words)), doc * np.int64(len(words) + 1) + ids
        while len(at):
            _, names, counts = np.unique(key, return_inverse=True, return_counts=True)
            keep = counts[names] > 1
            at, names = at[keep], names[keep]
            if not len(at):
                break
            self.levels.append((at, names))
            right = np.searchsorted(at, at + (1 << (len(self.levels) - 1)))
            right[right == len(at)] = 0
            both = at[right] == at + (1 << (len(self.levels) - 1))
            # a named stretch lies inside one document, but its right neighbour may not
            both &= doc[at] == doc[at[right]]
            key = names * np.int64(names.max() + 1) + names[right]
            at, key = at[both], key[both]

    def _names(self, level: int, places: np.ndarray) -> np.ndarray:
        """Names at places; -1 where there is none."""
        at, names = self.levels[level]
        where = np.searchsorted(at, places)
        where[where == len(at)] = 0
        return np.where(at[where] == places, names[where], -1)

    def extend(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words from ``left`` and ``right`` on, and how many before them, agree."""
        after, before = np.zeros_like(left), np.zeros_like(left)
        for level in range(len(self.levels) - 1, -1, -1):
            m = 1 << level
            a, b = self._names(level, left + after), self._names(level, right + after)
            after += np.where((a == b) & (a >= 0), m, 0)
            a, b = self._names(level, left - before - m), self._names(level, right - before - m)
            before += np.where((a == b) & (a >= 0), m, 0)
        return after, before

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) from the progressions of every level."""
        places, periods = [], []
        for level, (at, names) in enumerate(self.levels):
            m = 1 << level
            order = np.argsort(names, kind="stable")
            at, names = at[order], names[order]
            same = names[1:] == names[:-1]
            gap = np.where(same, np.diff(at), 0)
            first = np.flatnonzero(np.append(True, ~same | (2 * gap > m)))
            last = np.append(first[1:], len(at)) - 1
            step = np.where(last > first, gap[np.minimum(first, len(gap) - 1)], 0)
            for ahead in (1, 2, 3):
                a, b = np.arange(len(first) - ahead), np.arange(ahead, len(first))
                nearest = at[first[b]] - at[last[a]]
                ok = (names[first[a]] == names[first[b]]) & (nearest < 2 * m)
                a, b, nearest = a[ok], b[ok], nearest[ok]
                each = np.maximum(np.maximum(step[a], step[b]), 1)
                size_a, size_b = last[a] - first[a], last[b] - first[b]
                # differences nearest + t * each, t from 0 to size_a + size_b, of which m to 2m - 1 count
                low = np.maximum(0, -((nearest - m) // each))
                high = np.minimum(size_a + size_b, (2 * m - 1 - nearest) // each)
                count = np.maximum(high - low + 1, 0)
                pair = np.repeat(np.arange(len(a)), count)
                t = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + low[pair]
                back = np.minimum(t, size_a[pair])
                places.append(at[last[a][pair]] - back * each[pair])
                periods.append(nearest[pair] + t * each[pair])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; starts count over all documents."""
    factors = Factors(words, bounds)
    place, period = factors.proposals()
    if not len(place):
        return place, place, period
    after, before = factors.extend(place, place + period)
    start, length = place - before, before + after + period
    ok = length >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([start[ok], length[ok], period[ok]]), axis=1)
    new = np.append(True, (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1]))[: found.shape[1]]
    found = found[:, new]
    return tuple(found[:, np.lexsort((found[2], found[0]))])


def repeated_tail(doc_id, n: int) -> np.ndarray | None:
    """Which words a document's words become: with h the crc32 of the id as text, every tenth document
    (h % 10 = 0) repeats a stretch to its end; None leaves them as they are."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    """``id_col``, ``runs`` (start, length, period by start, then period) and ``collapsed`` of each document;
    row-local, no shuffle. ``rewrite(id, n)`` may give the places whose words take the place of a document's n words."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def flush(rows: list, id_type: pa.DataType) -> pa.RecordBatch:
        """Runs and collapsed texts of a few documents: (id, text, places or None, hashes)."""
        bounds = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])
        words = np.concatenate([r[3] for r in rows]) if rows else np.empty(0, np.uint64)
        start, length, period = find_runs(words, bounds)
        cover = np.zeros(len(words) + 1, np.int32)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, start + length, -1)
        dropped = np.cumsum(cover[:-1]) > 0
        first = np.searchsorted(start, bounds)
        spans, texts = [], []
        for k, (_, text, places, hashes) in enumerate(rows):
            part = slice(first[k], first[k + 1])
            spans.append([{"start": s, "length": n, "period": q} for s, n, q in zip((start[part] - bounds[k]).tolist(), length[part].tolist(), period[part].tolist())])
            split = text.split()
            if places is not None or spans[-1]:
                where = np.arange(len(split)) if places is None else places
                split = [split[i] for i in where[~dropped[bounds[k] : bounds[k + 1]]].tolist()]
            texts.append(b" ".join(split))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, total = [], 0
            for row, hashes, bounds in hashed_words(batch.column(1), lower=False):
                for k in range(len(bounds) - 1):
                    key, part = batch.column(0)[row + k].as_py(), hashes[bounds[k] : bounds[k + 1]]
                    if rows and total + len(part) > TOGETHER:
                        yield flush(rows, batch.column(0).type)
                        rows, total = [], 0
                    places = rewrite(key, len(part)) if rewrite else None
                    text = (batch.column(1)[row + k].as_py() or "").encode()
                    rows.append((key, text, places, part if places is None else part[places]))
                    total += len(part)
            if rows:
                yield flush(rows, batch.column(0).type)

    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return table.mapInArrow(run, _ROW.format(table.schema["id"].dataType.simpleString())).withColumnRenamed("id", id_col)
