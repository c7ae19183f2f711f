"""Operator 8, best-fit packing by the sum-of-squares rule.

1. ``cut_pieces`` turns each document into token pieces of at most ``capacity`` tokens. Only longer
   documents are cut, at multiples of ``capacity`` counted from their end, so the first piece may be
   shorter. It is row-local: only narrow piece rows leave it.
2. ``pack`` deals the pieces into groups of about ``GROUP_PIECES`` by a hash of (id, piece) and packs
   each group by itself: a piece goes to the residual gap where the sum of squared counts of open
   sequences per gap becomes smallest. Pieces go in order of falling length. A second round takes
   the sequences that are still open from all groups as items and packs them again, so the
   groups' leftovers meet.

Ids are those of the byte-level BPE vocabulary and its added tokens, as ``tokenizers`` gives them
without adding any. A text is first split at the added tokens of the vocabulary's JSON file (it lies
beside the rank file), each of which is one id; no unit spans one. A stretch between them is split
at single spaces between characters that aren't blank (the vocabulary's pattern never joins text
across such a place except for the space itself, which begins the next unit), and a worker
remembers the ids of units it has met.

Defined results: null and empty texts are one piece holding the end id; repeated rows are packed
each; an empty table gives no rows. Rows with one id and piece number but different content stay
separate pieces.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import written

GROUP_PIECES = 20_000
#: A worker's memory of units is emptied when it holds this many.
UNITS_KEPT = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_OTHER_BLANK = re.compile(r"[^\S \n]")
_WORKER: dict[str, UnitEncoder] = {}


def _encoder(ranks_path: str, pattern: str) -> UnitEncoder:
    """This worker's encoder: it lives as long as the worker."""
    if ranks_path not in _WORKER:
        _WORKER[ranks_path] = UnitEncoder(ranks_path, pattern)
    return _WORKER[ranks_path]


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Id of each added token in the JSON file beside the rank file; none where there is no such file."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    found = [t for t in vocabulary["added_tokens"] if t["content"]]
    if vocabulary.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError(f"{path}: only added tokens that are matched as they stand are supported")
    return {t["content"]: t["id"] for t in found}


class UnitEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, with a bounded memory of units."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        for tok, rank in ranks.items():
            self.width[rank] = len(tok)
        self.units: dict[bytes, bytes] = {}
        added = added_tokens(ranks_path)
        self.added = {t: np.asarray([k], "<u4").tobytes() for t, k in added.items()}
        # where several begin at one place, the longest is meant
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def _direct(self, text: str) -> np.ndarray:
        return np.asarray(self.enc.encode_ordinary(text), "<u4")

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode the units as one text; no token crosses a unit's end, so byte counts cut the ids."""
        ids = self._direct(" " + b" ".join(fresh).decode())
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(u) + 1 for u in fresh])) + 1
        raw, at = ids.tobytes(), 0
        for u, end in zip(fresh, (4 * ends).tolist(), strict=True):
            self.units[u] = raw[at:end]
            at = end

    def __call__(self, text: str) -> bytes:
        if self.split is None or not any(t in text for t in self.added):
            return self._stretch(text)
        # the odd parts are added tokens
        return b"".join([self.added[part] if k % 2 else self._stretch(part) for k, part in enumerate(self.split.split(text)) if part])

    def _stretch(self, text: str) -> bytes:
        """Ids of text without added tokens."""
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_BLANK.search(text):
            return self._direct(text).tobytes()
        first, *rest = text.encode().split(b" ")
        units = self.units
        if fresh := list(set(rest).difference(units)):
            if len(units) > UNITS_KEPT:
                units.clear()
                fresh = list(set(rest))
            self._learn(fresh)
        return self._direct(first.decode()).tobytes() + b"".join([units[u] for u in rest])


def cut_pieces(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    end = np.asarray([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                first = len(ids) % step or step
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), step)], [*range(first, len(ids), step), len(ids)], strict=True)):
                    rows.append((doc, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length: it goes to the gap that leaves the squared counts of
    open sequences per gap smallest; of equal gaps the smallest, of equal sequences the newest."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences per residual gap; closed ones (gap 0) don't count
    count[0] = 0
    holding: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        # change of the sum when a gap g becomes g - n: 2 * (count[g-n] - count[g]) + 2, or without the
        # first part where the sequence is then full; a new sequence: 2 * count[capacity-n] + 1
        gaps = count[n:capacity]
        if gaps.any():
            change = 2 * (count[: capacity - n] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            fresh = 0 if n == capacity else 2 * count[capacity - n] + 1
            if change[best] <= fresh:
                gap = best + n
                k = holding[gap].pop()
                count[gap] -= 1
            else:
                gap, k, made = capacity, made, made + 1
        else:
            gap, k, made = capacity, made, made + 1
        seq[i], offset[i] = k, capacity - gap
        if gap > n:
            count[gap - n] += 1
            holding[gap - n].append(k)
    return seq, offset


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    pieces = written(pieces, "pack_pieces")
    groups = pieces.count() // GROUP_PIECES + 1
    first = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        pdf["_seq"], pdf["offset"] = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf

    filled = written(first.groupBy("_g").applyInPandas(fill, f"{PIECES}, _g int, _seq long, offset long"), "pack_filled")
    used = filled.groupBy("_g", "_seq").agg(F.sum("length").cast("long").alias("length"))
    again = used.where(F.col("length") < capacity)
    rounds = written(again.withColumn("_h", F.pmod(F.xxhash64("_g", "_seq"), F.lit(again.count() // GROUP_PIECES + 1)).cast("int")), "pack_open")

    def refill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_g", "_seq"], ascending=[False, True, True], kind="stable")
        pdf["_seq2"], pdf["_shift"] = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf[["_g", "_seq", "_h", "_seq2", "_shift"]]

    moved = rounds.groupBy("_h").applyInPandas(refill, "_g int, _seq long, _h int, _seq2 long, _shift long")
    placed = filled.join(moved, ["_g", "_seq"], "left")
    # full sequences get even numbers, those of the second round odd ones
    kept, met = F.shiftleft(F.col("_g").cast("long"), 32) + 2 * F.col("_seq"), F.shiftleft(F.col("_h").cast("long"), 32) + 2 * F.col("_seq2") + 1
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(F.col("_h").isNull(), kept).otherwise(met).alias("sequence_id"),
        (F.col("offset") + F.coalesce("_shift", F.lit(0))).cast("long").alias("offset"),
    )


def packed_sequences(packed: DataFrame) -> DataFrame:
    """Per sequence its pieces in order and its fill, for a writer of training batches."""
    piece = F.struct("offset", "doc_id", "piece", "start", "length")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("length").alias("used"))
