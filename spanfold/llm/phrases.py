"""Operator 11, phrase collocation mining with one FM-index per shard.

Texts are lowered (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``. Everything is per language. ``f`` of a phrase is the number of its contiguous occurrences
inside pieces, overlaps included; ``n`` is the number of words.

1. ``encode``: texts of one language become shards of about ``SHARD_WORDS`` words: the shard's distinct
   words with their counts, and its texts as numbers of words, 0 after each piece. A text longer than a
   shard is cut at piece ends. Word counts are summed over all shards.
2. ``FMIndex``: suffixes of a shard sorted as deep as the longest phrase, the last column (BWT), the places of
   each word in it, and the same for the shard read backwards. An interval of rows stands for a phrase;
   ``extend`` adds a word on the left or on the right to all phrases of one length at once and keeps both
   intervals in step. The interval's size is the count.
3. ``mine``: pairs of frequent words first; then phrases of three words up to ``longest`` whose pairs are all frequent,
   grown to the right and to the left in turn. Each shard reports counts, Spark sums them across shards and keeps those of
   ``least`` at least. A phrase is frequent only if its parts are, so nothing is lost.
   Most longer phrases are rare, so their counts are first summed into ``BITS`` counters shared by hash; a shard reports a
   phrase by name only if its counter reaches ``least``. What is frequent reaches the shards as tables of ``BITS`` bits, whose size
   doesn't grow with the input. A rare phrase that shares a bit or a counter is counted in vain and dropped by its sum: the
   counts stay exact. (With some 50 rare phrases a counter, about 3 * 10**9 words, the counters begin to save less; raise ``BITS``.)
4. ``score``: cutting a phrase after its first k words gives l, r and floor(1000 * a * n / (l * r)), in decimals of
   38 digits; the lowest cut counts (ties: smallest k). A phrase that a longer one holds as often is dropped: the
   counts of its one-word extensions to the left and right tell, as a longer phrase can't be more frequent than they.
   The first ``top`` of each language stay.

Words are told apart by 64-bit hashes within a language (with V words two share one with probability V**2 / 2**65).
Defined results: null text is empty, null language is ``und`` (together with a language of that name); repeated rows
count each; ties of score go by count, then by the phrase's bytes; a text of any length counts whole; extra columns
don't matter (only text and language are read); an empty table, or one without a frequent pair, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanfold.llm.common import written
from spanfold.llm.words import _LOWER_BYTE, STRETCH, cut_words, scramble, text_bytes

SHARD_WORDS = 1 << 21
BITS = 1 << 26
LONGEST, LEAST, TOP = 5, 100, 2000

_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IS_GAP = _ENDS_PIECE.copy()
_IS_GAP[[0x20, 0x09]] = True


def word_stretches(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """The words of the texts in stretches: (hashes, whether a piece begins at each word, lowered bytes, starts, ends).
    A long text comes in several stretches; a piece may go on from one to the next."""
    offsets, data = text_bytes(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + STRETCH, "right")) - 1))
        a, b = int(offsets[row]), int(offsets[last])
        open_piece = False  # whether the last piece of the stretch before may go on
        while a < b:
            cut = b if b - a <= 2 * STRETCH else a + STRETCH
            while cut < b:  # one long text: cut behind a gap
                gaps = np.flatnonzero(_IS_GAP[data[a:cut]])
                if len(gaps):
                    cut = a + int(gaps[-1]) + 1
                    break
                cut = min(cut + STRETCH, b)
            raw = data[a:cut]
            cuts = offsets[row : last + 1] - a
            cuts = cuts[(cuts >= 0) & (cuts <= len(raw))]
            hashes, start, end = cut_words(raw, cuts, _LOWER_BYTE, _IS_GAP)
            stops = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(_ENDS_PIECE[raw], out=stops[1:])
            if len(hashes):
                text = np.searchsorted(cuts, start, "right")
                begins = np.ones(len(hashes), bool)
                begins[1:] = (stops[start[1:]] > stops[end[:-1]]) | (text[1:] != text[:-1])
                begins[0] = not (open_piece and stops[start[0]] == 0)
                open_piece = stops[-1] == stops[end[-1]]
                yield hashes, begins, raw.tobytes().lower(), start, end
            else:
                open_piece = open_piece and stops[-1] == 0
            a = cut
        row = last


class _Pending:
    """Words of one language that wait for their shard."""

    def __init__(self):
        self.hashes, self.begins, self.words, self.size = [], [], {}, 0

    def add(self, hashes, begins, raw, start, end) -> None:
        distinct, first = np.unique(hashes, return_index=True)
        for h, a, b in zip(distinct.tolist(), start[first].tolist(), end[first].tolist()):
            if h not in self.words:
                self.words[h] = raw[a:b]
        self.hashes.append(hashes)
        self.begins.append(begins)
        self.size += len(hashes)

    def row(self, lang: str) -> dict:
        import xxhash

        hashes, begins = np.concatenate(self.hashes), np.concatenate(self.begins)
        keys, codes, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # small numbers for frequent words compress better
        number = np.empty(len(keys), np.int64)
        number[order] = np.arange(1, len(keys) + 1)
        seq = np.zeros(len(hashes) + int(begins.sum()), np.uint32)
        seq[np.arange(len(hashes)) + np.cumsum(begins)] = number[codes]
        planes = np.ascontiguousarray(seq.view(np.uint8).reshape(-1, 4).T).tobytes()
        keys = keys[order]
        own = scramble(keys ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))  # a word's key holds its language
        words = [self.words[h].decode() for h in keys.tolist()]
        return {"lang": lang, "n": len(hashes), "words": words, "keys": own.view(np.int64), "counts": counts[order], "seq": zstandard.compress(planes, 1)}


_SHARD = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("seq", pa.binary())])


def encode(docs: DataFrame, text_col: str, lang_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Shard rows of the documents; row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, _Pending] = {}

        def flush(lang: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([pending.pop(lang).row(lang)], _SHARD)

        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                texts = batch.column(1).filter(pc.equal(langs, lang))
                for stretch in word_stretches(texts):
                    if stretch[1][0]:  # a piece begins: nobody's piece is cut by a flush
                        if lang in pending and pending[lang].size >= shard_words:
                            yield flush(lang)
                        elif sum(p.size for p in pending.values()) >= 2 * shard_words:
                            yield flush(max(pending, key=lambda x: pending[x].size))
                    pending.setdefault(lang, _Pending()).add(*stretch)
        for lang in list(pending):
            yield flush(lang)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, n long, words array<string>, keys array<long>, counts array<long>, seq binary")


class FMIndex:
    """Index of a sequence of word numbers (0: gap) for phrases of up to ``depth`` words.

    ``lo[side]`` and ``size`` of each phrase are its interval: side 0 in the rows of the sequence read backwards (phrases grow
    to the right there), side 1 in the rows of the sequence itself (they grow to the left). Either index is built when first used.
    """

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq, self.depth = seq, depth
        self.count = np.bincount(seq, minlength=1)
        self.before = np.cumsum(self.count) - self.count
        self._sides: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def side(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(last column, sorted word * rows + row): the second one ranks a word up to any row by binary search."""
        if k not in self._sides:
            seq = self.seq if k else self.seq[::-1]
            rank, m = seq.astype(np.int64), 1
            while m < self.depth:
                _, rank = np.unique(rank * (rank.max() + 1) + np.roll(rank, -m), return_inverse=True)
                m *= 2
            rows = np.argsort(rank, kind="stable")
            last = seq[rows - 1].astype(np.int64)
            self._sides[k] = last, np.sort(last * len(seq) + np.arange(len(seq)))
        return self._sides[k]

    def words(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """All words as phrases: (numbers, [lo, lo], size)."""
        found = np.flatnonzero(self.count)
        found = found[found > 0]
        return found[:, None], [self.before[found], self.before[found]], self.count[found]

    def extend(self, phrases: np.ndarray, lo: list[np.ndarray], size: np.ndarray, left: bool):
        """Every phrase with every word that stands next to it on one side, with counts."""
        last, ranked = self.side(int(left))
        rows = len(self.seq)
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[int(left)][of]
        width = len(self.count)
        key, count = np.unique(of * width + last[at], return_counts=True)
        of, word = np.divmod(key, width)
        inside = np.cumsum(count) - count  # occurrences with a smaller word, all phrases together
        inside -= inside[np.searchsorted(of, of)]
        found = word > 0
        of, word, count, inside = of[found], word[found], count[found], inside[found]
        here, there = np.searchsorted(ranked, word * rows + lo[int(left)][of]), lo[1 - int(left)][of] + inside
        grown = np.concatenate([word[:, None], phrases[of]] if left else [phrases[of], word[:, None]], axis=1)
        return grown, [there, here] if left else [here, there], count


def _squeezed(seq: np.ndarray, joined: np.ndarray, least: int) -> np.ndarray:
    """The chains of at least ``least`` words, with a gap between them; ``joined[i]``: i and i + 1 are of one chain."""
    word = seq > 0
    begins = word & ~np.append(False, joined)
    chain = np.cumsum(begins)
    keep = word & (np.bincount(chain[word], minlength=len(begins) + 2)[chain] >= least)
    seq, begins = seq[keep], begins[keep]
    out = np.zeros(len(seq) + int(begins.sum()) + 1, np.int64)
    out[np.arange(len(seq)) + np.cumsum(begins)] = seq
    return out


def bit_table(keys: DataFrame, *names: str) -> bytes:
    """``BITS`` bits with those of the keys set. At most BITS / 64 rows come to the driver."""
    key = F.col(names[0])
    if len(names) > 1:
        key = key.bitwiseXOR(F.shiftrightunsigned(F.col(names[1]), 17))
    at = key.bitwiseAND(F.lit(BITS - 1))
    words = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    rows = words.toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return zstandard.compress(table.tobytes(), 1)


def _has(table: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Whether the bits of words' or pairs' keys are set."""
    key = first if second is None else first ^ (second >> np.uint64(17))
    at = key & np.uint64(len(table) * 64 - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _indexed(shards: DataFrame, words: bytes, pairs: bytes | None, longest: int, report, schema: str) -> DataFrame:
    """``report`` (an iterator of batches from an iterator of (language, word keys, index)) of every shard's index over its frequent
    words; given ``pairs``, over the chains of three words and more whose pairs are frequent."""
    told = shards.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, joint = [t and np.frombuffer(zstandard.decompress(t), np.uint64) for t in told.value]

        def indexes():
            for batch in batches:
                for k in range(batch.num_rows):
                    own, raw = batch.column(1)[k].values.to_numpy(), batch.column(2)[k].as_py()
                    keys = np.concatenate([[np.uint64(0)], own.view(np.uint64)])
                    seq = np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
                    frequent = _has(known, keys)
                    frequent[0] = False
                    seq = np.where(frequent[seq], seq, 0)
                    joined = (seq[:-1] > 0) & (seq[1:] > 0)
                    if joint is not None:
                        joined &= _has(joint, keys[seq[:-1]], keys[seq[1:]])
                    yield batch.column(0)[k].as_py(), keys, FMIndex(_squeezed(seq, joined, 2 if joint is None else 3), 2 if joint is None else longest)

        yield from report(indexes())

    return shards.select("lang", "keys", "seq").mapInArrow(run, schema)


def _grown(index: FMIndex, longest: int, keep=None):
    """Phrases of three words up to ``longest``, length by length, as (numbers, counts); those that ``keep`` refuses don't grow."""
    found = index.extend(*index.words(), left=False)
    for size in range(3, longest + 1):
        phrases, lo, count = index.extend(*found, left=size % 2 == 1)
        if keep is not None:
            stay = keep(phrases)
            phrases, lo, count = phrases[stay], [x[stay] for x in lo], count[stay]
        found = phrases, lo, count
        yield phrases, count


def _hashed(words: np.ndarray) -> np.ndarray:
    """One number per row of word keys."""
    out = np.full(len(words), words.shape[1], np.uint64)
    for column in words.T:
        out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def pair_counts(shards: DataFrame, words: bytes) -> DataFrame:
    """lang, first, second, f: each shard's pairs of frequent words."""

    def report(indexes) -> Iterator[pa.RecordBatch]:
        for lang, keys, index in indexes:
            pairs, _, count = index.extend(*index.words(), left=False)
            for a in range(0, len(count), 1 << 18):
                part = keys[pairs[a : a + (1 << 18)]].view(np.int64)
                said = pa.DictionaryArray.from_arrays(np.zeros(len(part), np.int32), [lang]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([said, pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(count[a : a + (1 << 18)].astype(np.int64))], names=["lang", "first", "second", "f"])

    return _indexed(shards, words, None, 2, report, "lang string, first long, second long, f long")


def phrase_table(shards: DataFrame, words: bytes, pairs: bytes, longest: int, least: int, bits: int) -> bytes:
    """Bit table of the longer phrases that may be frequent: those whose counter reaches ``least``. Phrases share ``bits`` counters
    by hash; a task reports what it adds to them, in blocks, as sorted places and counts."""
    block = min(1 << 20, bits)

    def blobs(places: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(places, np.arange(0, bits + 1, block))
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if b > a:
                both = np.concatenate([np.diff(places[a:b], prepend=k * block), counts[a:b]]).astype(np.uint32)
                planes = np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zstandard.compress(planes, 1)], pa.binary())], names=["block", "added"])

    def report(indexes) -> Iterator[pa.RecordBatch]:
        places, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, keys, index in indexes:
            for phrases, count in _grown(index, longest):
                at = (_hashed(keys[phrases]) & np.uint64(bits - 1)).astype(np.int64)
                places, where = np.unique(np.concatenate([places, at]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, count]), len(places)).astype(np.int64)
            if len(places) > 1 << 21:
                yield from blobs(places, counts)
                places, counts = places[:0], counts[:0]
        yield from blobs(places, counts)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both = np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
                places, counts = both.reshape(2, -1)
                sums.setdefault(k, np.zeros(block, np.int64))[np.cumsum(places)] += counts
        for k, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    added = _indexed(shards, words, pairs, longest, report, "block long, added binary")
    found = added.repartition("block").mapInArrow(total, "block long, bits binary").toArrow()
    table = np.zeros(bits // 8, np.uint8)
    for k, raw in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()):
        table[k * block // 8 : (k + 1) * block // 8] = np.frombuffer(raw, np.uint8)
    return zstandard.compress(table.tobytes(), 1)


def longer_counts(shards: DataFrame, words: bytes, pairs: bytes, phrases: bytes, longest: int) -> DataFrame:
    """lang, phrase (word keys), f: each shard's phrases of three words up to ``longest`` that are in the tables."""
    told = shards.sparkSession.sparkContext.broadcast(phrases)

    def report(indexes) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zstandard.decompress(told.value), np.uint64)
        for lang, keys, index in indexes:
            for found, count in _grown(index, longest, lambda p: _has(table, _hashed(keys[p]))):
                for a in range(0, len(count), 1 << 18):
                    part = keys[found[a : a + (1 << 18)]].view(np.int64)
                    said = pa.DictionaryArray.from_arrays(np.zeros(len(part), np.int32), [lang]).cast(pa.string())
                    ends = np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([said, pa.ListArray.from_arrays(ends, part.ravel()), pa.array(count[a : a + (1 << 18)].astype(np.int64))], names=["lang", "phrase", "f"])

    return _indexed(shards, words, pairs, longest, report, "lang string, phrase array<long>, f long")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, sizes), all written: frequent phrases of 1 to ``longest`` words (lang, phrase as word keys, f), frequent
    words (key, word), words of each language (lang, n)."""
    shards = written(encode(docs, text_col, lang_col, shard_words), "phrase_shards")
    sizes = written(shards.groupBy("lang").agg(F.sum("n").alias("n")), "phrase_sizes")
    each = shards.select("lang", F.explode(F.arrays_zip("words", "keys", "counts")).alias("w")).select("lang", "w.words", "w.keys", "w.counts")
    words = each.groupBy("lang", F.col("keys").alias("key"), F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    words = written(words, "phrase_words")
    known = bit_table(words, "key")
    pairs = pair_counts(shards, known).groupBy("lang", "first", "second").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    pairs = written(pairs, "phrase_pairs")
    joint = bit_table(pairs, "first", "second")
    likely = phrase_table(shards, known, joint, longest, least, BITS)
    longer = longer_counts(shards, known, joint, likely, longest).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases = words.select("lang", F.array("key").alias("phrase"), "f").unionByName(pairs.select("lang", F.array("first", "second").alias("phrase"), "f")).unionByName(longer)
    return written(phrases, "phrase_counts"), words.select("key", "word"), sizes


def _exact(name: str) -> str:
    return f"cast({name} as decimal(19, 0))"


def score(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score, left_kinds and right_kinds (frequent words next to it) of every frequent phrase of two
    words or more that no longer one holds as often."""
    size = F.size("phrase")
    several = phrases.where(size > 1)
    cut = several.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumn("head", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("tail", F.slice("phrase", F.col("k") + 1, size - F.col("k")))
    counts = phrases.select(F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cut = cut.join(counts.withColumnsRenamed({"part": "head", "part_f": "l"}), "head").join(counts.withColumnsRenamed({"part": "tail", "part_f": "r"}), "tail").join(sizes, "lang")
    cut = cut.withColumn("score", F.expr(f"({_exact('f')} * {_exact('n')} * 1000) div ({_exact('l')} * {_exact('r')})"))
    lowest = cut.groupBy("lang", "phrase", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    grown = phrases.where(size > 2).select("f", F.explode(F.array(F.struct(F.slice("phrase", F.lit(2), size - 1).alias("phrase"), F.lit(1).alias("left")), F.struct(F.slice("phrase", F.lit(1), size - 1).alias("phrase"), F.lit(0).alias("left")))).alias("g"))
    grown = grown.groupBy("g.phrase").agg(F.max("f").alias("most"), F.sum("g.left").alias("left_kinds"), F.sum(1 - F.col("g.left")).alias("right_kinds"))
    kept = lowest.join(grown, "phrase", "left").where(F.coalesce("most", F.lit(0)) < F.col("f"))
    none = F.lit(0).cast("long")
    return kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", F.coalesce("left_kinds", none).alias("left_kinds"), F.coalesce("right_kinds", none).alias("right_kinds"))


def spelled(scored: DataFrame, words: DataFrame) -> DataFrame:
    """``scored`` with its phrases as text."""
    each = scored.select("*", F.posexplode("phrase").alias("pos", "key")).join(words, "key")
    cols = [c for c in scored.columns if c != "phrase"]
    joined = each.groupBy("phrase", *cols).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return joined.select(F.array_join(F.transform("w", lambda w: w["word"]), " ").alias("phrase"), *cols)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's first ``top`` phrases by score, count, bytes: lang, rank, phrase, a, l, r, n, score, left_kinds, right_kinds."""
    phrases, words, sizes = mine(docs, text_col, lang_col, least, longest, shard_words)
    by = [F.col("score").desc(), F.col("a").desc()]
    first = score(phrases, sizes).withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top).drop("rank")
    told = written(spelled(first, words), "phrase_told")
    ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_kinds", "right_kinds")
