"""Operator 4, language ID by cross-parsing entropy.

Per language a suffix automaton of labelled text is built; it accepts exactly the substrings of that
text. A document is parsed against each: the longest substring of the language's text from the
current place is one phrase, and the next phrase begins where it ends. With c phrases over n
characters and m characters of labelled text, the estimate is c * log2(m) / n bits a character, and
the language with the smallest one wins (ties: the first by name).

Training text is a documented, bounded sample. Every language is learned. Of each, the ``SAMPLE_DOCS``
different labelled texts (those with a letter) with the smallest key hash share a budget of ``SAMPLE_CHARS`` characters (with
more than ``SAMPLE_ALL / SAMPLE_CHARS`` languages, an equal part of ``SAMPLE_ALL`` each): all give an equal
stretch at a place set by the hash, and what short texts leave over goes to the longer ones, so no text
is a language's whole model while others wait. Predictions read whole texts. The model is that text; each
worker builds the automata once. Many documents are parsed side by side with array operations, one
character a step; the last few long ones are finished one by one.

Characters: letters, lowered (where that gives several characters, the first); a run of anything
else is one gap. Every letter of the labelled text has a code of its own, whatever the script and
however many there are. Letters that the labelled text lacks match nothing and are a phrase each.
The automata's transitions are held sparsely, in one hash table for all languages.

Defined results: null text or a text without a letter is ``und`` with score 0; otherwise the score is
1 - best / second estimate (1 where one language is known, 0 where none is, with ``und``); repeated
rows get equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanfold.llm.common import fold, key_hash, written

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 60, 30_000, 7_680_000
#: The sample's rows (numbers only) go to every task up to this many, beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Parts of a language in which its first rows are looked for.
PARTS = 64
UNKNOWN = "und"
#: Documents are parsed side by side until fewer lanes than this are left.
LANES = 256
#: Characters parsed side by side at once.
TOGETHER = 1 << 25
_SPREAD = 0x9E3779B97F4A7C15
_TABLES: dict = {}


def training_rows(id_col: str = "doc_id", lang_col: str = "lang"):
    """The rows that may be learned from: a label, and not in the held-out fold."""
    return F.col(lang_col).isNotNull() & (fold(id_col, 4) != 2)


def train(docs: DataFrame, rows, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Labelled text per language from the rows of ``docs`` where ``rows`` holds."""
    text = F.col(text_col).cast("string")
    known = docs.where(rows & text.rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), key_hash(F.col(id_col)).alias("h"), F.xxhash64(text).alias("t"), text.alias("text"))
    # repeated rows are one text; only numbers are sorted here, first inside parts of a language, so that a frequent
    # language isn't one task's
    chosen = known.select("lang", "h", "t", F.length("text").alias("size")).distinct().withColumn("part", F.pmod("t", F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "t"))).where(F.col("n") <= SAMPLE_DOCS)
    chosen = written(chosen, "langid_choice")
    held = chosen.agg(F.count("*").alias("rows"), F.count_distinct("lang").alias("langs")).first()
    budget = max(1, min(SAMPLE_CHARS, SAMPLE_ALL // max(1, held["langs"])))
    # by length: a text's even part of what the shorter ones left; the first one longer than that sets the level for the rest
    whole, by_size = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("size", "n")
    left = budget - F.coalesce(F.sum("size").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    even = F.floor(left / (F.count("*").over(whole) - F.row_number().over(by_size) + 1))
    chosen = chosen.withColumn("even", even).withColumn("level", F.max(F.when(F.col("size") > F.col("even"), F.col("even"))).over(whole))
    chosen = chosen.withColumn("take", F.least("size", F.coalesce("level", "size")).cast("int")).where("take > 0")
    parts = chosen.select("lang", "h", "t", "n", "take", (F.pmod(F.col("h"), F.col("size") - F.col("take") + 1) + 1).cast("int").alias("at"))
    if held["rows"] <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    sample = known.join(parts, ["lang", "h", "t"]).select("lang", "n", F.substring("text", F.col("at"), F.col("take")).alias("text")).distinct()
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["n"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(t) for lang, t in sorted(texts.items())}


def _letters() -> np.ndarray:
    """Per code point: is it a letter?"""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _TABLES["letters"]


def _lowered() -> np.ndarray:
    """Per code point: the code point of its lower-case letter."""
    if "lowered" not in _TABLES:
        low = np.arange(sys.maxunicode + 1, dtype=np.int32)
        for c in np.flatnonzero(_letters()).tolist():
            low[c] = ord(chr(c).lower()[0])
        _TABLES["lowered"] = low
    return _TABLES["lowered"]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automata:
    """The languages' suffix automata in one hash table: ``to[slot]`` where ``keys[slot]`` is ``state * width + code``.

    A state number belongs to one language; 0 is none. Ways out of the start states are in ``again``."""

    def __init__(self, model: dict[str, str]):
        self.langs = list(model)
        letters, low = _letters(), _lowered()
        used = np.unique(np.concatenate([np.empty(0, np.int32), *[low[p[letters[p]]] for p in map(_points, model.values())]]))
        # codes: 0 a gap, 1.. the labelled text's letters, the last one any other letter
        self.width = len(used) + 2
        kind = np.min_scalar_type(self.width - 1)
        of_low = np.full(sys.maxunicode + 1, self.width - 1, kind)
        of_low[used] = np.arange(1, len(used) + 1)
        self.code = np.where(letters, of_low[low], kind.type(0))
        # where a new phrase leads
        self.again = np.zeros((len(model), self.width), np.int64)
        self.log_m, keys, to, at = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1
        for lang, text in enumerate(model.values()):
            codes = self.encode(text)
            edges = _suffix_automaton(codes.tolist())
            for c, s in edges[0].items():
                self.again[lang, c] = s + at
            keys.append(np.array([(s + at) * self.width + c for s, out in enumerate(edges) if s for c in out], np.int64))
            to.append(np.array([s + at for out in edges[1:] for s in out.values()], np.int64))
            self.log_m.append(np.log2(len(codes) + 2))
            at += len(edges)
        self._store(np.concatenate(keys), np.concatenate(to))

    def _store(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Fill the hash table: open addressing, at most a quarter full."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = 64 - bits, (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last one stays
            mine = self.keys[slot[rest]] == keys[rest]
            self.to[slot[rest[mine]]] = to[rest[mine]]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_SPREAD) >> np.uint64(self.shift)).view(np.int64)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The state that each ``state * width + code`` leads to, 0 where there is none."""
        slot = self._slots(keys)
        held = self.keys.take(slot)
        hit = held == keys
        out = self.to.take(slot) * hit
        rest = np.flatnonzero((held >= 0) > hit)
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.to[slot[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Codes of the text's characters, runs of gaps as one."""
        codes = self.code[_points(text)]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        return codes[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        langs, width, again = len(self.log_m), self.width, self.again
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[k]) for k in order])
        flat = np.concatenate([texts[k] for k in order]) if len(order) else np.empty(0, self.code.dtype)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(order) else np.empty(0, np.int64)
        # state 0 has no way out, so the character after it begins a phrase too
        state = np.zeros((langs, len(order)), np.int64)
        count = np.zeros((langs, len(order)), np.int64)
        active, t = len(order), 0
        while True:
            while active and lengths[active - 1] <= t:
                active -= 1
            if active * langs < LANES:
                break
            # every text that is at least as long as the shortest active one takes these steps
            for t in range(t, int(lengths[active - 1])):
                c = flat[start[:active] + t]
                now = self._next((state[:, :active] * width + c).ravel()).reshape(langs, active)
                miss = now == 0
                count[:, :active] += miss
                state[:, :active] = np.where(miss, again[:, c], now)
            t += 1
        keys, to, shift, mask, word = memoryview(self.keys), memoryview(self.to), self.shift, self.mask, (1 << 64) - 1
        for k in range(active):
            rest = flat[start[k] + t : start[k] + lengths[k]].tolist()
            for lang in range(langs):
                s, n, first = int(state[lang, k]), 0, again[lang].tolist()
                for c in rest:
                    key = s * width + c
                    slot = (key * _SPREAD & word) >> shift
                    while (held := keys[slot]) != key and held >= 0:
                        slot = (slot + 1) & mask
                    if held == key:
                        s = to[slot]
                    else:
                        n += 1
                        s = first[c]
                count[lang, k] += n
        out = np.empty((len(order), langs), np.int64)
        out[order] = count.T
        return out


def _suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of ``codes``; state 0 is its start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


def _automata(model: dict[str, str]) -> Automata:
    """This worker's automata of ``model``."""
    key = hash(tuple(model.items()))
    if _TABLES.get("key") != key:
        _TABLES.update(key=key, automata=Automata(model))
    return _TABLES["automata"]


def identify(column: pa.Array, model: dict[str, str]) -> tuple[list[str], list[float]]:
    """(language, score) of each text of an Arrow column."""
    auto, letters = _automata(model), _letters()
    langs, scores = [UNKNOWN] * len(column), [0.0] * len(column)
    rows: list[int] = []
    texts: list[np.ndarray] = []

    def parse() -> None:
        if not rows or not auto.langs:
            return
        bits = auto.phrases(texts) * np.array(auto.log_m) / np.array([max(1, len(t)) for t in texts])[:, None]
        best = bits.argmin(axis=1)
        ranked = np.sort(bits, axis=1)
        for k, row in enumerate(rows):
            langs[row] = auto.langs[best[k]]
            scores[row] = float(1 - ranked[k, 0] / ranked[k, 1]) if len(auto.langs) > 1 and ranked[k, 1] > 0 else 1.0
        rows.clear()
        texts.clear()

    size = 0
    for row, value in enumerate(column):
        text = value.as_py() or ""
        if not letters[_points(text)].any():
            continue
        if size and size + len(text) > TOGETHER:
            parse()
            size = 0
        rows.append(row)
        texts.append(auto.encode(text))
        size += len(text)
    parse()
    return langs, scores


def predict(docs: DataFrame, model: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = identify(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string"))
    return narrow.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict[str, str], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language, columns unchanged; row-local, nothing is shuffled. Only texts go to Python, and one flag a row
    comes back."""

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        return pa.array([lang != UNKNOWN for lang in identify(texts, model)[0]], pa.bool_())

    return docs.where(known(F.col(text_col).cast("string")))
