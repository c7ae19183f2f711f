"""Operator 2, LM scoring: a hidden Markov language model over word classes.

A text is the sequence of its lowered words and one end token. The model's states emit a word's
class (a hash of its last three bytes and its length up to four), and a class emits the word by its
training count c: (c + 0.1) / (C + 0.1 * (W + 1)), with C tokens and W distinct words of the class;
one share is left for unknown words of that class. So the model is a proper distribution over the
known words and one unknown word per class, its size is fixed, and its word counts follow the corpus.

1. ``encode`` turns stretches of documents into chunk rows: the distinct word hashes of the chunk
   (sorted), their counts in training documents and classes, and the texts as indexes into them.
2. ``count`` sends each chunk's hashes to shards by hash range (a chunk holds a word once, so no word
   is hot), sums counts over all chunks and returns them to the chunks.
3. ``train``: the states start from farthest-first texts, each chosen among all training texts (a
   pass in which every task proposes its text that the states so far fit worst); then
   Baum-Welch rounds over all training documents, each a pass in which every task adds up expected
   counts, summed over tasks by Spark (states x classes numbers): ``ROUNDS`` and more, up to
   ``START_ROUNDS`` more, while a round raises the mean log likelihood of a token by ``GAIN``.
   The counts are those of whole texts. To keep memory small and arrays wide, a text is laid out in
   runs of ``RUN`` tokens side by side: each run's products of transitions and emissions (states x
   states) give what is known before and after it, in one short pass over the runs each way; then
   forward and backward go through all runs at once, from those values at their borders.
4. ``score``: the scaled forward recursion over whole texts, exact for any length.

Words are told apart by 64-bit hashes (with V words two share one with probability V**2 / 2**65).

Defined results: null text is empty and has the end token only; repeated rows are scored and counted
each; with no training document every count is 0 and the base is log10 of the unknown word's share;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import written
from spanfold.llm.words import _BYTE, hashed_words, scramble, text_bytes

STATES, CLASSES, ROUNDS, RUN = 8, 4096, 2, 128
CHUNK_BYTES = 1 << 23
SHARD_KEYS = 2_000_000
START_ROUNDS, GAIN = 10, 0.01
#: Texts with fewer tokens start a state only where no text has as many.
SEED_TOKENS = 50
#: Weight, in tokens, of the overall class distribution in each state's emissions.
PRIOR = 200.0
ADD = 0.1
_CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, ends array<long>, codes binary, keys binary, train binary, classes binary, n_keys long, n_tokens long"


def held_out(doc_id: int | None, modulus: int = 10) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == 0


def _classes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of each word ``raw[start:end]``: its last three bytes (A-Z lowered) and its length up to four."""
    size = np.minimum(end - start, 4)
    lowered = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    mixed = size.astype(np.uint64)
    for back in (1, 2, 3):
        byte = np.where(end - back >= start, _BYTE[lowered[np.maximum(end - back, 0)]], np.uint64(0))
        mixed = scramble(mixed * np.uint64(31) + byte)
    return (mixed % np.uint64(CLASSES)).astype(np.uint16)


def _squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, place by place, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1) if len(a) else b""


def _expand(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _chunk_row(chunk: int, ids: list, part: pa.Array) -> dict:
    """One chunk of texts as a row."""
    offsets, data = text_bytes(part)
    raw = data[offsets[0] : offsets[-1]] if len(data) else np.empty(0, np.uint8)
    hashes, ends = [], []
    total = 0
    for _, h, bounds in hashed_words(part, lower=True):
        hashes.append(h)
        ends.extend((bounds[1:] + total).tolist())
        total += len(h)
    words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    keys, first, codes = np.unique(words, return_index=True, return_inverse=True)
    # where the words stand, for their classes
    start, end = word_spans(raw, offsets - offsets[0])
    classes = _classes(raw, start[first], end[first]) if len(words) else np.empty(0, np.uint16)
    held = [held_out(i) for i in ids]
    sizes = np.diff([0, *ends])
    train = np.bincount(codes, weights=np.repeat(~np.array(held, bool), sizes), minlength=len(keys)).astype(np.uint32)
    # small numbers for frequent words compress better
    rank = np.argsort(np.argsort(-np.bincount(codes, minlength=len(keys)), kind="stable"))
    order = np.argsort(rank)
    return {
        "chunk": chunk, "doc_ids": ids, "held": held, "ends": ends, "codes": _squeeze(rank[codes].astype(np.uint32)),
        "keys": _squeeze(keys), "train": _squeeze(train), "classes": _squeeze(np.concatenate([classes, order.astype(np.uint32).view(np.uint16)])),
        "n_keys": len(keys), "n_tokens": total,
    }


def word_spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of ``raw``; a word also ends at each of ``cuts``."""
    word = ~np.isin(raw, [0x20, *range(0x09, 0x0E)])
    joins = np.zeros(len(raw) + 1, bool)
    joins[1:-1] = word[1:] & word[:-1]
    joins[cuts] = False
    return np.flatnonzero(word & ~joins[:-1]), np.flatnonzero(word & ~joins[1:]) + 1


def encode(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunk rows of the documents; row-local."""
    kinds = {"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "ends": pa.list_(pa.int64()), "codes": pa.binary(), "keys": pa.binary(), "train": pa.binary(), "classes": pa.binary(), "n_keys": pa.int64(), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 24
        for batch in batches:
            offsets, _ = text_bytes(batch.column(1))
            row = 0
            while row < batch.num_rows:
                last = min(batch.num_rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1))
                found = _chunk_row(made, batch.column(0).slice(row, last - row).to_pylist(), batch.column(1).slice(row, last - row))
                yield pa.RecordBatch.from_arrays([pa.array([found[k]], t) for k, t in kinds.items()], names=list(kinds))
                row, made = last, made + 1

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _CHUNK)


def unpack(codes: bytes, classes: bytes, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into the sorted keys per token, class per key, class per token)."""
    both = _expand(classes, np.uint16)
    per_key, order = both[:n_keys], both[n_keys:].view(np.uint32)
    at = order[_expand(codes, np.uint32)] if n_keys else np.empty(0, np.uint32)
    return at, per_key, per_key[at]


def count(chunks: DataFrame) -> DataFrame:
    """``chunk, shard, counts, class_tokens, class_words``: per chunk and shard the training counts of
    the chunk's words; rows with chunk -1 hold the shard's tokens and distinct words per class."""
    shards = (chunks.agg(F.sum("n_keys")).first()[0] or 0) // SHARD_KEYS + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)
        for batch in batches:
            for r in batch.to_pylist():
                keys, train = _expand(r["keys"], np.uint64), _expand(r["train"], np.uint32)
                classes = _expand(r["classes"], np.uint16)[: len(keys)]
                at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                cut = [[x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for x in (keys, train, classes)]
                yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int64()), pa.array([r["chunk"]] * shards, pa.int64()), *[pa.array(c, pa.binary()) for c in cut]], names=["shard", "chunk", "keys", "train", "classes"])

    def add(t: pa.Table) -> pa.Table:
        parts = [[np.frombuffer(v.as_buffer(), kind) for v in t.column(name)] for name, kind in (("keys", np.uint64), ("train", np.uint32), ("classes", np.uint16))]
        keys, train, classes = (np.concatenate(p) for p in parts)
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(place, weights=train, minlength=len(distinct)).astype(np.int64)
        known = total > 0
        by_class = [np.bincount(classes[first], weights=w, minlength=CLASSES).astype(np.int64) for w in (total, known)]
        counts = np.split(total[place], np.cumsum([len(p) for p in parts[0]])[:-1])
        n, shard = t.num_rows, t.column("shard")[0].as_py()
        none = [None] * n
        return pa.table({
            "chunk": pa.array([*t.column("chunk").to_pylist(), -1], pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int64()),
            "counts": pa.array([*[c.tobytes() for c in counts], None], pa.binary()),
            "class_tokens": pa.array([*none, by_class[0]], pa.list_(pa.int64())), "class_words": pa.array([*none, by_class[1]], pa.list_(pa.int64())),
        })

    dealt = chunks.select("chunk", "keys", "train", "classes").mapInArrow(deal, "shard long, chunk long, keys binary, train binary, classes binary")
    return dealt.groupBy("shard").applyInArrow(add, "chunk long, shard long, counts binary, class_tokens array<long>, class_words array<long>")


class Model:
    """Start, transition and emission probabilities; the last class is the end token."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def expected(model: Model, runs: np.ndarray, lengths: np.ndarray, enter: np.ndarray | None = None, after: np.ndarray | None = None, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected start, transition and emission counts of token runs (rows, padded), and their log likelihood.

    A run is a whole text unless said otherwise, per run: ``enter``, the states' probabilities at its first token
    given what came before; ``before``, those at the token before it (zeros where a text begins); ``after``, the
    likelihood of what follows it by the state of its last token (up to a factor)."""
    n, steps = runs.shape
    k = len(model.start)
    emit, ones = np.ascontiguousarray(model.emit.T)[runs.T], np.ones(k)
    alpha, scale = np.empty((steps, n, k)), np.empty((steps, n))
    whole = int(lengths.min())  # up to here every run has a token
    for t in range(steps):
        np.multiply(alpha[t - 1] @ model.move if t else model.start if enter is None else enter, emit[t], out=alpha[t])
        scale[t] = alpha[t] @ ones
        if t >= whole:
            scale[t, lengths <= t] = 1.0
            alpha[t, lengths <= t] = 0.0
        alpha[t] *= (1.0 / scale[t])[:, None]
    last = np.ones((n, k))
    if after is not None:  # scaled as beta is: the posterior of the last token adds up to 1
        last = after / np.einsum("nk,nk->n", alpha[lengths - 1, np.arange(n)], after)[:, None]
    moves, beta = np.zeros((k, k)), last.copy()
    first = np.ones(n, bool) if before is None else ~before.any(axis=1)
    for t in range(steps - 1, -1, -1):
        if t or before is not None:
            ahead = emit[t] * beta
            ahead *= (1.0 / scale[t])[:, None]
            if t >= whole:
                ahead[lengths <= t] = 0.0
            moves += ((alpha[t - 1] if t else before).T @ ahead) * model.move
        alpha[t] *= beta  # now the posterior; zero where the run is over
        if t:
            beta = ahead @ model.move.T
            if t >= whole:
                beta[lengths <= t] = last[lengths <= t]
    at, emits = runs.T.ravel(), np.empty((k, model.emit.shape[1]))
    for j in range(k):
        emits[j] = np.bincount(at, weights=alpha[:, :, j].ravel(), minlength=emits.shape[1])
    return alpha[0][first].sum(axis=0), moves, emits, float(np.log(scale).sum())


def transfers(model: Model, runs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per run (rows, padded) the weights from the state of its first token to that of its last, over all its tokens,
    up to a factor per run."""
    n, steps = runs.shape
    k = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)[runs.T]
    out = np.eye(k) * emit[0][:, :, None]
    for t in range(1, steps):
        now = (out.reshape(n * k, k) @ model.move).reshape(n, k, k)
        now *= emit[t][:, None, :]
        if t % 8 == 0:
            now /= now.sum(axis=(1, 2), keepdims=True)
        over = lengths <= t
        if over.any():
            now[over] = out[over]
        out = now
    return out / out.sum(axis=(1, 2), keepdims=True)


def borders(model: Model, products: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(enter, after, before) of ``expected`` for each run. ``products``: the runs' ``transfers``, text by text;
    ``texts``: the runs of each text. All texts take their steps side by side."""
    k = len(model.start)
    order = np.argsort(-texts, kind="stable")
    base, size = (np.cumsum(texts) - texts)[order], texts[order]
    enter, before, after = np.tile(model.start, (len(products), 1)), np.zeros((len(products), k)), np.ones((len(products), k))
    for r in range(1, int(size[0]) if len(size) else 0):
        at = base[: np.searchsorted(-size, -r)] + r
        seen = np.einsum("nk,nkj->nj", enter[at - 1], products[at - 1])
        before[at] = seen / seen.sum(axis=1, keepdims=True)
        enter[at] = before[at] @ model.move
    for r in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
        at = base[: np.searchsorted(-size, -r)] + r
        follows = np.einsum("nkj,nj->nk", products[at], after[at]) @ model.move.T
        after[at - 1] = follows / follows.sum(axis=1, keepdims=True)
    return enter, after, before


def expected_of_texts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``expected`` of whole sequences of any length."""
    k = len(model.start)
    starts, moves, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), 0.0
    short = [s for s in sequences if len(s) <= RUN]
    long = [s for s in sequences if len(s) > RUN]
    runs = [s[a : a + RUN] for s in long for a in range(0, len(s), RUN)]
    products = np.empty((len(runs), k, k))
    for rows, padded, lengths in _blocks(runs):
        products[rows] = transfers(model, padded, lengths)
    enter, after, before = borders(model, products, np.array([-(-len(s) // RUN) for s in long], np.int64))
    found = [expected(model, padded, lengths) for _, padded, lengths in _blocks(short)]
    found += [expected(model, padded, lengths, enter[rows], after[rows], before[rows]) for rows, padded, lengths in _blocks(runs)]
    for s, m, e, part in found:
        starts += s
        moves += m
        emits += e
        log += part
    return starts, moves, emits, log


def reestimate(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
    """The model of expected counts, smoothed by the overall class shares."""
    k = len(starts)
    start, move = starts + 1.0, moves + np.eye(k) + 0.1
    emit = emits + PRIOR * share
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _blocks(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, padded rows, lengths) of the parts, shortest first, some at a time."""
    order = np.argsort([len(p) for p in parts], kind="stable")
    for a in range(0, len(parts), 1024):
        rows = order[a : a + 1024]
        lengths = np.array([len(parts[r]) for r in rows])
        padded = np.zeros((len(rows), int(lengths.max())), np.int64)
        for row, r in zip(padded, rows, strict=True):
            row[: len(parts[r])] = parts[r]
        yield rows, padded, lengths


def worst_fit(sequences: list[np.ndarray], ids: list[int], logs: np.ndarray) -> tuple[tuple, int] | None:
    """(key, place) of the sequence that the states so far (rows of ``logs``: log weights of the classes) fit worst, by
    the best state's mean weight of a token; sequences of ``SEED_TOKENS`` come before shorter ones, then the smaller id."""
    if not sequences:
        return None
    sizes = np.array([len(s) for s in sequences])
    flat, first = np.concatenate(sequences), np.cumsum(sizes) - sizes
    fit = np.full(len(sizes), -np.inf) if len(logs) else np.zeros(len(sizes))
    for row in logs:
        fit = np.maximum(fit, np.add.reduceat(row[flat], first) / sizes)
    fit, short = np.round(fit, 9), sizes < SEED_TOKENS
    k = int(np.lexsort((ids, fit, short))[0])
    return (bool(short[k]), float(fit[k]), int(ids[k])), k


def first_model(texts: DataFrame, share: np.ndarray) -> Model:
    """Start values: each state's emissions from a seed text, the farthest from the states before it of all training texts."""
    emit = np.tile(share, (STATES, 1))

    def propose(logs: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                for r in batch.to_pylist():
                    sequences = _training(r)
                    ids = [i or 0 for i, held in zip(r["doc_ids"], r["held"], strict=True) if not held]
                    found = worst_fit(sequences, ids, logs)
                    if found and (best is None or found[0] < best[0]):
                        best = found[0], np.bincount(sequences[found[1]], minlength=CLASSES + 1)
            if best:
                (short, fit, one), counts = best
                yield pa.RecordBatch.from_arrays([pa.array([short]), pa.array([fit]), pa.array([one], pa.int64()), pa.array([counts], pa.list_(pa.int64()))], names=["short", "fit", "id", "counts"])

        return run

    for k in range(STATES):
        proposed = texts.mapInArrow(propose(np.log(emit[:k])), "short boolean, fit double, id long, counts array<long>")
        seed = proposed.agg(F.min(F.struct("short", "fit", "id", "counts")).alias("s")).first()["s"]
        if seed is None:  # no training text
            break
        emit[k] = np.array(seed["counts"]) + 20.0 * share
        emit[k] /= emit[k].sum()
    near = np.full((STATES, STATES), 0.05 / max(1, STATES - 1)) + (0.95 - 0.05 / max(1, STATES - 1)) * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), near / near.sum(axis=1, keepdims=True), emit)


def _training(r: dict) -> list[np.ndarray]:
    """Class sequences, each with its end, of a chunk row's training texts."""
    _, _, per_token = unpack(r["codes"], r["classes"], r["n_keys"])
    out, a = [], 0
    for end, held in zip(r["ends"], r["held"], strict=True):
        if not held:
            out.append(np.append(per_token[a:end], CLASSES).astype(np.int64))
        a = end
    return out


_TEXTS = ("doc_ids", "held", "ends", "codes", "classes", "n_keys")


def train(chunks: DataFrame, share: np.ndarray) -> Model:
    """The model after Baum-Welch rounds over all training texts (how many: see above)."""

    def collect(model: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES + 1)), np.zeros(1)]
            for batch in batches:
                for r in batch.to_pylist():
                    *parts, log = expected_of_texts(model, _training(r))
                    for total, part in zip(sums, (*parts, log), strict=True):
                        total += part
            flat = np.concatenate([s.ravel() for s in sums])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.float64())], names=["at", "n"])

        return run

    texts = chunks.select(*_TEXTS)
    model = first_model(texts, share)
    last = -np.inf
    for done in range(START_ROUNDS + ROUNDS):
        rows = texts.mapInArrow(collect(model), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        flat = np.zeros(STATES + STATES * STATES + STATES * (CLASSES + 1) + 1)
        flat[[r["at"] for r in rows]] = [round(r["n"], 6) for r in rows]
        a, b = STATES, STATES + STATES * STATES
        emits = flat[b:-1].reshape(STATES, -1)
        model = reestimate(flat[:a], flat[a:b].reshape(STATES, STATES), emits, share)
        mean = flat[-1] / max(1.0, emits.sum())  # of the model that this round began with
        if done + 1 >= ROUNDS and mean - last < GAIN:
            break
        last = mean
    return model


def forward(model: Model, emit: np.ndarray, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each whole sequence; ``emit``: weight per class (rows) and state."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[k]) for k in order])
    flat = np.concatenate([sequences[k] for k in order])
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    logs = np.zeros(len(order))
    alpha = model.start * np.ones((len(order), 1)) * emit[flat[at]]
    active = len(order)
    for t in range(1, int(lengths[0])):
        while lengths[active - 1] <= t:
            active -= 1
        now = (alpha[:active] @ model.move) * emit[flat[at[:active] + t]]
        if t % 8 == 0:
            s = now.sum(axis=1)
            now /= s[:, None]
            logs[:active] += np.log(s)
        alpha[:active] = now
    out = np.empty(len(order))
    out[order] = logs + np.log(alpha.sum(axis=1))
    return out


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    chunks = written(encode(docs, id_col, text_col), "lm_chunks")
    counts = written(count(chunks), "lm_counts")
    by_class = counts.where("chunk = -1").select(F.posexplode(F.arrays_zip("class_tokens", "class_words")).alias("c", "x"))
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class.groupBy("c").agg(F.sum("x.class_tokens").alias("t"), F.sum("x.class_words").alias("w")).collect():
        tokens[r["c"]], words[r["c"]] = r["t"], r["w"]
    ends = int(chunks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0)
    n, v = int(tokens.sum()) + ends, int(words.sum()) + (ends > 0)
    mass = np.append(tokens + ADD * (words + 1), ends + 2 * ADD)
    model = train(chunks, mass / mass.sum())
    emit = np.ascontiguousarray((model.emit / mass).T)
    end_log, log_all = np.log10(ends + ADD), np.log10(n + ADD * (v + 1))

    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        slices = [r for r in found.to_pylist() if r["counts"] is not None]
        c = np.frombuffer(b"".join(r["counts"] for r in sorted(slices, key=lambda r: r["shard"])), np.int64)
        log_c = np.log10(c + ADD)
        for r in texts.to_pylist():
            at, _, classes = unpack(r["codes"], r["classes"], r["n_keys"])
            ends_at = np.array(r["ends"], np.int64)
            sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (log_c, c > 0)] if len(at) else [np.zeros(1), np.zeros(1, np.int64)]
            first = np.concatenate([[0], ends_at[:-1]])
            plain, known = (s[ends_at] - s[first] for s in sums)
            size = ends_at - first + 1
            logs = forward(model, emit, [np.append(classes[a:b], CLASSES).astype(np.int64) for a, b in zip(first, ends_at, strict=True)]) / np.log(10)
            plain = plain + end_log
            out += zip(r["doc_ids"], r["held"], size.tolist(), (known + (ends > 0)).tolist(), (plain - size * log_all).tolist(), (plain + logs).tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[id_col, "held_out", "n_tokens", "n_known", "base_score", "score"])

    back = counts.where("chunk >= 0").select("chunk", "shard", "counts").groupBy("chunk")
    scored = chunks.select("chunk", *_TEXTS).groupBy("chunk").cogroup(back).applyInArrow(run, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(id_col, "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
