"""Work inside one document without a shuffle.

A row-local tokenizer leaves the tokens of a document together and in order inside one partition.
The functions here read that stream in Arrow batches and keep no more than the document at hand, so
neither texts nor tokens cross the network. They must directly follow ``tokenize_offsets`` (row-local)
and row-wise steps; after a shuffle use the window forms (``candidates.window_top``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_START = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("tok", T.LongType()), T.StructField("logit", T.DoubleType()),
                       T.StructField("char", T.LongType()), T.StructField("cum", T.DoubleType()), T.StructField("val", T.DoubleType())])
_END = T.StructType(_START.fields[:-1])
_VALUES = ("tok_idx", "start", "end", "start_logit", "end_logit", "logit1")


def _key_changes(batch, n_keys: int):
    """Places of a record batch where a key isn't that of the row before (nulls are alike)."""
    import numpy as np
    import pyarrow.compute as pc

    changes = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in range(n_keys):
        here, before = batch.column(k).slice(1), batch.column(k).slice(0, max(batch.num_rows - 1, 0))
        differs = pc.fill_null(pc.not_equal(here, before), False)
        changes |= pc.or_(differs, pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)
    return 1 + np.flatnonzero(changes)


def whole_documents(batches: Iterator, n_keys: int, by_key: bool = False) -> Iterator:
    """Record batches cut anew so that no document spans two: what a batch leaves open is carried on.

    A document ends where ``tok_idx`` (the column after the keys) doesn't go on by one, or a key differs;
    with ``by_key`` only where a key differs."""
    import numpy as np
    import pyarrow as pa

    open_parts = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        idx = batch.column(n_keys).to_numpy(zero_copy_only=False)
        keys = tuple(batch.column(k)[0].as_py() for k in range(n_keys))
        goes_on = last is not None and (by_key or idx[0] == last[1] + 1) and keys == last[0]
        # tok_idx starts at 0 in every document, so each later document of the batch begins at a 0
        begins = _key_changes(batch, n_keys) if by_key else 1 + np.flatnonzero(idx[1:] == 0)
        if not goes_on and open_parts:
            yield pa.Table.from_batches(open_parts).combine_chunks()
            open_parts = []
        cut = int(begins[-1]) if len(begins) else 0
        if cut:
            open_parts.append(batch.slice(0, cut))
            yield pa.Table.from_batches(open_parts).combine_chunks()
            open_parts = [batch.slice(cut)]
        else:
            open_parts.append(batch)
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(n_keys)), idx[-1]
    if open_parts:
        yield pa.Table.from_batches(open_parts).combine_chunks()


def one_row_a_token(batches: Iterator, n_keys: int) -> Iterator:
    """Token batches of documents in order, those of the same keys (nulls alike) next to each other, as one row
    per key and ``tok_idx``: the first text's that has it, with the sum of the texts' ``covered``. A task holds a
    batch and the longest text of one key, however many texts share it."""
    import numpy as np
    import pyarrow as pa

    def merged(parts):
        """The texts of one key as one table."""
        table = pa.Table.from_batches(parts)
        idx = table.column("tok_idx").to_numpy()
        if len(idx) > 1 + idx.max():
            number, first = np.unique(idx, return_index=True)
            total = np.bincount(idx, weights=table.column("covered").to_numpy()).astype(np.int64)
            table = table.take(pa.array(first))
            changed = {"covered": pa.array(total[number])}
            if "prev_tok" in table.column_names:  # the neighbours are those of the rows that stay
                tok, n = table.column("tok").combine_chunks(), len(number)
                changed |= {c: tok.take(pa.array(np.arange(n) + by, mask=np.arange(n) == end)) for c, by, end in (("prev_tok", -1, 0), ("next_tok", 1, n - 1))}
            for name, column in changed.items():
                table = table.set_column(table.column_names.index(name), name, column)
        return table.combine_chunks().to_batches(max_chunksize=1 << 14)

    held, key, size, longest = [], None, 0, 1
    for batch in batches:
        if batch.num_rows == 0:
            continue
        begins = np.r_[0, _key_changes(batch, n_keys)]
        idx = batch.column(batch.schema.get_field_index("tok_idx")).to_numpy()
        first_key = tuple(batch.column(k)[0].as_py() for k in range(n_keys))
        if held and first_key != key:
            yield from merged(held)
            held, size, longest = [], 0, 1
        # keys that end in this batch and have one text go on as they are
        ends = np.r_[begins[1:], batch.num_rows]
        again = np.add.reduceat(idx == 0, begins) > 1
        again[-1] = True
        if held:
            again[0] = True
        done = 0
        for g in np.flatnonzero(again):
            if begins[g] > done:
                yield batch.slice(done, begins[g] - done)
            part = batch.slice(begins[g], ends[g] - begins[g])
            done = ends[g]
            held.append(part)
            size, longest = size + part.num_rows, max(longest, 1 + int(idx[begins[g] : ends[g]].max()))
            if g < len(begins) - 1:
                yield from merged(held)
                held, size, longest = [], 0, 1
        key = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(n_keys))
        if size > 2 * longest + batch.num_rows:
            held = merged(held)
            size = sum(p.num_rows for p in held)
    if held:
        yield from merged(held)


def window_top(token_scores: DataFrame, max_length: int = 384, stride: int = 128, n_best: int = 20, keys=("doc_id",), by_key: bool = False,
               summary: bool = False) -> DataFrame:
    """One row per overlapping window with its best starts and ends, exactly as ``candidates.window_top``
    of ``tokens.window_tokens`` gives them, for scores in document order (see the module; no nulls).

    ``by_key``: rows of equal keys (nulls alike) lie next to each other and are one document, as in the window
    form, where texts that share an id share its windows; null logits come last. A task holds the scores of one
    id at a time.

    ``summary`` adds the window's ``n_tokens``, ``mean_start``, ``mean_end`` (of the logits) and ``answered``: 1 if its last
    token with ``is_end`` isn't before its first with ``is_start``, else 0 (null where ``token_scores`` has no flags)."""
    import numpy as np
    import pyarrow as pa

    keys = list(keys)
    step, n_keys = max_length - stride, len(keys)
    fields = [token_scores.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("window_id", T.LongType()), T.StructField("starts", T.ArrayType(_START)), T.StructField("ends", T.ArrayType(_END))])
    flags = [c for c in ("is_start", "is_end") if c in token_scores.columns] if summary else []
    if summary:
        kinds = [("n_tokens", T.LongType()), ("mean_start", T.DoubleType()), ("mean_end", T.DoubleType()), ("answered", T.IntegerType())]
        schema = T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in kinds]])

    def best(logits):
        """Places of the ``n_best`` highest logits of one window, best first (ties: later token first)."""
        if len(logits) <= n_best:
            near = np.arange(len(logits))
        else:  # nothing below the n_best-th highest value counts
            near = np.flatnonzero(logits >= np.partition(logits, len(logits) - n_best)[len(logits) - n_best])
        return near[np.lexsort((-near, -logits[near]))[:n_best]]

    def lists(places, sums, columns, struct):
        """One list of structs per window: rank, then the columns at its places, the window's running sum among them."""
        sizes = np.fromiter((len(p) for p in places), dtype=np.int64, count=len(places))
        at = np.concatenate(places)
        rank = 1 + np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        values = {"rank": rank.astype(np.int32), "cum": np.concatenate(sums), **{name: c[at] for name, c in columns.items()}}
        packed = pa.StructArray.from_arrays([pa.array(values[n]) for n in struct.names], names=struct.names)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], type=pa.int32()), packed)

    def windows(batches):
        for table in whole_documents(batches, n_keys, by_key):
            idx, start, end, s_logit, e_logit, logit = (table.column(c).to_numpy() for c in _VALUES)
            borders = [table.column(c).to_numpy() for c in flags]
            ranked = s_logit, e_logit
            first = np.r_[0, _key_changes(table.to_batches()[0], n_keys)] if by_key else np.flatnonzero(idx == 0)
            size = np.diff(np.r_[first, len(idx)])
            n_windows = 1 + np.maximum(0, -(-(size - max_length) // step))
            doc = np.repeat(np.arange(len(first)), n_windows)
            window = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            if by_key:
                # texts of one id: their tokens by number, and windows by number, not by place
                owner, beyond = np.repeat(np.arange(len(first)), size), int(idx.max()) + 1
                order = np.lexsort((idx, owner))
                idx, start, end, s_logit, e_logit, logit, *borders = (v[order] for v in (idx, start, end, s_logit, e_logit, logit, *borders))
                ranked = [np.where(np.isnan(v), -np.inf, v) for v in (s_logit, e_logit)]
                place = owner * beyond + idx
                lo = np.searchsorted(place, doc * beyond + np.minimum(window * step, beyond))
                hi = np.searchsorted(place, doc * beyond + np.minimum(window * step + max_length, beyond))
                doc, window, lo, hi = (v[hi > lo] for v in (doc, window, lo, hi))
            else:
                lo = first[doc] + window * step
                hi = np.minimum(lo + max_length, (first + size)[doc])
            at, sums = ([], []), ([], [])
            for a, b in zip(lo, hi):
                cum = np.cumsum(logit[a:b])
                for k, logits in enumerate(ranked):
                    near = best(logits[a:b])
                    at[k].append(a + near)
                    sums[k].append(cum[near])
            out = [table.column(k).take(pa.array(first[doc])).combine_chunks() for k in range(n_keys)]
            out.append(pa.array(window, type=pa.int64()))
            out.append(lists(at[0], sums[0], {"tok": idx, "logit": s_logit, "char": start, "val": logit}, _START))
            out.append(lists(at[1], sums[1], {"tok": idx, "logit": e_logit, "char": end}, _END))
            if summary:
                out.append(pa.array(hi - lo))
                out += [pa.array(np.array([v[a:b].mean() for a, b in zip(lo, hi)], np.float64)) for v in (s_logit, e_logit)]
                held = [None] * len(lo)
                if flags:
                    opens, closes = (np.flatnonzero(b == 1) for b in borders)
                    first_open, last_close = np.searchsorted(opens, lo), np.searchsorted(closes, hi) - 1
                    some = (first_open < len(opens)) & (last_close >= 0)
                    a, b = np.append(opens, 0)[first_open], np.append(closes, 0)[last_close]
                    held = (some & (a < hi) & (b >= lo) & (idx[b] >= idx[a])).astype(np.int32)
                out.append(pa.array(held, pa.int32()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return token_scores.select(*keys, *_VALUES, *flags).mapInArrow(windows, schema)


def document_sum(words: DataFrame, value: str, name: str, keys=("doc_id",)) -> DataFrame:
    """``words`` (in document order, see the module) with the sum of the double ``value`` over the row's
    document as ``name``; null values count as 0."""
    import numpy as np
    import pyarrow as pa

    keys = list(keys)
    rows = words.select(*keys, "tok_idx", *[c for c in words.columns if c not in (*keys, "tok_idx")])
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def sums(batches):
        for table in whole_documents(batches, len(keys)):
            first = np.flatnonzero(table.column("tok_idx").to_numpy() == 0)
            values = np.nan_to_num(table.column(value).to_numpy().astype(np.float64))
            size = np.diff(np.r_[first, len(values)])
            total = pa.array(np.repeat(np.add.reduceat(values, first), size))
            yield from table.append_column(name, total).to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(sums, schema).select(*words.columns, name)


def _by_key(batches: Iterator, n_keys: int, *order: str) -> Iterator:
    """(table, first row of each key) of rows whose equal keys (nulls alike) lie next to each other, those of a key
    sorted by the columns ``order``. A task holds the rows of one key at a time."""
    import numpy as np
    import pyarrow as pa

    for table in whole_documents(batches, n_keys, by_key=True):
        begins = np.r_[0, _key_changes(table.to_batches()[0], n_keys)]
        columns = [table.column(c).to_numpy() for c in order]
        if np.all([c == 0 for c in columns], axis=0).sum() > len(begins):  # several texts of a key
            owner = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, table.num_rows]))
            table = table.take(pa.array(np.lexsort((*reversed(columns), owner)))).combine_chunks()
        yield table, begins


def single_space(words: DataFrame, keys=("doc_id",)) -> DataFrame:
    """``(keys..., tok_idx, tok, ss_start, _len)`` of ``words`` in document order (see the module), those of the same keys next
    to each other: the word's offset in the words joined by single spaces and the length of all of them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = words.select(*keys, "tok_idx", "tok")
    schema = T.StructType([*rows.schema.fields, T.StructField("ss_start", T.LongType()), T.StructField("_len", T.LongType())])

    def offsets(batches):
        for table, begins in _by_key(batches, len(keys), "tok_idx"):
            ends = np.cumsum(pc.utf8_length(table.column("tok")).to_numpy().astype(np.int64) + 1)
            before = np.append(0, ends)
            last = np.r_[begins[1:], table.num_rows]
            size = last - begins
            out = table.append_column("ss_start", pa.array(before[:-1] - np.repeat(before[begins], size)))
            out = out.append_column("_len", pa.array(np.repeat(before[last] - before[begins] - 1, size)))
            yield from out.to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(offsets, schema)


def piece_words(pieces: DataFrame, keys=("doc_id",)) -> DataFrame:
    """``(keys..., word_idx, start, end, weight)``, exactly as ``attribution.words_from_pieces`` gives them, of ``pieces`` in
    document order (see the module), those of the same keys next to each other."""
    import numpy as np
    import pyarrow as pa

    keys = list(keys)
    rows = pieces.select(*keys, "tok_idx", "piece_idx", "start", "end", F.col("weight").cast("double").alias("weight"), F.col("word_start").cast("boolean").alias("word_start"))
    names = [("word_idx", T.LongType()), ("start", T.LongType()), ("end", T.LongType()), ("weight", T.DoubleType())]
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, t) for n, t in names]])

    def summed(batches):
        for table, begins in _by_key(batches, len(keys), "tok_idx", "piece_idx"):
            start, end, raw, opens = (table.column(c).to_numpy() for c in ("start", "end", "weight", "word_start"))
            word = np.cumsum(opens.astype(np.int64))
            size = np.diff(np.r_[begins, table.num_rows])
            word -= np.repeat(word[begins] - opens[begins], size) + 1  # counts anew in each key
            owner = np.repeat(np.arange(len(begins)), size)
            first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])])
            given = np.add.reduceat((~np.isnan(raw)).astype(np.int64), first) > 0  # null weights count in no sum
            raw = np.add.reduceat(np.nan_to_num(raw), first)
            total = np.bincount(owner[first], weights=raw, minlength=len(begins))[owner[first]]
            weight = np.divide(raw, total, out=np.zeros_like(raw), where=total != 0)
            at = pa.array(first)
            columns = [*[table.column(k).take(at) for k in keys], pa.array(word[first]), pa.array(np.minimum.reduceat(start, first)),
                       pa.array(np.maximum.reduceat(end, first)), pa.array(weight, mask=~given & (total != 0))]
            yield from pa.Table.from_arrays(columns, names=schema.names).combine_chunks().to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(summed, schema)
