"""Tokens with character offsets and span <-> token alignment."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanfold.functions.text import NON_WS_CLASS, WHITESPACE_CHARS, WS_CLASS, core

PIECES = f"{NON_WS_CLASS}+|{WS_CLASS}+"
_TOKEN_RE = re.compile("[^" + re.escape(WHITESPACE_CHARS) + "]+")
#: Tokens that a row-local tokenizer hands on together, whatever the size of a document or of an input batch.
TOGETHER = 1 << 14
#: Bytes of text that are searched for white space at once; a longer text is read token by token.
BYTES = 1 << 17


def tokenize_offsets(docs: DataFrame, keys=("doc_id",), text: str = "text", keep=(), method: str = "rowlocal", neighbours: bool = False,
                     pattern: str | None = None, ranges: str | None = None, words: bool = False) -> DataFrame:
    """Whitespace tokens with half-open code-point offsets.

    ``(keys..., tok_idx, tok, start, end[, prev_end, next_end])``; ``tok_idx`` is 0-based.

    ``method="rowlocal"`` (default): each document is tokenized where it is read, in
    Arrow batches (``mapInArrow``: short texts side by side as arrays of bytes, long ones and
    those with a ``pattern`` by a compiled regex), so no text or token crosses the network; use it
    when later steps work on derived spans. A task holds the tokens of ``BYTES`` bytes or about
    ``TOGETHER`` tokens at a time.
    ``method="window"``: JVM only; the text is hash-partitioned by document once,
    ``regexp_extract_all`` cuts it into alternating non-space/space pieces and a running
    length sum gives offsets; every per-document window over the tokens downstream
    reuses that partitioning. ``neighbours`` adds the previous/next token end.
    ``pattern`` (the tokeniser plug-in) is a regex matching one token; the default is a
    run of non-whitespace (``str.split()``). It is run by Python's ``re`` (row-local) or
    Java's regex (window): write classes explicitly (``\\w``/``\\s`` differ between them).
    ``ranges`` (row-local only) names the column of :func:`with_ranges`: ``opens`` and ``closes`` (1 if a range of
    the document begins, ends where the token does) and ``covered`` (the token's characters inside ranges) are added,
    and texts that share their keys give one row a ``tok_idx`` (the first text's that has it; ``covered`` is summed
    over them). ``words`` (with ``ranges`` only) adds ``prev_tok`` and ``next_tok``.
    """
    keys = list(keys)
    if method == "window":
        return _tokenize_window(docs, keys, text, keep, neighbours, pattern)
    return _tokenize_rowlocal(docs, keys, text, keep, neighbours, pattern, ranges, words)


def with_ranges(docs: DataFrame, ranges: DataFrame, keys=("doc_id",), name: str = "ranges", texts: str | None = None) -> DataFrame:
    """``docs`` with the document's disjoint ``ranges(keys..., start, end)`` as the array column ``name`` (null without
    any), documents of the same keys next to each other. One shuffle of the texts by key, none of their tokens.
    ``texts``: a column for the number of documents of the same keys."""
    keys = list(keys)
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    held = ranges.where(F.col("end") > F.col("start")).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias(name))
    docs = docs.repartition(*keys)
    if texts is not None:
        docs = docs.withColumn(texts, F.count("*").over(Window.partitionBy(*keys)))
    return docs.join(held.hint("shuffle_hash"), keys, "left").sortWithinPartitions(*keys)


def _tokenize_rowlocal(docs: DataFrame, keys, text, keep, neighbours, pattern=None, ranges=None, words=False) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from spanfold.operators.rowlocal import one_row_a_token

    token_re = _TOKEN_RE if pattern is None else re.compile(pattern)
    inside = np.ones(256, bool)  # bytes of tokens: white space is ASCII, so no byte of another character is one of it
    inside[list(WHITESPACE_CHARS.encode())] = False
    carry = keys + list(keep)
    out_fields = [T.StructField(c, docs.schema[c].dataType, True) for c in carry] + [
        T.StructField("tok_idx", T.LongType()),
        T.StructField("tok", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("prev_end", T.LongType()),
        T.StructField("next_end", T.LongType()),
    ]
    added = [*(("prev_tok", "next_tok") if words else ()), "opens", "closes", "covered"] if ranges is not None else []
    out_fields += [T.StructField(c, T.StringType() if c.endswith("tok") else T.LongType()) for c in added]
    schema = T.StructType(out_fields)
    names = schema.names

    def met(batch, row, start, end):
        """Whether a range of its row begins and ends where a token of the batch does, and its characters inside them."""
        held = batch.column(len(carry) + 1)
        sizes, held = pc.list_value_length(held).fill_null(0).to_numpy(), held.flatten()
        first, last = (held.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        beyond = 1 + max(int(end.max(initial=0)), int(last.max(initial=0)))  # rows one after the other on one line
        shift = np.repeat(np.arange(len(sizes)), sizes) * beyond
        first, last = first + shift, np.append(0, last + shift)
        before = np.append(0, np.cumsum(last[1:] - first))

        def up_to(x):
            k = np.searchsorted(first, x, "right")
            return before[k] - np.maximum(0, last[k] - x)

        start, end = row * beyond + start, row * beyond + end
        return [pa.array(np.isin(start, first).astype(np.int64)), pa.array(np.isin(end, last[1:]).astype(np.int64)), pa.array(up_to(end) - up_to(start))]

    def parts(row, body):
        """(row, first token's number, tokens, starts, ends, end before the first, end of the next token, token before
        the first, next token) of a text, at most TOGETHER tokens at a time: one token more is read before a part is handed on."""
        toks, st, en, first, before, word = [], [], [], 0, -1, None
        for m in token_re.finditer(body):
            a, b = m.span()
            if a == b:
                continue
            if len(toks) == TOGETHER:
                yield row, first, toks, st, en, before, b, word, m.group()
                first, before, word = first + len(toks), en[-1], toks[-1]
                toks, st, en = [], [], []
            toks.append(m.group())
            st.append(a)
            en.append(b)
        if toks:
            yield row, first, toks, st, en, before, -1, word, None

    def joined(batch, held):
        sizes = [len(p[2]) for p in held]
        rows = pa.array(np.repeat(np.array([p[0] for p in held], np.int64), sizes))
        ends = [np.array(p[4], np.int64) for p in held]
        columns = [
            *[batch.column(c).take(rows) for c in range(len(carry))],
            np.concatenate([np.arange(p[1], p[1] + n, dtype=np.int64) for p, n in zip(held, sizes)]),
            [tok for p in held for tok in p[2]],
            np.concatenate([np.array(p[3], np.int64) for p in held]),
            np.concatenate(ends),
            np.concatenate([np.r_[p[5], e[:-1]] for p, e in zip(held, ends)]),
            np.concatenate([np.r_[e[1:], p[6]] for p, e in zip(held, ends)]),
        ]
        kinds = [pa.int64(), batch.column(len(carry)).type, *[pa.int64()] * 4]
        arrays = columns[: len(carry)] + [pa.array(c, t) for c, t in zip(columns[len(carry) :], kinds)]
        if ranges is not None:
            if words:
                arrays.append(pa.array([tok for p in held for tok in (p[7], *p[2][:-1])], pa.string()))
                arrays.append(pa.array([tok for p in held for tok in (*p[2][1:], p[8])], pa.string()))
            arrays += met(batch, rows.to_numpy(), columns[len(carry) + 2], columns[len(carry) + 3])
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def side_by_side(batch):
        """All tokens of a batch of short texts: borders between white space and other bytes, offsets in characters."""
        kind = batch.column(len(carry)).type
        texts = batch.column(len(carry)).fill_null("").cast(pa.string())
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if places[-1] > places[0] else np.empty(0, np.uint8)
        places -= places[0]
        token = inside[body]
        border = np.zeros(len(body) + 1, bool)  # a text begins or ends here, so does a token
        border[places] = True
        begins = token & border[:-1]
        begins[1:] |= token[1:] & ~token[:-1]
        ends = token & border[1:]
        ends[:-1] |= token[:-1] & ~token[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        before = np.append(0, np.cumsum((body & 0xC0) != 0x80))  # characters before each byte
        row = np.searchsorted(places, first, "right") - 1
        opens = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
        number = np.arange(len(row)) - np.repeat(opens, np.diff(np.append(opens, len(row))))
        start, end = (before[at] - before[places[row]] for at in (first, last))
        previous, following = np.roll(end, 1), np.roll(end, -1)
        previous[opens], following[np.append(opens, len(row))[1:] - 1 if len(row) else opens] = -1, -1
        sizes = np.append(0, np.cumsum(last - first)).astype(np.int32)
        tokens = pa.StringArray.from_buffers(len(row), pa.py_buffer(sizes.tobytes()), pa.py_buffer(body[token].tobytes())).cast(kind)
        at = pa.array(row)
        arrays = [batch.column(c).take(at) for c in range(len(carry))] + [pa.array(number), tokens, *map(pa.array, (start, end, previous, following))]
        if ranges is not None:
            if words:
                place = np.arange(len(row))
                arrays += [tokens.take(pa.array(place + by, mask=none < 0)) for by, none in ((-1, previous), (1, following))]
            arrays += met(batch, row, start, end)
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def one_by_one(batch):
        held, size = [], 0
        bodies = batch.column(len(carry))
        for row in range(batch.num_rows):
            body = bodies[row].as_py()
            for part in parts(row, body) if body else ():
                held.append(part)
                size += len(part[2])
                if size >= TOGETHER:
                    yield joined(batch, held)
                    held, size = [], 0
        if held:
            yield joined(batch, held)

    def batches(it):
        for batch in it:
            if pattern is not None:
                yield from one_by_one(batch)
                continue
            total = np.append(0, np.cumsum(pc.binary_length(batch.column(len(carry))).fill_null(0).to_numpy(zero_copy_only=False)))
            row = 0
            while row < batch.num_rows:
                after = int(np.searchsorted(total, total[row] + BYTES, "right")) - 1
                if after > row:
                    found = side_by_side(batch.slice(row, after - row))
                    for at in range(0, found.num_rows, TOGETHER):
                        yield found.slice(at, TOGETHER)
                else:  # a text of more than BYTES bytes
                    after = row + 1
                    yield from one_by_one(batch.slice(row, 1))
                row = after

    def once(it):
        yield from one_row_a_token(batches(it), len(keys))

    read = [*carry, F.col(text).cast("string").alias("_text"), *([ranges] if ranges is not None else [])]
    t = docs.select(*read).mapInArrow(batches if ranges is None else once, schema)
    cols = [*carry, "tok_idx", "tok", "start", "end", *added]
    if neighbours:
        cols += [F.when(F.col("prev_end") >= 0, F.col("prev_end")).alias("prev_end"), F.when(F.col("next_end") >= 0, F.col("next_end")).alias("next_end")]
    return t.select(*cols)


def _tokenize_window(docs: DataFrame, keys, text, keep, neighbours, pattern=None) -> DataFrame:
    # shuffle the compact text once by document; the piece window below reuses it
    docs = docs.repartition(*keys)
    if pattern is not None:
        # custom tokens: the text between consecutive tokens is the gap piece
        pieces_re = f"(?:{pattern})|(?:(?!{pattern})[\\s\\S])+"
        pieces = docs.select(*keys, *keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pieces_re), F.lit(0))).alias("_p", "tok"))
        w = Window.partitionBy(*keys).orderBy("_p")
        pieces = pieces.withColumn("end", F.sum(F.length("tok")).over(w)).withColumn("_is_tok", F.col("tok").rlike(f"^(?:{pattern})$"))
        t = pieces.where("_is_tok").withColumn("tok_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("_p")) - 1)
        t = t.select(*keys, *keep, F.col("tok_idx").cast("long"), "tok", (F.col("end") - F.length("tok")).cast("long").alias("start"), F.col("end").cast("long"))
        if neighbours:
            wt = Window.partitionBy(*keys).orderBy("tok_idx")
            t = t.withColumn("prev_end", F.lag("end").over(wt)).withColumn("next_end", F.lead("end").over(wt))
        return t
    pieces = docs.select(*keys, *keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))).alias("_p", "tok"))
    w = Window.partitionBy(*keys).orderBy("_p")
    pieces = pieces.withColumn("end", F.sum(F.length("tok")).over(w))
    toks = pieces.where(F.col("tok").rlike(NON_WS_CLASS))
    t = toks.select(
        *keys,
        *keep,
        # pieces alternate, so the token index is the piece index halved, shifted by one
        # when the text starts with whitespace (piece 0 is then a space run)
        F.when(F.col("_p") % 2 == 0, F.col("_p") / 2).otherwise((F.col("_p") - 1) / 2).cast("long").alias("tok_idx"),
        "tok",
        (F.col("end") - F.length("tok")).cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
    )
    if neighbours:
        wt = Window.partitionBy(*keys).orderBy("tok_idx")
        t = t.withColumn("prev_end", F.lag("end").over(wt)).withColumn("next_end", F.lead("end").over(wt))
    return t


BLOCK = 4096  # characters per block of the interval join key


def overlap_join(left: DataFrame, right: DataFrame, keys=("doc_id",), how: str = "inner", block: int = BLOCK) -> DataFrame:
    """Interval join: rows whose half-open ranges intersect, on the equi key(s) plus a theta predicate.

    ``left`` and ``right`` carry ``start``/``end``; the right side's are renamed
    ``r_start``/``r_end`` and ``overlap`` is the intersection length. Besides the
    document key, both sides carry the character block(s) ``floor(pos / block)`` their
    range touches, so the theta predicate is only evaluated within one block of one
    document (one huge document cannot turn into an all-pairs scan); a pair that shares
    several blocks is kept only in the block of its first shared character.
    """
    keys = list(keys)

    def blocks(df, s, e, name):
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / block), F.floor((F.col(e) - 1) / block))))

    l = blocks(left.where(F.col("end") > F.col("start")), "start", "end", "_blk")
    r = blocks(right.where(F.col("end") > F.col("start")).withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end"), "r_start", "r_end", "_rblk")
    cond = [l[k] == r[k] for k in keys] + [l["_blk"] == r["_rblk"], l["start"] < r["r_end"], r["r_start"] < l["end"]]
    j = l.join(r, on=cond, how="inner")
    for k in keys:
        j = j.drop(r[k])
    j = j.where(F.col("_blk") == F.floor(F.greatest(F.col("start"), F.col("r_start")) / block)).drop("_blk", "_rblk")
    j = j.withColumn("overlap", F.least("end", "r_end") - F.greatest("start", "r_start"))
    if how == "inner":
        return j
    raise ValueError("overlap_join supports inner joins; left-join the result back for outer semantics")


def token_label_overlap(tokens: DataFrame, gold: DataFrame | None, threshold: float = 0.0, keys=("doc_id",), covered: str | None = None) -> DataFrame:
    """Label 1 iff (chars of the token inside gold) / (token length) > threshold; else 0.

    ``gold`` must be normalized (disjoint) so overlaps add up to the covered count. ``covered``: the column of
    ``tokens`` that counts them already (:func:`tokenize_offsets` of documents :func:`with_ranges`, where the tokens
    are one row per key and ``tok_idx``), so no token is shuffled and no ``gold`` is needed.
    """
    keys = list(keys)
    n = F.col("end") - F.col("start")
    if covered is not None:
        label = F.when((n > 0) & (F.col(covered) / n > F.lit(threshold)), 1).otherwise(0).cast("int")
        return tokens.withColumn("label", label).drop(covered)
    others = [c for c in tokens.columns if c not in (*keys, "tok_idx")]
    last = F.greatest(F.col("start"), F.col("end") - 1)
    t = tokens.select(*keys, "tok_idx", "start", "end").withColumn("_blk", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(last / BLOCK))))
    g = gold.where(F.col("end") > F.col("start")).select(*keys, F.col("start").alias("_gs"), F.col("end").alias("_ge"))
    g = g.withColumn("_gblk", F.explode(F.sequence(F.floor(F.col("_gs") / BLOCK), F.floor((F.col("_ge") - 1) / BLOCK))))
    g = g.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_gs", "_ge", "_gblk")
    meet = [F.col(k) == F.col(f"_g_{k}") for k in keys] + [F.col("_blk") == F.col("_gblk"), F.col("start") < F.col("_ge"), F.col("_gs") < F.col("end")]
    # a pair that shares several blocks counts in the block of its first shared character
    first_shared = F.floor(F.greatest("start", "_gs") / BLOCK) == F.col("_blk")
    shared = F.least("end", "_ge") - F.greatest("start", "_gs")
    # only the tokens that meet gold are gathered here; every token then passes one shuffle with all its columns
    met = t.join(g.hint("shuffle_hash"), meet).where(first_shared).groupBy(*keys, "tok_idx").agg(F.sum(shared).alias("_met"))
    lab = tokens.join(met.hint("shuffle_hash"), [*keys, "tok_idx"], "left").groupBy(*keys, "tok_idx")
    lab = lab.agg(F.coalesce(F.max("_met"), F.lit(0)).alias("_covered"), *[F.first(c).alias(c) for c in others])
    label = F.when((n > 0) & (F.col("_covered") / n > F.lit(threshold)), 1).otherwise(0).cast("int")
    return lab.select(*tokens.columns, label.alias("label"))


def token_label_first_char(tokens: DataFrame, gold: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Label 1 iff the token's first character lies inside a gold range; empty tokens are 0."""
    keys = list(keys)
    g = gold.where(F.col("end") > F.col("start")).select(*keys, F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    g = g.withColumn("_blk", F.explode(F.sequence(F.floor(F.col("g_start") / BLOCK), F.floor((F.col("g_end") - 1) / BLOCK))))
    t = tokens.where(F.col("end") > F.col("start")).select(*keys, "tok_idx", "start", F.floor(F.col("start") / BLOCK).alias("_blk"))
    inside = [t[k] == g[k] for k in [*keys, "_blk"]] + [t["start"] >= g["g_start"], t["start"] < g["g_end"]]
    hit = t.join(g, on=inside, how="left_semi").select(*keys, "tok_idx").withColumn("label", F.lit(1))
    return tokens.join(hit, on=[*keys, "tok_idx"], how="left").withColumn("label", F.coalesce("label", F.lit(0)).cast("int"))


def doc_label_fraction(docs: DataFrame, gold: DataFrame, threshold: float = 0.3, keys=("doc_id",), text: str = "text") -> DataFrame:
    """Document label 1 iff |gold chars| / len(text) > threshold and the text is non-empty.

    ``gold`` must be normalized. Documents without spans are kept (LEFT JOIN from docs).
    """
    keys = list(keys)
    glen = gold.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("gold_chars"))
    d = docs.select(*keys, F.length(text).alias("n_chars")).join(glen, on=keys, how="left")
    d = d.withColumn("gold_chars", F.coalesce("gold_chars", F.lit(0)).cast("long"))
    frac = F.when(F.col("n_chars") > 0, F.col("gold_chars") / F.col("n_chars"))
    return d.withColumn("fraction", frac).withColumn(
        "label", F.when((F.col("n_chars") > 0) & (frac > F.lit(threshold)), 1).otherwise(0).cast("int")
    )


def word_offsets(tokens: DataFrame, keys=("doc_id",), block: int = 1 << 12) -> DataFrame:
    """Offsets under the single-space assumption: running sum of len(word)+1 of earlier words.

    A two-level prefix over token blocks (``modeling.running_sum``), so a huge document is
    not one window group."""
    from spanfold.operators.modeling import running_sum

    r = running_sum(tokens, list(keys), "tok_idx", F.length("tok") + 1, "ss_start", block, exclusive=True)
    return r.withColumn("ss_start", F.col("ss_start").cast("long"))


def spans_to_entities(tokens: DataFrame, gold: DataFrame, label: str = "TOXIC", keys=("doc_id",)) -> DataFrame:
    """Runs of consecutive tokens touching gold merged into ``(start, end, label)`` entities.

    A token touches gold if any of its characters is in a gold range; a run ends at the
    first non-touching token (whitespace is not a token here, so it never breaks a run).
    """
    keys = list(keys)
    lab = token_label_overlap(tokens, gold, 0.0, keys)
    w = Window.partitionBy(*keys).orderBy("tok_idx")
    # island id: position among all tokens minus position among touching tokens
    t = lab.where(F.col("label") == 1).withColumn("_isl", F.col("tok_idx") - F.row_number().over(w))
    return t.groupBy(*keys, "_isl").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_isl").withColumn("label", F.lit(label))


def strided_windows(tokens: DataFrame, max_length: int = 384, stride: int = 128, keys=("doc_id",)) -> DataFrame:
    """Overlapping windows of ``max_length`` tokens; consecutive windows share ``stride`` tokens.

    ``(keys..., window_id, first_tok, last_tok, n_tok)``. One window when the document fits,
    otherwise windows start every ``max_length - stride`` tokens until the last token is covered.
    """
    keys = list(keys)
    step = max_length - stride
    n = tokens.groupBy(*keys).agg(F.count("*").alias("_n"))
    nwin = F.lit(1) + F.greatest(F.lit(0), F.ceil((F.col("_n") - max_length) / F.lit(step)))
    w = n.select(*keys, "_n", F.explode(F.sequence(F.lit(0), (nwin - 1).cast("long"))).alias("window_id"))
    first = F.col("window_id") * step
    last = F.least(first + max_length, F.col("_n")) - 1
    return w.select(*keys, "window_id", first.alias("first_tok"), last.alias("last_tok"), (last - first + 1).alias("n_tok"))


def window_tokens(tokens: DataFrame, max_length: int = 384, stride: int = 128, keys=("doc_id",)) -> DataFrame:
    """Tokens of every window of :func:`strided_windows` (a token in an overlap belongs to both).

    Computed arithmetically: token ``i`` lies in windows ``ceil((i-L+1)/step) .. floor(i/step)``
    (clipped to the document's window count), so no token x window join is needed.
    ``pos`` is the token's position inside the window.
    """
    keys = list(keys)
    step = max_length - stride
    t = tokens.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    nwin = F.lit(1) + F.greatest(F.lit(0), F.ceil((F.col("_n") - max_length) / F.lit(step)))
    i = F.col("tok_idx")
    t = t.withColumn("_lo", F.greatest(F.lit(0), F.ceil((i - max_length + 1) / F.lit(step))).cast("long"))
    t = t.withColumn("_hi", F.least(F.floor(i / F.lit(step)), nwin - 1).cast("long"))
    t = t.withColumn("window_id", F.explode(F.sequence(F.col("_lo"), F.greatest(F.col("_lo"), F.col("_hi")))))
    t = t.where(F.col("window_id") <= F.col("_hi"))
    return t.withColumn("pos", i - F.col("window_id") * step).drop("_n", "_lo", "_hi")
