"""Corpus modelling helpers: keyed randomness, sequences, losses, splits, pyspark.ml models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.functions.text import core

#: A prime below 2**31, so that every product of two residues fits a long; results lie in [0, HASH_MOD).
HASH_PRIME, HASH_MOD = 2147483647, 1000


def keyed_uniform(doc_id: Column, pos: Column) -> Column:
    """A reproducible value in [0, HASH_MOD) from (doc_id, pos): same on any cluster and in SQL.

    Three rounds of squaring modulo a prime, mixed with the position: neighbouring documents and
    positions get unrelated values (a linear step would give runs and bands)."""
    p = F.lit(HASH_PRIME).cast("long")
    d, i = F.pmod(doc_id.cast("long"), p), F.pmod(pos.cast("long"), p)
    x = (d * 1103515245 + 12345) % p
    x = (x * x + i * 69069 + 1) % p
    x = (x * x + d * 40692 + 7) % p
    x = (x * x + i * 16807 + 3) % p
    return (x * x + 5) % p % HASH_MOD


def keyed_uniform_sql(doc_id: str, pos: str) -> str:
    """``keyed_uniform`` for non-negative ids and positions below the prime, as a DuckDB expression."""
    p = HASH_PRIME
    steps = f"[(({pos}) * 69069 + 1)::BIGINT, (({doc_id}) * 40692 + 7)::BIGINT, (({pos}) * 16807 + 3)::BIGINT, 5::BIGINT]"
    return f"(list_reduce(list_prepend(((({doc_id}) * 1103515245 + 12345) % {p})::BIGINT, {steps}), lambda x, s: (x * x + s) % {p}) % {HASH_MOD})"


def random_offsets(doc_id: Column, n_chars: Column, p_keep: float = 0.5) -> Column:
    """Offsets of a text kept with probability ``p_keep`` (the random baseline), row-local.

    The values are those of ``keyed_uniform``, taken for a whole text at once."""
    cut = int(HASH_MOD * p_keep)

    @F.arrow_udf("array<int>")
    def kept(ids: pa.Array, sizes: pa.Array) -> pa.Array:
        parts, ends = [np.empty(0, np.int32)], [0]
        for one, n in zip(ids.to_pylist(), sizes.to_pylist()):
            # as in SQL, nothing is kept without an id
            part = np.flatnonzero(_uniforms(one, n) < cut).astype(np.int32) if one is not None and n else parts[0]
            parts.append(part)
            ends.append(ends[-1] + len(part))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))

    return kept(doc_id.cast("long"), n_chars.cast("long"))


def _uniforms(one: int, n: int) -> np.ndarray:
    """``keyed_uniform`` of one id and the positions 0 to n - 1."""
    p, d = HASH_PRIME, one % HASH_PRIME
    i = np.arange(n, dtype=np.int64) % p
    x = np.int64((d * 1103515245 + 12345) % p)
    x = (x * x + i * 69069 + 1) % p
    x = (x * x + d * 40692 + 7) % p
    x = (x * x + i * 16807 + 3) % p
    return (x * x + 5) % p % HASH_MOD


def train_val_split(df: DataFrame, fraction: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Stable split by a keyed hash of the id (not ``randomSplit``): ``split`` = train | validation."""
    u = keyed_uniform(F.col(key), F.lit(0))
    return df.withColumn("split", F.when(u < int(HASH_MOD * fraction), "train").otherwise("validation"))


def pad_sequence(seq: Column, maxlen: int, padding: str = "post", value: int = 0) -> Column:
    """Cut to ``maxlen`` (at the end) and pad with ``value`` before ("pre") or after ("post")."""
    cut = F.slice(seq, 1, maxlen)
    pad = F.array_repeat(F.lit(value).cast("long"), F.lit(maxlen) - F.size(cut))
    return F.concat(pad, cut) if padding == "pre" else F.concat(cut, pad)


def _lse(logits: list[Column]) -> Column:
    m = F.greatest(*logits)
    return m + F.log(sum((F.exp(z - m) for z in logits[1:]), F.exp(logits[0] - m)))


def cross_entropy(logits: list[Column], target: Column) -> Column:
    """-log softmax(z)[target] per row."""
    lse = _lse(logits)
    picked = F.lit(None).cast("double")
    for c, z in reversed(list(enumerate(logits))):
        picked = F.when(target == c, z).otherwise(picked)
    return lse - picked


def smoothed_ce(df: DataFrame, logits: list[str], target: str, smoothing: float, mask: str, keys=("doc_id",)) -> DataFrame:
    """Mean over unmasked rows of -sum_c y'_c log softmax(z)_c with y' = 1-s on the target
    and s/(C-1) elsewhere (per key group)."""
    zs = [F.col(z) for z in logits]
    n = len(zs)
    lse = _lse(zs)
    other = smoothing / (n - 1)
    loss = -sum(
        (F.when(F.col(target) == c, 1 - smoothing).otherwise(other) * (z - lse) for c, z in enumerate(zs)),
        F.lit(0.0),
    )
    m = F.col(mask)
    return df.groupBy(*keys).agg((F.sum(loss * m) / F.sum(m)).alias("loss"))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Binary cross-entropy on logits, in the overflow-free softplus form."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


# ---------------------------------------------------------------------------- learned models (pyspark.ml, JVM-side)
def doc_classifier(train: DataFrame, label: str = "toxic", text: str = "text", num_features: int = 1 << 18, max_iter: int = 30):
    """Document toxicity scorer: RegexTokenizer -> HashingTF -> IDF -> LogisticRegression.

    Returns a fitted ``PipelineModel``; ``score_documents`` applies it. Training and
    scoring are distributed; nothing is collected.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern="[ \\t\\n\\r\\x0B\\f]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(train.withColumn("_label", F.col(label).cast("double")))


def score_documents(model, docs: DataFrame, keys=("doc_id",)) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(docs)
    return out.select(*keys, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction"))


def word_contributions(model, words: DataFrame, word: str = "word") -> DataFrame:
    """``(word, contrib)``: what one occurrence of a word adds to a fitted ``doc_classifier``'s margin.

    The classifier is linear in term counts, so a one-word text's margin less the intercept is that
    word's share, and a document's margin is the intercept plus the sum over its words."""
    from pyspark.ml.functions import vector_to_array

    text = model.stages[0].getInputCol()
    scored = model.transform(words.select(word).distinct().withColumn(text, F.col(word)))
    return scored.select(word, (vector_to_array("rawPrediction")[1] - F.lit(model.stages[-1].intercept)).alias("contrib"))


def token_features(tokens: DataFrame, keys=("doc_id",), words: tuple[str, str] | None = None) -> DataFrame:
    """Context features per token: its lower-cased core word and its neighbours' (lag/lead). ``words``: the columns that
    hold the neighbouring tokens already (``tokenize_offsets`` with ``words``), so nothing is gathered."""
    from pyspark.sql import Window

    if words is not None:
        before, after = (core(F.col(c)) for c in words)
    else:
        w = Window.partitionBy(*keys).orderBy("tok_idx")
        before, after = F.lag("core").over(w), F.lead("core").over(w)
    return (
        tokens.withColumn("f_w", F.col("core"))
        .withColumn("f_prev", F.coalesce(before, F.lit("<s>")))
        .withColumn("f_next", F.coalesce(after, F.lit("</s>")))
        .withColumn("f_shape", F.when(F.col("tok").rlike("^[\\p{Lu}]"), "cap").otherwise("low"))
    )


def hashed_features(feats: DataFrame, num_features: int = 1 << 18) -> DataFrame:
    """``feats`` with the vector ``_features``, which the token models then take as it is."""
    return _hasher(num_features).transform(feats)


#: Inputs of the token models.
INPUTS = ("f_w", "f_prev", "f_next", "f_shape")


def _hasher(num_features: int):
    from pyspark.ml.feature import FeatureHasher

    return FeatureHasher(inputCols=list(INPUTS), outputCol="_features", numFeatures=num_features)


def fit_token_model(feats: DataFrame, label: str, num_features: int = 1 << 18, max_iter: int = 30):
    """Class-weighted logistic regression on hashed token context features (the token tagger).

    Positives are rare, so each class is weighted by the inverse of its frequency; the
    two class counts come from one small aggregate. ``feats`` may be :func:`hashed_features`."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression

    counts = feats.agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n")).first()
    pos, n = float(counts["pos"] or 0), float(counts["n"] or 0)
    w_pos = (n - pos) / pos if pos > 0 else 1.0
    data = feats.withColumn("_label", F.col(label).cast("double")).withColumn("_w", F.when(F.col(label) == 1, F.lit(w_pos)).otherwise(F.lit(1.0)))
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_w", maxIter=max_iter, regParam=0.001)
    if "_features" in feats.columns:
        return PipelineModel(stages=[_hasher(num_features), lr.fit(data)])
    return Pipeline(stages=[_hasher(num_features), lr]).fit(data)


def murmur3(strings: pa.StringArray, seed: int = 42) -> np.ndarray:
    """The strings' 32-bit murmur3 hashes, as ``FeatureHasher`` takes them; four bytes of all strings at a time."""
    _, places, data = strings.buffers()
    places = np.frombuffer(places, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.append(np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), np.zeros(4, np.uint8)).astype(np.uint32)
    sizes, out = np.diff(places), np.full(len(strings), seed, np.uint32)

    def turned(x, by):
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    def mixed(x):
        return turned(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    rows, at = np.arange(len(strings)), 0
    while len(rows := rows[sizes[rows] >= at + 4]):
        p = places[rows] + at
        word = data[p] | data[p + 1] << np.uint32(8) | data[p + 2] << np.uint32(16) | data[p + 3] << np.uint32(24)
        out[rows] = turned(out[rows] ^ mixed(word), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        at += 4
    left, last = sizes % 4, places[:-1] + sizes - sizes % 4
    word = sum((np.where(left > k, data[last + k], 0).astype(np.uint32) << np.uint32(8 * k) for k in range(3)), np.zeros(len(out), np.uint32))
    out ^= mixed(word) ^ sizes.astype(np.uint32)
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    out = (out ^ (out >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (out ^ (out >> np.uint32(16))).view(np.int32)


def token_margin(model, feats: DataFrame) -> Column:
    """The raw margin of class 1 of a fitted token model, from the columns ``INPUTS``: the intercept and the weights of
    the token's feature numbers (``FeatureHasher``'s), looked up in Arrow batches. Rows stay where and as they are."""
    hasher, fitted = model.stages
    sent = feats.sparkSession.sparkContext.broadcast((fitted.coefficients.toArray(), float(fitted.intercept)))

    @F.arrow_udf("double")
    def margin(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        weights, total = sent.value
        for name, column in zip(INPUTS, (a, b, c, d)):
            coded = column.cast(pa.string()).dictionary_encode()  # each distinct word is hashed once
            named = pc.binary_join_element_wise(f"{name}=", coded.dictionary, "")
            total = total + weights[murmur3(named).astype(np.int64) % len(weights)][coded.indices.to_numpy()]
        return pa.array(total)

    return margin(*INPUTS)


def apply_token_model(model, feats: DataFrame, prefix: str) -> DataFrame:
    """Adds ``{prefix}_prob`` and ``{prefix}_logit`` (the raw margin of class 1)."""
    margin = F.col(f"{prefix}_logit")
    return feats.withColumn(f"{prefix}_logit", token_margin(model, feats)).withColumn(f"{prefix}_prob", 1.0 / (1.0 + F.exp(-margin)))


def running_sum(df: DataFrame, group: list[str], order: str, value, name: str, block: int = 1 << 16, exclusive: bool = False,
                with_count: bool = False) -> DataFrame:
    """Running sum of ``value`` by ``order`` inside each ``group`` as column ``name``
    (``exclusive``: rows strictly before; ``with_count`` also adds ``name + "_n"``).

    Skew-safe two-level prefix: rows are cut into blocks of ``order // block``; block totals
    are prefixed per group (one row per block, a small window), then rows are prefixed
    inside their block. A group holding a large share of all rows is spread over its
    blocks instead of landing in one task.
    """
    from pyspark.sql import Window

    v = value if not isinstance(value, str) else F.col(value)
    b = df.withColumn("_v", v.cast("double") if not with_count else v).withColumn("_blk", F.floor(F.col(order) / block))
    tot = b.groupBy(*group, "_blk").agg(F.sum("_v").alias("_bs"), F.count("*").alias("_bc"))
    wb = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*group, "_blk", F.coalesce(F.sum("_bs").over(wb), F.lit(0)).alias("_ps"), F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_pc"))
    wr = Window.partitionBy(*group, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    b = b.withColumn("_rs", F.coalesce(F.sum("_v").over(wr), F.lit(0))).withColumn("_rc", F.count("_v").over(wr))
    j = b.join(tot, on=[*group, "_blk"])
    j = j.withColumn(name, F.col("_ps") + F.col("_rs"))
    if with_count:
        j = j.withColumn(name + "_n", F.col("_pc") + F.col("_rc"))
    return j.drop("_v", "_blk", "_ps", "_pc", "_rs", "_rc", "_bs", "_bc")


def running_mean(df: DataFrame, group: list[str], order: str, value: str, block: int = 1 << 16) -> DataFrame:
    """Running mean of ``value`` by ``order`` inside each ``group`` (e.g. the training loss
    by step, restarting each epoch of each run), adding ``running_mean``; a two-level
    prefix (see :func:`running_sum`), so one hot group is spread over its blocks."""
    r = running_sum(df, group, order, F.col(value).cast("double"), "_rsum", block, with_count=True)
    return r.withColumn("running_mean", F.col("_rsum") / F.col("_rsum_n")).drop("_rsum", "_rsum_n")
