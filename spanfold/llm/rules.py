"""Operator 3, quality rules: a learned decision list over text statistics.

``statistics`` makes one narrow row of counts per document. ``learn`` fits an ordered list of
threshold conjunctions by sequential covering: on two thirds of the labelled rows a rule grows, one
condition at a time, by information gain for the bad class; on the other third its last conditions
are cut while that raises (bad - good) / (bad + good); the rows it covers are set aside and the next
rule is grown, until a rule no longer covers mostly bad rows there. ``verdict`` writes the list as
one Spark conditional expression: WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true.

The list is fitted on a documented, bounded sample: the ``LABELLED`` labelled rows with the smallest
key hash. Rows that the fixed base rules reject aren't used, as the list never decides on them. An id
with several labels has the smallest one (bad wins). Rows far behind the sample's last hash are filtered
where they are read, so the driver and each task see little more than the sample at every size.

Defined results: null text has no words and fails the base rules; without labelled rows of both
classes the list is empty and keeps what the base rules keep; repeated rows are rated each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import key_hash, written
from spanfold.llm.words import hashed_words, text_bytes, windows

MIN_WORDS, MAX_REPEATED = 50, 50
LABELLED, MAX_RULES, MAX_CONDITIONS, CUTS = 20_000, 12, 4, 48
#: A rule stays only if at least this share of what it covers among the pruning rows is bad.
PRECISION = 0.9
_SYMBOLS = b"#*$%&|<>"
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Deleting these leaves one byte per code point that isn't blank.
_NOT_FIRST = _BLANKS + bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")


def _lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def _repeated(hashes: np.ndarray) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(hashes)
    if n < 4:
        return 0
    grams, _ = windows(hashes, np.array([0, n]), 3)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(grams)] |= twice
    return int(covered.sum())


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``COUNTS`` of every row; row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            rows: list[tuple] = []
            for first, hashes, bounds in hashed_words(batch.column(1), lower=False):
                for k in range(len(bounds) - 1):
                    raw = data[offsets[first + k] : offsets[first + k + 1]].tobytes()
                    own = hashes[bounds[k] : bounds[k + 1]]
                    n_lines, dup = _lines(raw)
                    letters = raw.translate(None, _NOT_FIRST)
                    marks = len(raw) - len(raw.translate(None, b"!?"))
                    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                    rows.append((len(own), len(letters), len(raw) - len(raw.translate(None, _SYMBOLS)), dup, _repeated(own), n_lines, upper, marks, len(np.unique(own))))
            cols = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=[id_col, *COUNTS])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What rules may test, from the counts."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "marks_per_word": F.col("n_marks") / words,
        "distinct_share": F.col("n_distinct") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


#: A condition: (feature, True for >= and False for <, threshold); a rule: conditions that all hold.
Rule = list[tuple[str, bool, float]]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, above, cut in rule:
        out &= x[name] >= cut if above else x[name] < cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the largest gain until only bad rows are covered."""
    rule: Rule = []
    covered = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[covered]).any():
        p, n = int(bad[covered].sum()), int(covered.sum())
        best, choice = 1e-9, None
        for name, values in x.items():
            v, b = values[covered], bad[covered]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1]))
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], cuts)  # rows below each cut
            below = np.concatenate([[0], np.cumsum(b[order])])[at]
            for above, hit, size in ((False, below, at), (True, p - below, n - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((hit > 0) & (size < n), hit * (np.log2(hit / size) - np.log2(p / n)), 0.0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, choice = float(gain[k]), (name, above, float(cuts[k]))
        if choice is None:
            break
        rule.append(choice)
        covered = _holds(rule, x, len(bad))
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = _holds(rule, x, len(bad))
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, growing: np.ndarray) -> list[Rule]:
    """The decision list; ``growing`` marks the rows that rules grow on, the others prune them."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, p = left & growing, left & ~growing
        if not bad[g].any() or not bad[p].any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g])
        prune, truth = {k: v[p] for k, v in x.items()}, bad[p]
        while len(rule) > 1 and _worth(rule[:-1], prune, truth) >= _worth(rule, prune, truth):
            rule = rule[:-1]
        if not rule or _worth(rule, prune, truth) < 2 * PRECISION - 1:
            break
        rules.append(rule)
        left &= ~_holds(rule, x, len(bad))
    return rules


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows with the smallest ``_h`` (60 even bits), by counts: all but some 1.1 k of them are left out
    before the sort. Should too few lie below the cut (many rows of one id behind it), all rows are sorted."""
    below = rows
    n = rows.count()
    if n > 2 * k:
        below = rows.where(F.col("_h") < F.lit(int((1 << 60) * (1.1 * k + 100) / n)))
        if below.count() < k:
            below = rows
    return below.orderBy("_h", "_id", *[c for c in rows.columns if c not in ("_h", "_id")]).limit(k)


def learn_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Fit the list on the sample of labelled statistics (label 0 is bad)."""
    known = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).alias("_label")).where("_label is not null and _lid is not null").groupBy("_lid").agg(F.min("_label").alias("_label"))
    rows = stats.where(~base_failed()).join(known, F.col(id_col) == F.col("_lid"))
    picked = [c.alias(name) for name, c in features().items()]
    rows = rows.select(key_hash(F.col(id_col)).alias("_h"), F.col(id_col).alias("_id"), "_label", *picked)
    sample = _smallest(rows, LABELLED).toPandas()
    x = {name: sample[name].to_numpy(float) for name in features()}
    return learn(x, sample["_label"].to_numpy() == 0, sample["_h"].to_numpy() % 3 != 0)


def condition(rule: Rule) -> Column:
    x, out = features(), F.lit(True)
    for name, above, cut in rule:
        out = out & (x[name] >= cut if above else x[name] < cut)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: is the document kept?"""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(condition(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id``, the counts, ``base_failed`` and ``kept`` of every row."""
    stats = written(statistics(docs, id_col, text_col), "rule_stats")
    rules = learn_from(stats, labels, id_col, label_col)
    return stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"))
