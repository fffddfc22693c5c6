"""Quality rules: text statistics, and ordered decision lists learnt from labelled ones.

A list is learnt by sequential covering. Each rule is a conjunction of thresholds, grown condition by
condition for information gain on two thirds of the rows not yet covered, then pruned from the end for
precision on the rest, and kept while it is right more often than ``min_precision`` there. The rules
come out as one Spark ``CASE`` expression, first match first, that can be read and run anywhere.

Rows: null and empty texts have no words and count 0 everywhere. Null labels take no part in fitting;
with too few labelled rows of either class the list is empty and keeps everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import textvec
from weftline.llm.staging import small_batches, tidy

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_STOP = np.isin(np.arange(256), list(b".!?"))


def _by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, how often its key is in its text, and whether it is the first of them."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    _, first, inverse, counts = np.unique(textvec.mix(keys + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return counts[inverse], is_first


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of each text of an Arrow column, over whole texts."""
    data, offsets = textvec.utf8(column)
    n = len(offsets) - 1
    if not len(data):
        return {k: np.zeros(n, np.int64) for k in STATISTICS}
    start, end, n_words = textvec.words(data, offsets)
    of_word = np.repeat(np.arange(n), n_words)
    h = textvec.hashes(data, start, end)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        inside = np.flatnonzero(of_word[2:] == of_word[:-2])
        grams = textvec.mix(textvec.mix(h[inside] * np.uint64(3) + h[inside + 1]) * np.uint64(3) + h[inside + 2])
        twice = inside[_repeats(of_word[inside], grams)[0] > 1]
        for i in range(3):
            covered[twice + i] = True
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    of_line = np.searchsorted(offsets, line_start, "right") - 1
    cut = np.concatenate([line_start[1:], [len(data)]])
    line_end = np.where((cut > line_start) & (data[cut - 1] == 10), cut - 1, cut)
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    _, first = _repeats(of_line[worded], textvec.hashes(data, line_start[worded], line_end[worded]))
    points = (data & 0xC0) != 0x80
    return {
        "n_words": n_words,
        "word_chars": _by_text(points & ~textvec.SEPARATOR[data], offsets),
        "n_symbols": _by_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(of_line[worded][~first], minlength=n),
        "n_repeat_words": np.bincount(of_word[covered], minlength=n),
        "n_lines": np.bincount(of_line[worded], minlength=n),
        "n_upper": _by_text(_UPPER[data], offsets),
        "n_digits": _by_text(_DIGIT[data], offsets),
        "n_stops": _by_text(_STOP[data], offsets),
    }


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with a column for each of ``STATISTICS`` (they replace columns of those names). Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textvec.pieces(batch, text_col):
                kept = {x: piece.column(i) for i, x in enumerate(piece.schema.names) if x != text_col and x not in STATISTICS}
                yield pa.RecordBatch.from_pydict(kept | {k: pa.array(v, pa.int64()) for k, v in statistics(piece.column(text_col)).items()})

    small_batches(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != text_col and f.name not in STATISTICS]
    return df.mapInArrow(tidy(run), T.StructType([*fields, *(T.StructField(k, T.LongType()) for k in STATISTICS)]))


def features() -> dict[str, Column]:
    """What conditions are about: shares and means of the statistics, null where there is nothing to divide by."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "stops_per_word": share("n_stops", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        v = x[:, list(names).index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        own = features()[self.feature]
        return F.coalesce(own > F.lit(self.threshold) if self.above else own <= F.lit(self.threshold), F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x, names) for c in rule), np.ones(len(x), bool))


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str], most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most and bad[inside].mean() < 1:
        p, n = bad[inside].sum(), inside.sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for j, name in enumerate(names):
            v = x[inside, j]
            known = v[~np.isnan(v)]
            if not len(known):
                continue
            for t in np.unique(np.quantile(known, np.linspace(0.02, 0.98, 49))):
                for above in (True, False):
                    hit = v > t if above else v <= t
                    k, m = bad[inside][hit].sum(), hit.sum()
                    if k and (gain := k * (np.log2(k / m) - np.log2(p / n))) > best[0]:
                        best = (gain, Condition(name, above, float(t)))
        if best[1] is None:
            break
        chosen = _centred(best[1], x[inside, list(names).index(best[1].feature)])
        rule = (*rule, chosen)
        inside &= chosen.holds(x, names)
    return rule


def _centred(c: Condition, v: np.ndarray) -> Condition:
    """The same condition with its threshold in the middle of the gap in which it lies."""
    low, high = v[v <= c.threshold], v[v > c.threshold]
    return Condition(c.feature, c.above, float((low.max() + high.min()) / 2)) if len(low) and len(high) else c


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> tuple[Rule, float, int]:
    """The beginning of the rule that does best on rows it was not grown on; its precision and hits there."""
    tries = []
    for n in range(len(rule), 0, -1):
        hit = _covers(rule[:n], x, names)
        k, m = int(bad[hit].sum()), int(hit.sum())
        tries.append(((2 * k - m) / (m + 1), n, k / m if m else 0.0, k))
    _, n, precision, hits = max(tries, default=(0, 0, 0.0, 0))
    return rule[:n], precision, hits


def _simplified(rule: Rule) -> Rule:
    """Of conditions on one side of a feature, the narrowest."""
    out: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        old = out.get((c.feature, c.above))
        if old is None or (c.threshold > old.threshold) == c.above:
            out[c.feature, c.above] = c
    return tuple(out.values())


def learn(x: np.ndarray, bad: np.ndarray, names: Sequence[str], min_precision: float = 0.9, min_hits: int = 3, most_rules: int = 12, most_conditions: int = 4, seed: int = 5) -> list[Rule]:
    """Ordered rules for ``bad`` rows by sequential covering."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    while len(rules) < most_rules and bad.sum() >= 2 * min_hits and (~bad).any():
        grow_on = rng.random(len(x)) < 2 / 3
        if not bad[grow_on].any():
            break
        rule, precision, hits = _prune(_grow(x[grow_on], bad[grow_on], names, most_conditions), x[~grow_on], bad[~grow_on], names)
        if not rule or precision < min_precision or hits < min_hits:
            break
        rules.append(_simplified(rule))
        left = ~_covers(rule, x, names)
        x, bad = x[left], bad[left]
    return rules


def fit(stats: DataFrame, bad: Column, key: Column, rows: int = 20_000, **options) -> list[Rule]:
    """Rules from labelled statistics: a bounded sample of about ``rows`` rows, chosen by a hash of ``key``."""
    own = features()
    labelled = stats.select(*(c.alias(k) for k, c in own.items()), bad.cast("boolean").alias("__bad"), F.xxhash64(F.lit(3), key).alias("__key")).filter("__bad is not null")
    total = labelled.count()
    part = min(1.0, rows / total) if total else 0.0
    found = labelled.filter(F.pmod("__key", F.lit(1_000_000)) < F.lit(int(part * 1_000_000))).orderBy("__key", *own).drop("__key").limit(2 * rows).collect()
    if not found:
        return []
    x = np.array([[np.nan if r[k] is None else r[k] for k in own] for r in found], float)
    return learn(x, np.array([r["__bad"] for r in found], bool), list(own), **options)


def verdict(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1; null if it meets none."""
    cases = [(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(i + 1)) for i, rule in enumerate(rules)]
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0])) if cases else F.lit(None).cast("int")
