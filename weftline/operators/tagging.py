"""Token features, class weights and a linear-chain sequence tagger.

Sentences are arrays of tokens; features are expressions over the array, so no sentence is shuffled.
The tagger is a linear-chain conditional random field over hashed token features; its likelihood, less an
absolute and a squared penalty, is raised by a quasi-Newton method; decoding is Viterbi in Arrow batches.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import numeric_text, word_shape
from weftline.operators.models import loaded, saved

# Units, quantities, stop words and the pattern of a leading quantity.
UNITS = ["cup", "cups", "tsp", "teaspoon", "teaspoons", "tbsp", "tablespoon", "tablespoons", "g", "gram", "grams", "kg", "kilogram", "kilograms", "ml", "milliliter", "milliliters", "l", "liter", "liters", "oz", "ounce", "ounces", "lb", "pound", "pounds", "pinch", "clove", "cloves", "slice", "slices"]
QUANTITIES = ["half", "quarter", "third", "fourth", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
STOP_WORDS = ["and", "or", "the", "a", "an", "of", "in"]
QUANTITY_START = r"^(\d+\s\d+/\d+|\d+/\d+|\d+(\.\d+)?)"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def tokenised(df: DataFrame, *columns: str) -> DataFrame:
    """Space-separated strings as arrays."""
    return df.withColumns({c: F.filter(F.split(c, r"\s+"), lambda x: x != "") for c in columns})


def aligned(df: DataFrame, tokens: str, labels: str) -> DataFrame:
    """Rows with as many labels as tokens."""
    return df.filter(F.size(tokens) == F.size(labels))


def by_label(tokens: Column, labels: Column, label: str) -> Column:
    """The tokens with a label."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), labels.alias("l")), lambda x: x["l"] == label), lambda x: x["t"])


def exploded(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """A row for each token: keep..., i, token, prev, next (null at the ends)."""
    at = F.posexplode(tokens).alias("i", "token")
    rows = df.select(*keep, F.col(tokens).alias("__all"), at)
    return rows.select(*keep, "i", "token", F.get("__all", F.col("i") - 1).alias("prev"), F.get("__all", F.col("i") + 1).alias("next"))


def features(rows: DataFrame) -> DataFrame:
    """The 31 features of each token of :func:`exploded` rows."""
    token, prev, next_ = F.col("token"), F.col("prev"), F.col("next")
    low, low_prev, low_next = F.lower(token), F.coalesce(F.lower(prev), F.lit("")), F.coalesce(F.lower(next_), F.lit(""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    named = {
        "bias": F.lit(1.0), "lower": low, "lemma": low, "pos_tag": F.lit("UNK"), "tag": F.lit("UNK"), "dep": F.lit("UNK"), "shape": word_shape(token),
        "is_stop": low.isin(STOP_WORDS), "is_digit": token.rlike(r"^\d+$"), "has_digit": token.rlike(r"\d"), "has_alpha": token.rlike(r"\p{L}"),
        "hyphenated": token.contains("-"), "slash_present": token.contains("/"), "is_title": token.rlike(r"^[^\p{L}]*\p{Lu}") & (F.initcap(low) == token),
        "is_upper": token.rlike(r"\p{Lu}") & ~token.rlike(r"\p{Ll}"), "is_punct": F.lit(PUNCTUATION).contains(token),
        "is_quantity": low.isin(QUANTITIES) | token.rlike(QUANTITY_START), "is_unit": low.isin(UNITS), "is_numeric": numeric_text(token),
        "is_fraction": token.rlike(r"^\d+/\d+"), "is_decimal": token.rlike(r"^\d+\.\d+"),
        "preceding_word": low_prev, "following_word": low_next, "prev_token": low_prev,
        "prev_is_quantity": yes(F.lower(prev).isin(QUANTITIES)), "prev_is_digit": yes(prev.rlike(r"^\d+$")), "BOS": prev.isNull(),
        "next_token": low_next, "next_is_unit": yes(F.lower(next_).isin(UNITS)), "next_is_ingredient": ~yes(F.lower(next_).isin([*UNITS, *QUANTITIES])), "EOS": next_.isNull(),
    }
    return rows.withColumns(named)


def class_weights(rows: DataFrame, label: str = "label", boost: dict[str, float] | None = None) -> DataFrame:
    """label, n, weight: all rows over the label's, times its boost."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    factor = F.coalesce(F.create_map(*[x for k, v in boost.items() for x in (F.lit(k), F.lit(v))])[F.col("label")], F.lit(1.0)) if boost else F.lit(1.0)
    return counts.join(F.broadcast(total), F.lit(True)).select("label", "n", (F.col("all") / F.col("n") * factor).alias("weight"))


def errors_by_label(rows: DataFrame, truth: str, predicted: str, weights: dict[str, float] | None = None) -> DataFrame:
    """label, n, errors, accuracy; with ``weights`` of labels also weight (null for a label without one)."""
    wrong = F.count_if(F.col(truth) != F.col(predicted))
    out = rows.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n"), wrong.alias("errors"), F.round(1 - wrong / F.count("*"), 6).alias("accuracy"))
    return out.withColumn("weight", F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("label").cast("string")]) if weights else out


@dataclass(frozen=True)
class Tagger:
    """Label scores of hashed features, and of a label after another."""

    labels: tuple[str, ...]
    weights: np.ndarray  # width x labels
    follows: np.ndarray  # labels x labels, the first row from
    width: int

    def decode(self, slots: Sequence[np.ndarray]) -> list[str]:
        """The best label sequence of one sentence, whose tokens have these feature slots."""
        if not len(slots):
            return []
        score = np.stack([self.weights[s].sum(axis=0) for s in slots])
        best, back = score[0], []
        for row in score[1:]:
            step = best[:, None] + self.follows
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [self.labels[i] for i in reversed(path)]


SLOTTED = ("lower", "shape", "is_quantity", "is_unit", "is_fraction", "is_stop", "is_punct", "prev_token", "prev_is_quantity", "prev_is_digit", "next_token", "next_is_unit", "next_is_ingredient", "BOS", "EOS")


def slotted(featured: DataFrame, width: int) -> DataFrame:
    """``slots``: the hashed places of a token's features."""
    return featured.withColumn("slots", F.array(*[F.pmod(F.xxhash64(F.lit(c), F.col(c).cast("string")), F.lit(width)).cast("int") for c in SLOTTED]))


class _Chains:
    """Sentences laid end to end, longest first, so that a step of a recursion is one operation over all that go on."""

    def __init__(self, slots: np.ndarray, y: np.ndarray, weight: np.ndarray, lengths: np.ndarray, width: int, labels: int) -> None:
        order = np.argsort(-lengths, kind="stable")
        begins = np.cumsum(lengths) - lengths
        at = np.concatenate([np.arange(begins[i], begins[i] + lengths[i]) for i in order])
        self.slots, self.y, self.width, self.labels = slots[at], y[at], width, labels
        self.lengths = lengths[order]
        self.begins = np.cumsum(self.lengths) - self.lengths
        means = np.array([weight[begins[i] : begins[i] + lengths[i]].mean() for i in order])
        self.weight = np.repeat(means, self.lengths)
        self.first = np.zeros(len(at), bool)
        self.first[self.begins] = True
        self.going = [int((self.lengths > t).sum()) for t in range(int(self.lengths[0]))]

    def loss(self, x: np.ndarray, squared: float) -> tuple[float, np.ndarray]:
        """Weighted negative log-likelihood plus ``squared`` times the sum of squares, and its gradient."""
        size, n = self.width * self.labels, len(self.y)
        w, follows = x[:size].reshape(self.width, self.labels), x[size:].reshape(self.labels, self.labels)
        score = w[self.slots].sum(axis=1)
        top = score.max(axis=1)
        e, step = np.exp(score - top[:, None]), np.exp(follows - follows.max())
        ahead, scale, back = np.empty_like(e), np.empty(n), np.ones_like(e)
        for t, k in enumerate(self.going):
            i = self.begins[:k] + t
            row = e[i] if t == 0 else (ahead[i - 1] @ step) * e[i]
            scale[i] = row.sum(axis=1)
            ahead[i] = row / scale[i][:, None]
        for t in range(len(self.going) - 1, 0, -1):
            i = self.begins[: self.going[t]] + t
            back[i - 1] = ((e[i] * back[i]) @ step.T) / scale[i][:, None]
        later = np.flatnonzero(~self.first)
        gold = score[np.arange(n), self.y]
        gold[later] += follows[self.y[later - 1], self.y[later]]
        total = np.log(scale) + top
        total[later] += follows.max()
        excess = ahead * back
        excess[np.arange(n), self.y] -= 1
        excess *= self.weight[:, None]
        flat = self.slots.reshape(-1)
        by_slot = np.stack([np.bincount(flat, np.repeat(excess[:, j], self.slots.shape[1]), self.width) for j in range(self.labels)], axis=1)
        onward = (e[later] * back[later]) * (self.weight[later] / scale[later])[:, None]
        moves = (ahead[later - 1].T @ onward) * step
        np.subtract.at(moves, (self.y[later - 1], self.y[later]), self.weight[later])
        value = float((self.weight * (total - gold)).sum() + squared * (x @ x))
        return value, np.concatenate([by_slot.reshape(-1), moves.reshape(-1)]) + 2 * squared * x


def least(f, x: np.ndarray, absolute: float = 0.0, steps: int = 100, memory: int = 6, tolerance: float = 1e-5) -> np.ndarray:
    """Where ``f`` (value and gradient) plus ``absolute`` times the sum of absolute values is least: limited-memory quasi-Newton steps that stay in the orthant where they start."""
    value, g = f(x)
    pairs: deque = deque(maxlen=memory)
    for _ in range(steps):
        slope = np.where(x != 0, g + absolute * np.sign(x), np.sign(g) * np.maximum(np.abs(g) - absolute, 0))
        if np.linalg.norm(slope) <= tolerance * max(1.0, np.linalg.norm(x)):
            break
        way, kept = -slope, []
        for s, y in reversed(pairs):
            kept.append(a := (s @ way) / (s @ y))
            way = way - a * y
        if pairs:
            s, y = pairs[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            way = way + (a - (y @ way) / (s @ y)) * s
        way = np.where(way * slope < 0, way, 0.0) if absolute else way
        orthant = np.where(x != 0, np.sign(x), -np.sign(slope))
        size, before = (1.0 if pairs else 1 / np.linalg.norm(slope)), value + absolute * np.abs(x).sum()
        while True:
            new = x + size * way
            new = np.where(new * orthant < 0, 0.0, new) if absolute else new
            new_value, new_g = f(new)
            if new_value + absolute * np.abs(new).sum() <= before + 1e-4 * (slope @ (new - x)):
                break
            size /= 2
            if size < 1e-12:
                return x
        if (new - x) @ (new_g - g) > 1e-12:
            pairs.append((new - x, new_g - g))
        x, value, g = new, new_value, new_g
    return x


def fit_tagger(rows: DataFrame, label: str = "label", width: int = 4096, most: int = 50_000, c1: float = 0.1, c2: float = 0.1, steps: int = 100) -> Tagger:
    """A conditional random field from slotted rows (id, i, slots, label, weight), with penalties ``c1`` on absolute and ``c2`` on squared weights.

    Fitted on a bounded sample of about ``most`` tokens: whole sentences, by hash of the id. A sentence counts by the mean weight of its tokens.
    """
    n = rows.count()
    part = rows if n <= most else rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    data = part.orderBy("id", "i").select("id", "slots", label, "weight").limit(2 * most).collect()
    labels = tuple(sorted({r[label] for r in data}))
    at = {x: i for i, x in enumerate(labels)}
    lengths = np.array(list(Counter(r["id"] for r in data).values()))
    weight = np.array([r["weight"] or 1.0 for r in data])
    chains = _Chains(np.array([r["slots"] for r in data]), np.array([at[r[label]] for r in data]), weight / weight.mean(), lengths, width, len(labels))
    x = least(lambda v: chains.loss(v, c2), np.zeros((width + len(labels)) * len(labels)), c1, steps)
    size = width * len(labels)
    return Tagger(labels, x[:size].reshape(width, -1), x[size:].reshape(len(labels), -1), width)


def save_tagger(spark: SparkSession, path: str, tagger: Tagger) -> None:
    saved(spark, path, {"labels": list(tagger.labels), "weights": tagger.weights, "follows": tagger.follows, "width": tagger.width})


def load_tagger(spark: SparkSession, path: str) -> Tagger:
    parts = loaded(spark, path)
    return Tagger(tuple(parts["labels"]), np.array(parts["weights"]), np.array(parts["follows"]), parts["width"])


def feature_lists(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """keep..., ``features``: for each token of a sentence, in order, a struct of it and its neighbours (empty at the ends), without a shuffle."""
    at = lambda i: F.coalesce(F.lower(F.get(tokens, i)), F.lit(""))
    one = lambda w, i: F.struct(w.alias("token"), F.lower(w).alias("lower"), at(i - 1).alias("prev_token"), at(i + 1).alias("next_token"), (i == 0).alias("BOS"), (i == F.size(tokens) - 1).alias("EOS"))
    return df.select(*keep, F.transform(tokens, one).alias("features"))


def tagged(sentences: DataFrame, tagger: Tagger) -> DataFrame:
    """``sentences`` (id, slots: array of arrays, in order) with labels: an array as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tagger.decode([np.array(s) for s in (sentence or [])]) for sentence in batch.column("slots").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "labels": pa.array(found, pa.list_(pa.string()))})

    return sentences.select("id", "slots").mapInArrow(run, f"id {sentences.schema['id'].dataType.simpleString()}, labels array<string>")
