"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts n-grams of labelled texts; a language's filter gets those whose share of the
language's n-grams is not far below their highest share in any language. All
filters share one table of bit masks: row r holds, for every language, bit r of its filter, so a few
reads and an AND give the set of languages that contain an n-gram. A text's n-grams are looked up, hits
are counted by language, each count is corrected for the filter's measured false-positive rate, and the
largest share decides.

Text is lower-cased, runs of anything but letters become one space. Null texts and texts without a
letter are ``und`` with score 0. Labels that are null take no part; with no labelled text everything
is ``und``. Ties go to the language first in code-point order. Repeated rows count and are judged as often
as they stand, long texts whole, rows without an id as others; an empty table gives an empty table. Other
columns pass through; those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import textvec
from weftline.llm.staging import small_batches, tidy

ORDERS = (3, 5)
SLOTS = 1 << 20
#: N-grams of a smaller share of their language's are no evidence; fewer than 1 / LEAST_SHARE are left for a language.
LEAST_SHARE = 1 / 100_000
PROBES = 3
UNDECIDED = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the number of the text of each, and whether each text has a letter."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [*(len(t) + 1 for t in lowered), 1]) if texts else np.zeros(len(codes), np.int64)
    letter = _letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[0] = True
    codes, owner = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep]
    has = np.zeros(len(texts) + 1, bool)
    has[owner[codes != 32]] = True
    found, of = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
        # Each text begins with the space that ends the one before, so an n-gram belongs to the text of its second letter.
        whole = owner[1 : len(codes) - n + 2] == owner[n - 2 : len(codes) - 1] if n > 2 else np.ones(len(h), bool)
        whole &= codes[1 : len(codes) - n + 2] != 32
        found.append(textvec.mix(h[whole]))
        of.append(owner[1 : len(codes) - n + 2][whole])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has[: len(texts)]
    return np.concatenate(found), np.concatenate(of), has[: len(texts)]


def slots(h: np.ndarray, probe: int) -> np.ndarray:
    """The table row that an n-gram reads at a probe (double hashing)."""
    return ((h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # SLOTS x words of 64 languages
    false_rate: np.ndarray  # by language

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray]) -> Model:
        names = sorted(by_language)
        table = np.zeros((SLOTS, max(1, -(-len(names) // 64))), np.uint64)
        rates = np.zeros(len(names))
        for i, name in enumerate(names):
            rows = np.zeros(SLOTS, bool)
            for p in range(PROBES):
                rows[slots(by_language[name], p)] = True
            table[rows, i // 64] |= np.uint64(1 << (i % 64))
            rates[i] = rows.mean() ** PROBES
        return cls(names, table, rates)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of all languages that contain it."""
        masks = self.table[slots(h, 0)]
        for p in range(1, PROBES):
            masks &= self.table[slots(h, p)]
        return masks

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of its n-grams that its language holds."""
        h, of, has = ngrams(texts)
        n = np.bincount(of, minlength=len(texts)).astype(float)
        shares = np.zeros((len(texts), len(self.languages)))
        masks = self.languages_of(h) if self.languages else None
        for i in range(len(self.languages)):
            hits = np.bincount(of[(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
            shares[:, i] = np.clip((hits - n * self.false_rate[i]) / (1 - self.false_rate[i]), 0, None) / np.maximum(n, 1)
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        best = shares.argmax(axis=1)
        return [self.languages[b] if ok else UNDECIDED for b, ok in zip(best, has, strict=True)], np.where(has, np.clip(shares.max(axis=1), 0, 1), 0.0)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, rows_per_language: int = 2000, relative: float = 0.2) -> Model:
    """A model from labelled rows of ``df``.

    Fitted on a bounded sample: about ``rows_per_language`` whole texts of each language, chosen by a hash of ``key``
    (default: of the text). A language's n-grams count that stand twice, are at least ``LEAST_SHARE`` of all its n-grams, and have
    at least ``relative`` of their highest share in any language; so the filters' false-positive rates stay low whatever the corpus is.
    """
    spark = df.sparkSession
    key = F.col(text_col) if key is None else key
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model.build({})
    part = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1_000_000, 1_000_000 * rows_per_language // n + 1)))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1_000_000)) < part[F.col(lang_col).cast("string")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                langs = piece.column("lang").to_pylist()
                names = sorted(set(langs))
                h, of, _ = ngrams(piece.column("text").to_pylist())
                of = np.array([names.index(x) for x in langs])[of]
                for i, name in enumerate(names):
                    grams, n = np.unique(h[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    small_batches(spark)
    grams = chosen.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = F.broadcast(grams.groupBy("lang").agg(F.sum("n").alias("total")))  # a row for each language
    shares = grams.join(totals, "lang").select("gram", F.struct("lang", (F.col("n") / F.col("total")).alias("share"), "n").alias("x"))
    # At most one entry for each language in a group.
    by_gram = shares.groupBy("gram").agg(F.collect_list("x").alias("xs"), F.max("x.share").alias("top"))
    kept = by_gram.select("gram", "top", F.explode("xs").alias("x")).filter((F.col("x.share") >= relative * F.col("top")) & (F.col("x.share") >= LEAST_SHARE) & (F.col("x.n") >= 2))
    found = kept.select("x.lang", "gram").toArrow()
    langs, hashes = found.column("lang").combine_chunks().dictionary_encode(), found.column("gram").to_numpy().view(np.uint64)
    names = langs.dictionary.to_pylist() if len(found) else []
    at = langs.indices.to_numpy() if len(found) else np.zeros(0, np.int64)
    out = {lang: hashes[at == names.index(lang)] if lang in names else np.zeros(0, np.uint64) for lang in counts}
    return Model.build(out)


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``df`` with the language and score of each whole text. Narrow; the model (8 MB for each 64 languages) is broadcast."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.table, model.false_rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for piece in textvec.pieces(batch, text_col):
                langs, scores = own.decide(piece.column(text_col).to_pylist())
                kept = {n: piece.column(i) for i, n in enumerate(piece.schema.names) if n not in (lang_col, score_col)}
                yield pa.RecordBatch.from_pydict(kept | {lang_col: pa.array(langs, pa.string()), score_col: pa.array(scores, pa.float64())})

    small_batches(spark)
    fields = [f for f in df.schema.fields if f.name not in (lang_col, score_col)]
    return df.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))
