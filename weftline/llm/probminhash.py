"""Near-duplicate documents by ProbMinHash.

A document is the weighted set of its five-word shingles; a shingle that stands n times weighs
1 + ln n. Each shingle sends arrivals of a Poisson process with its weight as rate; each arrival falls
on a random one of M registers, and a register keeps the shingle that arrived first. Two documents
agree in a register with the probability Jaccard similarity of their weighted sets. Shingles stop
sending once their next arrival is later than every register's first. Arrivals are generated for many
documents together, one arrival of each live shingle at a time.

Bands of registers name the pairs to compare; documents are linked if the exact Jaccard similarity of
their sets of shingles is 0.8 or more; distributed union-find joins links into classes.

Rows: words are ``[^\\x20\\x09-\\x0D]+``, case counts. A text of one to four words is one shingle. Texts
with equal word sequences are copies. Null texts and texts without words are alike to nothing and each
its own class. Texts whose rows have no id are linked to copies alone. Rows that repeat an id with the same words are one document of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textvec
from weftline.llm.components import BLOOM, linked, similar
from weftline.llm.staging import drop, setting, small_batches, staged, tidy

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5


def shingles(column: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, count; and two hashes of each text's words (both 0 without words)."""
    data, offsets = textvec.utf8(column)
    texts = len(offsets) - 1
    start, end, n_words = textvec.words(data, offsets)
    h = textvec.hashes(data, start, end)
    owner = np.repeat(np.arange(texts), n_words)
    # Whole texts: sums over words of hashes that know the position, mixed.
    place = (np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)).astype(np.uint64)
    ends = np.cumsum(n_words)
    whole = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textvec.mix(h * np.uint64(salt) + textvec.mix(place + np.uint64(salt))), dtype=np.uint64)])
        whole.append(textvec.mix(total[ends] - total[ends - n_words] + n_words.astype(np.uint64)))
        whole[-1][n_words == 0] = 0
    # A text of fewer than n words has one shingle, of all its words: those that are missing count as 0.
    first = np.flatnonzero((place == 0) | (np.concatenate([owner[n - 1 :] == owner[: len(owner) - n + 1], np.zeros(min(n - 1, len(owner)), bool)]))) if len(h) else np.zeros(0, np.int64)
    gram = np.zeros(len(first), np.uint64)
    for i in range(n):
        at = np.minimum(first + i, max(len(h) - 1, 0))
        inside = (first + i < len(h)) & (owner[at] == owner[first]) if len(h) else np.zeros(0, bool)
        gram = textvec.mix(gram * np.uint64(3) + np.where(inside, h[at] if len(h) else gram, 0).astype(np.uint64))
    of = owner[first]
    _, at, counts = np.unique(textvec.mix(gram + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_counts=True)
    order = np.argsort(of[at], kind="stable")
    return of[at][order], gram[at][order], counts[order], whole[0], whole[1]


def registers(of: np.ndarray, item: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """For each text and register, the item that arrived there first (0 where the text has no items)."""
    soonest = np.full(texts * m, np.inf)
    winner = np.zeros(texts * m, np.uint64)
    clock = np.zeros(len(item))
    turn = 0
    while len(item):
        turn += 1
        draw = textvec.mix(item + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64))
        clock = clock - np.log(textvec.unit(draw)) / weight
        at = of * m + (textvec.mix(draw + np.uint64(0x632BE59BD9B4E019)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(soonest, at, clock)
        won = soonest[at] == clock
        winner[at[won]] = item[won]
        live = clock < soonest.reshape(texts, m).max(axis=1)[of]
        of, item, weight, clock = of[live], item[live], weight[live], clock[live]
    return winner.reshape(texts, m)


def _sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h1, h2 (null without words), n_shingles, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                n = piece.num_rows
                of, gram, counts, h1, h2 = shingles(piece.column("text"))
                won = registers(of, gram, 1 + np.log(counts), n, BANDS * ROWS).reshape(n, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
                for r in range(ROWS):
                    key = textvec.mix(key * np.uint64(3) + won[:, :, r])
                empty = (h1 == 0) & (h2 == 0)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_pydict({"id": piece.column("id"), "h1": pa.array(h1.view(np.int64), mask=empty), "h2": pa.array(h2.view(np.int64), mask=empty), "n_shingles": pa.array(np.bincount(of, minlength=n)), "bands": bands})

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, h1 long, h2 long, n_shingles long, bands array<long>")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """id, class_id (the least id of its class), n_copies (rows with the same words), n_shingles: a row for each row of ``df``."""
    sketched = staged(_sketched(df, id_col, text_col), "sketches")
    grouped = sketched.filter("h1 is not null").groupBy("h1", "h2")
    texts = grouped.agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("weight"))
    nodes = staged(texts.select(F.monotonically_increasing_id().alias("node"), "*"), "texts")

    def payload_of(some: DataFrame) -> DataFrame:
        # A text is read from the row of its first id; where that id has several texts, hashes tell which.
        wanted = staged(nodes.join(some, "node").select("node", "bands", F.col("first").alias("__first"), F.col("h1").alias("__h1")), "wanted")
        docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
        with setting(df.sparkSession, **BLOOM):
            sets = staged(_keep_own(docs.join(wanted.filter("node >= 0"), F.col("__id") == F.col("__first"))), "sets")
        drop(wanted)
        return sets

    components = linked(nodes.select("node", "bands", "weight"), payload_of, lambda a, b: similar(a, b, threshold))
    rooted = nodes.select("node", "h1", "h2", "first", "copies")
    if components is None:
        found = rooted.withColumn("class_id", F.col("first"))
    else:
        rooted = rooted.join(components, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("class_id")), "root")
    found = staged(found.select("h1", "h2", "class_id", "copies"), "classes")
    drop(nodes, components)
    out = sketched.select("id", "h1", "h2", "n_shingles").join(found, ["h1", "h2"], "left")
    class_id = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id")
    return out.select("id", class_id, F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), "n_shingles")


def _keep_own(texts: DataFrame) -> DataFrame:
    """Shingle sets (items) of the texts whose words are those of their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                of, gram, _, h1, _ = shingles(piece.column("text"))
                own = h1.view(np.int64) == piece.column("__h1").to_numpy()
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=piece.num_rows))]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_pydict({"node": piece.column("node"), "bands": piece.column("bands"), "items": sets}).filter(pa.array(own))

    found = texts.select("node", "bands", "__h1", "text").mapInArrow(tidy(run), "node long, bands array<long>, items array<long>")
    return found.dropDuplicates(["node"])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """``df`` without near duplicates: of each class the row with the least id stays (of rows that repeat it, one). Rows without an id all stay."""
    found = classes(df, id_col, text_col, threshold).filter(F.col("id") == F.col("class_id")).select(F.col("id").alias("__id")).distinct()
    kept = df.join(found, F.col(id_col) == F.col("__id"), "left_semi").withColumn("__key", F.xxhash64(text_col)).dropDuplicates([id_col, "__key"]).drop("__key")
    return kept.unionByName(df.filter(F.col(id_col).isNull()))
