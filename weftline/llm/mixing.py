"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by hash into 256 blocks. A source's target is drawn as whole epochs
over its blocks, each in an order of its own, and a last part epoch that stops inside one block before the document that would exceed the
target; the one document not drawn in it whose size is nearest to what is left closes the gap. How many of each source's block draws an output
shard gets is settled by halving the shards again and again: at each node the left half's quotas are
one multivariate-hypergeometric draw from the node's, so quotas stay exact and shards look like the
whole. A shard then takes its share of each source's permuted draws, all disjoint, and its rows are
ordered by hash.

Everything about documents is DataFrame work. The driver sees the words of each source, and block totals,
256 numbers for each, of ``PLANNED`` sources at a time; the plan is broadcast where there are no more
sources than that, and joined by source where there are.

Rows: a null text has no words, a null source is a source of its own (last in order), repeated rows
share their fate, an empty table gives an empty table. A source without words has target 0 and its
documents are not drawn. Reruns agree: all choices follow from ``seed``, ids and sources. Long texts are counted
whole. Other columns pass through; those named like the results (``mix_size``, ``mix_source_size``,
``mix_target``, ``mix_shards``) are replaced, and names that begin with ``__mix_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import drop, staged

BLOCKS = 256
#: Sources that are planned, and sent to every task, at once; more are planned in turns, and joined.
PLANNED = 4096
#: A mix has a shard for so many words, and no fewer than LEAST_SHARDS.
SHARD_WORDS, LEAST_SHARDS = 100_000_000, 64
RESULTS = ("mix_size", "mix_source_size", "mix_target", "mix_shards")
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> dict:
    """Words to take from each source: shares by weight (repeating, by code point, null last) of all words, at most ``cap`` times a source's own; what is above goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > cap * sizes[s]]
        if not full:
            return out | {s: weight[s] * share for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source for each shard: rows sum to the quotas, columns differ by one at most."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = int(quotas.sum())
    room = [total * (k + 1) // shards - total * k // shards for k in range(shards)]

    def node(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = own
            return
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, sum(room[lo:mid]), method="marginals")
        node(lo, mid, left)
        node(mid, hi, own - left)

    if len(quotas):
        node(0, shards, quotas)
    return out


def _digit(key: Column, level: int) -> Column:
    """One byte of the key: level 0 is the block, later ones order documents inside it."""
    return F.shiftrightunsigned(key, 56 - 8 * level).bitwiseAND(F.lit(255)).cast("int")


def plan(sized: DataFrame, weights: Sequence[float], cap: float, shards: int | None, seed: int) -> list[dict]:
    """For each source: words, target, the shards of each block's draws, and where the last part epoch stops.

    ``sized``: __source, __size, __key. One pass for the sources' words, one for block totals, then one over the blocks in which
    some epoch stops for each further byte of the key, until one document (or its repeats) is left.
    """
    words = sized.groupBy("__source").agg(F.sum("__size").alias("words"))
    sizes = {r["__source"]: r["words"] for r in words.collect()}
    want = targets(sizes, weights, cap)
    order = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    parts = -(-len(sizes) // PLANNED) or 1
    ordered: list[dict] = []
    for part in range(parts):
        # So many sources at a time that the driver holds their block totals.
        own = sized if parts == 1 else sized.filter(F.pmod(F.xxhash64("__source"), F.lit(parts)) == part)
        ordered += _planned(own, want, order, cap, seed)
    ordered.sort(key=lambda p: order[p["source"]])
    shards = shards or max(LEAST_SHARDS, -(-sum(sizes.values()) // SHARD_WORDS))
    quotas = split_quotas(np.array([len(p["draws"]) for p in ordered], np.int64), shards, seed)
    for p, own in zip(ordered, quotas, strict=True):
        p["shards"] = [[] for _ in range(BLOCKS)]
        for block, shard in zip(p.pop("draws"), np.repeat(np.arange(shards), own), strict=True):
            if block < BLOCKS:
                p["shards"][block].append(int(shard))
            else:
                p["last_shard"] = int(shard)
    return ordered


def _planned(sized: DataFrame, want: dict, order: dict, cap: float, seed: int) -> list[dict]:
    """The draws of each source in ``sized``, and where its last part epoch stops."""
    bins = lambda rows, level: rows.groupBy("__source", _digit(F.col("__key"), level).alias("bin")).agg(F.sum("__size").alias("words"), F.min("__key").alias("lo"), F.max("__key").alias("hi")).collect()
    blocks: dict = {}
    for r in bins(sized, 0):
        blocks.setdefault(r["__source"], {})[r["bin"]] = r
    sizes = {s: sum(r["words"] for r in b.values()) for s, b in blocks.items()}
    plans, open_ = {}, {}
    for s, b in sorted(blocks.items(), key=lambda x: order[x[0]]):
        epochs = min(int(want[s] // sizes[s]), int(cap)) if sizes[s] else 0
        rest = want[s] - epochs * sizes[s] if epochs < cap and sizes[s] else 0.0
        orders = [[int(x) for x in np.random.default_rng([seed, order[s], e]).permutation(BLOCKS) if int(x) in b] for e in range(epochs + 1)]
        whole, at = [], None
        for x in orders[epochs]:
            if b[x]["words"] > rest:
                at = x
                break
            rest -= b[x]["words"]
            whole.append(x)
        at = at if rest > 0 else None
        plans[s] = {"source": s, "words": sizes[s], "target": float(want[s]), "draws": [x for o in orders[:epochs] for x in o] + whole + ([at] if at is not None else []), "at": -1 if at is None else at, "upto": None, "part": whole, "last": None, "last_shard": None}
        if at is not None:
            open_[s] = {"path": [at], "rest": rest, "below": None, "one": b[at] if b[at]["lo"] == b[at]["hi"] else None}
    for level in range(1, 8):
        todo = {s: o for s, o in open_.items() if o["one"] is None}
        if not todo:
            break
        # The few open prefixes, one for each source, choose the rows of this pass.
        prefix = {s: int.from_bytes(bytes(o["path"]), "big") for s, o in todo.items()}
        chosen = F.lit(False)
        by_source = F.create_map(*[x for s, v in prefix.items() if s is not None for x in (F.lit(s), F.lit(v))]) if any(s is not None for s in prefix) else None
        top = F.shiftrightunsigned("__key", 64 - 8 * level)
        if by_source is not None:
            chosen = F.coalesce(top == by_source[F.col("__source")], F.lit(False))
        if None in prefix:
            chosen = chosen | (F.col("__source").isNull() & (top == F.lit(prefix[None])))
        found: dict = {}
        for r in bins(sized.filter(chosen), level):
            found.setdefault(r["__source"], []).append(r)
        for s, o in todo.items():
            for r in sorted(found[s], key=lambda r: r["bin"]):
                if r["words"] > o["rest"]:
                    o["path"].append(r["bin"])
                    o["one"] = r if r["lo"] == r["hi"] or level == 7 else None
                    break
                o["rest"] -= r["words"]
                o["below"] = _above(r["hi"], o["below"])
    for s, o in open_.items():
        plans[s] |= {"upto": o["below"], "rest": o["rest"]}
        if o["below"] is None:
            plans[s]["draws"].pop()
            plans[s]["at"] = -1
    _close(sized, plans)
    return list(plans.values())


def _close(sized: DataFrame, plans: dict) -> None:
    """Adds the document (with its repeats) that brings each part epoch nearest to its target, as a draw of its own."""
    rows = [(s, [b in set(p["part"]) for b in range(BLOCKS)], p["at"], p["upto"], p["rest"]) for s, p in plans.items() if p.get("rest")]
    if not rows:
        return
    bounded = sized.sparkSession.createDataFrame(rows, "__of string, __part array<boolean>, __at int, __upto long, __rest double")  # PLANNED rows at most
    block = _digit(F.col("__key"), 0)
    drawn = F.when(block == F.col("__at"), ~_beyond("__key", "__upto")).otherwise(F.get("__part", block))
    free = sized.filter(F.col("__size") > 0).join(F.broadcast(bounded), F.col("__source").eqNullSafe(F.col("__of"))).filter(~drawn)
    free = free.groupBy("__source", "__key").agg(F.sum("__size").alias("words"), F.first("__rest").alias("rest"))
    for r in free.groupBy("__source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("rest")).alias("off"), "__key")).alias("best"), F.first("rest").alias("rest")).collect():
        if r["best"]["off"] < r["rest"]:
            plans[r["__source"]]["last"] = r["best"]["__key"]
            plans[r["__source"]]["draws"].append(BLOCKS)


def _beyond(key: str, upto: str) -> Column:
    """Whether a key comes after another as unsigned numbers."""
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))
    return flip(key) > flip(upto)


def _above(a: int, b: int | None) -> int:
    """The greater of two keys as unsigned numbers."""
    return a if b is None or a % 2**64 > b % 2**64 else b


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, shards: int | None = None, seed: int = 7) -> DataFrame:
    """``df`` with mix_size, mix_source_size, mix_target (words) and mix_shards, the shard of each copy that the mix takes (empty: none).

    ``shards``: how many; by the words of the table if not given. Two narrow aggregates over (source, size, key); the texts are not shuffled.
    """
    df = df.drop(*[c for c in RESULTS if c in df.columns and c not in (id_col, text_col, source_col)])
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col))
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(text_col, F.lit(WORD))).cast("long")
    sized = staged(df.select(F.col(source_col).cast("string").alias("__source"), size.alias("__size"), key.alias("__key")), "sizes")
    plans = plan(sized, weights, cap, shards, seed)
    drop(sized)
    rows = [(p["source"], p["words"], p["target"], p["shards"], p["at"], p["upto"], p["last"], p["last_shard"]) for p in plans]
    named = {"of": "string", "words": "long", "target": "double", "draws": "array<array<int>>", "at": "int", "upto": "long", "last": "long", "last_shard": "int"}
    bounded = df.sparkSession.createDataFrame(rows, ", ".join(f"__mix_{k} {v}" for k, v in named.items()))  # a row for each source
    bounded = F.broadcast(bounded) if len(rows) <= PLANNED else staged(bounded, "plan")
    joined = df.withColumns({"__mix_size": size, "__mix_key": key}).join(bounded, F.col(source_col).cast("string").eqNullSafe(F.col("__mix_of")), "left")
    block = _digit(F.col("__mix_key"), 0)
    own = F.get("__mix_draws", block)
    # In the block where the part epoch stops, documents beyond the stop have one draw fewer.
    cut = (block == F.col("__mix_at")) & _beyond("__mix_key", "__mix_upto")
    drawn = F.when(cut, F.slice(own, 1, F.size(own) - 1)).otherwise(own)
    drawn = F.when(F.col("__mix_key") == F.col("__mix_last"), F.array_append(drawn, F.col("__mix_last_shard"))).otherwise(drawn)
    taken = F.when(F.col("__mix_size") == 0, F.slice(own, 1, 0)).otherwise(drawn)
    results = (F.col("__mix_size"), F.col("__mix_words"), F.col("__mix_target"), taken)
    return joined.select(*(F.col(c) for c in df.columns), *(c.alias(n) for c, n in zip(results, RESULTS, strict=True)))


def shards(mixed: DataFrame, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """The copies of a mix: a row for each, with mix_shard; rows of a shard stand together, ordered by hash. One shuffle of what the mix takes."""
    copies = mixed.select(*[c for c in mixed.columns if c != "mix_shards"], F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    return copies.repartition("mix_shard").sortWithinPartitions("mix_shard", F.xxhash64(F.lit(seed + 1), F.col(id_col).cast("string"), "mix_copy"))
