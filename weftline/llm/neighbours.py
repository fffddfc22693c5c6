"""Approximate nearest neighbours by cosine, with multiprobe p-stable hashing.

Unit vectors are hashed by Gaussian projections cut into cells; a table's bucket is the cells of its
functions. A query visits its own bucket and, in the order of estimated success, those that differ by
one cell in some functions: the less far the query is from the borders it crosses, the sooner. Visits of
all tables are one order. All found are ranked by the exact cosine of the original vectors.

How many buckets a query visits is settled by measurement: true neighbours of a bounded sample of
queries, found by a full scan, must lie in visited buckets for at least ``recall`` of them. Where all
possible visits would not reach that, and for queries that find fewer than ``k``, all vectors are
compared instead, in the same blocks: hashing by no function has one bucket. Equal
vectors are one node with its smallest ids, so groups of copies cost one row. Large buckets are split
into blocks of bounded size on both sides; a block returns a few rows for each of its queries.

Rows: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids
or vectors of another length than most. Repeated rows count once. Ties go to the smaller id; fewer than
``k`` candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.staging import small_batches, staged

BLOCK = 4096
TABLES = 4


@dataclass(frozen=True)
class Hashing:
    """Projections (tables x functions x dimensions), offsets in cells, and the order of perturbations."""

    planes: np.ndarray
    offsets: np.ndarray
    width: float
    template: np.ndarray  # sets of ranks among the 2 x functions borders, by expected success

    @classmethod
    def make(cls, dimensions: int, functions: int, tables: int = TABLES, width: float = 2.0, seed: int = 17) -> Hashing:
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal((tables, functions, dimensions)), rng.random((tables, functions)), width, perturbations(functions))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """vectors x tables x functions, in cells."""
        return np.einsum("nd,tfd->ntf", unit, self.planes) / self.width + self.offsets

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        """One number for the whole cells of a table's functions."""
        key = np.zeros(cells.shape[:-1], np.int64)
        for f in range(cells.shape[-1]):
            key = key * 1_000_003 + cells[..., f].astype(np.int64)
        return key

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table and bucket of each visit of each query, all possible ones, the most promising first."""
        n, (tables, functions, _) = len(unit), self.planes.shape
        cells = self.cells(unit)
        own = np.floor(cells)
        low = cells - own
        borders = np.concatenate([low, 1 - low], axis=2) ** 2  # crossing down, crossing up
        order = np.argsort(borders, axis=2, kind="stable")
        cost = np.take_along_axis(borders, order, 2) @ self.template.T.astype(float)
        step = np.where(order < functions, -1, 1)
        delta = np.zeros((n, tables, len(self.template), functions), np.int64)
        for rank in range(2 * functions):
            at = (order[:, :, rank] % functions)[:, :, None]
            hit = self.template[:, rank][None, None, :] * step[:, :, rank][:, :, None]
            np.put_along_axis(delta, np.broadcast_to(at[..., None], (*hit.shape, 1)), np.take_along_axis(delta, np.broadcast_to(at[..., None], (*hit.shape, 1)), 3) + hit[..., None], 3)
        keys = self.bucket(own[:, :, None, :] + delta)
        # Sets that cross both borders of one function name no bucket of their own: they go last.
        both = np.zeros(cost.shape, bool)
        for f in range(functions):
            places = np.argsort(order, axis=2)
            down, up = places[:, :, f], places[:, :, f + functions]
            both |= (self.template.T[down] & self.template.T[up]).astype(bool).reshape(cost.shape)
        cost = np.where(both, np.inf, cost).reshape(n, -1)
        rank = np.argsort(cost, axis=1, kind="stable")
        table = np.broadcast_to(np.arange(tables)[None, :, None], keys.shape).reshape(n, -1)
        found = np.take_along_axis(keys.reshape(n, -1), rank, 1)
        table = np.where(np.isinf(np.take_along_axis(cost, rank, 1)), -1, np.take_along_axis(table, rank, 1))
        return table, found


def perturbations(functions: int, most: int = 128) -> np.ndarray:
    """The first ``most`` sets of borders by expected cost, as rows of 0 and 1 over border ranks: shift and expand from a heap."""
    m = functions
    if not m:
        return np.zeros((1, 0), np.int64)
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)] + [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    rows = [[0] * (2 * m)]
    heap = [(expected[0], (0,))]
    while heap and len(rows) < most:
        cost, ranks = heapq.heappop(heap)
        # A border's rank and its opposite's add up to 2m - 1 as a rule; such a pair cannot both be crossed.
        if all(2 * m - 1 - r not in ranks for r in ranks):
            rows.append([int(j in ranks) for j in range(2 * m)])
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - expected[last] + expected[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (cost + expected[last + 1], (*ranks, last + 1)))
    return np.array(rows, np.int64)


def usable(id_: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return id_.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to 1 or so: cosines stay as they are, squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, each summed in the same order wherever the rows stand."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


#: Rough products may be off by this much at most.
ROUGH = 1e-9


def best(queries: np.ndarray, vectors: np.ndarray, lead: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, row of the vector, cosine: the ``k`` nearest of each query, ties to the smaller ``lead``.

    All vectors as near as the k-th by a rough product, or nearer, are ranked by their exact cosines.
    """
    rough = _unit(queries) @ _unit(vectors).T
    n = min(len(vectors), 2 * k + 8)
    if n < len(vectors):
        some = np.argpartition(-rough, n - 1, axis=1)[:, :n]
        least = -np.partition(-rough, min(k, len(vectors)) - 1, axis=1)[:, min(k, len(vectors)) - 1] - ROUGH
        more = np.flatnonzero((rough >= least[:, None]).sum(axis=1) > n)
    else:
        some, more = np.broadcast_to(np.arange(n), (len(queries), n)), np.zeros(0, np.int64)
    exact = cosine(queries[:, None, :], vectors[some])
    order = np.lexsort((lead[some], -exact), axis=1)[:, :k]
    found, score = np.take_along_axis(some, order, 1), np.take_along_axis(exact, order, 1)
    for q in more:  # many are equally near, as far as the rough product tells
        near = np.flatnonzero(rough[q] >= least[q])
        own = cosine(queries[q][None, :], vectors[near])
        order = np.lexsort((lead[near], -own))[:k]
        found[q], score[q] = near[order], own[order]
    return np.repeat(np.arange(len(queries)), found.shape[1]), found.reshape(-1), score.reshape(-1)


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: node, h1, h2, vector (packed), ids (the k + 1 smallest), lead (the smallest). Each partition first sums up its own."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, tuple[bytes, list[int]]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"h1": pa.array([x[0] for x in own], pa.int64()), "h2": pa.array([x[1] for x in own], pa.int64()), "vector": pa.array([v for v, _ in own.values()], pa.binary()), "ids": pa.array([i for _, i in own.values()], pa.list_(pa.int64()))})
            own.clear()
            return out

        for batch in batches:
            vectors = batch.column("vector")
            packed = vectors.flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            for i, (h1, h2, id_) in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                ids = own.setdefault((h1, h2), (packed[i].tobytes(), []))[1]
                if id_ not in ids:
                    ids.append(id_)
                    if len(ids) > k + 1:
                        ids.remove(max(ids))
            if len(own) > 50_000:
                yield flush()
        if own:
            yield flush()

    summed = rows.select("h1", "h2", "vector", "id").mapInArrow(partial, "h1 long, h2 long, vector binary, ids array<long>")
    grouped = summed.groupBy("h1", "h2").agg(F.any_value("vector").alias("vector"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    return staged(grouped.select(F.monotonically_increasing_id().alias("node"), "*", F.col("ids")[0].alias("lead")), "vectors")


def _scan(nodes: DataFrame, queries: np.ndarray, d: int, k: int) -> dict[int, list[tuple[float, bytes]]]:
    """The k nearest of a bounded set of queries by a full scan: query number, cosine and vector."""
    shared = nodes.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, row, score = best(shared.value, _matrix(batch.column("vector"), d), np.array(batch.column("lead").to_pylist()), k)
                yield pa.RecordBatch.from_pydict({"q": pa.array(at), "score": pa.array(score), "vector": batch.column("vector").take(pa.array(row))})

    top = nodes.select("vector", "lead").mapInArrow(run, "q long, score double, vector binary")
    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).filter(F.col("r") <= k)
    out: dict[int, list[tuple[float, bytes]]] = {}
    for r in ranked.collect():
        out.setdefault(r["q"], []).append((r["score"], bytes(r["vector"])))
    return out


def enough_visits(hashing: Hashing, queries: np.ndarray, near: dict[int, list[tuple[float, bytes]]], recall: float) -> int:
    """The least number of visits by which ``recall`` of the true neighbours lie in a visited bucket; 0 if all visits there are do not reach it."""
    table, bucket = hashing.visits(_unit(queries))
    first = []
    for q, found in near.items():
        x = np.frombuffer(b"".join(v for _, v in found), np.float64).reshape(len(found), -1)
        own = hashing.bucket(np.floor(hashing.cells(_unit(x))))
        for row in own:
            hit = np.zeros(table.shape[1], bool)
            for t, b in enumerate(row):
                hit |= (table[q] == t) & (bucket[q] == b)
            first.append(int(hit.argmax()) + 1 if hit.any() else table.shape[1] + 1)
    least = int(np.quantile(first, recall, method="higher")) if first else 1
    return least if least <= table.shape[1] else 0


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = 0.96, sample: int = 128, seed: int = 17) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest that are found for each row where ``is_query`` holds."""
    spark = df.sparkSession
    small_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = df.filter(usable(F.col(id_col), F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return empty
    d = common["d"]
    rows = rows.filter(F.size("vector") == d).select("id", "asks", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"))
    nodes = _nodes(rows, k)
    n = nodes.count()
    asked = staged(rows.filter("asks").select(F.col("id").alias("query_id"), "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("query_id", "node"), "asked")
    asking = staged(nodes.join(asked.select("node").distinct(), "node").select("node", "vector", "lead"), "asking")
    chosen = asking.orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    if not chosen:
        return empty
    hashing = Hashing.make(d, max(1, math.ceil(math.log(max(n, 1) / 4000, 3.5))), seed=seed)
    known = np.frombuffer(b"".join(bytes(r["vector"]) for r in chosen), np.float64).reshape(-1, d)
    visits = enough_visits(hashing, known, _scan(nodes, known, d, k + 1), recall)
    every = Hashing.make(d, 0, tables=1, seed=seed)
    found = staged(_blocks(_grid(hashing if visits else every, visits or 1, d, nodes, asking), d, k + 1), "found").dropDuplicates(["q", "node"])
    if visits:
        # Queries that found fewer vectors than there are to find are compared with all.
        counts = found.groupBy(F.col("q").alias("node")).agg(F.count("*").alias("n"))
        short = staged(asking.join(counts, "node", "left").filter(F.coalesce("n", F.lit(0)) < min(k + 1, n)).select("node", "vector", "lead"), "short")
        if not short.isEmpty():
            found = found.unionByName(_blocks(_grid(every, 1, d, nodes, short), d, k + 1)).dropDuplicates(["q", "node"])
    byquery = asked.withColumnRenamed("node", "q").join(found, "q").join(nodes.select("node", "ids"), "node")
    hits = byquery.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grid(hashing: Hashing, visits: int, d: int, nodes: DataFrame, asking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries by table, bucket and block: each bucket is cut into blocks of about BLOCK vectors by BLOCK queries."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = hashing.bucket(np.floor(hashing.cells(_unit(_matrix(batch.column("vector"), d))))) if batch.num_rows else np.zeros((0, 1), np.int64)
            for t in range(own.shape[1]):
                yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(own), t, np.int32)), "bucket": pa.array(own[:, t]), "node": batch.column("node"), "vector": batch.column("vector"), "lead": batch.column("lead")})

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                table, bucket = (x[:, :visits] for x in hashing.visits(_unit(_matrix(part.column("vector"), d))))
                row, col = np.nonzero(table >= 0)
                yield pa.RecordBatch.from_pydict({"t": pa.array(table[row, col].astype(np.int32)), "bucket": pa.array(bucket[row, col]), "node": part.column("node").take(pa.array(row)), "vector": part.column("vector").take(pa.array(row))})

    index = staged(nodes.select("node", "vector", "lead").mapInArrow(placed, "t int, bucket long, node long, vector binary, lead long"), "index")
    probes = staged(asking.select("node", "vector").mapInArrow(visited, "t int, bucket long, node long, vector binary"), "visits")
    size = lambda x, name: x.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = staged(size(index, "vs").join(size(probes, "qs"), ["t", "bucket"]), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.join(sizes, ["t", "bucket"]).select("t", "bucket", F.pmod(F.xxhash64("node"), "vs").cast("int").alias("v"), every("qs").alias("q"), "node", "vector", "lead")
    probes = probes.join(sizes, ["t", "bucket"]).select("t", "bucket", every("vs").alias("v"), F.pmod(F.xxhash64("node"), "qs").cast("int").alias("q"), "node", "vector")
    return index, probes


def _blocks(grid: tuple[DataFrame, DataFrame], d: int, k: int) -> DataFrame:
    """q, node, score: the k nearest of each query in each block."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return pa.table({"q": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, lead, node = _matrix(vectors.column("vector").combine_chunks(), d), vectors.column("lead").to_numpy(), vectors.column("node").to_numpy()
        out: dict[str, list] = {"q": [], "node": [], "score": []}
        for at in range(0, len(queries), 512):
            part = queries.slice(at, 512)
            row, col, score = best(_matrix(part.column("vector").combine_chunks(), d), x, lead, k)
            out["q"].append(part.column("node").to_numpy()[row])
            out["node"].append(node[col])
            out["score"].append(score)
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in out.items()})

    keys = ("t", "bucket", "v", "q")
    return grid[0].groupBy(*keys).cogroup(grid[1].groupBy(*keys)).applyInArrow(run, "q long, node long, score double")
