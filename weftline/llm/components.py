"""Linking near duplicates: candidates from band keys, exact comparison, and distributed union-find.

Members of one band bucket are candidates. What is asked for are the components of all links between
candidates, so two members need not be compared once they are known to be in one component:

1. every bucket of two is compared, and in larger ones each member with the bucket's hub;
2. a bucket whose members are then in several components keeps an anchor, a member of its largest one.
   Members outside the anchor's component seek: wave by wave they are compared with the next, larger
   slice of the bucket, leaving out members of their own component, until the slices have covered the
   bucket or nobody seeks.

Of two members of a bucket that end up apart at least one was outside the anchor's component all along
and met the other in that other's slice; so the components are exactly those of all candidates, at any
size of bucket. A wave takes seekers and slice in blocks of bounded number and weight, each block
against each, so no bucket is gathered in one task. Only links between components leave a block.

What is kept about members and links is dealt to all tasks where it is large. Tables of ``FEW`` rows or fewer
are taken in one task, and so few links are joined by the driver: the same steps with the same results, without
a round of tasks for each. Payloads are always compared by all tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import drop, staged

#: Members that a seeker meets in the first wave, and how many times as many in each one after.
SLICE, GROWTH = 16, 4
#: The most members of a block, and the most weight that they have together.
BLOCK, WEIGHT = 256, 1 << 20
OPEN = ("key", "n", "all_weight", "node", "weight", "anchor", "root")
#: Turns in which buckets are counted.
TURNS = 2
#: Keys of large buckets are sent to all tasks up to this number (some 40 bytes each), else joined.
SENT_KEYS = 500_000
#: Rows of members or links (some 50 bytes each) that one task takes.
FEW = 100_000
#: Lets Spark skip, by a Bloom filter of at most 8 MB, rows without a partner before they are shuffled.
BLOOM = {"spark__sql__optimizer__runtime__bloomFilter__enabled": "true", "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0"}


def _slim(table: DataFrame) -> DataFrame:
    """A staged table, in one task if it has few rows."""
    if table.count() > FEW:
        return table
    out = table.coalesce(1)
    out._staged_at = table._staged_at
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a - b, and the least node of the component of each."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, np.concatenate([root[x], root[y]]), np.concatenate([low, low]))
        while (root[root] != root).any():
            root = root[root]
    return node, node[root]


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), staged: root is the least node of its component. A staged table of few edges is joined here."""
    if hasattr(edges, "_staged_at") and edges.count() <= FEW:
        held = edges.filter("a != b").select("a", "b").toArrow()
        node, root = _joined(*[held.column(c).to_numpy().astype(np.int64) for c in ("a", "b")])
        few = edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root}), "node long, root long")
        return _slim(staged(few.coalesce(1), "components"))
    return _dealt_roots(edges)


def _dealt_roots(edges: DataFrame) -> DataFrame:
    """The same for any number of edges.

    Alternating large-star and small-star steps, each one aggregate and one join written to the shared folder, until only stars are left.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.filter("a != b").distinct(), "edges")
        drop(now)
        # Now every edge leads down, from a to b.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        own, next_ = F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.join(low, "a").select(F.explode(F.array(own, next_)).alias("e")).select("e.a", "e.b")
        now = staged(small.filter("a != b").distinct(), "edges")
        drop(large)
        # Stars: no node has two edges down, and none that has one is another's root.
        upper, lower = F.struct(F.col("a").alias("x"), F.lit(1).alias("d")), F.struct(F.col("b").alias("x"), F.lit(0).alias("d"))
        ends = now.select(F.explode(F.array(upper, lower)).alias("e"))
        degree = ends.groupBy("e.x").agg(F.sum("e.d").alias("down"), F.min("e.d").alias("lo"))
        if degree.filter((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("lo") == 0))).isEmpty():
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = staged(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "components")
    drop(now)
    return found


def _buckets(items: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (a, b) that are all of a bucket, and members (key, n, all_weight, node, weight) of larger buckets, both staged; None without any.

    Of buckets that hold the same members one is kept.
    """
    keys = items.select("node", "weight", F.explode("bands").alias("key"))
    # Some bands at a time: what is shuffled at once is so much less.
    parts = []
    for part in range(TURNS):
        own = items.select("node", F.explode(F.filter("bands", lambda _, i: i % TURNS == part)).alias("key"))  # noqa: B023
        counted = own.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
        parts.append(staged(counted.filter("n > 1"), "buckets"))
    parts = [_slim(p) for p in parts]
    buckets = reduce(DataFrame.unionByName, parts)
    if buckets.isEmpty():
        drop(*parts)
        return None
    large = buckets.filter("n > 2").select("key")
    large = F.broadcast(large) if large.count() <= SENT_KEYS else large
    every = _slim(staged(keys.join(large, "key"), "members"))
    shape = every.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum("weight").alias("weight"))
    first = shape.groupBy("n", "who").agg(F.min(F.struct("key", "weight")).alias("x")).select("x.key", "n", F.col("x.weight").alias("all_weight"))
    members = _slim(staged(every.join(first, "key").select("key", "n", "all_weight", "node", "weight"), "members"))
    two = _slim(staged(reduce(DataFrame.unionByName, [p.filter("n = 2").select("a", "b") for p in parts]).distinct(), "pairs"))
    drop(*parts, every)
    return two, members


def _stars(members: DataFrame) -> DataFrame:
    """Each member with its bucket's hub: in small buckets the least node, in others the member that meets most others, which copies may have been made from."""
    met = members.filter(F.col("n") > SLICE).groupBy("node").agg(F.sum("n").alias("met"))
    ranked = members.join(met, "node", "left").select("key", "node", F.struct(F.coalesce("met", F.lit(0)).alias("met"), (-F.col("node")).alias("less")).alias("r"))
    hubs = ranked.groupBy("key").agg((-F.max("r")["less"]).alias("hub"))
    joined = members.join(hubs, "key").filter("node != hub")
    return joined.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))


def _seeking(own: DataFrame) -> DataFrame:
    """Of buckets with members outside the anchor's component: how many (r), their weight (rw), and the anchor's component (main)."""
    by_root = own.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("weight").alias("w"), F.bool_or(F.col("node") == F.col("anchor")).alias("main"))
    apart = lambda c: F.sum(F.when(~F.col("main"), F.col(c)).otherwise(0))
    return by_root.groupBy("key").agg(apart("c").alias("r"), apart("w").alias("rw"), F.max(F.when(F.col("main"), F.col("root"))).alias("main")).filter("r > 0")


def _blocks(own: DataFrame, least: int, most: int) -> DataFrame:
    """Seekers, and members at places from ``least`` to ``most`` of n, of each bucket, dealt into blocks: each block of the ones (s) against each of the others (m)."""
    share = F.least(F.lit(1.0), F.lit(float(most - least)) / F.col("n"))
    size = lambda count, weight: F.ceil(F.greatest(F.lit(1.0), count / BLOCK, weight / F.lit(float(WEIGHT)))).cast("int")
    place = F.pmod(F.xxhash64(F.lit("place"), "node"), F.lit(1 << 30)) * F.col("n") / F.lit(1 << 30)
    own = own.withColumns(
        {
            "seeks": F.col("root") != F.col("main"),
            "met": (place >= least) & (place < most),
            "sb": size(F.col("r"), F.col("rw")),
            "mb": size(share * F.col("n"), share * F.col("all_weight")),
        }
    ).filter("seeks or met")
    dealt = lambda n: F.pmod(F.xxhash64(F.lit("block"), "node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<s:int,m:int,left:boolean>>")
    seeker = F.transform(every("mb"), lambda m: F.struct(dealt("sb").alias("s"), m.alias("m"), F.lit(True).alias("left")))
    other = F.transform(every("sb"), lambda s: F.struct(s.alias("s"), dealt("mb").alias("m"), F.lit(False).alias("left")))
    at = F.concat(F.when(F.col("seeks"), seeker).otherwise(none), F.when(F.col("met"), other).otherwise(none))
    return own.select("key", "node", "root", "seeks", "met", F.explode(at).alias("at"))


def _wave(dealt: DataFrame, held: DataFrame, near: Callable, prepare: Callable, could: Callable | None) -> DataFrame:
    """Links (a, b) between components, by comparing blocks."""
    row = F.struct("node", "root", "seeks", "met", "bands", "items")
    side = lambda left: F.collect_list(F.when(F.col("at.left") == left, row))
    block = dealt.join(held, "node").groupBy("key", "at.s", "at.m").agg(side(True).alias("xs"), side(False).alias("ys"))
    ready = lambda ms: F.transform(ms, lambda m: F.struct(m["node"].alias("node"), m["root"].alias("root"), m["seeks"].alias("seeks"), m["met"].alias("met"), m["bands"].alias("bands"), prepare(m["items"]).alias("items")))
    block = block.filter((F.size("xs") > 0) & (F.size("ys") > 0)).select("key", ready(F.col("xs")).alias("xs"), ready(F.col("ys")).alias("ys"))

    def linked_to(x: Column) -> Column:
        """Components of ``ys`` that ``x`` is linked to. A pair counts in one of the buckets that it shares, and once if both seek and both are met."""

        def hit(y: Column) -> Column:
            first = F.array_min(F.array_intersect(x["bands"], y["bands"])) == F.col("key")
            again = y["seeks"] & x["met"] & (x["node"] > y["node"])
            open_ = (y["root"] != x["root"]) & ~again
            return (open_ if could is None else open_ & could(x["bands"], y["bands"])) & first & near(x["items"], y["items"])

        return F.array_distinct(F.transform(F.filter("ys", hit), lambda y: F.struct(x["root"].alias("a"), y["root"].alias("b"))))

    return block.select(F.explode(F.flatten(F.transform("xs", linked_to))).alias("e")).select("e.a", "e.b").distinct()


def linked(
    items: DataFrame,
    payload_of: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column],
    prepare: Callable[[Column], Column] = lambda x: x,
    could: Callable[[Column, Column], Column] | None = None,
) -> DataFrame | None:
    """(node, root), staged, of nodes that share a bucket with another: root names the component of links, and a node that is left out is one of its own; None without any.

    ``items``: node (unique long), bands (array of long keys, different ones for different bands) and weight (what the node's payload takes
    to hold). ``payload_of`` gets nodes (node) and gives node, bands and items for each, staged. Two nodes that share a band are
    linked where ``near`` holds for what ``prepare`` makes of their items. Pairs for whose bands ``could`` does not hold, if it is
    given, are not looked at further.
    """
    buckets = _buckets(items)
    if buckets is None:
        return None
    two, members = buckets
    pairs = _slim(staged(two.unionByName(_stars(members)).distinct(), "pairs"))
    drop(two)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    if could is not None:
        one, other = [items.select(F.col("node").alias(end), F.col("bands").alias(own)) for end, own in (("a", "xs"), ("b", "ys"))]
        every, pairs = pairs, _slim(staged(pairs.join(one, "a").join(other, "b").filter(could(F.col("xs"), F.col("ys"))).select("a", "b"), "pairs"))
        drop(every)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node"))
    wanted = wanted.distinct()
    held = payload_of(wanted)
    one = held.select(F.col("node").alias("a"), F.col("items").alias("xs"))
    other = held.select(F.col("node").alias("b"), F.col("items").alias("ys"))
    both = F.array(F.struct(prepare(F.col("xs")).alias("x"), prepare(F.col("ys")).alias("y")))
    links = staged(pairs.join(one, "a").join(other, "b").filter(F.exists(both, lambda p: near(p["x"], p["y"]))).select("a", "b"), "links")
    drop(pairs)
    joined = roots(links)
    found = _slim(staged(held.select("node").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "components"))
    drop(links, joined)
    # Buckets in several components, each with a member of its largest one as anchor; the others are done.
    own = _slim(staged(members.join(found, "node"), "members"))
    drop(members)
    by_root = own.groupBy("key", "root").agg(F.count("*").alias("c"), F.min("node").alias("rep"))
    mixed = by_root.groupBy("key").agg(F.max(F.struct("c", "rep"))["rep"].alias("anchor"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    open_ = _slim(staged(own.join(mixed, "key"), "members"))
    drop(own)
    least, most = 0, SLICE
    merges: list[DataFrame] = []
    while True:
        seeking = _slim(staged(_seeking(open_.filter(F.col("n") > least)), "seeking"))
        if seeking.isEmpty():
            break
        still = _slim(staged(open_.select(*OPEN).join(seeking, "key"), "members"))
        drop(open_)
        dealt = staged(_blocks(still, least, most), "blocks")
        more = staged(_wave(dealt, held, near, prepare, could), "links")
        drop(seeking, dealt)
        open_ = still
        if not more.isEmpty():
            merges.append(roots(more))
            to = merges[-1].select(F.col("node").alias("root"), F.col("root").alias("to"))
            latest = [F.coalesce("to", "root").alias("root") if c == "root" else F.col(c) for c in OPEN]
            open_ = _slim(staged(still.select(*OPEN).join(to, "root", "left").select(*latest), "members"))
            drop(still)
        drop(more)
        least, most = most, most * (1 + GROWTH)
    drop(seeking, open_, held)
    if merges:
        # What each wave joined, as links between the first components.
        chain = staged(reduce(DataFrame.unionByName, merges).select(F.col("node").alias("a"), F.col("root").alias("b")), "links")
        joined = roots(chain)
        drop(chain)
        to = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
        was, found = found, staged(found.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "components")
        drop(was, joined, *merges)
    return found


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether two arrays without repeats have at least ``threshold`` as Jaccard similarity; empty ones are similar to nothing."""
    sizes = F.size(a) + F.size(b)
    could = F.least(F.size(a), F.size(b)) >= F.lit(threshold) * F.greatest(F.size(a), F.size(b))
    enough = F.exists(F.array(F.size(F.array_intersect(a, b))), lambda c: c >= F.lit(threshold) * (sizes - c))
    return could & (F.size(a) > 0) & enough
