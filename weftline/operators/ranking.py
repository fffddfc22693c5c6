"""Ranks, shares, gaps, quantile cuts, tiers and segments.

``shares`` needs no window; ranks and running sums over a whole frame are those of :mod:`ordering`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import cut, ladder
from weftline.functions.stats import quantiles, with_scalars
from weftline.operators import ordering

#: Tiers by percent of the total, market-value segments and their edges.
SHARE_TIERS = [(20, "Tier 1 (High)"), (10, "Tier 2 (Medium)")]
SEGMENT_EDGES = [0, 50, 100, 200, 400, 800, 1200]


def shares(df: DataFrame, value: str) -> DataFrame:
    """``df`` with share_pct, percent of the sum: one aggregate, its single row broadcast."""
    return with_scalars(df, df.agg(F.sum(value).alias("__total"))).withColumn("share_pct", F.try_divide(F.col(value), F.col("__total")) * 100).drop("__total")


def ranked(df: DataFrame, value: str, tie: str) -> DataFrame:
    """``df`` by falling value: dense_rank, cumulative_share, gap and growth_pct to the next lower row (0 for the last), dominance."""
    below = F.col("__below")
    return ordering.ranked(shares(df, value), value, tie, "share_pct").select(
        "*",
        F.coalesce(F.col(value) - below, F.lit(0.0)).alias("gap"),
        F.coalesce((F.try_divide(F.col(value), below) - 1) * 100, F.lit(0.0)).alias("growth_pct"),
        (F.col("share_pct") / F.col("dense_rank")).alias("dominance"),
    ).drop("__below")


def quantile_cut(df: DataFrame, value: str, labels: Sequence[str], name: str) -> DataFrame:
    """Bins between exact quantiles, right-closed, the lowest included; all in the first bin if there are fewer distinct values than bins."""
    n = len(labels)
    edges = quantiles(df, {value: [i / n for i in range(1, n)]})[value]
    distinct = df.select(value).filter(F.col(value).isNotNull()).distinct().limit(n).count()
    tests = [(F.col(value) <= F.lit(edges[i]).cast("double"), F.lit(label)) for i, label in enumerate(labels[:-1])]
    bin_ = reduce(lambda w, t: w.when(*t), tests[1:], F.when(*tests[0])).otherwise(F.lit(labels[-1]))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.lit(labels[0]) if distinct < n else bin_))


def classes(df: DataFrame, value: str, name: str, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Small up to the ``low`` quantile, Medium up to ``high``, else Large."""
    edges = [F.lit(e).cast("double") for e in quantiles(df, {value: (low, high)})[value]]
    return df.withColumn(name, F.when(F.col(value) <= edges[0], "Small").when(F.col(value) <= edges[1], "Medium").otherwise("Large"))


def share_tier(share: Column) -> Column:
    return ladder(share, SHARE_TIERS).when(share > 0, F.lit("Tier 3 (Low)")).otherwise(F.lit("Tier 4 (Zero)"))


def segments(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """segment, count, sum, mean, max, min for every label, empty ones too."""
    binned = df.withColumn("segment", cut(F.col(value), edges, labels)).filter("segment is not null")
    sums = binned.groupBy("segment").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "segment string")
    return every.join(sums, "segment", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def above_average(df: DataFrame, value: str) -> DataFrame:
    return with_scalars(df, df.agg(F.avg(value).alias("__mean"))).filter(F.col(value) > F.col("__mean")).drop("__mean")


def top(df: DataFrame, value: str, tie: str, k: int, ascending: bool = False) -> DataFrame:
    """The k largest (or smallest) rows; partial top-k in each task."""
    return df.orderBy(F.col(value).asc() if ascending else F.col(value).desc(), tie).limit(k)
