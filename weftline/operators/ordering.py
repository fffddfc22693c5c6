"""Numbers, ranks and running sums over a whole frame, without one task for all of its rows.

Rows go into buckets by ranges of their keys; inside a bucket a window orders them, and what the
buckets before it hold is added. Bounds come from a sample by hash of the keys, so a row falls into the
same bucket whenever it is computed. Only a line for each bucket is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.stats import with_scalars

#: Sampled rows for each bucket, and what hashes are counted modulo.
PER_BUCKET, MODULUS = 100, 1_000_000


def bucketed(df: DataFrame, keys: Sequence[Column], buckets: int | None = None) -> DataFrame:
    """``df`` with __key (a struct of the keys, which give the order) and __bucket, rising with it. As many buckets as shuffles have partitions, unless told.

    Rows of equal keys share a bucket: let the last key tell rows apart, so that one value of many rows is dealt over several.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn("__key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    rate = with_scalars(out, out.agg(F.count("*").alias("__all")))
    some = rate.filter(F.pmod(F.xxhash64("__key"), F.lit(MODULUS)) * F.col("__all") < F.lit(MODULUS * PER_BUCKET * buckets).cast("long"))
    ends = some.agg(F.sort_array(F.collect_list("__key")).alias("s"))
    step = F.greatest(F.floor(F.size("s") / buckets), F.lit(1)).cast("int")
    bounds = ends.select(F.filter("s", lambda _, i: (i > 0) & (i % step == 0)).alias("__bounds"))
    return with_scalars(out, bounds).withColumn("__bucket", F.size(F.filter("__bounds", lambda b: b <= F.col("__key")))).drop("__bounds")


def numbered(df: DataFrame, keys: Sequence[Column], name: str, buckets: int | None = None) -> DataFrame:
    """``df`` with the place of each row in the order of the keys, from 1."""
    rows = bucketed(df, keys, buckets)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key")) + F.col("__before")
    return rows.join(F.broadcast(before), "__bucket").select(*[F.col(c) for c in df.columns], place.alias(name))


def ranked(df: DataFrame, value: str, tie: str, running: str, buckets: int | None = None) -> DataFrame:
    """``df`` by falling value (nulls last) with dense_rank, cumulative_share (the running sum of ``running``) and __below, the value of the next row."""
    x = F.col(value)
    rows = bucketed(df, [x.isNull(), -x, F.col(tie)], buckets)
    by_value = rows.groupBy("__bucket", F.col(value).alias("__value")).agg(F.sum(running).alias("__sum"), F.min("__key").alias("__low"), F.max("__key").alias("__high"))
    lines = by_value.groupBy("__bucket").agg(F.count("*").alias("__values"), F.sum("__sum").alias("__sum"), F.min("__low").alias("__low"), F.max("__high").alias("__high"), F.min_by("__value", "__low").alias("__first"))
    order = Window.orderBy("__bucket")
    same = F.lag(F.struct("__high.k0", "__high.k1")).over(order).eqNullSafe(F.struct("__low.k0", "__low.k1")).cast("long")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("__same", same).select(
        "__bucket",
        (F.coalesce(F.sum("__values").over(earlier), F.lit(0)) - F.sum("__same").over(order)).alias("__ranks"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__before"),
        F.lead("__first").over(order).alias("__next"),
    )
    inside = Window.partitionBy("__bucket").orderBy("__key")
    falling = Window.partitionBy("__bucket").orderBy(F.col("__key.k0"), F.col("__key.k1"))
    return rows.join(F.broadcast(lines), "__bucket").select(
        *[F.col(c) for c in df.columns],
        (F.dense_rank().over(falling) + F.col("__ranks")).cast("int").alias("dense_rank"),
        (F.sum(running).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")).alias("cumulative_share"),
        F.coalesce(F.lead(value).over(inside), F.col("__next")).alias("__below"),
    )
