"""Imputation, outliers, recoding, sampling and deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import clamp
from weftline.functions.stats import fences, with_scalars


def imputed(df: DataFrame, medians: Sequence[str] = (), modes: Sequence[str] = ()) -> DataFrame:
    """Nulls become the median or the (smallest) mode of their column; one aggregate for all columns."""
    constants = df.agg(*[F.median(c).alias(f"__{c}") for c in medians], *[F.mode(c, True).alias(f"__{c}") for c in modes])
    out = with_scalars(df, constants)
    return out.select(*[F.coalesce(F.col(c).cast("double") if c in medians else F.col(c), F.col(f"__{c}")).alias(c) if c in (*medians, *modes) else F.col(c) for c in df.columns])


def zeros_to_median(df: DataFrame, c: str) -> DataFrame:
    """Zeros become the median of all values."""
    return with_scalars(df, df.agg(F.median(c).alias("__m"))).withColumn(c, F.when(F.col(c) == 0, F.col("__m")).otherwise(F.col(c).cast("double"))).drop("__m")


def winsorised(df: DataFrame, c: str, width: float = 1.5) -> DataFrame:
    """Values outside the quartile fences become the fences; ``<c>_outlier`` says which were."""
    out = with_scalars(df, fences(df, c, width))
    outside = (F.col(c) < F.col("low")) | (F.col(c) > F.col("high"))
    return out.select(*[clamp(F.col(x), F.col("low"), F.col("high")).alias(x) if x == c else F.col(x) for x in df.columns], outside.alias(f"{c}_outlier"))


def rare_to_other(df: DataFrame, c: str, share: float = 0.01, other: str = "Other") -> DataFrame:
    """Values of less than ``share`` of the rows become ``other``."""
    total = df.agg(F.count("*").alias("__all"))
    common = with_scalars(df.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n")), total).filter(F.col("__n") >= share * F.col("__all")).select("__v")
    return df.join(common, F.col(c).eqNullSafe(F.col("__v")), "left").select(*[F.when(F.col("__v").isNull() & F.col(c).isNotNull(), F.lit(other)).otherwise(F.col(c)).alias(x) if x == c else F.col(x) for x in df.columns])


def yes_no(df: DataFrame) -> DataFrame:
    """String columns that hold nothing but yes and no (any case) become 1 and 0; then full-row duplicates go. All columns are tested in one aggregate."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if texts:
        found = df.agg(*[F.coalesce(F.bool_and(F.coalesce(F.lower(c).isin("yes", "no"), F.lit(False))), F.lit(True)).alias(c) for c in texts]).first()
        flags = [c for c in texts if found[c]]
        df = df.withColumns({c: F.when(F.lower(c) == "yes", 1).otherwise(0) for c in flags}) if flags else df
    return df.dropDuplicates()


def stratified(df: DataFrame, strata: Sequence[str], fraction: float, key: str, seed: int = 42) -> DataFrame:
    """round(fraction * n) rows of each stratum, those with the least hash of ``key``: the same rows every time."""
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.select("*", F.row_number().over(order).alias("__r"), F.count("*").over(Window.partitionBy(*strata)).alias("__n")).filter(F.col("__r") <= F.round(F.col("__n") * fraction)).drop("__r", "__n")


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a checksum of ``seed`` and ``key``."""
    text = F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))
    low = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000 < int(share * 10_000)
    return df.filter(low), df.filter(~low)


def deduplicated(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in ``order`` (which must be total to be repeatable)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def outlier_rules(passengers="passenger_count", rate="RatecodeID", payment="payment_type", pickup="tpep_pickup_datetime", dropoff="tpep_dropoff_datetime", distance="trip_distance", fare="fare_amount", tip="tip_amount", total="total_amount", start="PULocationID", end="DOLocationID", airport="Airport_fee") -> dict[str, Column]:
    """What a trip must meet to be analysed, in order; unknown fails, except where a rule only excludes."""
    excluded = lambda c: ~F.coalesce(c, F.lit(False))
    col = F.col
    return {
        "passengers": col(passengers) < 7,
        "rate_code": col(rate).between(1, 6),
        "payment": col(payment).between(1, 6),
        "time": col(pickup) < col(dropoff),
        "short_but_dear": excluded((col(distance) <= 1) & (col(fare) > 300)),
        "nowhere": excluded(((col(distance) == 0) | (col(fare) == 0)) & (col(start) != col(end))),
        "distance": col(distance) <= 250,
        "airport_fee": col(airport).isin(0.0, 1.25),
        "total": col(total) >= col(fare),
        "tip": F.try_divide(col(tip), col(fare)) <= 1.5,
        "fare": col(fare) <= 500,
        "travelled": col(distance) > 0,
    }


def nonzero(columns: Sequence[str]) -> Column:
    """Whether all of these are there and not 0."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(c) != 0, F.lit(False)) for c in columns))


def within_minutes(seconds: Column, most: float = 200.0) -> Column:
    """Durations above 0 and up to ``most`` minutes."""
    return F.coalesce((seconds > 0) & (seconds <= most * 60), F.lit(False))


def merged_columns(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two spellings of one column as one: the first, where null the second."""
    return df.select(*[F.coalesce(df[first], df[second]).alias(first) if c == first else df[c] for c in df.columns if c != second])


def split_lists(df: DataFrame, c: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """feature, prevalence of the items of a comma list, those within low and high."""
    items = df.select(F.explode(F.array_distinct(F.transform(F.split(c, ","), lambda x: F.trim(x)))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    return with_scalars(items, df.agg(F.count("*").alias("__all"))).select("feature", (F.col("n") / F.col("__all")).alias("prevalence")).filter(F.col("prevalence").between(low, high))
