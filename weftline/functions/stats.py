"""Summaries as aggregate expressions and one-pass frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType, StringType


def five_numbers(value: str) -> list[Column]:
    """count, mean, median, min, max."""
    return [F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.median(value), 4).alias("median"), F.min(value).alias("min"), F.max(value).alias("max")]


#: Relative accuracy of the first pass over quantiles, and the values among which one is looked for exactly.
ACCURACY, FEW_VALUES = 10_000, 1_000_000


def _by_rank(df: DataFrame, wanted: Sequence[tuple[str, int, int]], few: int = FEW_VALUES) -> list[float]:
    """For each (column, rank from 0, values in all) the value of that rank: brackets by approximate quantiles, then counts, then what lies inside.

    Three passes of partial aggregates, whatever the number of columns and ranks; brackets that hold more than ``few`` values are looked into again.
    """
    share = lambda n, r: [max(0.0, r / max(n - 1, 1) - 2 / ACCURACY), min(1.0, r / max(n - 1, 1) + 2 / ACCURACY)]
    x = [F.col(c).cast("double") for c, _, _ in wanted]
    ends = df.agg(*[F.percentile_approx(v, F.array(*map(F.lit, share(n, r))), ACCURACY).alias(f"e{i}") for i, (v, (_, r, n)) in enumerate(zip(x, wanted, strict=True))]).first()
    inside = [v.between(ends[f"e{i}"][0], ends[f"e{i}"][1]) for i, v in enumerate(x)]
    counts = df.agg(*[f for i, v in enumerate(x) for f in (F.count_if(v < ends[f"e{i}"][0]).alias(f"b{i}"), F.count_if(inside[i]).alias(f"n{i}"))]).first()
    at = [r - counts[f"b{i}"] for i, (_, r, _) in enumerate(wanted)]
    many = [i for i in range(len(wanted)) if few < counts[f"n{i}"] < wanted[i][2]]
    exact = [i for i in range(len(wanted)) if i not in many]
    out: dict[int, float] = {}
    if exact:
        place = lambda i: at[i] / max(counts[f"n{i}"] - 1, 1)
        found = df.agg(*[F.percentile(F.when(inside[i], x[i]), place(i)).alias(f"v{i}") for i in exact]).first()
        out = {i: found[f"v{i}"] for i in exact}
    for i in many:
        out[i] = _by_rank(df.filter(inside[i]), [(wanted[i][0], at[i], counts[f"n{i}"])], few)[0]
    return [out[i] for i in range(len(wanted))]


def quantiles(df: DataFrame, probabilities: dict[str, Sequence[float]], few: int = FEW_VALUES) -> dict[str, list[float | None]]:
    """Exact quantiles of columns, between ranks on a straight line; None without values. No task holds the values of a column."""
    n = df.agg(*[F.count(c).alias(c) for c in probabilities]).first()
    ranks = [(c, r, n[c]) for c, ps in probabilities.items() if n[c] for p in ps for r in (math.floor(p * (n[c] - 1)), math.ceil(p * (n[c] - 1)))]
    values = iter(_by_rank(df, ranks, few) if ranks else [])
    out: dict[str, list[float | None]] = {}
    for c, ps in probabilities.items():
        out[c] = []
        for p in ps:
            low, high = (next(values), next(values)) if n[c] else (None, None)
            at = p * (n[c] - 1)
            out[c].append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out


def describe(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.25, 0.5, 0.75), digits: int = 4) -> DataFrame:
    """A row for each column: count, mean, sample deviation, min, exact quantiles, max."""
    names = ["n", "mean", "std", "min", *(f"p{round(q * 100):02d}" for q in probabilities), "max"]
    own = quantiles(df, {c: probabilities for c in columns})
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        numbers = [F.count(x).cast("double"), F.avg(x), F.stddev_samp(x), F.min(x), *(F.lit(q).cast("double") for q in own[c]), F.max(x)]
        parts.append(F.struct(F.lit(c).alias("column"), *[F.round(v, digits).alias(n) for v, n in zip(numbers, names, strict=True)]))
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, null_count, null_pct. One pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("null_count"), F.round(F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, F.count("*")), 4).alias("null_pct")) for c in columns]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    """Names of the numeric, text, time and other columns, in their order."""
    kinds: dict[str, list[str]] = {"numeric": [], "text": [], "time": [], "other": []}
    for f in df.schema.fields:
        kind = "numeric" if isinstance(f.dataType, NumericType) else "text" if isinstance(f.dataType, StringType) else "time" if isinstance(f.dataType, DatetimeType) else "other"
        kinds[kind].append(f.name)
    return kinds


def schema_profile(df: DataFrame) -> DataFrame:
    """column, kind, n, null_count, n_distinct of every column. One line for each column and value is shuffled, after partial counts."""
    kind = {c: k for k, names in columns_by_kind(df).items() for c in names}
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    values = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    nulls = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
    kinds = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
    return values.groupBy("column").agg(F.sum("n").alias("n"), nulls.alias("null_count"), F.count("v").alias("n_distinct")).select("column", kinds[F.col("column")].alias("kind"), "n", "null_count", "n_distinct")


def correlations(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pairwise Pearson correlations (a, b, r) of rows that have both. One pass."""
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), digits).alias("r")) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def skewness(value: str) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def fences(df: DataFrame, value: str, width: float = 1.5) -> DataFrame:
    """One row: q1, q3, low, high."""
    q1, q3 = quantiles(df, {value: (0.25, 0.75)})[value]
    q = df.sparkSession.createDataFrame([(q1, q3)], "q1 double, q3 double")
    return q.select("q1", "q3", (F.col("q1") - width * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + width * (F.col("q3") - F.col("q1"))).alias("high"))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a frame of exactly one row (an aggregate), which is broadcast."""
    return df.join(F.broadcast(one_row), F.lit(True))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0-based, the last one closed), n; empty bins stand with 0."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str, digits: int = 6) -> DataFrame:
    """label, precision, recall, f1, support for each label, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    cells = confusion(df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).select(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")), "t", "p")
    by_label = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("right")))).alias("x")).select("x.*")
    sums = by_label.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "called", "right")])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rated = sums.select("label", zero(F.try_divide(F.col("right").cast("double"), F.col("called"))).alias("precision"), zero(F.try_divide(F.col("right").cast("double"), F.col("support"))).alias("recall"), zero(F.try_divide(2.0 * F.col("right"), F.col("called") + F.col("support"))).alias("f1"), "support", "right")
    total = F.sum("support")
    numbers = ["precision", "recall", "f1"]
    accuracy = F.sum("right") / total
    tail = rated.agg(F.array(F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(x) for x in numbers], total.alias("support")), F.struct(F.lit("macro avg").alias("label"), *[F.avg(x).alias(x) for x in numbers], total.alias("support")), F.struct(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(x) * F.col("support")) / total).alias(x) for x in numbers], total.alias("support"))).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rated.drop("right").unionByName(tail).select("label", *[F.round(x, digits).alias(x) for x in numbers], "support")
