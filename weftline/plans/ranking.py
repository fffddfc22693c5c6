"""Market values: ranks, shares, gaps, quantile cuts, tiers and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import stats
from weftline.functions.scalars import cut
from weftline.operators import ordering, ranking
from weftline.plans.registry import query
from weftline.plans.views import banks, sql


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(sql("""SELECT bank, name, value, round(value * 100 / sum(value) OVER (), 6) AS share_pct, CAST(dense_rank() OVER (ORDER BY value DESC) AS INTEGER) AS dense_rank,
  round(sum(value * 100) OVER (ORDER BY value DESC, bank ROWS UNBOUNDED PRECEDING) / sum(value) OVER (), 4) AS cumulative_share,
  round(coalesce(value - lead(value) OVER w, 0), 4) AS gap, round(coalesce((value / lead(value) OVER w - 1) * 100, 0), 4) AS growth_pct,
  round(value * 100 / sum(value) OVER () / dense_rank() OVER (ORDER BY value DESC), 6) AS dominance FROM banks WINDOW w AS (ORDER BY value DESC, bank)"""))
def market_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Rank, share, running share, gap, growth and dominance of each bank."""
    df = ranking.ranked(banks(spark, folder), "value", "bank")
    return _rounded(_rounded(df, 6, "share_pct", "dominance"), 4, "cumulative_share", "gap", "growth_pct")


@query(sql("""SELECT bank, CASE WHEN value <= e[1] THEN 'Q1' WHEN value <= e[2] THEN 'Q2' WHEN value <= e[3] THEN 'Q3' ELSE 'Q4' END AS quartile FROM banks, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM banks)"""))
def quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Bins between quantiles."""
    return ranking.quantile_cut(banks(spark, folder), "value", ["Q1", "Q2", "Q3", "Q4"], "quartile").select("bank", "quartile")


@query(sql("""SELECT bank, CASE WHEN r <= e[1] THEN 'Q1' WHEN r <= e[2] THEN 'Q2' WHEN r <= e[3] THEN 'Q3' ELSE 'Q4' END AS quartile
  FROM (SELECT bank, row_number() OVER (ORDER BY value, bank) AS r FROM banks), (SELECT quantile_cont(i, [0.25, 0.5, 0.75]) AS e FROM (SELECT CAST(row_number() OVER () AS DOUBLE) AS i FROM banks))"""))
def quartiles_by_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Bins between quantiles of the rank, ties by id."""
    rows = ordering.numbered(banks(spark, folder), [F.col("value"), F.col("bank")], "r")
    return ranking.quantile_cut(rows, "r", ["Q1", "Q2", "Q3", "Q4"], "quartile").select("bank", "quartile")


@query(sql("""SELECT bank, CASE WHEN value <= e[1] THEN 'Small' WHEN value <= e[2] THEN 'Medium' ELSE 'Large' END AS size FROM banks, (SELECT quantile_cont(value, [0.33, 0.66]) AS e FROM banks)"""))
def size_classes(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.classes(banks(spark, folder), "value", "size").select("bank", "size")


@query(sql("""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN s >= 20 THEN 'Tier 1 (High)' WHEN s >= 10 THEN 'Tier 2 (Medium)' WHEN s > 0 THEN 'Tier 3 (Low)' ELSE 'Tier 4 (Zero)' END AS tier
  FROM (SELECT value * 100 / sum(value) OVER () * 8 AS s FROM banks)) GROUP BY 1"""))
def share_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Banks by tier (shares are taken eight-fold, so that tiers are filled)."""
    return ranking.shares(banks(spark, folder), "value").groupBy(ranking.share_tier(F.col("share_pct") * 8).alias("tier")).agg(F.count("*").alias("n"))


_LABELS = ["0-50", "50-100", "100-200", "200-400", "400-800", "800-1200"]


@query(sql("""SELECT s.segment, coalesce(n, 0) AS n, total, mean, "max", "min" FROM (VALUES ('0-50', 0, 50), ('50-100', 50, 100), ('100-200', 100, 200), ('200-400', 200, 400), ('400-800', 400, 800), ('800-1200', 800, 1200)) s(segment, lo, hi)
  LEFT JOIN (SELECT CASE WHEN v > 0 AND v <= 50 THEN '0-50' WHEN v > 50 AND v <= 100 THEN '50-100' WHEN v > 100 AND v <= 200 THEN '100-200' WHEN v > 200 AND v <= 400 THEN '200-400' WHEN v > 400 AND v <= 800 THEN '400-800' WHEN v > 800 AND v <= 1200 THEN '800-1200' END AS segment,
  count(*) AS n, round(sum(v), 2) AS total, round(avg(v), 4) AS mean, max(v) AS "max", min(v) AS "min" FROM (SELECT round(value / 12, 2) AS v FROM banks) GROUP BY 1) t ON s.segment = t.segment"""))
def value_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments by fixed edges, empty ones too."""
    rows = banks(spark, folder).select(F.round(F.col("value") / 12, 2).alias("v"))
    out = ranking.segments(rows, "v", ranking.SEGMENT_EDGES, _LABELS)
    return out.select("segment", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "max", "min")


@query(sql("SELECT bank, value FROM banks WHERE value > (SELECT avg(value) FROM banks)"))
def above_average(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.above_average(banks(spark, folder), "value").select("bank", "value")


@query(sql("SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(15) r(b) LEFT JOIN (SELECT least(CAST(floor(value / (10000.0 / 15)) AS INTEGER), 14) AS bin, count(*) AS n FROM banks WHERE value BETWEEN 0 AND 10000 GROUP BY 1) ON b = bin"))
def value_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Equal-width bins, empty ones too."""
    return stats.histogram(banks(spark, folder), "value", 0.0, 10000.0, 15)


@query(sql("SELECT bank, CASE WHEN value > 0 AND value <= 3000 THEN 'low' WHEN value > 3000 AND value <= 7000 THEN 'mid' WHEN value > 7000 AND value <= 9000 THEN 'high' END AS band FROM banks"))
def fixed_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Right-closed bins; null above the last edge."""
    return banks(spark, folder).select("bank", cut(F.col("value"), [0, 3000, 7000, 9000], ["low", "mid", "high"]).alias("band"))


@query(sql("SELECT bank, name, value FROM banks ORDER BY value DESC, bank LIMIT 5"))
def largest_banks(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top(banks(spark, folder), "value", "bank", 5)
