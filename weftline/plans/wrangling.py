"""Summaries of columns, imputation, outliers, sampling, encodings and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import stats
from weftline.functions import scalars
from weftline.operators import cleaning, models
from weftline.plans.registry import query
from weftline.plans.views import cars, sql, table, trips

_DESCRIBED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c})::DOUBLE AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min,
  {", ".join(f"round(quantile_cont({c}::DOUBLE, {q}), 4) AS p{round(q * 100):02d}" for q in (0.01, 0.25, 0.5, 0.75, 0.99))}, round(max({c})::DOUBLE, 4) AS max FROM trips"""
    for c in ("fare", "distance", "passengers")
)


@query(sql(_DESCRIBED))
def describe(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean, deviation, minimum, quantiles and maximum of columns, one pass."""
    return stats.describe(trips(spark, folder), ["fare", "distance", "passengers"], (0.01, 0.25, 0.5, 0.75, 0.99))


@query(sql(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct FROM trips""" for c in ("passengers", "payment_type", "fare"))))
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return stats.null_profile(trips(spark, folder), ["passengers", "payment_type", "fare"])


@query(sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM trips" for a, b in (("fare", "fare"), ("fare", "distance"), ("fare", "passengers"), ("distance", "distance"), ("distance", "passengers"), ("passengers", "passengers")))))
def correlations(spark: SparkSession, folder: str) -> DataFrame:
    return stats.correlations(trips(spark, folder), ["fare", "distance", "passengers"])


@query(sql("SELECT pu, round(skewness(fare), 6) AS skew FROM trips GROUP BY 1"))
def skewness(spark: SparkSession, folder: str) -> DataFrame:
    """Bias-corrected skewness by group."""
    return trips(spark, folder).groupBy("pu").agg(F.round(stats.skewness("fare"), 6).alias("skew"))


@query(sql("SELECT car, coalesce(owners::DOUBLE, (SELECT quantile_cont(owners, 0.5) FROM cars)) AS owners, coalesce(trim, (SELECT trim FROM cars WHERE trim IS NOT NULL GROUP BY trim ORDER BY count(*) DESC, trim LIMIT 1)) AS trim FROM cars"))
def impute(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls as median and smallest mode."""
    return cleaning.imputed(cars(spark, folder).select("car", "owners", "trim"), ["owners"], ["trim"])


@query(sql("SELECT car, CASE WHEN owners = 0 THEN (SELECT quantile_cont(owners, 0.5) FROM cars) ELSE owners::DOUBLE END AS owners FROM cars"))
def zero_to_median(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.zeros_to_median(cars(spark, folder).select("car", "owners"), "owners")


@query(sql("""SELECT l_orderkey, l_linenumber, round(greatest(least(v, q[2] + 0.5 * (q[2] - q[1])), q[1] - 0.5 * (q[2] - q[1])), 4) AS v, v < q[1] - 0.5 * (q[2] - q[1]) OR v > q[2] + 0.5 * (q[2] - q[1]) AS v_outlier
  FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem), (SELECT quantile_cont(l_extendedprice, [0.25, 0.75]) AS q FROM lineitem)"""))
def winsorise(spark: SparkSession, folder: str) -> DataFrame:
    """Values within half an interquartile range of the quartiles."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    return cleaning.winsorised(rows, "v", 0.5).withColumn("v", F.round("v", 4))


@query(sql("SELECT car, CASE WHEN n * 1.0 / t < 0.04 THEN 'Other' ELSE make END AS make FROM (SELECT car, make, count(*) OVER (PARTITION BY make) AS n, count(*) OVER () AS t FROM cars)"))
def rare_to_other(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.rare_to_other(cars(spark, folder).select("car", "make"), "make", 0.04)


@query("""SELECT DISTINCT c_nationkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS solvent, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS with_null FROM customer""")
def yes_no(spark: SparkSession, folder: str) -> DataFrame:
    """Yes/no columns as 1 and 0; a null or another value leaves a column as it is; duplicates go."""
    rows = table(spark, folder, "customer").select("c_nationkey", F.expr("if(c_acctbal > 0, 'YES', 'No')").alias("solvent"), "c_mktsegment", F.expr("case when c_custkey % 5 = 0 then null when c_custkey % 2 = 0 then 'Yes' else 'no' end").alias("with_null"))
    return cleaning.yes_no(rows)


@query(sql("""SELECT trip_key, "do", distance, fare FROM trips WHERE passengers < 7 AND payment_type BETWEEN 1 AND 6 AND pickup < dropoff AND NOT (distance <= 1 AND fare > 300) AND NOT ((distance = 0 OR fare = 0) AND pu <> "do") AND distance <= 45
  AND total >= fare AND tip / nullif(fare, 0) <= 1.5 AND fare <= 50000 AND distance > 0"""))
def outlier_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rule set for analysis, limits of this data for two of them."""
    own = cleaning.outlier_rules(passengers="passengers", rate="payment_type", payment="payment_type", pickup="pickup", dropoff="dropoff", distance="distance", fare="fare", tip="tip", total="total", start="pu", end="do", airport="zero")
    own |= {"distance": F.col("distance") <= 45, "fare": F.col("fare") <= 50000}
    rows = trips(spark, folder).withColumn("zero", F.lit(0.0))
    for condition in own.values():
        rows = rows.filter(condition)
    return rows.select("trip_key", "do", "distance", "fare")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) < 5, false)")
def negated_filter(spark: SparkSession, folder: str) -> DataFrame:
    """NOT a comparison keeps rows of which it is unknown."""
    from weftline.functions.scalars import negated

    return table(spark, folder, "customer").filter(negated(F.expr("nullif(c_nationkey, 3)") < 5)).select("c_custkey")


@query(sql("SELECT car, price, size FROM cars WHERE owners IS NULL OR trim IS NULL"))
def any_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    return cars(spark, folder).filter(F.col("owners").isNull() | F.col("trim").isNull()).select("car", "price", "size")


@query(sql("SELECT car, owners, trim FROM cars WHERE owners IS NOT NULL AND trim IS NOT NULL"))
def drop_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    return cars(spark, folder).select("car", "owners", "trim").dropna(subset=["owners", "trim"])


@query("SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, CAST(round(count(*) * 0.05) AS BIGINT) AS n FROM events GROUP BY ALL HAVING round(count(*) * 0.05) > 0")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows a stratified sample takes of each stratum."""
    rows = table(spark, folder, "events").select("event_id", "event_type", F.hour("ts").alias("hour"))
    return cleaning.stratified(rows, ["event_type", "hour"], 0.05, "event_id").groupBy("event_type", "hour").agg(F.count("*").alias("n"))


@query(sql("SELECT trip_key, \"do\", tip FROM trips WHERE fare <> 0 AND tip <> 0 AND distance <> 0 AND passengers <> 0"))
def nonzero_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in which four measures are there and not 0."""
    return trips(spark, folder).filter(cleaning.nonzero(["fare", "tip", "distance", "passengers"])).select("trip_key", "do", "tip")


@query(sql("SELECT trip_key, \"do\", date_diff('second', pickup, dropoff) AS seconds FROM trips WHERE date_diff('second', pickup, dropoff) > 0 AND date_diff('second', pickup, dropoff) <= 288000 * 60"))
def duration_window(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose duration is above 0 and at most so many minutes (200 days of them here)."""
    seconds = scalars.seconds_between(F.col("pickup"), F.col("dropoff"))
    return trips(spark, folder).withColumn("seconds", seconds).filter(cleaning.within_minutes(F.col("seconds"), 288_000)).select("trip_key", "do", "seconds")


@query("SELECT p_partkey, CASE WHEN CAST('0x' || substr(md5('42/' || p_partkey), 1, 8) AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'test' END AS part FROM part")
def split_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Train and test rows by a checksum of the key."""
    train, test = cleaning.hash_split(table(spark, folder, "part").select("p_partkey"), "p_partkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def batch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each key by a total order."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return cleaning.deduplicated(rows, ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(sql("SELECT f AS feature, round(count(*) * 1.0 / (SELECT count(*) FROM cars), 6) AS prevalence FROM (SELECT car, unnest(list_distinct(string_split(options, ','))) AS f FROM cars) GROUP BY 1 HAVING count(*) * 1.0 / (SELECT count(*) FROM cars) BETWEEN 0.0005 AND 0.95"))
def list_features(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the items of comma lists."""
    return cleaning.split_lists(cars(spark, folder), "options", 0.0005, 0.95).withColumn("prevalence", F.round("prevalence", 6))


@query(sql("SELECT car, CASE WHEN kind IS NULL THEN 0 ELSE len(string_split(kind, ' ')) END AS items FROM cars"))
def list_counts(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.functions.scalars import list_count

    return cars(spark, folder).select("car", list_count(F.replace("kind", F.lit(" "), F.lit(","))).cast("long").alias("items"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_returnflag = 'N' AS INTEGER) AS \"flag_N\", CAST(l_returnflag = 'R' AS INTEGER) AS \"flag_R\" FROM lineitem")
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag"))
    return models.one_hot(rows, "flag")


@query(sql("SELECT car, make, CAST(dense_rank() OVER (ORDER BY make) - 1 AS INTEGER) AS make_code FROM cars"))
def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    return models.label_encoded(cars(spark, folder).select("car", "make"), "make")


@query(sql("SELECT car, round((price - (SELECT avg(price) FROM cars)) / (SELECT stddev_pop(price) FROM cars), 6) AS price, round((size - (SELECT avg(size) FROM cars)) / (SELECT stddev_pop(size) FROM cars), 6) AS size FROM cars"))
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    out = models.scaled(cars(spark, folder).select("car", "price", "size"), ["price", "size"])
    return out.select("car", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"))


@query(sql("SELECT 'one' AS model, count(*) AS n, round(regr_intercept(total, fare), 4) AS intercept, round(regr_slope(total, fare), 6) AS slope, round(regr_r2(total, fare), 6) AS r2 FROM trips"))
def ols_one(spark: SparkSession, folder: str) -> DataFrame:
    """Least squares with one predictor, and its fit."""
    rows = trips(spark, folder)
    fit = models.ols(models.moments(rows, ["fare"], "total"))
    return models.metrics(rows, "total", fit.predicted()).select(F.lit("one").alias("model"), "n", F.lit(round(fit.intercept, 4)).alias("intercept"), F.lit(round(float(fit.weights[0]), 6)).alias("slope"), "r2")


def _modelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twin"))
    train, test = cleaning.hash_split(rows, "l_orderkey", 0.7)
    features = ["l_quantity", "l_discount", "l_tax", "twin"]
    return models.scaled(train, features), models.scaled(test, features, train), features


def _refined(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    train, test, features = _modelled(spark, folder)
    alpha, fit = models.refined(train, test, models.without_collinear(train, features, "y"), "y", kind)
    return models.metrics(test, "y", fit.predicted()).withColumn("alpha", F.lit(alpha)).withColumn("kept", F.lit(int(np.sum(np.abs(fit.weights) > 1e-9))))


@query()
def ridge_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge with a coarse and a fine grid after collinear features go."""
    return _refined(spark, folder, "ridge")


@query()
def lasso_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Lasso with a coarse and a fine grid after collinear features go."""
    return _refined(spark, folder, "lasso")


@query()
def coefficient_table(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the three models, and whether a model drops the feature."""
    train, _, features = _modelled(spark, folder)
    m = models.moments(train, features[:3], "y")
    rows = models.coefficients({"ols": models.ols(m), "ridge": models.ridge(m, 10.0), "lasso": models.lasso(m, 100.0)})
    return spark.createDataFrame(rows, "feature string, ols double, ridge double, lasso double, dropped boolean")


_INFLATED = """WITH t AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem WHERE CAST('0x' || substr(md5('42/' || l_orderkey), 1, 8) AS BIGINT) % 10000 < 7000), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM t)
  SELECT 'l_discount' AS feature, round(1 / (1 - (ab * ab + bc * bc - 2 * ab * bc * ac) / (1 - ac * ac)), 6) AS vif FROM r UNION ALL SELECT f, 'inf'::DOUBLE FROM (VALUES ('l_quantity'), ('l_tax'), ('twin')) v(f)"""


@query(_INFLATED)
def inflation_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Variance inflation of each feature; three of the four determine each other."""
    train, _, features = _modelled(spark, folder)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in models.inflation(models.moments(train, features, "y")).items()], "feature string, vif double")
