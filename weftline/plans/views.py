"""The driver's tables as the concepts of the engine: trips, zones, events, banks, cars, sentences; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.validation import Names


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TRIP = Names(id="trip_id", key="trip_key", pickup="pickup", dropoff="dropoff", passengers="passengers", distance="distance", start="pu", end="do", fare="fare", total="total", corrupt=None)


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """A line item as a trip from the customer's nation to the supplier's, in kilometres and another currency (so that means seldom lie halfway between two roundings). Column pruning leaves out joins' unused columns."""
    line = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    line = line.join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trip_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trip_key"),
        F.col("o_orderdate").alias("pickup"),
        F.col("l_shipdate").alias("dropoff"),
        F.expr("nullif(l_linenumber, 7)").cast("int").alias("passengers"),
        (F.col("l_quantity") * 1.609344).alias("distance"),
        F.col("c_nationkey").alias("pu"),
        F.col("s_nationkey").alias("do"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_linestatus") == "O", 9).alias("payment_type"),
        (F.col("l_extendedprice") * 0.92137).alias("fare"),
        (F.col("l_extendedprice") * F.col("l_discount") * 0.84519).alias("tip"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax")) * 0.92137).alias("total"),
        (F.col("l_discount") * 0.91732).alias("tip_pct"),
        F.col("o_custkey").alias("customer"),
    )


TRIPS_SQL = """(SELECT l_orderkey * 10 + l_linenumber AS trip_id, concat_ws('-', l_orderkey, l_linenumber) AS trip_key, o_orderdate AS pickup, l_shipdate AS dropoff,
  CAST(nullif(l_linenumber, 7) AS INTEGER) AS passengers, l_quantity * 1.609344::DOUBLE AS distance, c_nationkey AS pu, s_nationkey AS "do",
  CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 WHEN l_linestatus = 'O' THEN 9 END AS payment_type,
  l_extendedprice * 0.92137::DOUBLE AS fare, l_extendedprice * l_discount * 0.84519::DOUBLE AS tip, l_extendedprice * (1 + l_tax) * 0.92137::DOUBLE AS total, l_discount * 0.91732::DOUBLE AS tip_pct, o_custkey AS customer
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as zones of regions; one is left out, so outer joins have something to show."""
    return table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey <> 7").select(F.col("n_nationkey").alias("location_id"), F.col("r_name").alias("borough"), F.col("n_name").alias("zone"))


ZONES_SQL = "(SELECT n_nationkey AS location_id, r_name AS borough, n_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7)"


def banks(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with a positive balance as banks by market value."""
    return table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("bank"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))


BANKS_SQL = "(SELECT s_suppkey AS bank, s_name AS name, s_acctbal AS value FROM supplier WHERE s_acctbal > 0)"


def cars(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as cars: price, size, kind, make, an option list, and a size that is missing now and then."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("car"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"), F.col("p_brand").alias("make"),
        F.expr("nullif(p_size % 10, 3)").alias("owners"), F.expr("case when p_partkey % 11 <> 0 then p_type end").alias("trim"), F.regexp_replace("p_name", " ", ",").alias("options"),
    )


CARS_SQL = "(SELECT p_partkey AS car, p_retailprice AS price, p_size AS size, p_type AS kind, p_brand AS make, nullif(p_size % 10, 3) AS owners, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS trim, replace(p_name, ' ', ',') AS options FROM part)"


def sql(body: str) -> str:
    """A query over the views above."""
    return f"WITH trips AS {TRIPS_SQL}, zones AS {ZONES_SQL}, banks AS {BANKS_SQL}, cars AS {CARS_SQL} {body}"
