"""Gold marts, dimension joins and incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import marts
from weftline.plans.registry import query
from weftline.plans.views import sql, table, trips, zones
from weftline.sources import readers



def hourly() -> marts.Mart:
    return marts.borough_hourly("pickup", "total", "fare", "distance", "tip_pct", "month")


def flows() -> marts.Mart:
    return marts.zone_flows("fare", "distance")


_HOURLY_SQL = sql("""SELECT borough AS pickup_borough, date_trunc('month', pickup) AS window_start, count(*) AS trips, round(sum(total), 2) AS total_revenue,
  round(avg(fare), 2) AS avg_fare, round(avg(distance), 2) AS avg_distance, round(avg(tip_pct), 4) AS avg_tip_pct FROM trips JOIN zones ON pu = location_id GROUP BY ALL""")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    return marts.with_zones(trips(spark, folder), zones(spark, folder), "pu", "do")


@query(_HOURLY_SQL)
def gold_area_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue and means by area and time bucket."""
    return hourly().of(_placed(spark, folder))


@query(_HOURLY_SQL)
def gold_area_hourly_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The same from three batches' partial sums."""
    rows = _placed(spark, folder)
    mart = hourly()
    return mart.finished(mart.merged(*[mart.partial(rows.filter(F.col("trip_id") % 3 == i)) for i in range(3)]))


@query(sql("""SELECT a.zone AS pickup_zone, b.zone AS dropoff_zone, count(*) AS trips, round(avg(fare), 2) AS avg_fare, round(avg(distance), 2) AS avg_distance
  FROM trips JOIN zones a ON pu = a.location_id JOIN zones b ON "do" = b.location_id GROUP BY ALL"""))
def gold_zone_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Trips and means between zones."""
    return flows().of(_placed(spark, folder))


@query(sql("""SELECT CAST(pickup AS DATE) AS trip_date, payment_type, CASE payment_type WHEN 1 THEN 'Credit card' WHEN 2 THEN 'Cash' ELSE 'Unknown' END AS payment_label, count(*) AS trips, round(sum(total), 2) AS total_revenue
  FROM trips WHERE payment_type IS NOT NULL GROUP BY ALL"""))
def gold_payment_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Trips and revenue by day and payment type."""
    return marts.payment_daily("pickup", "total").of(trips(spark, folder))


@query(sql("SELECT zone, borough, count(*) AS trips, round(avg(total), 2) AS avg_total FROM trips LEFT JOIN zones ON pu = location_id GROUP BY ALL"))
def join_left_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Trips by zone; trips of an unknown zone stand under null."""
    z = zones(spark, folder)
    return trips(spark, folder).join(z, F.col("pu") == F.col("location_id"), "left").groupBy("zone", "borough").agg(F.count("*").alias("trips"), F.round(F.avg("total"), 2).alias("avg_total"))


@query(sql("SELECT location_id, zone, n AS trips FROM zones LEFT JOIN (SELECT pu, count(*) AS n FROM trips WHERE passengers = 1 AND distance < 2 GROUP BY pu) ON location_id = pu"))
def join_zones_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by zone; zones without trips keep null."""
    counts = trips(spark, folder).filter("passengers = 1 and distance < 2").groupBy("pu").agg(F.count("*").alias("trips"))
    return zones(spark, folder).join(counts, F.col("location_id") == F.col("pu"), "left").select("location_id", "zone", "trips")


@query(sql("SELECT location_id, zone, round(coalesce(m, 0), 4) AS avg_passengers FROM zones LEFT JOIN (SELECT pu, avg(passengers) AS m FROM trips WHERE distance > 49 GROUP BY pu) ON location_id = pu"))
def join_zones_average_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Averages by zone, 0 where there is none."""
    means = trips(spark, folder).filter("distance > 49").groupBy("pu").agg(F.avg("passengers").alias("m"))
    return zones(spark, folder).join(means, F.col("location_id") == F.col("pu"), "left").select("location_id", "zone", F.round(F.coalesce("m", F.lit(0.0)), 4).alias("avg_passengers"))


@query(sql("""SELECT coalesce(pu, "do") AS location_id, coalesce(a, 0) AS pickups, coalesce(b, 0) AS dropoffs, round(coalesce(a, 0) / (coalesce(b, 0) + 1e-6), 4) AS ratio
  FROM (SELECT pu, count(*) AS a FROM trips WHERE pu < 20 GROUP BY pu) FULL JOIN (SELECT "do", count(*) AS b FROM trips WHERE "do" > 3 GROUP BY "do") ON pu = "do" """))
def join_full_pickups_dropoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Pickups and dropoffs by location, from both sides, and their ratio."""
    t = trips(spark, folder)
    up = t.filter("pu < 20").groupBy(F.col("pu").alias("location_id")).agg(F.count("*").alias("a"))
    down = t.filter("do > 3").groupBy(F.col("do").alias("location_id")).agg(F.count("*").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return up.join(down, "location_id", "full_outer").select("location_id", zero("a").alias("pickups"), zero("b").alias("dropoffs"), F.round(zero("a") / (zero("b") + 1e-6), 4).alias("ratio"))


@query(sql("""SELECT pu, CAST(month(pickup) AS INTEGER) AS month, count(*) AS trips FROM trips WHERE pu IN (SELECT pu FROM trips GROUP BY pu ORDER BY count(*) DESC, pu LIMIT 5) GROUP BY ALL"""))
def join_semi_top_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Months of the five busiest zones."""
    t = trips(spark, folder)
    busiest = t.groupBy("pu").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pu").limit(5)
    return t.join(busiest, "pu", "left_semi").groupBy("pu", F.month("pickup").alias("month")).agg(F.count("*").alias("trips"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def join_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without a large order."""
    large = table(spark, folder, "orders").filter("o_totalprice > 150000")
    return table(spark, folder, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""WITH old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, round(c_acctbal * 2, 2) AS v FROM customer WHERE c_custkey % 2 = 0)
  SELECT k, v FROM new UNION ALL SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new)""")
def sink_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A table after changes replace rows of their key."""
    c = table(spark, folder, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") * 2, 2).alias("v"))
    return marts.upserted(old, new, ["k"])


@query("""WITH old AS (SELECT l_orderkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)
  SELECT k, v FROM old UNION ALL SELECT l_orderkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1""")
def sink_insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """A table after rows with new keys are added, one for each key."""
    line = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    return marts.inserted(line.filter("k % 3 = 0").groupBy("k").agg(F.min("v").alias("v")), line, ["k"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 AND o_orderkey <= 6000")
def source_increment(spark: SparkSession, folder: str) -> DataFrame:
    """Rows after a cursor, at most so many keys on."""
    return readers.increment(table(spark, folder, "orders"), "o_orderkey", 1000, 5000).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 500")
def source_first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows by key."""
    return readers.first_rows(table(spark, folder, "orders"), 500, "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(value, 4) AS value FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_parse(spark: SparkSession, folder: str) -> DataFrame:
    """A field of JSON text."""
    parsed = table(spark, folder, "events").withColumn("p", F.from_json("props", "k long"))
    return parsed.filter("p.k > 50").select("event_id", F.col("p.k").alias("k"), F.round("value", 4).alias("value"))
