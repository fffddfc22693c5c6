"""Temporal, geographic, pricing and tip summaries of trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.functions.stats import five_numbers, with_scalars
from weftline.plans.registry import query
from weftline.plans.views import sql, table, trips, zones

_FIVE = "count({0}) AS n, round(avg({0}), 4) AS mean, round(quantile_cont({0}, 0.5), 4) AS median, min({0}) AS min, max({0}) AS max"
_TIER = "CASE WHEN distance <= 2 THEN 'short' WHEN distance <= 5 THEN 'medium' ELSE 'long' END"


def _tier(distance: Column) -> Column:
    return F.when(distance <= 2, "short").when(distance <= 5, "medium").otherwise("long")


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")
def events_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour LIMIT 1")
def busiest_hour(spark: SparkSession, folder: str) -> DataFrame:
    return events_by_hour(spark, folder).orderBy(F.desc("n"), "hour").limit(1)


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, isodow(ts) >= 6 AS weekend, CAST(round(count(*) / (13 / 256)) AS BIGINT) AS scaled FROM events WHERE substr(md5(CAST(event_id AS VARCHAR)), 1, 2) < '0d' GROUP BY ALL")
def scaled_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a sample of 13 in 256 rows by checksum, scaled up."""
    some = table(spark, folder, "events").filter(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 2) < "0d")
    return some.groupBy(F.hour("ts").alias("hour"), (F.weekday("ts") >= 5).alias("weekend")).agg(F.round(F.count("*") / (13 / 256)).cast("long").alias("scaled"))


@query(sql("SELECT CAST(month(pickup) AS INTEGER) AS month, round(sum(total), 2) AS revenue FROM trips GROUP BY 1"))
def revenue_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder).groupBy(F.month("pickup").alias("month")).agg(F.round(F.sum("total"), 2).alias("revenue"))


@query(sql("SELECT CAST(quarter(pickup) AS INTEGER) AS quarter, round(sum(total) * 100 / sum(sum(total)) OVER (), 4) AS share FROM trips GROUP BY 1"))
def revenue_share_by_quarter(spark: SparkSession, folder: str) -> DataFrame:
    sums = trips(spark, folder).groupBy(F.quarter("pickup").alias("quarter")).agg(F.sum("total").alias("s"))
    return with_scalars(sums, sums.agg(F.sum("s").alias("t"))).select("quarter", F.round(F.col("s") * 100 / F.col("t"), 4).alias("share"))


@query("SELECT CASE WHEN hour(ts) >= 23 OR hour(ts) <= 5 THEN 'Night' ELSE 'Day' END AS part, round(sum(value) * 100 / sum(sum(value)) OVER (), 4) AS share FROM events GROUP BY 1")
def day_night_share(spark: SparkSession, folder: str) -> DataFrame:
    part = F.when(scalars.is_night(F.hour("ts")), "Night").otherwise("Day")
    sums = table(spark, folder, "events").groupBy(part.alias("part")).agg(F.sum("value").alias("s"))
    return with_scalars(sums, sums.agg(F.sum("s").alias("t"))).select("part", F.round(F.col("s") * 100 / F.col("t"), 4).alias("share"))


@query(sql(f"SELECT passengers, {_FIVE.format('tip')} FROM trips GROUP BY 1"))
def tips_by_passengers(spark: SparkSession, folder: str) -> DataFrame:
    """Five numbers of tips by passengers; unknown is a group."""
    return trips(spark, folder).groupBy("passengers").agg(*five_numbers("tip"))


@query(sql(f"SELECT {_TIER} AS tier, payment_type, {_FIVE.format('fare')} FROM trips GROUP BY ALL"))
def fares_by_tier(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder).groupBy(_tier(F.col("distance")).alias("tier"), "payment_type").agg(*five_numbers("fare"))


@query(sql(f"SELECT zone, {_FIVE.format('total')} FROM trips JOIN zones ON pu = location_id GROUP BY 1"))
def totals_by_zone(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder).join(zones(spark, folder), F.col("pu") == F.col("location_id")).groupBy("zone").agg(*five_numbers("total"))


@query(sql("SELECT pu, round(avg(fare / nullif(distance, 0)), 4) AS fare_per_mile, round(avg(fare / nullif(distance, 0) / nullif(passengers, 0)), 4) AS per_passenger FROM trips GROUP BY 1"))
def fare_per_mile(spark: SparkSession, folder: str) -> DataFrame:
    mile = scalars.ratio(F.col("fare"), F.col("distance"))
    return trips(spark, folder).groupBy("pu").agg(F.round(F.avg(mile), 4).alias("fare_per_mile"), F.round(F.avg(scalars.ratio(mile, F.col("passengers"))), 4).alias("per_passenger"))


@query(sql("SELECT strftime(pickup, '%A') AS day_name, round(avg(passengers), 4) AS mean_passengers FROM trips GROUP BY 1"))
def passengers_by_weekday(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder).groupBy(scalars.day_name(F.col("pickup")).alias("day_name")).agg(F.round(F.avg("passengers"), 4).alias("mean_passengers"))


@query(sql("""SELECT m.measure, round(avg(CASE WHEN tip_pct < 0.02 THEN m.v END), 4) AS low, round(avg(CASE WHEN tip_pct > 0.08 THEN m.v END), 4) AS high
  FROM (SELECT tip_pct, unnest([{'measure': 'distance', 'v': distance}, {'measure': 'fare', 'v': fare}, {'measure': 'passengers', 'v': passengers::DOUBLE}, {'measure': 'total', 'v': total}]) AS m FROM trips) GROUP BY 1"""))
def tip_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """Means of low and high tippers, a row for each measure; one pass."""
    low, high = F.col("tip_pct") < 0.02, F.col("tip_pct") > 0.08
    names = ["distance", "fare", "passengers", "total"]
    parts = [F.struct(F.lit(n).alias("measure"), F.round(F.avg(F.when(low, F.col(n))), 4).alias("low"), F.round(F.avg(F.when(high, F.col(n))), 4).alias("high")) for n in names]
    return trips(spark, folder).agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


@query(sql("""SELECT trip_key, "do", speed FROM (SELECT trip_key, "do", round(distance / (date_diff('second', pickup, dropoff) / 3600.0), 6) AS speed FROM trips WHERE dropoff > pickup) ORDER BY speed, trip_key, "do" LIMIT 50"""))
def slowest_trips(spark: SparkSession, folder: str) -> DataFrame:
    speed = F.round(scalars.ratio(F.col("distance"), scalars.seconds_between(F.col("pickup"), F.col("dropoff")) / 3600.0), 6)
    return trips(spark, folder).filter("dropoff > pickup").select("trip_key", "do", speed.alias("speed")).orderBy("speed", "trip_key", "do").limit(50)


@query(sql("""SELECT pu, "do", CAST(month(pickup) AS INTEGER) AS month, round(avg(distance / (date_diff('second', pickup, dropoff) / 3600.0)), 6) AS speed FROM trips WHERE dropoff > pickup GROUP BY ALL"""))
def route_speeds(spark: SparkSession, folder: str) -> DataFrame:
    """Mean speed of each route and month."""
    speed = scalars.ratio(F.col("distance"), scalars.seconds_between(F.col("pickup"), F.col("dropoff")) / 3600.0)
    return trips(spark, folder).filter("dropoff > pickup").groupBy("pu", "do", F.month("pickup").alias("month")).agg(F.round(F.avg(speed), 6).alias("speed"))


@query(sql("""SELECT location_id, pickups, dropoffs, round(pickups / (dropoffs + 1e-6), 6) AS ratio FROM (SELECT location_id, (SELECT count(*) FROM trips WHERE pu = location_id) AS pickups, (SELECT count(*) FROM trips WHERE "do" = location_id) AS dropoffs FROM zones)
  WHERE pickups > 0 AND dropoffs > 0 ORDER BY ratio DESC, location_id LIMIT 10"""))
def top_pickup_ratios(spark: SparkSession, folder: str) -> DataFrame:
    t = trips(spark, folder)
    up, down = (t.groupBy(F.col(c).alias("location_id")).agg(F.count("*").alias(n)) for c, n in (("pu", "pickups"), ("do", "dropoffs")))
    rows = zones(spark, folder).select("location_id").join(up, "location_id").join(down, "location_id")
    return rows.withColumn("ratio", F.round(F.col("pickups") / (F.col("dropoffs") + 1e-6), 6)).orderBy(F.desc("ratio"), "location_id").limit(10)


@query(sql("SELECT CAST(month(pickup) AS INTEGER) AS month, count(passengers) AS n, round(avg(passengers), 4) AS mean, quantile_cont(passengers, 0.5) AS median, max(passengers) AS max FROM trips GROUP BY 1"))
def four_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of known values, mean, median and maximum."""
    return trips(spark, folder).groupBy(F.month("pickup").alias("month")).agg(F.count("passengers").alias("n"), F.round(F.avg("passengers"), 4).alias("mean"), F.median("passengers").alias("median"), F.max("passengers").alias("max"))


@query(sql("SELECT trip_key, pu, total FROM (SELECT *, row_number() OVER (PARTITION BY pu ORDER BY total DESC, trip_key, \"do\", distance) AS r FROM trips) WHERE r <= 3"))
def top_trips_by_zone(spark: SparkSession, folder: str) -> DataFrame:
    """The three dearest trips of each zone; Spark keeps partial top rows before the shuffle."""
    w = Window.partitionBy("pu").orderBy(F.desc("total"), "trip_key", "do", "distance")
    return trips(spark, folder).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("trip_key", "pu", "total")
