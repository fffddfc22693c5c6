"""Filters, rates, proportions, top-k, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.plans.registry import query
from weftline.plans.views import sql, table, trips


@query(sql("SELECT payment_type, round(avg(date_diff('day', pickup, dropoff)), 4) AS avg_duration_days FROM trips GROUP BY payment_type"))
def average_duration_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder).groupBy("payment_type").agg(F.round(F.avg(F.datediff("dropoff", "pickup")), 4).alias("avg_duration_days"))


@query(sql("SELECT pu, round(avg(CASE WHEN dropoff >= pickup THEN 1.0 ELSE 0.0 END), 6) AS rate FROM trips GROUP BY pu ORDER BY rate DESC, pu LIMIT 1"))
def highest_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The group with the highest rate."""
    rate = F.round(F.avg((F.col("dropoff") >= F.col("pickup")).cast("int")), 6)
    return trips(spark, folder).groupBy("pu").agg(rate.alias("rate")).orderBy(F.desc("rate"), "pu").limit(1)


@query("SELECT c_nationkey, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END), 6) AS share FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_rates(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.round(F.avg((F.col("c_mktsegment") == "BUILDING").cast("int")), 6)
    return table(spark, folder, "customer").groupBy("c_nationkey").agg(rate.alias("share")).orderBy(F.desc("share"), "c_nationkey").limit(3)


@query("SELECT count(*) AS n, round(avg(l_quantity), 4) AS avg_quantity, max(l_extendedprice) AS max_price FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('O', 'F') AND l_quantity > 30 AND l_discount BETWEEN 0.02 AND 0.08 AND l_tax < 0.07 AND l_linenumber <> 4")
def conjunctive_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A six-way filter, pushed to the scan, with global aggregates."""
    c = F.col
    rows = table(spark, folder, "lineitem").filter((c("l_returnflag") == "R") & c("l_linestatus").isin("O", "F") & (c("l_quantity") > 30) & c("l_discount").between(0.02, 0.08) & (c("l_tax") < 0.07) & (c("l_linenumber") != 4))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"), F.max("l_extendedprice").alias("max_price"))


@query(sql("SELECT round(count(*) FILTER (WHERE passengers > 3) / count(*), 6) AS proportion FROM trips"))
def filtered_proportion(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that meet a condition over all rows, nulls among them; 0 without rows."""
    return trips(spark, folder).agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("passengers") > 3), F.count("*")), F.lit(0.0)), 6).alias("proportion"))


@query(sql("SELECT round(avg(hour(ts) * 100 + minute(ts)), 4) AS mean_hhmm, round(avg(value), 4) AS mean_value, count(*) AS n FROM events WHERE hour(ts) * 100 + minute(ts) < 900"))
def early_events(spark: SparkSession, folder: str) -> DataFrame:
    """Means of rows before nine o'clock, by times written as HHMM."""
    hhmm = F.hour("ts") * 100 + F.minute("ts")
    return table(spark, folder, "events").filter(hhmm < 900).agg(F.round(F.avg(hhmm), 4).alias("mean_hhmm"), F.round(F.avg("value"), 4).alias("mean_value"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Frequencies of values, as counts and percent."""
    from weftline.functions.stats import with_scalars

    counts = table(spark, folder, "events").filter("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"))
    return with_scalars(counts, counts.agg(F.sum("n").alias("t"))).select("event_type", "n", F.round(F.col("n") * 100.0 / F.col("t"), 4).alias("pct"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(10)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def top_by_absolute(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(20)


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS rate, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, 1.0::DOUBLE, NULL FROM supplier")
def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of frames with different columns; what is missing is null."""
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1.0).alias("rate"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return a.subtract(table(spark, folder, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT bool_and(l_returnflag IN ('A', 'N', 'R')) AS is_subset, bool_and(l_linestatus IN ('O')) AS is_not FROM lineitem")
def subset_test(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").agg(F.bool_and(F.col("l_returnflag").isin("A", "N", "R")).alias("is_subset"), F.bool_and(F.col("l_linestatus").isin("O")).alias("is_not"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types, count(DISTINCT p_type) AS n FROM part GROUP BY 1")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values of a group."""
    return table(spark, folder, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.count_distinct("p_type").alias("n"))


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def duplicate_count(spark: SparkSession, folder: str) -> DataFrame:
    """Rows after the first of their key."""
    keys = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return keys.agg(F.sum(F.col("n") - 1).alias("duplicates"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS wd, strftime(o_orderdate, '%A') AS day_name, isodow(o_orderdate) >= 6 AS weekend, CAST(o_orderdate AS DATE) AS dt, date_trunc('month', o_orderdate) AS mon FROM orders""")
def date_parts(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, folder, "orders").select("o_orderkey", F.year(at).alias("y"), F.month(at).alias("m"), F.day(at).alias("d"), F.quarter(at).alias("q"), F.weekday(at).alias("wd"), scalars.day_name(at).alias("day_name"), (F.weekday(at) >= 5).alias("weekend"), F.to_date(at).alias("dt"), F.date_trunc("month", at).alias("mon"))


@query(sql("""SELECT trip_key, date_diff('second', pickup, dropoff) AS seconds, round(date_diff('second', pickup, dropoff) / 3600, 4) AS hours, date_diff('day', pickup, dropoff) AS days FROM trips"""))
def durations(spark: SparkSession, folder: str) -> DataFrame:
    s = scalars.seconds_between(F.col("pickup"), F.col("dropoff"))
    return trips(spark, folder).select("trip_key", s.alias("seconds"), F.round(s / 3600, 4).alias("hours"), F.datediff("dropoff", "pickup").cast("long").alias("days"))


@query("SELECT l_orderkey, l_linenumber, md5(concat_ws('|', l_orderkey, coalesce(nullif(l_linenumber, 7)::VARCHAR, ''), l_returnflag)) AS k FROM lineitem")
def business_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", scalars.business_key("l_orderkey", F.expr("nullif(l_linenumber, 7)"), "l_returnflag").alias("k"))


@query(sql("""SELECT trip_key, round(tip * 100 / nullif(fare, 0), 4) AS tip_percent, CASE WHEN fare > 0 THEN round(tip / fare, 6) ELSE 0.0 END AS tip_pct, round(fare / nullif(distance, 0), 4) AS fare_per_mile,
  round(fare / nullif(distance, 0) / nullif(passengers, 0), 4) AS per_passenger, round(ln(1 + fare), 6) AS log_fare, round(sqrt(abs(fare - 1000)), 6) AS root FROM trips"""))
def ratios(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    mile = scalars.ratio(c("fare"), c("distance"))
    return trips(spark, folder).select("trip_key", F.round(scalars.percent(c("tip"), c("fare")), 4).alias("tip_percent"), F.round(scalars.guarded_ratio(c("tip"), c("fare")), 6).alias("tip_pct"), F.round(mile, 4).alias("fare_per_mile"), F.round(scalars.ratio(mile, c("passengers")), 4).alias("per_passenger"), F.round(F.log1p("fare"), 6).alias("log_fare"), F.round(F.sqrt(F.abs(c("fare") - 1000)), 6).alias("root"))


@query("""SELECT shape, len, is_digit, hyphen, low, is_title, is_upper, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(w, '\\p{Lu}', 'X', 'g'), '\\p{Ll}', 'x', 'g') AS shape, length(w) AS len,
  regexp_matches(w, '^[0-9]+$') AS is_digit, contains(w, '-') AS hyphen, lower(w) AS low, regexp_full_match(w, '[^\\p{Ll}]*\\p{Lu}[^\\p{Lu}]*') AS is_title, regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '\\p{Ll}') AS is_upper
  FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY ALL""")
def token_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes and classes of all tokens of whole texts, with how often they stand."""
    w = F.col("w")
    tokens = table(spark, folder, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    classes = {"shape": scalars.word_shape(w), "len": F.length("w").cast("long"), "is_digit": w.rlike("^[0-9]+$"), "hyphen": w.contains("-"), "low": F.lower("w"), "is_title": w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Lu}]*$"), "is_upper": w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")}
    return tokens.select(*[c.alias(n) for n, c in classes.items()]).groupBy(*classes).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS as_double, TRY_CAST(p_name AS INTEGER) AS as_int, len(string_split(p_name, ' ')) AS words, upper(trim(p_brand)) AS brand FROM part")
def casts_and_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("as_double"), F.expr("try_cast(p_name as int)").alias("as_int"), F.size(F.split("p_name", " ")).cast("long").alias("words"), F.upper(F.trim("p_brand")).alias("brand"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def pivot_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A cross table."""
    p = table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT o_orderkey, '{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}' AS js FROM orders")
def row_to_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))).alias("js"))


@query("""WITH m AS (SELECT l_returnflag AS g, avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS a, avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS b FROM lineitem GROUP BY 1 UNION ALL SELECT 'none', 0.0, 1.0)
  SELECT g, round(CASE WHEN a <> 0 AND b <> 0 THEN (b / a - 1) * 100 END, 4) AS throughput_gain_pct, round(CASE WHEN a <> 0 AND b <> 0 THEN (a / b - 1) * 100 END, 4) AS latency_gain_pct FROM m""")
def percent_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Gain of one measure over another in percent, where more is better and where less is; null where either is 0."""
    price = lambda status: F.avg(F.when(F.col("l_linestatus") == status, F.col("l_extendedprice")))
    measures = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(price("O").alias("a"), price("F").alias("b"))
    measures = measures.unionByName(spark.createDataFrame([("none", 0.0, 1.0)], "g string, a double, b double"))
    a, b = F.col("a"), F.col("b")
    return measures.select("g", F.round(scalars.gain(a, b), 4).alias("throughput_gain_pct"), F.round(scalars.gain(a, b, higher=False), 4).alias("latency_gain_pct"))


@query("SELECT event_type AS pickup_borough, date_trunc('hour', ts) AS window_start, count(*) AS trips, round(sum(value), 2) AS total_revenue, round(avg(value * 0.70710678), 2) AS avg_fare, round(avg(user_id * 0.70710678), 2) AS avg_distance, round(avg(value * 0.70710678), 4) AS avg_tip_pct FROM events GROUP BY 1, 2")
def gold_events_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """The mart by area and hour, over events."""
    from weftline.operators import marts

    rows = table(spark, folder, "events").select(F.col("event_type").alias("pickup_borough"), "ts", "value", (F.col("value") * 0.70710678).alias("part"), (F.col("user_id") * 0.70710678).alias("who"))
    return marts.borough_hourly("ts", "value", "part", "who", "part").of(rows)


@query("SELECT p_partkey, TRY_CAST('1995-0' || (p_size % 12) || '-15 10:00:00' AS TIMESTAMP) AS at FROM part")
def strings_to_times(spark: SparkSession, folder: str) -> DataFrame:
    """Text as timestamps; what is none is null."""
    text = F.concat(F.lit("1995-0"), F.col("p_size") % 12, F.lit("-15 10:00:00"))
    return table(spark, folder, "part").select("p_partkey", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"))
