"""Files written and read again: text formats, broken files, rolled files, counts, tables, spellings, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import stats
from weftline.operators import cleaning
from weftline.plans.registry import query
from weftline.plans.views import sql, table, zones
from weftline.sources import readers, sinks
from weftline.sources.paths import shared


@query(sql("SELECT location_id, borough, zone, 'none' AS service_zone FROM zones"))
def csv_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zone lookup as CSV, its number cast."""
    at = shared(spark, "files")
    named = {"LocationID": "location_id", "Borough": "borough", "Zone": "zone"}
    sinks.csv(zones(spark, folder).select(*[F.col(c).alias(n) for n, c in named.items()], F.lit("none").alias("service_zone")), at)
    return readers.zones(spark, at)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    """CSV with a header of padded names, types found by reading."""
    at = shared(spark, "files")
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias(" s_suppkey"), F.col("s_name").alias("s_name "), F.col("s_acctbal").alias(" s_acctbal "))
    rows.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(at)
    return readers.csv(spark, at, infer=True)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def json_array(spark: SparkSession, folder: str) -> DataFrame:
    """A file that is one list of objects."""
    at = shared(spark, "files")
    item = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    table(spark, folder, "nation").agg(F.to_json(F.collect_list(item))).write.text(at)
    return readers.json_array(spark, at, "k long, name string")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def tolerant_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files among which some are none."""
    at = shared(spark, "files")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    rows.write.parquet(f"{at}/good")
    table(spark, folder, "region").select("r_name").write.text(f"{at}/bad")
    return readers.parquet(spark, f"{at}/bad", f"{at}/good", tolerant=True, schema=rows.schema)


@query("SELECT count(*) AS n, true AS rolled, true AS several FROM orders")
def rolled_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of at most 500 rows."""
    at = shared(spark, "files")
    sinks.parquet(table(spark, folder, "orders").select("o_orderkey"), at, rows_per_file=500)
    files = spark.read.parquet(at).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= 500).alias("rolled"), (F.count("*") > 1).alias("several"))


@query("SELECT (SELECT count(*) FROM orders) AS lines, (SELECT count(*) FROM orders) AS parquet_rows, (SELECT count(*) FROM nation) AS table_rows, 0::BIGINT AS none")
def file_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files, rows by Parquet footers, rows of a table, and of a folder that is not there."""
    at = shared(spark, "files")
    table(spark, folder, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus"))).write.text(f"{at}/lines")
    table(spark, folder, "orders").write.parquet(f"{at}/rows")
    counts = (readers.line_count(spark, f"{at}/lines"), readers.row_count(spark, f"{at}/rows"), table(spark, folder, "nation").count(), readers.row_count(spark, f"{at}/none"))
    return spark.createDataFrame([counts], "lines long, parquet_rows long, table_rows long, none long")


@query("SELECT r_regionkey, r_name FROM region")
def created_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table made by a statement, twice without harm, and filled."""
    at = shared(spark, "files")
    name = "weftline_" + at.rsplit("-", 1)[1]
    for _ in range(2):
        sinks.created(spark, name, "r_regionkey bigint not null, r_name string", at)
    table(spark, folder, "region").select(F.col("r_regionkey").cast("long"), "r_name").write.insertInto(name)
    filled = spark.table(name).schema
    sinks.dropped(spark, name)
    return spark.read.schema(filled).parquet(at)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS fee FROM orders")
def merged_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Files in which one column has two names, as one column."""
    rows, even = table(spark, folder, "orders"), F.col("o_orderkey") % 2 == 0
    new = rows.filter(even).select("o_orderkey", F.col("o_totalprice").alias("fee"))
    old = rows.filter(~even).select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("old_fee"))
    return cleaning.merged_columns(new.unionByName(old, allowMissingColumns=True), "fee", "old_fee")


_KINDS = {"c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "text", "joined": "time"}


_PROFILED = "WITH t AS (SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS c_nationkey, c_acctbal, c_mktsegment, TIMESTAMP '2024-01-01' AS joined FROM customer) "


@query(_PROFILED + " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_distinct FROM t""" for c, k in _KINDS.items()))
def schema_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Each column with its kind, its nulls and its distinct values."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", F.expr("nullif(c_nationkey, 3)").alias("c_nationkey"), "c_acctbal", "c_mktsegment", F.to_timestamp(F.lit("2024-01-01")).alias("joined"))
    return stats.schema_profile(rows)
