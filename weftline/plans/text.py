"""Tokens, labels, tagging and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import scalars, stats
from weftline.operators import tagging
from weftline.plans.registry import query
from weftline.plans.views import table
from weftline.sources import readers


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM conversations) WHERE token <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 10")
def most_common_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = table(spark, folder, "conversations").select(F.explode(F.split("text", " ")).alias("token")).filter("token <> ''")
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(10)


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return stats.confusion(table(spark, folder, "labels"), "quality", "toxic")


@query("""WITH r AS (SELECT label, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE p = label) AS called, count(*) FILTER (WHERE t = label AND p = label) AS ok FROM (SELECT quality::VARCHAR AS t, toxic::VARCHAR AS p FROM labels), (VALUES ('0'), ('1')) v(label) GROUP BY 1),
  s AS (SELECT label, coalesce(ok / nullif(called, 0), 0) AS precision, coalesce(ok / nullif(support, 0), 0) AS recall, coalesce(2.0 * ok / nullif(called + support, 0), 0)::DOUBLE AS f1, support, ok FROM r)
  SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
  UNION ALL SELECT 'accuracy', round(sum(ok) / sum(support), 6), round(sum(ok) / sum(support), 6), round(sum(ok) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""")
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 by label and over all."""
    return stats.classification_report(table(spark, folder, "labels"), "quality", "toxic")


@query("SELECT quality AS label, count(*) AS n, sum(CASE WHEN quality <> toxic THEN 1 ELSE 0 END)::BIGINT AS errors, round(1 - sum(CASE WHEN quality <> toxic THEN 1 ELSE 0 END) / count(*), 6) AS accuracy, CASE quality WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE END AS weight FROM labels GROUP BY quality")
def errors_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.errors_by_label(table(spark, folder, "labels"), "quality", "toxic", {"0": 0.5, "1": 2.0})


@query("SELECT role AS label, count(*) AS n, round(sum(count(*)) OVER () * 1.0 / count(*) * CASE WHEN role = 'user' THEN 2.0 ELSE 1.0 END, 6) AS weight FROM conversations GROUP BY 1")
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Inverse frequencies, one label boosted."""
    return tagging.class_weights(table(spark, folder, "conversations"), "role", {"user": 2.0}).withColumn("weight", F.round("weight", 6))


@query("""SELECT conv_id, turn, token, coalesce(prev, '') AS prev_token, coalesce("next", '') AS next_token, prev IS NULL AS "BOS", "next" IS NULL AS "EOS", regexp_matches(token, '[0-9]') AS has_digit, contains(token, '-') AS hyphenated, lower(token) IN ('and', 'or', 'the', 'a', 'an', 'of', 'in') AS is_stop
  FROM (SELECT conv_id, turn, i, lower(lag(w) OVER p) AS prev, lower(lead(w) OVER p) AS "next", w AS token FROM (SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS l FROM conversations)) WINDOW p AS (PARTITION BY conv_id, turn ORDER BY i))""")
def token_features(spark: SparkSession, folder: str) -> DataFrame:
    """Some of the features of every token; neighbours come from the array, without a shuffle."""
    rows = tagging.exploded(tagging.tokenised(table(spark, folder, "conversations"), "text"), "text", "conv_id", "turn")
    return tagging.features(rows).select("conv_id", "turn", "token", "prev_token", "next_token", "BOS", "EOS", "has_digit", "hyphenated", "is_stop")


@query("""SELECT conv_id, turn, len(l) AS n, array_to_string(list_transform(l, lambda w, i: coalesce(lower(l[i - 1]), '') || '<' || lower(w) || '>' || coalesce(lower(l[i + 1]), '') || CASE WHEN i = 1 THEN '!' ELSE '' END), ' ') AS chain
  FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS l FROM conversations)""")
def sentence_features(spark: SparkSession, folder: str) -> DataFrame:
    """Each sentence as an array of the features of its tokens."""
    rows = tagging.feature_lists(tagging.tokenised(table(spark, folder, "conversations"), "text"), "text", "conv_id", "turn")
    told = F.transform("features", lambda x: F.concat(x["prev_token"], F.lit("<"), x["lower"], F.lit(">"), x["next_token"], F.when(x["BOS"], "!").otherwise("")))
    return rows.select("conv_id", "turn", F.size("features").cast("long").alias("n"), F.array_join(told, " ").alias("chain"))


@query("""SELECT token, regexp_matches(token, '\\p{L}') AS has_alpha, contains(token, '/') AS slash_present, regexp_matches(token, '^[0-9]+$') AS is_digit, regexp_matches(token, '^[0-9]+/[0-9]+') AS is_fraction, regexp_matches(token, '^[0-9]+\\.[0-9]+') AS is_decimal,
  token IN ('half') OR regexp_matches(token, '^[0-9]') AS is_quantity, token IN ('cup', 'kg') AS is_unit, token IN (',') AS is_punct, count(*) AS n
  FROM (SELECT unnest([CAST(l_quantity AS INTEGER) || '/' || l_linenumber, l_linenumber::VARCHAR, l_linenumber || '.5', l_returnflag, 'cup', 'kg', 'half', ',']) AS token FROM lineitem) GROUP BY ALL""")
def token_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities, fractions, decimals, units and punctuation among tokens made of line items."""
    line = table(spark, folder, "lineitem")
    text = [F.concat(F.col("l_quantity").cast("int"), F.lit("/"), "l_linenumber"), F.col("l_linenumber").cast("string"), F.concat("l_linenumber", F.lit(".5")), F.col("l_returnflag"), *map(F.lit, ("cup", "kg", "half", ","))]
    rows = tagging.exploded(line.select("l_orderkey", F.array(*text).alias("tokens")), "tokens", "l_orderkey")
    names = ["token", "has_alpha", "slash_present", "is_digit", "is_fraction", "is_decimal", "is_quantity", "is_unit", "is_punct"]
    return tagging.features(rows).groupBy(*names).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences (id, tokens, labels) whose labels follow from the tokens by a rule."""
    turns = tagging.tokenised(table(spark, folder, "conversations"), "text").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("tokens"))
    return turns.withColumn("labels", F.transform("tokens", lambda w: F.when(w.contains("."), "END").when(F.length(w) <= 3, "SHORT").otherwise("WORD")))


@query("SELECT concat_ws('-', conv_id, turn) AS id, len(l) AS tokens, len(list_filter(l, lambda w: contains(w, '.'))) AS ends FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS l FROM conversations)")
def tokens_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of one label from parallel arrays."""
    rows = tagging.aligned(_labelled(spark, folder), "tokens", "labels")
    return rows.select("id", F.size("tokens").cast("long").alias("tokens"), F.size(tagging.by_label(F.col("tokens"), F.col("labels"), "END")).cast("long").alias("ends"))


@query()
def sequence_tagger(spark: SparkSession, folder: str) -> DataFrame:
    """Train the tagger on most sentences, tag the rest, and report."""
    width = 4096
    rows = tagging.exploded(_labelled(spark, folder).select("id", "tokens", "labels"), "tokens", "id", "labels")
    rows = tagging.slotted(tagging.features(rows), width).select("id", "i", "slots", F.get("labels", F.col("i")).alias("label"))
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    weights = tagging.class_weights(rows.filter(~held)).select("label", "weight")
    tagger = tagging.fit_tagger(rows.filter(~held).join(F.broadcast(weights), "label"), width=width)
    sentences = rows.filter(held).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "slots", "label"))).alias("x")).select("id", F.col("x.slots").alias("slots"), F.col("x.label").alias("truth"))
    found = tagging.tagged(sentences, tagger).join(sentences.select("id", "truth"), "id")
    pairs = found.select(F.explode(F.arrays_zip("truth", "labels")).alias("p")).select(F.col("p.truth").alias("truth"), F.col("p.labels").alias("predicted"))
    return stats.classification_report(pairs, "truth", "predicted")


@query("""SELECT doc_id, len(t) AS n, array_to_string(list_concat(l, list_transform(range(greatest(len(t) - len(l), 0)), lambda x: 'O'))[1:len(t)], '|') AS padded
  FROM (SELECT doc_id, string_split(text, ' ') AS t, string_split(CASE WHEN doc_id % 2 = 0 THEN text || ' one two' ELSE split_part(text, '. ', 1) END, ' ') AS l FROM documents)""")
def pad_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of whole texts, some longer and some shorter than the tokens, cut or padded to their number."""
    labels = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" one two"))).otherwise(F.split_part("text", F.lit(". "), F.lit(1)))
    rows = table(spark, folder, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n"), F.split(labels, " ").alias("l"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.array_join(scalars.padded(F.col("l"), F.col("n"), "O"), "|").alias("padded"))


@query("SELECT page_id, CAST(i AS INTEGER) AS \"row\", 'Bank ' || page_id || i AS name, CAST(i * 10 AS VARCHAR) AS value FROM (SELECT page_id, unnest([0, 1]) AS i FROM pages WHERE page_id % 3 <> 0)")
def html_table(spark: SparkSession, folder: str) -> DataFrame:
    """The first table of each page; here a table is put into pages first, as those of the data have none."""
    rows = F.concat(F.lit("<tr><td>Bank "), F.col("page_id"), F.lit("0</td><td>0</td></tr><tr><td>Bank "), F.col("page_id"), F.lit("1</td><td>10</td></tr>"))
    html = F.concat("html", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<table><tr><th>Name</th><th>Value</th></tr>"), rows, F.lit("</table>"))).otherwise(F.lit("")))
    return readers.html_tables(table(spark, folder, "pages").select("page_id", html.alias("html")), "page_id", "html", ["name", "value"])


@query("SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def conversation_ends(spark: SparkSession, folder: str) -> DataFrame:
    """The last speaker of each conversation."""
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
def neighbours_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Values before and after in the order of a group."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
