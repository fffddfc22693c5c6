"""The queries opN_<name> over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, langid, lines, mixing, neighbours, pitmanyor, probminhash, rules, urls, warc
from weftline.llm.staging import staged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of every text, by a model of those whose id's CRC is not divisible by 10."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = pitmanyor.train(docs.filter("not held_out"))
    return pitmanyor.score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near copies that each document belongs to."""
    found = probminhash.classes(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_shingles")


URL_RULES = [urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"), urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/")]


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The rule that fits each page's URL, and the verdict: the rule's, else that of the models trained on URLs with rules."""
    judged = urls.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.col("__score").alias("score"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the lines that stay."""
    kept = lines.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__kept").alias("n_kept"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every text's ids and of the text decoded from them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, tokenizer_path()).drop("text"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as its record in the archives says it."""
    found = warc.round_trip(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), F.sha2("payload", 256).alias("payload_sha256"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every text, the fixed base rules, and the verdict of rules learnt from the labels."""
    stats = staged(rules.with_statistics(table(spark, folder, "documents").select("doc_id", "text")), "statistics")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    learnt = rules.fit(stats.join(labels, "doc_id"), F.col("quality") == 0, F.col("doc_id"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rule = rules.verdict(learnt)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rule.isNull()).alias("kept"), rule.alias("rule"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learnt from those whose id's CRC is not divisible by 5."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = langid.train(docs.filter(~held_out), key=F.col("doc_id"))
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, score_col="score")
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return neighbours.search(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix takes, and the shards its copies go to."""
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_shards")).alias("taken"), F.col("mix_shards").alias("shards"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_minhash": op2_minhash,
    "op3_url_filter": op3_url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_neighbours": op9_neighbours,
    "op10_mixing": op10_mixing,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    # SHA-1 as base32: five hexadecimal digits are four characters.
    "op6_warc": """SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, CASE WHEN page_id = last THEN sha256(coalesce(html, '')) END AS payload_sha256
  FROM (SELECT *, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)""",
}
