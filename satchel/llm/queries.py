"""The operators applied to the given tables, one query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from satchel.llm import balance, bpe, chat, credentials, decontaminate, divergence, langid, lines, quality, setsketch, surrogates, trie, warc
from satchel.plans.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality.verdict(F.col("text"), forest).alias("v")).select("doc_id", "v.*")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = langid.learn(docs.where("NOT held_out"))
    return docs.select("doc_id", "held_out", langid.predict(F.col("text"), model).alias("v")).select("doc_id", "held_out", "v.*")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.resolve(docs, lines.begin(docs)).select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    file = bpe.load(spark, vocabulary or vocabulary_path())
    return table(spark, sf_dir, "documents").select("doc_id", bpe.digests(F.col("text"), file).alias("v")).select("doc_id", "v.*")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.summary(chat.format_conversations(turns))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return credentials.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


#: The key of the registered query; a corpus has a secret one of its own.
KEY = "a key for the given tables"


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, KEY).select("doc_id", "text", "entities.*")


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(warc.archived(spark, warc.page_records(table(spark, sf_dir, "pages"))))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt so that they share beginnings: the first h turns of the nearest
    smaller multiple of five, then their own."""
    own = stage(trie.sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "conversations")
    most = 8
    head = own.where(F.col("conv_id") % 5 == 0).select(
        F.col("conv_id").alias("b"), F.substring("key", 1, most * trie.WIDTH).alias("head"), F.slice("sizes", 1, most).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    both = own.withColumn("h", h).withColumn("b", F.col("conv_id") - F.col("conv_id") % 5).join(head, "b", "left")
    key, sizes = trie.spliced(F.col("head"), F.col("head_sizes"), F.col("key"), F.col("sizes"), F.col("h"))
    return trie.nodes(both.select("conv_id", key.alias("key"), sizes.alias("sizes")))


def balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        balance.text_link(F.col("text")).alias("links"))
    return balance.assign(docs, F.col("links"), "doc_id").drop("links").withColumn("grown_shard", F.lit(None).cast("int"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules,
        "op2_decontamination": decontamination,
        "op3_language_id": language_id,
        "op4_near_dedup": near_dedup,
        "op5_line_dedup": line_dedup,
        "op6_bpe": tokens,
        "op7_chat_format": chat_format,
        "op8_pii_surrogates": pii_surrogates,
        "op9_secret_scan": secret_scan,
        "op10_warc": warc_archives,
        "op11_prefix_trie": prefix_trie,
        "op12_balanced_shards": balanced_shards,
        "op13_source_divergence": source_divergence,
    }
