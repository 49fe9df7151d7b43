"""Queries of this subpackage: one opN_ query an operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.llm.mixing import plan_sql
from vetloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vetloom.llm.bpe import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm.vectors import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm.mixing import plan, sized

    return plan(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    scored = toxicity.score(docs, toxicity.learn(docs, labels, ~held_out))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm.urlfilter import judge

    return judge(table(spark, sf_dir, "pages"), back_off=True)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm.vectors import near_links

    return near_links(table(spark, sf_dir, "embeddings"), 0.9)


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm.pitmanyor import score

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return score(table(spark, sf_dir, "documents"), held_out)


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vetloom.llm.idfiles import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_nearest": op3_nearest,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_pack_windows": op6_pack_windows,
    "op7_url_filter": op7_url_filter,
    "op8_near_vectors": op8_near_vectors,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_id_files": op10_id_files,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix_sources": plan_sql(),
}
