"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, licenses, minhash, mixing, ngram_join, pieces, sharding, spelling, suffix_dedup, telephony, toxicity, url_filter
from .common import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.audio_features(telephony.store_audio(read(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "hits")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(read(spark, sf_dir, "documents"), with_texts=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(read(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read(spark, sf_dir, "documents"))
    names = F.array_distinct("matches.template")
    return found.select(
        "doc_id", "n_shingles", F.size(names).alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.size("matches").alias("n_matches"), F.array_max(F.col("matches.contained")).alias("contained"),
        F.array_min(F.col("matches.first_word")).alias("first_word"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_mixing": op3_mixing,
        "op4_media": op4_media,
        "op5_toxicity": op5_toxicity,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_sharding": op8_sharding,
        "op9_minhash": op9_minhash,
        "op10_licenses": op10_licenses,
        "op11_filter_audit": op11_filter_audit,
        "op12_spelling": op12_spelling,
        "op13_ngram_join": op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.url_filter_sql(),
        "op3_mixing": mixing.mixing_sql(),
        "op6_exact_dedup": exact_dedup.EXACT_DEDUP_SQL,
        "op9_minhash": minhash.NEAR_DEDUP_SQL,
        "op11_filter_audit": filter_audit.AUDIT_SQL,
        "op12_spelling": spelling.SPELLING_SQL,
        "op13_ngram_join": ngram_join.NGRAM_JOIN_SQL,
    }
