"""The registered queries of this subpackage: operators with production parameters on their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsignal.llm import bpe, exact_dedup, language, licenses, mixing, quality, search, secrets, simhash, toxicity, urls, whitening, winnow
from airsignal.llm.common import crc_mod, table
from airsignal.session import scratch_path

#: Targets of the mixing query: shares of all tokens per domain.
MIX_TARGETS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.1, "low": 0.05}

#: Rules of the url query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table for mixing: ``low`` for documents labelled as low quality, the language for the others."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).join(known, "doc_id")
            .select("doc_id", F.when(F.col("quality") == 0, F.lit("low")).otherwise(F.col("lang")).alias("domain")))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    return secrets.digests(found)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return _scored(toxicity.score(docs, model), 0.5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return _scored(quality.score(docs, model), 0.3)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return language.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domains(docs, table(spark, sf_dir, "labels")), MIX_TARGETS)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows, 4))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(urls.labelled_table(spark))
    return urls.judge(table(spark, sf_dir, "pages"), model, urls.parse_rules(URL_RULES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_bpe, op2_simhash, op3_winnowing, op4_secrets, op5_exact_dedup, op6_toxicity, op7_quality, op8_language, op9_mixing, op10_licenses, op11_whitening, op12_search, op13_urls]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op12_search": search.ORACLE}
