"""Stages of the corpus pipeline over ``documents``.

Toxic documents go, then exact copies, then near copies (one document of each group stays); the rest is drawn by
rates that bring low quality down to its target weight, and encoded. All stages but the last return the columns of ``documents``. Each
stage's result is written to shared storage and read again by the next; what a stage has written besides is removed with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airsignal.llm import bpe, exact_dedup, mixing, simhash, toxicity
from airsignal.llm.common import crc_mod, saved, scratch, table
from airsignal.llm.queries import domains, vocabulary_path

#: Share of all tokens that the low-quality domain gets; the other domains keep their documents, and no document is drawn twice (copies have just been removed).
TARGETS, MOST = {"low": 0.05}, 1.0
#: Words of a shingle and differing bits of near copies, as in the operator's contract.
NEAR_SHINGLE, NEAR_BITS = 3, 3


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; learned as in the query, from the given documents that have labels."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, shingle=NEAR_SHINGLE, bits=NEAR_BITS)


def rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, domains(docs, table(spark, sf_dir, "labels")), TARGETS, hold_rest=True, most=MOST)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: once or not at all."""
    return mixing.draw(docs, saved(rates(spark, docs, sf_dir).select("doc_id", "rate"), "rates"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the text decoded from them."""
    return bpe.encode_digest(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; only their table is left of what the run has written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as written:
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            now = written.pop()  # the stage's result, the last table written
            if before is not None:
                written.append(before)
            before = now
    return docs
