"""One query for each operator, at production parameters and over whole tables, with oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, chat, lattice, mixing, parsing, pii, quality, simhash, toxicity, urlfilter
from .common import table

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents"), carried=("doc_id",)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.allotment(table(spark, sf_dir, "documents")))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))


def op4_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compare_edited(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.tag(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(urlfilter.evaluate(urlfilter.with_times(table(spark, sf_dir, "pages")), urlfilter.query_entries(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_lattice": op3_lattice,
    "op4_parsing": op4_parsing,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_urlfilter": op10_urlfilter,
}
ORACLE_SQL: dict[str, str] = {
    "op8_chat": chat.ORACLE_SQL,
    "op10_urlfilter": urlfilter.ORACLE_SQL,
}
