"""A cleaning pipeline over `documents`: each stage reads what the one before has written.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bytebpe, mixing, pii, quality, simhash
from assayer.llm.common import cut, table, written
from assayer.llm.queries import BPE_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in a struct `others`, so that extra columns stay whatever their names."""
    return docs.select(*names, F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in names)).alias("others"))


def unpacked(docs: DataFrame, columns: list[str], *names: str) -> DataFrame:
    return docs.select(*(F.col(c) if c in names else F.col(f"others.c{i}").alias(c) for i, c in enumerate(columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go; each row by its own verdict, whatever its id.

    Null and empty texts have no word and go. Rows with a null id face the rules like any other, repeated rows go or stay together,
    and an empty table stays empty. All columns of `docs` stay.
    """
    judged = quality.judge(packed(docs, "doc_id", "text", "lang"), table(spark, sf_dir, "labels"), carried=("text", "lang", "others"))
    return unpacked(judged.where("kept"), docs.columns, "doc_id", "text", "lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows of each group that have an id one stays, the one with the smallest; of those without an id, one too.

    Rows are numbered once, so that each stays or goes by its own text; of equal ids in a group the one with the smallest fingerprint and
    then the smallest hash stays. Rows without a word are a group. An empty table stays empty, and all columns of `docs` stay.
    """
    numbered = packed(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = cut(simhash.fingerprints(numbered, carried=("text", "others", "row")))
    own, none = F.struct("doc_id", F.xxhash64("text", "others"), "row"), F.col("doc_id").isNull()
    firsts = [F.min(F.when(~none, own)).alias("known"), F.min(F.when(none, own)).alias("unknown")]
    distinct = rows.groupBy("fp").agg(*firsts)
    distinct = cut(distinct.select("fp", F.col("known.doc_id").alias("low"), F.col("known.row").alias("known"), "unknown"))
    member = cut(simhash.rooted(distinct))
    known = member.where("root.fp = fp and known is not null").select(F.col("known").alias("row"))
    unknown = member.where("unknown is not null").groupBy(F.col("root.fp").alias("fp")).agg(F.min("unknown").alias("first")).select(F.col("first.row").alias("row"))
    return unpacked(rows.join(known.union(unknown), "row", "left_semi"), docs.columns, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; other texts stay as they are, null ones too.

    Every row stays, repeated ones and those without an id too; n_chars is the new text's length. All columns of `docs` stay.
    """
    found = pii.detect(packed(docs, "doc_id", "text"))
    text = pii.redacted(F.col("text"), F.col("pii_spans"))
    out = unpacked(found.withColumn("text", text), docs.columns, "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in its shards' order: a row for each document, pass and shard with the text that the shard draws; what isn't drawn goes.

    Null and empty texts have no word to draw and go; a null source is one of its own. Repeated rows are drawn one by one. n_chars is the
    drawn text's length. An empty table stays empty, and all columns of `docs` stay.
    """
    mixed = mixing.mix(packed(docs, "doc_id", "text", "source"), by_block=False)
    out = unpacked(mixed, docs.columns, "doc_id", "text", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digests of the ids and of the bytes they decode to; null texts count as empty, and every row gets one."""
    return bytebpe.encode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", target_weights),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: Linking, certified cutoffs, trained weights and merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, with ids as text so that digests alone identify them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs.drop("ids")
