"""Documents to training sequences, in five stages.

Each stage gets the documents its predecessor kept, read back from Parquet.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm.jaccard_join import jaccard_classes
from nearpath.llm.language_id import identify_documents
from nearpath.llm.packing import pack_documents
from nearpath.llm.quality_rules import keep_good
from nearpath.llm.rows import unpack_rest, unused_name
from nearpath.llm.substring_dedup import repeated_passages
from nearpath.sources.workdir import discard, settle, settle_in

#: No stage can be written in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text is in none of the languages."""
    # the verdict depends on these columns only
    key = F.xxhash64("text", "lang", "source")
    row, gone_id, gone_row = (unused_name(docs, n) for n in ("row", "gone_id", "gone_row"))
    rejected = settle(
        identify_documents(docs.withColumn(row, key), "doc_id", row).where(~F.col("kept"))
        .select(F.col("doc_id").alias(gone_id), F.col(row).alias(gone_row)).distinct(),
        "rejected",
    )
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (key == F.col(gone_row))
    return docs.join(rejected, same, "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the quality rules."""
    return keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near copies."""
    own_id, own_key = unused_name(docs, "own_id"), unused_name(docs, "own_key")

    def keyed(rows: DataFrame, key: Column) -> DataFrame:
        row_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
        return rows.withColumn(own_id, row_id).withColumn(own_key, key)

    classes = jaccard_classes(docs)
    first = (
        classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("kept"))
    )
    first = keyed(first.select("kept.*"), F.col("text_key")).select(own_id, own_key)
    # one shuffle serves the join and the rows that repeat
    return (
        keyed(docs, F.xxhash64(F.coalesce("text", F.lit(""))))
        .join(first, [own_id, own_key], "left_semi").dropDuplicates([own_id, own_key])
        .select(*(f"`{name}`" for name in docs.columns))
    )


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of the texts."""
    kept = repeated_passages(docs).withColumnRenamed("kept_text", "text")
    out = unpack_rest(kept, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("jaccard_join", one_of_each),
    ("substring_dedup", without_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, folder = settle_in(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            discard(spark, before)  # nothing reads the stage before the last any more
        before = folder
    return docs
