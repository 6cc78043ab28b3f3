"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, mixing, pii, quality, simhash

#: Documents scored below it are rejected.
KEEP_FROM = 0.7
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with all their columns: those of ``KEEP_FROM`` or more. Null texts are scored as
    empty ones; null and repeated ids are rows like others; an empty table stays empty."""
    field = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.accepted(docs, field, KEEP_FROM)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id, with all its columns. Rows of a null id stay, and all rows
    of the id that stays; texts without words are one group; an empty table stays empty."""
    return simhash.first_of_group(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, in texts of any length; a null text becomes an empty one. All rows and columns
    stay, whatever their ids and names; an empty table stays empty."""
    return pii.masked(docs)


def in_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix of their sources; a null source is one of its own. Every row has its place, rows
    of null and of repeated ids and equal rows too; an empty table stays empty."""
    return mixing.in_mix_order(mixing.mixed(docs))


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mix_position) of the documents of files in the order of the mix: a document's place is the number of
    rows of the files before its own, by the number in their names, and of those before it in its file."""
    number = F.regexp_extract("_metadata.file_name", r"part-([0-9]+)", 1).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), number.alias("file"), F.col("_metadata.row_index").alias("row"))
    # One line for each file of the mixing stage.
    before = Window.orderBy("of_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy(F.col("file").alias("of_file")).count().select("of_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(files), F.col("file") == F.col("of_file")).select("doc_id", "text", (F.col("before") + F.col("row")).alias("mix_position"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding, and its place in the mix: one line a row, whatever its id. A null text
    has no ids; an empty table gives no line; further columns are not read."""
    docs = placed(docs)
    # Places are unique, ids need not be.
    digests = bpe.digests(docs.select(F.col("mix_position").alias("doc_id"), "text"), RANKS, public_tokenizers.PATTERN)
    ids = docs.select("doc_id", "mix_position")
    return digests.withColumnRenamed("doc_id", "mix_position").join(ids, "mix_position").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mix_position")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("PII", without_personal_data),
    ("mixing sources to target weights", in_mix),
    ("byte-level BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents, whose nulls, repeated ids, empty and long texts and further columns each stage
    treats as it says. What lies between them is written to the shared folder of checkpoints, and
    deleted as soon as the stage after it is written; the mix, from which the result is read, stays."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            common.removed(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, the classifier and the token ids have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None
