"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwise.llm.coders import default_path
from arcwise.llm.common import keep
from arcwise.llm.langid import fit_centroids, keep_known, labelled_rows
from arcwise.llm.line_dedup import dedup_lines
from arcwise.llm.mixing import mix_sources
from arcwise.llm.packing import pack_documents
from arcwise.llm.shingle_dedup import later_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the centroids recognise; texts that are null or without letters go."""
    return keep_known(docs, fit_centroids(labelled_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line resembles; all lines that have a word take part."""
    return dedup_lines(docs, least_words=1).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that resemble one with a smaller id: Jaccard 0.8 or more of five-word shingles.

    Texts whose SimHash fingerprints are linked, through the tiles of
    op9_simhash, are compared with the first of their group; links of two
    bits miss most copies that are not exact, so a join of the shingles finds
    the rest.
    Rows that share an id but are not alike all stay; of rows with the same
    id and text the first by the other columns stays. Rows without an id stay.
    """
    named = docs.where("doc_id is not null").withColumn("text_key", F.xxhash64("text")).join(later_copies(docs), ["doc_id", "text_key"], "left_anti")
    order = Window.partitionBy("doc_id", "text_key").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    named = named.withColumn("copy_no", F.row_number().over(order)).where("copy_no = 1").select(docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until the sources have their weights."""
    return mix_sources(docs).withColumn("_copy", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Centroids, fingerprints, Newton steps and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
