"""A corpus pipeline of five operators: quality classifier, line dedup, near-duplicate removal, source mixing, best-fit packing.

For all stages: null texts count as empty and null ids as ids of their own, null sources as a source; repeated rows are documents of their own until
the third stage keeps one of each class; ties go to the smallest id, then to a hash of the row; further columns, whatever their names, go through
the first four stages unchanged; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.lineage import settled
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix_documents
from tessera.llm.near_dup import keep_one
from tessera.llm.packing import best_fit_pack
from tessera.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels that are not held out, does not reject; all, if there is no label to learn from."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line; none goes."""
    return dedup_lines(docs, short_repeats=True, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return best_fit_pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("source mixing", mix), ("best-fit packing", pack)]

ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole documents table, each result written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settled(docs, f"stage{i}")
    return docs
