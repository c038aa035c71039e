"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm.common import cut, table
from scriptoria.llm.decontaminate import drop_contaminated
from scriptoria.llm.mixing import mixed_documents
from scriptoria.llm.near_copies import keep_one
from scriptoria.llm.quality_knn import score_quality
from scriptoria.llm.queries import tokenizer_path
from scriptoria.llm.token_files import read_documents, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of texts linked at a five-word similarity of 0.8: SimHash groups, completed exactly."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents whole, as often as their source's share asks."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token-ID files; what they hold of each document."""
    return read_documents(write_tokens(docs, tokenizer_path()))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]

#: Learnt scores, XXH64 fingerprints and token ids are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
