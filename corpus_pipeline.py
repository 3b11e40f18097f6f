"""The corpus pipeline: stages over the documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, decontam, jaccard, linededup, quality
from sheaf.llm.common import materialise, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), path="lang", result="__judged")
    return judged.where("__judged.keep").select(*docs.columns)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines. Exact copies, of which a later stage keeps one, count as one page."""
    return linededup.drop_boilerplate(docs, copies=False)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining documents."""
    return bpe.encode(docs, ids="ids", keep=["doc_id"]).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality_classifier", _quality), ("line_dedup", _line_dedup), ("ngram_jaccard", _near_duplicates), ("decontamination", _decontaminate), ("bpe", _encode)]

#: The stages hold trained models and tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
