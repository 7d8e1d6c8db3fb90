"""Corpus pipeline: quality rules, SimHash near-dedup, substring dedup, mixing
to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``; the last returns one row per packed piece,
with its token ids.

Defined cases are those of the operators; a document whose text is repeated
whole elsewhere stays as an empty document; a document taken in two epochs
would appear twice, so the pipeline's mix allows one epoch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import queries as q
from hourloom.llm.common import columns
from hourloom.llm.mixing import mix_sources
from hourloom.llm.packing import pack
from hourloom.llm.rules import judge_documents
from hourloom.llm.simhash import one_per_group
from hourloom.llm.substring import remove_repeats
from hourloom.session import ensure_checkpoint_dir

#: Part of all tokens that the pipeline's mix aims at.
MIX_SHARE = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge_documents(docs).where("kept").select(*columns(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs).select(*columns(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mix_sources(docs, q.MIX_WEIGHTS, MIX_SHARE, 1, domain=q.domain_of(F.col("source")))
    return out.select(*columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pack(docs.select("doc_id", "text"), q.TOKENIZER, q.WINDOW)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup), ("substring dedup", substring_dedup),
          ("mixing sources to target weights", mixing), ("packing", packing)]

#: Bit fingerprints, seeded hash orders and a public tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = q.documents(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hourloom/pipeline-{uuid.uuid4().hex[:12]}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
