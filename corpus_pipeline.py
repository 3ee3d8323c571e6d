"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `docs`. `run` writes every stage's rows to the shared
folder and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontam, neardup, packing, quality, secrets, tokens
from tapeloom.llm.apart import set_apart
from tapeloom.llm.registry import table
from tapeloom.session import stage

#: Fitted cutoffs, token ids and decoded secrets are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a proven cutoff go."""
    given, restored = set_apart(docs)
    judged = quality.judge(given, table(spark, sf_dir, "labels"), *given.columns)
    return restored(judged.where("kept").select(given.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    given, restored = set_apart(docs)
    gone = neardup.near_duplicates(given).where("not kept").select("doc_id", "key")
    keyed = given.withColumn("_key", F.xxhash64("text"))
    same = (keyed["doc_id"] == gone["doc_id"]) & (keyed["_key"] == gone["key"])
    return restored(keyed.join(gone, same, "left_anti").select(given.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out; mostly contaminated documents go."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also encoded ones, are replaced by a mark; every document stays."""
    return secrets.mask(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return packing.pack(docs, tokens.find(tokens.WORD_BPE), 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_masks", secret_masks),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
