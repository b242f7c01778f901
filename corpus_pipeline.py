"""The training-data pipeline over ``documents``: quality rules, language identification, near-duplicates, benchmark decontamination, BPE.

Each stage takes all rows that the one before it kept, written as Parquet and read again. The first four return the
columns of ``documents``; the last returns each kept document's ids and digests. No stage is expressible in SQL as a
whole (rules and machines are learned from the rows), so ``ORACLE_SQL`` is None and the tests hold the stages against
brute-force versions.

Null, empty and blank texts fail the base rules of the first stage. Null ids and null languages teach nothing; rows with a null id are judged
by their text and are nobody's copy. Rows of one id stay or go together as near-duplicates and are judged by themselves elsewhere; repeated rows
stay repeated. Ties go to the smallest id. Very long texts are taken whole. Further columns pass through the first four stages, whatever their names. An
empty table, or a stage that keeps nothing, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe_codec, decontamination, language_id, near_dedup, quality_rules
from faultline.llm.common import Scratch, table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learned rules reject."""
    return quality_rules.keep(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language is not certain enough."""
    return language_id.certain(docs, language_id.train(docs, ~language_id.held_out("doc_id"), calibrated=True))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of texts that share 0.8 of their five-word shingles."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which a benchmark item occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of the ids and of the text they decode to."""
    import public_tokenizers

    coded = bpe_codec.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "ids", *bpe_codec.digests())


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every earlier stage is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
