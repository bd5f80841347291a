"""A corpus pipeline in five stages, each an operator of the training-data subpackage on all that the one before kept.

toxicity drops toxic documents; near_copies keeps one document of each group of near copies; pii replaces personal
data in texts; mixing makes the mix of sources, each document with the words that the mix takes of it; packing
returns the pieces of all documents with their places in sequences of 4096 tokens. All but the last return the
columns of ``documents``, other columns of any name included.

Edge cases: null, empty and blank texts are never toxic (unless labels say so of texts without hits), never copies of each other, and hold no
personal data; the mix takes no words of them, so they end there. Repeated rows are one document after near_copies. Rows without doc_id
stay, one for each text. Texts of any length are read whole. Ties: of equal texts the least doc_id stays. An empty table, or one without
labels, gives an empty result, or all that the other stages keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import common, mixing, packing, pii, simjoin, toxicity
from pixelloom.llm.queries import vocabulary


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simjoin.without_near_copies(docs)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", _toxicity), ("near_copies", _near_copies), ("pii", _pii), ("mixing", _mixing), ("packing", _packing)]

#: A learned model and a genetic algorithm are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again by the next one."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.step(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
