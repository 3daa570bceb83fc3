"""The corpus pipeline: documents in, packed documents out. Each stage is written and read again by the next one.

In all stages a null text counts as empty and stays null, extra columns are carried along, a row without doc_id is never
taken for a copy, and rows that repeat a doc_id stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from streetgrove.llm import exact, minhash, packing, secrets, toxicity
from streetgrove.llm.common import table, without
from streetgrove.session import cut

VOCABULARY = "byte_bpe_50k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labels of rows that are not held out."""
    model = toxicity.fit(toxicity.learned_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the largest doc_id."""
    return without(docs, exact.exact_duplicates(docs).where("not kept"), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their five-word shingles the one with the smallest doc_id."""
    return without(docs, minhash.near_duplicates(docs, shingle=5, percent=80).where("not kept"), "near-copies")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and their n_chars counted again."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, part, length, bin_id, bin_size, bin_start, bin_used): where each piece of each document goes; lengths are tokens."""
    return packing.best_fit(docs, vocab_path=public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("secret scan", hide_secrets), ("packing", pack),
]

#: The scores of the first stage and the packing of the last are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
