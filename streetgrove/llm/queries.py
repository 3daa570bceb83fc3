"""One registered query for each operator of this package, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetgrove.llm import bpe, chat, clusters, codes, exact, html_text, minhash, packing, secrets, shards, toxicity, winnow
from streetgrove.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.learned_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d"""


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    pieces = chat.format_trees(chat.linear(rows.unionByName(own)))
    return chat.read_back(pieces).withColumnRenamed("tree", "conv_id").drop("path")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), vocab_path=public_tokenizers.path(VOCABULARY))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_winnowing, op3_token_counts, op4_bpe_encode_decode, op5_exact_dedup, op6_reply_trees, op7_html_main_text,
        op8_best_fit_packing, op9_secret_scan, op10_minhash_dedup, op11_virtual_slots, op12_vector_codes, op13_centroid_clusters,
    )
}

#: Scores, fingerprints, tokens, page labels, the packing and the shards are beyond SQL; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL, "op6_reply_trees": chat.CHECKING_SQL, "op9_secret_scan": secrets.checking_sql(), "op10_minhash_dedup": minhash.CHECKING_SQL,
    "op12_vector_codes": codes.checking_sql(), "op13_centroid_clusters": clusters.checking_sql(),
}
