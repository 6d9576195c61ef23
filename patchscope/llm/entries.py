"""The thin queries over the given tables: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchscope.llm import bpe, chat, clusters, fingerprint, hosts, html, langid, merkle, ranked, seeds, simhash, toxicity, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality labels of the pages' own ids; quality 0 is a bad page."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = hosts.judge(table(spark, sf_dir, "pages"), outcomes)
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bound")})


def op10_polynomial_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.exact_groups(table(spark, sf_dir, "documents"))


def op11_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


def op12_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_likeness(table(spark, sf_dir, "documents"))


def op13_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_byte_bpe, op2_chat_perspectives, op3_spaced_seeds, op4_language_spans, op5_wavelet_shards, op6_template_removal, op7_simhash_bktree,
        op8_noisy_channel_toxicity, op9_host_reputation, op10_polynomial_fingerprints, op11_rotated_centroids, op12_merkle_fingerprints, op13_hybrid_search,
        pipeline)
}
ORACLES = {
    "op2_chat_perspectives": chat.SQL, "op3_spaced_seeds": seeds.SQL, "op9_host_reputation": hosts.SQL, "op10_polynomial_fingerprints": fingerprint.SQL,
    "op11_rotated_centroids": clusters.SQL, "op13_hybrid_search": ranked.SQL,
}
