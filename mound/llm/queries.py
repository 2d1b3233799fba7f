"""The registered queries: every operator over its whole table, and the DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mound.llm import ann_tree, decontamination, divergence, exact_topk, mixing, passages, pii, sentencepiece_codec, sharding, simhash, toxicity, url_filter, whitening
from mound.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text by a model of the labels that may be learnt from."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing.rated(docs).select("doc_id", "size", "source_size", "target", taken)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    return exact_topk.top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found vectors of every hundredth vector."""
    return ann_tree.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    out = simhash.groups(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they agree with the library's and decode to the text."""
    out = sentencepiece_codec.encode(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_tokens", "ids", "parity", "round_trip")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that other documents have too."""
    return passages.repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    out = url_filter.judge(read(spark, sf_dir, "pages", "page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows, and the items that leaked."""
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.digest(read(spark, sf_dir, "documents", "doc_id", "text"), items)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components, whitened."""
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language diverge, and in which terms."""
    return divergence.audit(read(spark, sf_dir, "documents", "lang", "source", "text"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_exact_topk": op4_exact_topk,
    "op5_ann_tree": op5_ann_tree,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_passages": op9_passages,
    "op10_url_filter": op10_url_filter,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op4_exact_topk": exact_topk.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
