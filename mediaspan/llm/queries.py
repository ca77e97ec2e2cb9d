"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaspan.llm import decontaminate, forest, licenses, lloyd, lm, minhash, mixing, pii, repeats, rtree, tokens, topk, toxicity
from mediaspan.llm.shared import scratch, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    tokens.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return tokens.read(spark, path)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.repeats(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.hard_negatives(rtree.relabelled(table(spark, sf_dir, "embeddings")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.encode(table(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"))


_ALL = (op1_mixing, op2_pii, op3_decontamination, op4_suffix_dedup, op5_toxicity, op6_licenses, op7_topk, op8_lm, op9_minhash, op10_token_ids, op11_hard_negatives, op12_vector_codes, op13_neighbours)
QUERIES: dict = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {"op3_decontamination": decontaminate.ORACLE, "op4_suffix_dedup": repeats.ORACLE, "op7_topk": topk.ORACLE, "op9_minhash": minhash.ORACLE, "op11_hard_negatives": rtree.ORACLE, "op12_vector_codes": lloyd.ORACLE}
