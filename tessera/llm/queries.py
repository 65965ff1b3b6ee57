"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, collocations, exact_dedup, langid, licenses, lm, mixing, near_dedup, oracles, packing, periodic, quality, sentencepiece_bpe, sharding
from tessera.llm.common import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), sharding.Topology.grid(2, 2, 2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm.score(docs, lm.train(docs))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_bpe.Model.load(sentencepiece_bpe.vocabulary_path())
    return sentencepiece_bpe.encode_decode(documents(spark, sf_dir), model)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect(documents(spark, sf_dir), twist=True)


_OPERATORS = (
    op1_sharding, op2_language_id, op3_mixing, op4_exact_dedup, op5_language_model, op6_quality, op7_licenses, op8_cross_polytope,
    op9_sentencepiece, op10_near_dedup, op11_packing, op12_collocations, op13_periodic_runs,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}

ORACLES: dict[str, str] = {
    "op1_sharding": oracles.SHARDING,
    "op3_mixing": oracles.MIXING,
    "op4_exact_dedup": oracles.EXACT_DEDUP,
}
