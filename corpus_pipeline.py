"""The corpus pipeline: raw documents to digests of token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of docs, whatever else those are.  An empty table gives an empty result in each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, langid, mixing, near_dedup, sentencepiece_bpe
from tessera.llm.common import prepare, remove, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go; lang becomes the predicted language.

    These are documents whose text is null or has no letter, and all documents where none has a lang to
    learn from.  Null ids are ids like any other; repeated rows have one fate.
    """
    prepare(spark)
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"))
    found = langid.identify(packed, langid.train(docs), carry=("row", "text")).filter(F.col("lang_pred") != "und")
    column = {"lang": F.col("lang_pred"), "text": F.col("text")}
    return found.select(*[column.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one document stays: the longest text, then the smallest id.

    A null text counts as empty; null ids come last; of rows that agree in id and length the least by its columns stays.
    """
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays (null ids last); documents without words stay."""
    prepare(spark)
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become the passes that the mix takes; documents without words go, as there is nothing to take.

    A null source is a source like any other, and repeated rows are documents of their own.
    """
    prepare(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document doc_id, the count of tokens and digests of ids and of the decoded text; a null text counts as empty."""
    prepare(spark)
    model = sentencepiece_bpe.Model.load(sentencepiece_bpe.vocabulary_path())
    return sentencepiece_bpe.encode_decode(docs, model)


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: The stages hold learned models and encodings that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents; a stage's table in the shared checkpoint folder goes when the next one has read it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read:
            remove(spark, f"{folder}/{read}")
        docs, read = spark.read.parquet(f"{folder}/{name}"), name
    return docs
