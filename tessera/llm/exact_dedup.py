"""Exact dedup by a 128-bit content hash, with the bytes compared inside groups.

Texts are equal when identical after deleting the white space of common.SPACES.  Rows meet by the MD5
of the normalised text; within a hash the normalised bytes themselves are the grouping key, so two
texts that share a hash are still told apart.  Equal texts are summed up before the shuffle: of a
group with a third of all rows, each task sends one row.  Each class is labelled by MD5 and SHA-256,
by which rows then find it without carrying their texts; should two classes agree in both, the query
fails instead of merging them.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, text_or_empty

#: For packing (length, smallest id) into one number that a hash aggregate can keep.
_ID_RANGE = Decimal(2 * 10**19)
_ID_TOP = 2**63 - 1


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _packed(length: Column, doc_id: Column) -> Column:
    """Larger for longer texts, then for smaller ids; a null id is the largest id."""
    rest = (F.lit(_ID_TOP) - F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(_ID_TOP).cast("decimal(20,0)"))).cast("decimal(38,0)")
    return (length.cast("decimal(10,0)") * F.lit(_ID_RANGE)).cast("decimal(38,0)") + rest


def groups(docs: DataFrame, hash128: Callable[[Column], Column] = F.md5) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows have doc_id, len, h, sha; classes have h, sha, group_size, keep_id, keep_len."""
    keyed = docs.select("doc_id", F.length(text_or_empty()).alias("len"), normalised(F.col("text")).alias("norm"))
    hashed = keyed.select("doc_id", "len", hash128(F.col("norm")).alias("h"), "norm")
    rows = hashed.select("doc_id", "len", "h", F.sha2("norm", 256).alias("sha"))
    classes = (
        hashed.groupBy("h", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_packed(F.col("len"), F.col("doc_id"))).alias("best"))
        .select(
            "h",
            F.sha2("norm", 256).alias("sha"),
            "group_size",
            (F.lit(_ID_TOP).cast("decimal(38,0)") - F.col("best") % F.lit(_ID_RANGE)).cast("long").alias("keep_id"),
            ((F.col("best") - F.col("best") % F.lit(_ID_RANGE)) / F.lit(_ID_RANGE)).cast("int").alias("keep_len"),
        )
    )
    labelled = (
        classes.groupBy("h", "sha")
        .agg(*(F.max(c).alias(c) for c in ("group_size", "keep_id", "keep_len")), F.count(F.lit(1)).alias("n"))
        .filter(F.assert_true(F.col("n") == 1, F.lit("two texts share MD5 and SHA-256")).isNull())
    )
    return rows, labelled.drop("n")


def _decided(docs: DataFrame, hash128: Callable[[Column], Column]) -> DataFrame:
    """The groups of equal rows (doc_id, len, sha, copies) with their class; stays: whether its first row is the one that stays."""
    rows, classes = groups(docs, hash128)
    once = rows.groupBy("h", "sha", "doc_id", "len").agg(F.count(F.lit(1)).alias("copies"))
    first = F.coalesce(F.col("doc_id"), F.lit(_ID_TOP)).eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))
    return once.join(classes, ["h", "sha"]).withColumn("stays", first)


def decide(docs: DataFrame, hash128: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty.  Of equal texts, the row with the most code points in its original
    text stays, then the smallest doc_id (null ids last, reported as null).  Of rows that are
    repeated with one id, one stays.  An empty table gives an empty result; other columns are ignored.
    """
    return (
        _decided(docs, hash128)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            F.when(F.col("keep_id") != _ID_TOP, F.col("keep_id")).alias("keep_id"),
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, hash128: Callable[[Column], Column] = F.md5) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows meet the decisions by one key of id, length and digest, so their texts are shuffled once.  Rows
    that agree in all three are repeated ones, of which the least by its columns stays.
    """
    key = lambda doc_id, size, sha: F.concat_ws("|", sha, size.cast("string"), doc_id.cast("string"))
    kept = _decided(docs, hash128).filter("stays").select(key(F.col("doc_id"), F.col("len"), F.col("sha")).alias("stay"), "copies")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        key(F.col("doc_id"), F.length(text_or_empty()), F.sha2(normalised(F.col("text")), 256)).alias("key"),
    )
    one = Window.partitionBy("key").orderBy(F.when(F.col("copies") > 1, F.to_json("row")))
    return rows.join(kept, rows["key"] == kept["stay"]).withColumn("nth", F.row_number().over(one)).filter("nth = 1").select("row.*")
