"""Populations of tables, and near names by shared pieces and edit distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import phrases

AGREE = 0.5


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer text; 1 for two empty ones, null for a null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.when(longest == 0, 1).otherwise(longest))


def near(names: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, similarity): pairs a < b of distinct names (column name) with a ratio of at least ``least``; complete for least > 0.5.

    An edit of a name changes two of its pairs of letters at most, so names that are near share most of them, and at
    least one of each other's 2 (1 - least) length + 1 rarest.  Names meet through those alone, so a common pair of
    letters gathers few of them, and are then compared by edit distance.  Empty names and nulls take no part.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be above 0.5 and at most 1")
    n = names.select("name").filter("name <> ''").distinct()
    # Pairs of letters with one sign before and after, told apart by how often they came before.
    wide = F.concat(F.lit("\u0002"), "name", F.lit("\u0003"))
    grams = n.select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("name") + 1), lambda k: F.substring(wide, k, F.lit(2)))).alias("at", "piece"))
    nth = F.row_number().over(Window.partitionBy("name", "piece").orderBy("at"))
    grams = grams.withColumn("gram", F.concat("piece", nth.cast("string"))).select("name", "gram")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = grams.join(often, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("often", "gram")))
    rare = ranked.filter(F.col("rank") <= F.floor(F.lit(2 * (1 - least) + 1e-9) * F.length("name")) + 1).select("name", "gram")
    a, b = rare.select(F.col("name").alias("a"), "gram"), rare.select(F.col("name").alias("b"), "gram")
    fits = (F.col("a") < F.col("b")) & (F.least(F.length("a"), F.length("b")) >= F.lit(least - 1e-9) * F.greatest(F.length("a"), F.length("b")))
    pairs = a.join(b, "gram").filter(fits).select("a", "b").distinct()
    return pairs.withColumn("similarity", ratio(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least - 1e-12)


def edits(length: int, least: float) -> int:
    """How many edits a name of that length may have."""
    return math.floor((1 - least) * length + 1e-9)


def table_population(tables: DataFrame, aliases: DataFrame) -> DataFrame:
    """tables (id, Caption, SectionTitle, ParentTitle) with Population and PopulationConfidence.

    The longest alias in the caption and in the section's title (else the parent's, if neither has one) give the names.  Two
    names that agree by half give the longer one, surer the nearer they are; others give the title's with 0.4; a title
    alone has 0.8, a caption alone 0.7, none 0.
    """

    def named(column: str) -> DataFrame:
        texts = tables.select(F.col("id"), F.col(column).alias("text"))
        return phrases.first_match(texts, aliases).select("id", F.col("Canonical").alias(f"_{column}"))

    rows = tables
    for column in ("Caption", "SectionTitle", "ParentTitle"):
        rows = rows.join(named(column), "id", "left")
    caption = F.col("_Caption")
    title = F.coalesce("_SectionTitle", F.when(caption.isNull(), F.col("_ParentTitle")))
    alike = ratio(F.lower(caption), F.lower(title))
    both = caption.isNotNull() & title.isNotNull()
    longer = F.when(F.length(caption) >= F.length(title), caption).otherwise(title)
    name = F.when(both & (alike >= AGREE), longer).otherwise(F.coalesce(title, caption))
    sure = F.when(both & (alike >= AGREE), F.least(F.lit(0.95), 0.7 + alike * 0.3)).when(both, 0.4).when(title.isNotNull(), 0.8).when(caption.isNotNull(), 0.7).otherwise(0.0)
    return rows.withColumns({"Population": name, "PopulationConfidence": sure}).select(*tables.columns, "Population", "PopulationConfidence")
