"""Labels and approval lists meet by application number and by ingredient lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relops import contained

#: The least length of a number that may stand inside another.
PIECE = 3


def number_of(text: Column) -> Column:
    """The digits of an application number; null without any."""
    return F.nullif(F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", ""), F.lit(""))


def full_of(text: Column) -> Column:
    """The whole number in capitals without blanks; null for nothing."""
    return F.nullif(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s", ""), F.lit(""))


def by_number(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, Tier) of left (a) and right (b) application numbers: equal as they stand first; of the left ones that nothing equals, those with equal digits."""
    l, r = left.select("a", full_of(F.col("a")).alias("full"), number_of(F.col("a")).alias("digits")).distinct(), right.select("b", full_of(F.col("b")).alias("full"), number_of(F.col("b")).alias("digits")).distinct()
    one = l.join(r.select("b", "full"), "full").select("a", "b", F.lit("exact").alias("Tier"))
    rest = l.join(one.select("a").distinct(), "a", "left_anti")
    return one.union(rest.join(r.select("b", "digits"), "digits").select("a", "b", F.lit("digits").alias("Tier")))


def inside(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) where the digits of a (three at least) stand in those of b."""
    digits = lambda f, c: f.select(c, number_of(F.col(c)).alias("text")).filter("text is not null").distinct()
    return contained(digits(left, "a"), digits(right, "b"), PIECE)


def ingredients(text: Column) -> Column:
    """The names of an ingredient list, cut at semicolons, in capitals with single blanks, each once, in order of name."""
    parts = F.transform(F.split(F.upper(F.coalesce(text, F.lit(""))), ";"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def set_digest(names: Column) -> Column:
    """A set's digest, whatever the order and repetition of its names; null for the empty set."""
    return F.when(F.size(names) > 0, F.sha2(F.array_join(names, ";"), 256))


def same_ingredients(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, Names) of lists (a, list) and (b, list) that name the same ingredients: lists meet by their sets' digests, each set once."""
    sets = lambda f, c: f.select(c, ingredients(F.col("list")).alias("Names")).withColumn("set", set_digest(F.col("Names"))).filter("set is not null")
    return sets(left, "a").join(sets(right, "b").select("b", "set"), "set").select("a", "b", F.size("Names").alias("Names"))
