"""Relational building blocks that the label queries share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored


def top1_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; the order should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def topk_with_ties(df: DataFrame, order: Sequence[Column], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose rank is at most k; rows that tie with the k-th stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.rank().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def page(df: DataFrame, order: Sequence[Column], number: int | None = None, size: int | None = None) -> DataFrame:
    """Rows in order; with a number (from 1) and a size, that page."""
    df = df.orderBy(*order)
    return df if number is None or size is None else df.offset((number - 1) * size).limit(size)


def ordered_string_agg(df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], sep: str, alias: str) -> DataFrame:
    """Texts of a key joined in order; null texts are left out."""
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("t"))
    rows = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), item)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["t"]), sep).alias(alias))


def containment_join(left: DataFrame, right: DataFrame, list_col: str, key: str, sep: str = "+") -> DataFrame:
    """Left rows with the right rows whose key stands in the left's delimited list, each pair once.

    The list is exploded and joined by equality, which shuffles by key where a containment test would
    compare all rows with all rows.
    """
    parts = F.array_distinct(F.transform(F.split(F.col(list_col), F.lit("\\" + sep)), lambda x: F.trim(x)))
    exploded = left.withColumn("_part", F.explode(parts))
    return exploded.join(right, exploded["_part"] == right[key]).drop("_part")


def contained(left: DataFrame, right: DataFrame, piece: int = 3, salts: int = 8) -> DataFrame:
    """(a, b) of left (a, text) and right (b, text) rows where the left text, of ``piece`` characters at least, stands in the right one.

    Texts meet by the left one's rarest piece of that many characters, so a common beginning gathers few; a piece that many
    right texts hold is dealt over several tasks.
    """
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - (piece - 1)), lambda k: F.substring("text", k, F.lit(piece))))
    held = right.filter(F.length("text") >= piece).select("b", F.col("text").alias("whole"), F.explode(pieces).alias("piece")).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    often = held.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
    # A piece that nobody holds ends the search.
    mine = left.filter(F.length("text") >= piece).select("a", "text", F.explode(pieces).alias("piece")).join(often, "piece", "left")
    rare = mine.groupBy("a", "text").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece")).alias("p")).filter("p.often > 0")
    dealt = rare.select("a", "text", F.col("p.piece").alias("piece"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    return dealt.join(held, ["piece", "salt"]).filter(F.contains("whole", F.col("text"))).select("a", "b")


def rank_avg_ties(order: Column, keys: Sequence[str | Column]) -> Column:
    """Ranks from 1 within keys; rows that tie share the mean of their ranks."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, order)) - 1) / 2.0


def pair_counts(df: DataFrame, item: str, via: str) -> DataFrame:
    """(a, b, n): for a < b, how many values of ``via`` both items have; items and values are made distinct first."""
    d = df.select(item, via).dropna().distinct()
    a, b = d.select(F.col(item).alias("a"), via), d.select(F.col(item).alias("b"), via)
    return a.join(b, via).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, keys: Sequence[str], counts: dict[str, str]) -> DataFrame:
    """By keys the numbers of distinct ids in several columns (name: column of whole numbers); nulls don't count.

    Rows (keys, which column, id) are made distinct: a counted row carries one id, whatever the number of columns.
    """
    which = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("_which"), F.col(c).cast("bigint").alias("_id")) for i, c in enumerate(counts.values())])).alias("_x")
    ids = df.select(*keys, which).select(*keys, "_x.*").distinct()
    return ids.groupBy(*keys).agg(*[F.count_if((F.col("_which") == i) & F.col("_id").isNotNull()).alias(name) for i, name in enumerate(counts)])


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of both, by key the new one with the largest order value; old rows stay for other keys."""
    latest = top1_per_key(new, keys, [F.col(order).desc()]).drop(order)
    return old.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest, allowMissingColumns=True)


#: Rows of a table of distinct values that are sent to all machines; more are joined by a shuffle.
MAX_SENT = 250_000


def by_distinct(df: DataFrame, keys: Sequence[str], name: str, value: Column, max_sent: int = MAX_SENT, of: DataFrame | None = None) -> DataFrame:
    """df with a value that depends on ``keys`` alone, made once for each of their combinations.

    For values that cost much more than a join.  The keys are read from ``of``, which has all of df's, or from df itself: what leads
    to it should be stored then, as it is read twice.
    """
    facts = stored((df if of is None else of).select(*keys).distinct().withColumn(name, value)).select(*[F.col(k).alias(f"_of_{k}") for k in keys], name)
    small = facts.limit(max_sent + 1).count() <= max_sent
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(F.broadcast(facts) if small else facts.hint("merge"), reduce(and_, same)).drop(*[f"_of_{k}" for k in keys])


def nest(parent: DataFrame, child: DataFrame, key: str, order: Sequence[str], alias: str) -> DataFrame:
    """Parents with an array of their children's structs, in order; an empty array where there are none."""
    fields = [c for c in child.columns if c != key]
    item = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in fields if c not in order])
    grouped = child.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(alias))
    return parent.join(grouped, key, "left").withColumn(alias, F.coalesce(F.col(alias), F.array().cast(grouped.schema[alias].dataType)))


def positions(rows: DataFrame, leading: list[Column], order: list[Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 1 in an order, of each value of ``within`` on its own, without sorting them in one task.

    ``leading`` are values that rise with the order, are never null and of which there are few: rows are numbered
    among those that agree in them, and start behind the rows of smaller ones, whose counts are one small table.
    """
    keys = [f"_k{i}" for i in range(len(leading))]
    keyed = rows.select("*", *[c.alias(k) for c, k in zip(leading, keys, strict=True)])
    before = Window.partitionBy(*within).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("_n")).select(*within, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(*within, *keys).orderBy(*order)))
    return numbered.join(starts, [*within, *keys]).withColumn(name, (F.col("_start") + F.col("_nth")).cast("int")).drop(*keys, "_nth", "_start")
