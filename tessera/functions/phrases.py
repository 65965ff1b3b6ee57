"""Longest aliases at word starts: phrase matching of texts against an alias table that is data.

Two forms with equal results.  ``matches`` takes the automaton where the table's size, which is counted first, is within
its bound, and otherwise joins the texts' word runs with the aliases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import pk
from tessera.session import ship_package

#: Aliases that an automaton may hold in each worker; some 100 bytes each.
BOUND = 200_000
#: Signs besides blanks behind which a word starts.
STARTS = ",(/"


def prepared(text: Column) -> Column:
    """A folded text in small letters with single blanks; aliases and texts meet in this form."""
    return F.trim(F.regexp_replace(F.lower(pk.fold(text)), r"\s+", " "))


def _aliases(table: DataFrame) -> DataFrame:
    """One canonical name for each prepared alias: the least, so reruns agree."""
    return table.select(prepared(F.col("Alias")).alias("Alias"), "Canonical").filter("Alias <> ''").groupBy("Alias").agg(F.min("Canonical").alias("Canonical"))


def matches(texts: DataFrame, table: DataFrame, bound: int = BOUND) -> DataFrame:
    """(id, Start, Alias, Canonical): at each word start of a text (id, text) the longest alias that stands there and ends with a word.

    Start counts the prepared text's characters from 0.  A word starts at the text's start and behind a blank, comma, bracket or
    stroke, and ends before anything that is no letter, digit or underscore.  Null and blank texts have no match.
    """
    aliases = _aliases(table)
    if aliases.limit(bound + 1).count() <= bound:
        return by_automaton(texts, [tuple(r) for r in aliases.collect()])
    return by_join(texts, aliases)


def by_automaton(texts: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """One pass over each text, whatever the number of aliases."""
    ship_package(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for alias, name in aliases:
            automaton.add_word(alias, (alias, name))
        if aliases:
            automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best: dict[int, tuple[str, str]] = {}
                for end, (alias, name) in automaton.iter(text or "") if aliases else ():
                    start = end + 1 - len(alias)
                    starts = start == 0 or text[start - 1] in STARTS or text[start - 1].isspace()
                    ends = end + 1 == len(text) or not (text[end + 1].isalnum() or text[end + 1] == "_")
                    if starts and ends and len(alias) > len(best.get(start, ("",))[0]):
                        best[start] = (alias, name)
                found += [(k, *best[k]) for k in sorted(best)]
                ids += [i] * len(best)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["id", "Start", "Alias", "Canonical"])

    return texts.select("id", prepared(F.col("text")).alias("text")).mapInArrow(work, f"id {kind}, Start int, Alias string, Canonical string")


def by_join(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Word runs of the lengths that aliases have, joined by equality; for alias tables of any size.

    A run goes from a word start to a later word end; runs are as many as starts times the longest alias's words.
    """
    boundary = r"[^\p{L}\p{N}_]"
    sizes = aliases.select(F.length("Alias").alias("n")).distinct()
    longest = sizes.agg(F.max("n")).first()[0] or 0
    t = texts.select("id", prepared(F.col("text")).alias("text")).filter(F.length("text") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.length("text") - 1), lambda k: (k == 0) | F.substring("text", k, 1).rlike(r"[\s,(/]") & (k > 0))
    t = t.withColumn("Start", F.explode(starts))
    rest = F.substring("text", F.col("Start") + 1, F.lit(longest + 1))
    ends = F.filter(F.sequence(F.lit(1), F.least(F.length(rest), F.lit(longest))), lambda n: (F.length(rest) == n) & (F.length(rest) <= longest) | F.substring(rest, n + 1, F.lit(1)).rlike(boundary))
    runs = t.filter(F.length(rest) > 0).withColumn("n", F.explode(ends)).select("id", "Start", "n", F.substring(rest, F.lit(1), F.col("n")).alias("Alias"))
    met = runs.join(aliases, "Alias")
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("id", "Start").orderBy(F.col("n").desc(), "Canonical"))).filter("k = 1")
    return best.select("id", F.col("Start").cast("int").alias("Start"), "Alias", "Canonical")


def first_match(texts: DataFrame, table: DataFrame, bound: int = BOUND) -> DataFrame:
    """(id, Canonical, Alias): a text's longest match, the leftmost of equal ones."""
    best = F.max_by(F.struct("Canonical", "Alias"), F.struct(F.length("Alias"), -F.col("Start")))
    return matches(texts, table, bound).groupBy("id").agg(best.alias("m")).select("id", "m.*")
