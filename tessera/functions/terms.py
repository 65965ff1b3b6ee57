"""Names and categories of adverse events against dictionaries that are tables: layered lookups, the first layer that knows wins.

Names: rows to leave out, then a variant's canonical name, then the dictionary's spelling, then the cleaned text.  Systems by
name: the dictionary's, then a pattern's; by category: an official label, an alias, an alias that is explicitly none, a
pattern.  The name's system wins over the category's.  What no layer knows is kept and flagged, and unmapped() audits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

#: Rows of a dictionary that are broadcast at most; larger ones are joined by shuffle.
BOUND = 200_000


def key(text: Column) -> Column:
    """Letters and digits in capitals: how dictionaries are looked up."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def cleaned(text: Column) -> Column:
    """A name without footnote marks and doubled blanks, its first letter a capital and the rest small; null for nothing."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[*†‡§¶#]+\s*$", ""), r"\s+", " "))
    return F.nullif(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(t.substr(F.lit(2), F.length(t)))), F.lit(""))


def sized(table: DataFrame, bound: int = BOUND) -> DataFrame:
    """The table, to be broadcast where its rows are counted to be within the bound."""
    return F.broadcast(table) if table.limit(bound + 1).count() <= bound else table


def _one(table: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """A lookup of one row for each key; of several the least value, a null (explicitly none) before all."""
    value_of = F.min(F.struct(F.col(value).isNotNull().alias("known"), F.col(value).alias("v")))
    return table.select(key(F.col(name)).alias("_k"), value).filter("_k <> ''").groupBy("_k").agg(value_of.alias("_s")).select("_k", F.col("_s.v").alias(out), F.lit(True).alias(f"{out}_met"))


def _layer(rows: DataFrame, on: str, table: DataFrame, bound: int) -> DataFrame:
    return rows.join(sized(table, bound), rows[on] == table["_k"], "left").drop("_k")


def _pattern(text_key: Column, patterns: list[tuple[str, str]]) -> Column:
    """The system of the first pattern (a piece of a key, a system) that the key holds."""
    out = F.lit(None).cast("string")
    for piece, system in reversed(patterns):
        out = F.when(text_key.contains(piece), system).otherwise(out)
    return out


def standardise(
    rows: DataFrame, dictionary: DataFrame, variants: DataFrame, categories: DataFrame, excluded: DataFrame, patterns: list[tuple[str, str]], bound: int = BOUND,
) -> DataFrame:
    """rows (ParameterName, ParameterCategory, ...) with canonical names and systems, NameLayer, SystemLayer and StdFlags.

    dictionary: Name, System (official names and labels); variants: Variant, Name; categories: Alias, System (null: explicitly none);
    excluded: Name; patterns: in order.  Excluded and blank names leave; a null category is none.
    Layers are tried once for each distinct name and category, which cost much more than the join that brings them to their rows.
    """
    printed = rows.select("ParameterName", "ParameterCategory").distinct()
    facts = stored(_by_layers(printed, dictionary, variants, categories, excluded, patterns, bound))
    rest = [c for c in rows.columns if c not in ("ParameterName", "ParameterCategory")]
    same = rows["ParameterName"].eqNullSafe(facts["_of_name"]) & rows["ParameterCategory"].eqNullSafe(facts["_of_category"])
    return rows.join(sized(facts, bound), same).select(*[rows[c] for c in rest], *[facts[c] for c in facts.columns[2:]])


def _by_layers(rows: DataFrame, dictionary: DataFrame, variants: DataFrame, categories: DataFrame, excluded: DataFrame, patterns: list[tuple[str, str]], bound: int) -> DataFrame:
    """(_of_name, _of_category, ParameterName, ParameterCategory, NameLayer, SystemLayer, StdFlags) of printed names and categories."""
    official = dictionary.select("System").filter("System is not null").distinct()
    bad = excluded.select(key(F.col("Name")).alias("_k")).filter("_k <> ''").distinct()
    keyed = rows.withColumns({"_name": key(F.col("ParameterName")), "_cat": key(F.col("ParameterCategory"))}).filter("_name <> ''")
    keyed = keyed.join(sized(bad, bound), keyed["_name"] == bad["_k"], "left_anti")
    keyed = _layer(keyed, "_name", _one(variants, "Variant", "Name", "_variant"), bound)
    # A variant leads to its name's dictionary row, another name to its own.
    keyed = keyed.withColumn("_look", F.coalesce(key(F.col("_variant")).alias("x"), F.lit("")))
    keyed = keyed.withColumn("_look", F.when(F.col("_look") != "", F.col("_look")).otherwise(F.col("_name")))
    spelled = dictionary.select(key(F.col("Name")).alias("_k"), "Name", "System").filter("_k <> ''").groupBy("_k").agg(F.min(F.struct("Name", "System")).alias("_s")).select("_k", F.col("_s.Name").alias("_spelled"), F.col("_s.System").alias("_system"))
    keyed = _layer(keyed, "_look", spelled, bound)
    keyed = _layer(keyed, "_cat", _one(official.select(F.col("System").alias("Alias"), "System"), "Alias", "System", "_official"), bound)
    keyed = _layer(keyed, "_cat", _one(categories, "Alias", "System", "_alias"), bound)
    name = F.coalesce("_variant", "_spelled", cleaned(F.col("ParameterName")))
    name_layer = F.when(F.col("_variant").isNotNull(), "variant").when(F.col("_spelled").isNotNull(), "dictionary").otherwise("text")
    by_pattern, cat_pattern = _pattern(F.col("_look"), patterns), _pattern(F.col("_cat"), patterns)
    by_name = F.coalesce("_system", by_pattern)
    none = F.coalesce(F.col("_alias_met"), F.lit(False)) & F.col("_alias").isNull()
    by_category = F.coalesce("_official", F.when(none, None).otherwise(F.coalesce("_alias", cat_pattern)))
    layer = (
        F.when(F.col("_system").isNotNull(), "name").when(by_pattern.isNotNull(), "name-pattern").when(F.col("_official").isNotNull(), "category").when(none, "category-none")
        .when(F.col("_alias").isNotNull(), "category-alias").when(cat_pattern.isNotNull(), "category-pattern").otherwise("unmapped")
    )
    system = F.coalesce(by_name, by_category)
    changed = F.when(~name.eqNullSafe(F.col("ParameterName")), "AE_STD:NAME")
    moved = F.when(system.isNull(), "AE_STD:SOC_UNMAPPED").when(F.col("ParameterCategory").isNull(), "AE_STD:SOC_FILLED").when(~system.eqNullSafe(F.col("ParameterCategory")), F.when(by_name.isNotNull() & by_category.isNotNull() & (by_name != by_category), "AE_STD:SOC_ALIGNED").otherwise("AE_STD:SOC"))
    out = keyed.withColumns({"_n": name, "_l": name_layer, "_s2": system, "_sl": layer, "_f": F.nullif(F.concat_ws(";", changed, moved), F.lit(""))})
    return out.select(F.col("ParameterName").alias("_of_name"), F.col("ParameterCategory").alias("_of_category"), F.col("_n").alias("ParameterName"), F.col("_s2").alias("ParameterCategory"), F.col("_l").alias("NameLayer"), F.col("_sl").alias("SystemLayer"), F.col("_f").alias("StdFlags"))


def unmapped(standardised: DataFrame) -> DataFrame:
    """The audit: names without a system, how often they stand there and by which layer they were left."""
    return standardised.filter("ParameterCategory is null").groupBy("ParameterName", "SystemLayer").agg(F.count(F.lit(1)).alias("n"))
