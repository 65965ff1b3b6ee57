"""Which classes can be shown as correlation maps, and designs of trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stage5 import is_placebo
from tessera.operators.relops import contained


def map_picker(obs: DataFrame, group: str, via: str, item: str, floor: int = 3) -> DataFrame:
    """Per group: numbers of vias and items, pairs of items, pairs that share at least ``floor`` vias, the best pair, and whether a map can be drawn.

    obs has one row per observation; items of a group meet through the vias that both have.
    """
    d = obs.select(group, via, item).dropna().distinct()
    size = d.groupBy(group).agg(F.countDistinct(via).alias("vias"), F.countDistinct(item).alias("items"))
    a, b = d.select(group, via, F.col(item).alias("a")), d.select(group, via, F.col(item).alias("b"))
    pairs = a.join(b, [group, via]).filter("a < b").groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    usable = pairs.groupBy(group).agg(F.sum((F.col("n") >= floor).cast("long")).alias("usable"), F.max("n").alias("best"))
    out = size.join(usable, group, "left").fillna(0, ["usable", "best"])
    reason = F.when(F.col("items") < 2, "TOO_FEW_ITEMS").when(F.col("vias") < floor, "TOO_FEW_VIAS").when(F.col("usable") == 0, "NO_USABLE_PAIR")
    return out.withColumns({"pairs": (F.col("items") * (F.col("items") - 1) / 2).cast("long"), "reason": reason, "renderable": reason.isNull()})


def arm_root(arm: Column) -> Column:
    """An arm's name without doses and regimens."""
    t = F.regexp_replace(F.lower(arm), r"\d[\d,.]*\s*(?:mg|mcg|µg|g|ml|units?|iu)(?:/\w+)*", " ")
    t = F.regexp_replace(t, r"\b(?:once|twice|three times|daily|weekly|every|bid|tid|qd|per day|po|iv|sc|n\s*=\s*\d+)\b", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z+]+", " "))


def trial_design(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The design of each trial from its arms: (keys, arms, design)."""
    placebo = is_placebo(F.col("TreatmentArm"), F.col("Dose"))
    rows = obs.withColumns({"_p": placebo, "_arm": F.lower(F.trim("TreatmentArm")), "_root": F.when(~placebo, arm_root(F.col("TreatmentArm")))})
    g = rows.groupBy(*keys).agg(F.countDistinct("_arm").alias("arms"), F.max(F.col("_p").cast("int")).alias("has_placebo"), F.countDistinct(F.when(~F.col("_p"), F.col("_arm"))).alias("active"), F.countDistinct("_root").alias("roots"))
    p, active, roots = F.col("has_placebo") == 1, F.col("active"), F.col("roots")
    design = (
        F.when(F.col("arms") <= 1, F.when(p, "PLACEBO_ONLY").otherwise("SINGLE_ARM"))
        .when(p & (active == 0), "PLACEBO_ONLY")
        .when(p & (active > 1) & (roots == 1), "STEPPED_DOSE_PLUS_PLACEBO")
        .when(~p & (active > 1) & (roots == 1), "STEPPED_DOSE_MONOTHERAPY")
        .when(~p & (roots > 1), "ACTIVE_ONLY")
        .when(p & (active >= 1), "PLACEBO_PLUS_ACTIVE")
        .otherwise("AMBIGUOUS")
    )
    return g.select(*keys, "arms", design.alias("design"))


def substring_matches(names: DataFrame, substances: DataFrame, least: int = 3) -> DataFrame:
    """(name, substance): equal names; names of at least ``least`` characters without an equal one, contained in a substance.
    """
    n = names.select(F.upper(F.trim("name")).alias("name")).distinct()
    s = substances.select(F.upper(F.trim("substance")).alias("substance")).distinct()
    same = n.join(s, F.col("name") == F.col("substance")).select("name", "substance")
    rest = n.join(same.select("name"), "name", "left_anti")
    met = contained(rest.select(F.col("name").alias("a"), F.col("name").alias("text")), s.select(F.col("substance").alias("b"), F.col("substance").alias("text")), least)
    return same.unionByName(met.select(F.col("a").alias("name"), F.col("b").alias("substance")))
