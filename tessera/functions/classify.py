"""Classification and scores of adverse-event signals, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags that are known, body systems that are serious, limits of the classes.
FLAGS = ("zerocellcorrected", "socremap", "wideci", "loweventcount")
SERIOUS = ("cardiac", "hepatobiliary", "renal", "respiratory", "nervous", "blood", "immune")
FRAGILE_EVENTS, TIGHT_EVENTS, WIDE_LOG10, NEAR_NN, SIMILAR_LOG10 = 10, 30, 0.5, 50, 0.15
SCORE_WEIGHTS = {"placebo": 0.25, "active": 0.05, "elevated": 0.25, "dose": 0.15, "soc": 0.20, "rows": 0.10}
ROW_TARGET = 40.0


def significance_of(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("protect"), "Protective").when(t.contains("elevat") | t.contains("increas"), "Elevated").otherwise("NotSignificant")


def flag_set(text: Column) -> Column:
    """Known flags of a list parted by ; or , without case, blanks, dashes and underlines."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda p: F.lower(F.regexp_replace(p, r"[_\-\s]", "")))
    return F.array_distinct(F.filter(parts, lambda p: p.isin(*FLAGS)))


def precision(flags: Column, events: Column, lower: Column, upper: Column) -> Column:
    """Fragile, Wide or Tight."""
    bad = F.arrays_overlap(flags, F.array(*[F.lit(f) for f in ("wideci", "loweventcount", "zerocellcorrected")]))
    width = F.log10(upper) - F.log10(lower)
    no_limits = lower.isNull() | upper.isNull() | (lower <= 0) | (upper <= 0)
    return F.when(F.coalesce(bad, F.lit(False)) | (F.coalesce(events, F.lit(0)) < FRAGILE_EVENTS) | no_limits, "Fragile").when((width >= WIDE_LOG10) | (events < TIGHT_EVENTS), "Wide").otherwise("Tight")


def is_serious(category: Column) -> Column:
    return F.coalesce(F.lower(category).rlike("|".join(SERIOUS)), F.lit(False))


def tier(prec: Column, sig: Column, nn: Column, category: Column) -> Column:
    """Counselling tier: Fragile, Reassure, Counsel or Watch."""
    return (
        F.when(prec == "Fragile", "Fragile")
        .when(sig != "Elevated", "Reassure")
        .when((prec == "Tight") & F.coalesce(nn <= NEAR_NN, F.lit(False)), "Counsel")
        .when(is_serious(category) | F.coalesce(nn > NEAR_NN, F.lit(False)), "Watch")
        .otherwise("Counsel")
    )


def verdict(prec: Column, sig: Column) -> Column:
    return F.when(prec == "Fragile", "LowConfidence").when(sig == "Elevated", "PlausiblyCausal").when(sig == "Protective", "Protective").otherwise("NotSignificantlyElevated")


def verdict_rank(v: Column) -> Column:
    return F.when(v == "PlausiblyCausal", 0).when(v == "Protective", 1).when(v == "NotSignificantlyElevated", 2).otherwise(4)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def quadrant(rr: Column, lower: Column, upper: Column, events: Column) -> dict[str, Column]:
    """x: certainty, y: effect, size: events."""
    width = F.when((lower > 0) & (upper > 0), F.log10(upper) - F.log10(lower)).otherwise(F.lit(3.0))
    return {"x": clamp(1 - width / 3), "y": clamp((F.log10(rr) + 1.5) / 3), "size": 8 + 1.6 * F.sqrt(events)}


def product_score(placebo: Column, active: Column, elevated: Column, rows: Column, doses: Column, socs: Column) -> Column:
    """0 to 100 from shares of placebo, active and elevated rows, dose and body-system spread, and the number of rows."""
    n = F.greatest(rows, F.lit(1)).cast("double")
    w = SCORE_WEIGHTS
    return F.round(100 * (w["placebo"] * clamp(placebo / n) + w["active"] * clamp(active / n) + w["elevated"] * clamp(elevated / n) + w["dose"] * clamp(doses / 3.0) + w["soc"] * clamp(socs / 10.0) + w["rows"] * clamp(rows / ROW_TARGET)), 0)


def comparison(sig_a: Column, rr_a: Column, sig_b: Column, rr_b: Column) -> Column:
    """OnlyA, OnlyB, Similar, AWorse or BWorse."""
    near = (F.abs(F.log10(rr_a) - F.log10(rr_b)) < SIMILAR_LOG10) | ((sig_a == "NotSignificant") & (sig_b == "NotSignificant"))
    return F.when(rr_b.isNull(), "OnlyA").when(rr_a.isNull(), "OnlyB").when(near, "Similar").when(rr_a > rr_b, "AWorse").otherwise("BWorse")


def class_type(name: Column) -> Column:
    """The type in brackets that ends a class name, upper case; Other without one."""
    got = F.upper(F.regexp_extract(name, r"\[([^\]]+)\]\s*$", 1))
    return F.when(got != "", got).otherwise("Other")
