"""Row validation, confidence, completeness, contracts and parse quality of observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column contracts by category.
REQUIRED = {
    "AdverseEvent": ("ParameterName", "TreatmentArm", "PrimaryValue", "PrimaryValueType"),
    "PK": ("ParameterName", "PrimaryValue", "PrimaryValueType", "Unit"),
    "DrugInteraction": ("ParameterName", "ParameterSubtype", "PrimaryValue", "PrimaryValueType", "LowerBound", "UpperBound", "BoundType"),
    "Efficacy": ("ParameterName", "TreatmentArm", "PrimaryValue", "PrimaryValueType"),
}
NULL_EXPECTED = {
    "AdverseEvent": ("Timepoint", "Time", "TimeUnit"),
    "PK": ("ParameterCategory", "PValue"),
    "DrugInteraction": ("ParameterCategory", "Timepoint", "Time", "TimeUnit", "SecondaryValue", "SecondaryValueType", "PValue"),
    "Efficacy": ("ParameterCategory", "SecondaryValue", "SecondaryValueType"),
}
DEFAULT_CI = {"AdverseEvent": "95CI", "Efficacy": "95CI", "PK": "90CI", "DrugInteraction": "90CI"}


def contract_nulled(name: str, category: Column) -> Column:
    """The column, null in categories whose contract expects none."""
    off = [c for c, names in NULL_EXPECTED.items() if name in names]
    return F.when(F.coalesce(category.isin(off), F.lit(False)), None).otherwise(F.col(name)) if off else F.col(name)


def missing_required(category: Column, columns: list[str]) -> Column:
    """MISSING_R_* flags joined by ;."""
    marks = [F.when((category == c) & F.col(n).isNull(), F.lit(f"MISSING_R_{n}")) for c, names in REQUIRED.items() for n in names if n in columns]
    return F.concat_ws(";", *marks)


def default_ci(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_CI.items() for x in kv]), category)


def row_issues(orphan: Column, name: Column, kind: Column, arm_n: Column, category: Column, lower: Column, upper: Column, confidence: Column) -> Column:
    """The issues of a row as an array, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(orphan, "ORPHAN_ROW"), F.when(name.isNull(), "MISSING_PARAMETER"), F.when(kind.isNull(), "MISSING_VALUE_TYPE"),
            F.when((category == "AdverseEvent") & arm_n.isNull(), "MISSING_ARM_N"), F.when(lower > upper, "BOUND_INVERSION"), F.when(confidence < 0.5, "LOW_CONFIDENCE"),
        )
    )


def status(issues: Column) -> Column:
    bad = F.array_contains(issues, "ORPHAN_ROW") | F.array_contains(issues, "BOUND_INVERSION")
    return F.when(bad, "Error").when(F.size(issues) > 0, "Warning").otherwise("Ok")


#: Factors by which an issue lowers the confidence.
PENALTIES = {"ORPHAN_ROW": 0.85, "MISSING_PARAMETER": 0.85, "MISSING_VALUE_TYPE": 0.90, "MISSING_ARM_N": 0.95, "BOUND_INVERSION": 0.85, "LOW_CONFIDENCE": 0.95}


def adjusted_confidence(confidence: Column, issues: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(issues, confidence, lambda a, i: a * F.element_at(table, i))))


def completeness(columns: list[Column]) -> Column:
    """Share of columns that aren't null."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("double") for c in columns]) / len(columns)


def parse_quality(value: Column, kind: Column, category: Column, name: Column, required_missing: Column, lower: Column, confidence: Column) -> Column:
    """A product of penalties, at most the confidence of the parse."""
    factors = [F.when(value.isNull(), 0.2), F.when(kind.isNull(), 0.2), F.when(kind == "Text", 0.3), F.when(category.isNull(), 0.4), F.when(name.isNull(), 0.3), F.when(required_missing, 0.6), F.when(lower < 0, 0.7)]
    return F.least(confidence, reduce(lambda a, b: a * b, [F.coalesce(f, F.lit(1.0)) for f in factors]))


def guardrail(before: dict[str, Column], after: dict[str, Column], body_systems: list[str]) -> Column:
    """The first reason to reject a correction of an observation, null if there is none."""
    from tessera.functions.stage5 import PLACEBO

    placebo = lambda c: F.coalesce(c.rlike(f"(?i){PLACEBO}"), F.lit(False))
    words = lambda c: F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"))
    wider = (F.size(F.array_except(words(before["name"]), words(after["name"]))) == 0) & (F.size(F.array_except(words(after["name"]), words(before["name"]))) > 0)
    return (
        F.when(placebo(before["arm"]) != placebo(after["arm"]), "PLACEBO_FLIP")
        .when(before["arm"].isNotNull() & after["arm"].isNull(), "ARM_NULLED")
        .when(F.lower(after["arm"]).isin(body_systems), "SOC_AS_ARM")
        .when(wider, "NAME_WIDENED")
        .when((before["unit"] == "%") & (after["type"] != "Percentage"), "PERCENT_DEMOTED")
        .when((after["type"] == "Text") & (after["unit"] == "%"), "TEXT_ROW_UNIT")
    )
