"""From observations to treatment-versus-comparator statistics: cohorts, comparators, risks, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats

#: Names of control arms.
PLACEBO = "placebo|sham|vehicle"
CONTROL = "control|comparator|standard of care|active control"
COHORT = ("ParameterName", "ParameterSubtype", "StudyContext", "Population", "Subpopulation")


def norm_key(col: Column) -> Column:
    """Null and blank are equal; outer blanks go, inner ones collapse, upper case."""
    return F.upper(F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), r"\s+", " "))


def is_placebo(arm: Column, dose: Column) -> Column:
    return F.coalesce(dose == 0, F.lit(False)) | F.coalesce(arm.rlike(f"(?i){PLACEBO}"), F.lit(False))


def event_count(value: Column, kind: Column, n: Column) -> tuple[Column, Column]:
    """(events, reason): a percentage counts N v / 100, a count itself; others can't be compared."""
    reason = (
        F.when(value.isNull(), "INVALID_EVENT_COUNT")
        .when((kind == "Percentage") & (value > 100), "PERCENT_OUT_OF_RANGE")
        .when((kind == "Percentage") & n.isNull(), "NO_ARMN")
        .when(~F.coalesce(kind.isin("Percentage", "Count"), F.lit(False)), "UNCOMPARABLE_VALUE_TYPE")
    )
    events = F.when(reason.isNull(), F.when(kind == "Percentage", n * value / 100.0).otherwise(value))
    return events, reason


def eligibility(arm: Column, guid: Column, name: Column, value: Column) -> Column:
    """Why a row takes no part, by the first rule that holds; null if it does."""
    return (
        F.when(guid.isNull(), "NO_DOCUMENT_GUID")
        .when(arm.isNull() | (F.trim(arm) == ""), "INVALID_TREATMENT_ARM")
        .when(name.isNull() | (F.trim(name) == ""), "STRUCTURAL_AE_ROW")
        .when(value.isNull(), "NO_PRIMARY_VALUE")
    )


def dose_normalised(rr: Column, lower: Column, upper: Column, dose: Column, unit: Column, ref_dose: Column, ref_unit: Column) -> dict[str, Column]:
    """Relative risk per e-fold of dose; doses are compared as decimals, so equal ones are exactly equal."""
    flag = (
        F.when(ref_dose.isNull() | dose.isNull() | (dose <= 0), "NO_DOSE_RANGE")
        .when(~unit.eqNullSafe(ref_unit), "DOSE_UNIT_MISMATCH")
        .when(dose == ref_dose, "IS_REFERENCE_DOSE")
    )
    span = F.when(flag.isNull(), F.log(dose.cast("double") / ref_dose.cast("double")))
    scaled = [F.exp(F.log(x) / span) for x in (rr, lower, upper)]
    both = scaled[1].isNotNull() & scaled[2].isNotNull()
    return {"dnrr": scaled[0], "dnrr_lower": F.when(both, F.least(scaled[1], scaled[2])), "dnrr_upper": F.when(both, F.greatest(scaled[1], scaled[2])), "dnrr_flag": flag}


def with_cohorts(obs: DataFrame) -> DataFrame:
    """Eligible rows with their cohort's key columns, a filled arm size, the comparator and the reference dose.

    Everything is a window over (document, table, cohort) or over an arm in it; one shuffle by the former serves them
    all.  Arms are counted by their first rows, sizes are compared by their least and greatest, so no window
    gathers sets.  Ties between candidates are broken by row, cell and id, nulls last.
    """
    keys = ["DocumentGUID", "TextTableID", *[f"k_{c}" for c in COHORT]]
    obs = obs.withColumns({f"k_{c}": norm_key(F.col(c)) for c in COHORT} | {"k_arm": norm_key(F.col("TreatmentArm"))})
    # An arm's window would ask for a shuffle of its own, which this one makes needless.
    obs = obs.repartition(*keys)
    cohort, arm = Window.partitionBy(*keys), Window.partitionBy(*keys, "k_arm")
    tie = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(2**62)) for c in ("SourceRowSeq", "SourceCellSeq", "id")])
    control = F.coalesce(F.col("TreatmentArm").rlike(f"(?i){CONTROL}"), F.lit(False))
    sized = F.when(F.col("ArmN") > 0, F.col("ArmN"))
    obs = obs.withColumns({"_low": F.min(sized).over(arm), "_high": F.max(sized).over(arm), "_control": F.max(control).over(arm), "_first": F.min(tie).over(arm) == tie})
    obs = obs.withColumns({"ArmN": F.when(F.coalesce(F.col("ArmN") > 0, F.lit(False)), F.col("ArmN")).when(F.col("_low") == F.col("_high"), F.col("_low")), "ArmNConflict": F.coalesce(F.col("_low") < F.col("_high"), F.lit(False))}).drop("_low", "_high")
    placebo, dosed = is_placebo(F.col("TreatmentArm"), F.col("Dose")), F.coalesce(F.col("Dose") > 0, F.lit(False))
    first = lambda cond, lead=None: F.min(F.when(cond, F.struct(*([lead.alias("lead")] if lead is not None else []), tie.alias("tie"), F.col("id").alias("id")))).over(cohort)["id"]
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(cohort)
    obs = obs.withColumns({
        "n_rows": F.count(F.lit(1)).over(cohort), "n_arms": count(F.col("_first")), "n_control": count(F.col("_first") & F.col("_control")),
        "c_placebo": first(placebo), "c_low": first(dosed, F.col("Dose")), "c_control": first(control), "c_first": first(F.lit(True)),
    }).drop("_first", "_control")
    flag = (
        F.when(F.col("n_rows") <= 1, "SINGLE_ARM")
        .when(F.col("c_placebo").isNotNull(), "PLACEBO_COMPARATOR")
        .when(F.col("c_low").isNotNull(), "LOW_DOSE_COMPARATOR")
        .when(F.col("n_control") == 1, "CONTROL_COMPARATOR")
        .when(F.col("n_control") > 1, "AMBIGUOUS_COMPARATOR")
        .when(F.col("n_arms") == 2, "ACTIVE_COMPARATOR")
        .when(F.col("n_arms") > 2, "AMBIGUOUS_COMPARATOR")
        .otherwise("NO_COMPARATOR")
    )
    chosen = F.when(flag == "PLACEBO_COMPARATOR", F.col("c_placebo")).when(flag == "LOW_DOSE_COMPARATOR", F.col("c_low")).when(flag == "CONTROL_COMPARATOR", F.col("c_control")).when(flag == "ACTIVE_COMPARATOR", F.col("c_first"))
    ref = F.min(F.when(dosed, F.struct(F.col("Dose").alias("d"), tie.alias("tie"), F.col("DoseUnit").alias("u")))).over(cohort)
    obs = obs.withColumns({"ComparatorFlag": flag, "ComparatorID": chosen, "RefDose": ref["d"], "RefUnit": ref["u"]})
    at = F.max(F.when(F.col("id") == F.col("ComparatorID"), F.struct("TreatmentArm", "ArmN", "PrimaryValue", "PrimaryValueType"))).over(cohort)
    return obs.withColumns({"CompArm": at["TreatmentArm"], "ComparatorN": at["ArmN"], "CompValue": at["PrimaryValue"], "CompType": at["PrimaryValueType"]}).drop("c_placebo", "c_low", "c_control", "c_first", "n_control")


def _with_risks(rows: DataFrame) -> DataFrame:
    """Cohort rows with events, Reason, risks and flags; they hold for rows that have a comparator other than themselves."""
    a, a_why = event_count(F.col("PrimaryValue"), F.col("PrimaryValueType"), F.col("ArmN"))
    c, c_why = event_count(F.col("CompValue"), F.col("CompType"), F.col("ComparatorN"))
    mixed = F.when(~F.col("PrimaryValueType").eqNullSafe(F.col("CompType")), "MIXED_VALUE_TYPES")
    rows = rows.withColumns({"EventsTreatment": a, "EventsComparator": c, "early": F.coalesce(mixed, a_why, c_why)})
    r = stats.relative_risk(F.col("EventsTreatment"), F.col("ArmN"), F.col("EventsComparator"), F.col("ComparatorN"))
    rows = rows.withColumns({"Reason": F.coalesce("early", r["reason"]), "RR": F.when(F.col("early").isNull(), r["rr"]), "RRLowerBound": F.when(F.col("early").isNull(), r["rr_lower"]), "RRUpperBound": F.when(F.col("early").isNull(), r["rr_upper"]), "ZeroFlag": F.when(F.col("early").isNull(), r["flags"])})
    d = dose_normalised(F.col("RR"), F.col("RRLowerBound"), F.col("RRUpperBound"), F.col("Dose"), F.col("DoseUnit"), F.col("RefDose"), F.col("RefUnit"))
    rows = rows.withColumns({"DNRR": d["dnrr"], "DNRRLowerBound": d["dnrr_lower"], "DNRRUpperBound": d["dnrr_upper"], "DoseFlag": F.when(F.col("RR").isNotNull(), d["dnrr_flag"])})
    return rows.withColumn("CalculationFlags", F.concat_ws(";", "ComparatorFlag", F.when(F.col("ArmNConflict"), F.lit("ARMN_CONFLICT")), "Reason", "ZeroFlag", "DoseFlag"))


def risk_rows(obs: DataFrame) -> DataFrame:
    """One statistics row per treatment row that has a comparator."""
    rows = with_cohorts(obs.filter(eligibility(F.col("TreatmentArm"), F.col("DocumentGUID"), F.col("ParameterName"), F.col("PrimaryValue")).isNull()))
    return _with_risks(rows.filter(F.col("ComparatorID").isNotNull() & (F.col("id") != F.col("ComparatorID"))))


def coverage(obs: DataFrame) -> DataFrame:
    """One row per source row: id, Status (RR_READY, COMPARATOR, or why there is no risk).  Cohorts are made once."""
    why = eligibility(F.col("TreatmentArm"), F.col("DocumentGUID"), F.col("ParameterName"), F.col("PrimaryValue"))
    left_out = obs.filter(why.isNotNull()).select("id", why.alias("Status"))
    rows = _with_risks(with_cohorts(obs.filter(why.isNull())))
    status = F.when(F.col("id") == F.col("ComparatorID"), "COMPARATOR").when(F.col("ComparatorID").isNull(), F.col("ComparatorFlag")).otherwise(F.coalesce("Reason", F.lit("RR_READY")))
    return left_out.unionByName(rows.select("id", status.alias("Status")))


def number_needed(events_t: Column, n_t: Column, events_c: Column, n_c: Column, lower: Column, upper: Column) -> dict[str, Column]:
    """Risks, kind (NNH, NNT, null where equal), number needed and its limits; both limits or none."""
    rt, rc = events_t / F.nullif(n_t.cast("double"), F.lit(0.0)), events_c / F.nullif(n_c.cast("double"), F.lit(0.0))
    nn = F.abs(1 / F.nullif(rt - rc, F.lit(0.0)))
    ends = [F.abs(1 / F.nullif(rc * (b - 1), F.lit(0.0))) for b in (lower, upper)]
    both = ends[0].isNotNull() & ends[1].isNotNull()
    return {"risk_t": rt, "risk_c": rc, "nn_type": F.when(rt > rc, "NNH").when(rt < rc, "NNT"), "nn": nn, "nn_lower": F.when(both, F.least(*ends)), "nn_upper": F.when(both, F.greatest(*ends))}
