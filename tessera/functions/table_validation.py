"""Checks of whole tables' observations, and a batch's figures, in one pass.

Observations are dealt by table once; every coarser grain (row and arm, arm, table) is grouped from the finer one, which that
dealing already serves.  The batch's figures are metrics observed while the checks run, so they cost no scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions import quality

#: Share by which a table's number of rows may differ from arms times parameters.
DEVIATION = 0.20
#: Least confidences of the bands of a batch's figures.
BANDS = (0.9, 0.7, 0.5)
COMPARISON = "Comparison"


def _blank(text: str) -> Column:
    return F.trim(F.coalesce(F.col(text), F.lit(""))) == ""


def issues(obs: DataFrame) -> DataFrame:
    """(TextTableID, Issue, Detail): one row for each finding.

    DUPLICATE_OBSERVATION: rows that agree in name, arm and source row; ARM_COVERAGE_GAP: arms with a size and no value;
    COUNT_DEVIATION: rows differ from arms times parameters by more than a fifth; TIME_EXTRACTION_INCONSISTENCY: some rows have a
    time and others don't, single doses left aside; and the issues of single rows, with their numbers.  Comparisons are no arm.
    """
    timed = F.lower(F.coalesce("Timepoint", F.lit(""))) != "single dose"
    own = quality.row_issues(_blank("DocumentGUID"), F.nullif(F.trim("ParameterName"), F.lit("")), F.col("PrimaryValueType"), F.col("ArmN"), F.col("TableCategory"), F.col("LowerBound"), F.col("UpperBound"), F.col("ParseConfidence"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    # Grain 1: a parameter and arm in a source row.
    one = obs.repartition("TextTableID").groupBy("TextTableID", "ParameterName", "TreatmentArm", "SourceRowSeq").agg(
        F.count(F.lit(1)).alias("n"), F.count("PrimaryValue").alias("values"), F.count("ArmN").alias("sizes"), count(timed).alias("timed"), count(timed & F.col("Time").isNotNull()).alias("times"),
        *[count(F.array_contains(own, i)).alias(i) for i in quality.PENALTIES],
    )
    compared = F.coalesce(F.col("TreatmentArm") == COMPARISON, F.lit(False))
    # Grain 2: an arm.
    total = lambda c: F.sum(c).alias(c)
    repeated = F.filter(F.collect_list(F.when(F.col("n") > 1, F.struct("ParameterName", "TreatmentArm", "SourceRowSeq", "n"))), lambda x: x.isNotNull())
    arms = one.groupBy("TextTableID", "TreatmentArm").agg(*[total(c) for c in ("n", "values", "sizes", "timed", "times", *quality.PENALTIES)], F.collect_set(F.when(~_blank("ParameterName") & ~compared, F.col("ParameterName"))).alias("names"), repeated.alias("repeated"))
    # Grain 3: the table.
    named = ~_blank("TreatmentArm") & ~compared
    tables = arms.groupBy("TextTableID").agg(
        *[total(c) for c in ("timed", "times", *quality.PENALTIES)], F.sum(F.when(~compared, F.col("n")).otherwise(0)).alias("rows"), count(named).alias("arms"), F.size(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
        F.flatten(F.collect_list("repeated")).alias("repeated"), F.filter(F.collect_list(F.when(named & (F.col("sizes") > 0) & (F.col("values") == 0), F.col("TreatmentArm"))), lambda x: x.isNotNull()).alias("gaps"),
    )
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    found = lambda kind, detail: F.struct(F.lit(kind).alias("Issue"), detail.alias("Detail"))
    expected = F.col("arms") * F.col("names")
    off = (expected > 0) & (F.abs(F.col("rows") - expected) > DEVIATION * expected)
    mixed = (F.col("times") > 0) & (F.col("times") < F.col("timed"))
    single = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.array().cast("array<struct<Issue:string,Detail:string>>"))
    all_ = F.concat(
        F.transform("repeated", lambda r: found("DUPLICATE_OBSERVATION", F.concat(F.lit("("), text(r["ParameterName"]), F.lit(", "), text(r["TreatmentArm"]), F.lit(", Row="), text(r["SourceRowSeq"]), F.lit(") x "), text(r["n"])))),
        F.transform("gaps", lambda a: found("ARM_COVERAGE_GAP", a)),
        single(off, found("COUNT_DEVIATION", F.concat(F.lit("expected "), text(expected), F.lit(" ("), text(F.col("arms")), F.lit(" arms, "), text(F.col("names")), F.lit(" parameters), got "), text(F.col("rows"))))),
        single(mixed, found("TIME_EXTRACTION_INCONSISTENCY", F.concat(text(F.col("timed") - F.col("times")), F.lit(" of "), text(F.col("timed")), F.lit(" without time")))),
        *[single(F.col(i) > 0, found(i, text(F.col(i)))) for i in quality.PENALTIES],
    )
    return tables.select("TextTableID", F.explode(all_).alias("i")).select("TextTableID", "i.*")


def observed(obs: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """obs with a batch's figures on the way: rows, values, flagged rows, rows by category and by band of confidence.

    The figures are there once an action has read the frame; no second scan is needed.
    """
    watch = Observation(name)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sure = F.col("ParseConfidence")
    bands = [sure >= BANDS[0], (sure < BANDS[0]) & (sure >= BANDS[1]), (sure < BANDS[1]) & (sure >= BANDS[2]), sure < BANDS[2]]
    figures = [F.count(F.lit(1)).alias("rows"), F.count("PrimaryValue").alias("values"), F.count("ValidationFlags").alias("flagged")]
    figures += [count(F.col("TableCategory") == c).alias(c) for c in quality.REQUIRED]
    figures += [count(b).alias(n) for b, n in zip(bands, ("sure", "likely", "doubtful", "unsure"), strict=True)]
    return obs.observe(watch, *figures), watch


def by_rule(obs: DataFrame) -> DataFrame:
    """Category and rule with their numbers of rows and the least confidence."""
    return obs.groupBy("TableCategory", "ParseRule").agg(F.count(F.lit(1)).alias("n"), F.min("ParseConfidence").alias("least"))


def skipped(tables: DataFrame) -> DataFrame:
    """Tables left out, by reason."""
    return tables.filter("Reason is not null").groupBy("Reason").agg(F.count(F.lit(1)).alias("n"))

