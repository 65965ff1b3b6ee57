"""Closed-form vectors of risk statistics, classes and correlations."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import classify, search, stage5, stats
from tessera.functions.correlation import incomplete_beta, pair_correlations, student_p
from tessera.plans.registry import QUERIES


@pytest.mark.parametrize(
    ("a", "n1", "c", "n2", "rr", "reason"),
    [(20, 100, 10, 100, 2.0, None), (0, 100, 5, 100, 0.5 / 5.5, None), (5, 0, 5, 100, None, "NO_ARMN"), (5, 100, 5, 0, None, "NO_COMPARATOR_N"), (-1, 100, 5, 100, None, "INVALID_EVENT_COUNT"), (101, 100, 5, 100, None, "EVENTS_EXCEED_ARMN")],
)
def test_relative_risk(spark, a, n1, c, n2, rr, reason):
    df = spark.createDataFrame([(a, n1, c, n2)], "a int, n1 int, c int, n2 int")
    r = df.select(*[v.alias(k) for k, v in stats.relative_risk(*(F.col(x) for x in ("a", "n1", "c", "n2"))).items()]).first()
    assert r.reason == reason and (r.rr is None if rr is None else abs(r.rr - rr) < 1e-9)
    if rr == 2.0:
        assert abs(r.rr_lower - 0.986559) < 1e-3 and abs(r.rr_upper - 4.054054) < 1e-2
    if a == 0:
        assert r.flags == "ZERO_CELL_CORRECTED" and r.rr_lower < r.rr < r.rr_upper


def test_dose_normalised_and_event_count(spark):
    df = spark.createDataFrame([(2.0, 1.0, 4.0, Decimal(100), "mg", Decimal(50), "mg"), (2.0, 1.0, 4.0, Decimal(50), "mg", Decimal(50), "mg"), (2.0, 1.0, 4.0, Decimal(50), "g", Decimal(25), "mg"), (2.0, 1.0, 4.0, Decimal(50), "mg", None, None)], "rr double, lo double, hi double, d decimal(18,6), u string, rd decimal(18,6), ru string")
    d = stage5.dose_normalised(*(F.col(c) for c in ("rr", "lo", "hi", "d", "u", "rd", "ru")))
    rows = df.select(*[v.alias(k) for k, v in d.items()]).collect()
    assert abs(rows[0].dnrr - math.e) < 1e-9 and abs(rows[0].dnrr_upper - math.e**2) < 1e-9
    assert [r.dnrr_flag for r in rows] == [None, "IS_REFERENCE_DOSE", "DOSE_UNIT_MISMATCH", "NO_DOSE_RANGE"]
    e = spark.createDataFrame([(101.0, "Percentage", 100), (5.0, "Numeric", 100), (None, "Count", 100), (20.0, "Percentage", 50)], "v double, k string, n int")
    events, reason = stage5.event_count(F.col("v"), F.col("k"), F.col("n"))
    assert [tuple(r) for r in e.select(events, reason).collect()] == [(None, "PERCENT_OUT_OF_RANGE"), (None, "UNCOMPARABLE_VALUE_TYPE"), (None, "INVALID_EVENT_COUNT"), (10.0, None)]


OBS = "id int, DocumentGUID string, TextTableID int, ParameterName string, ParameterSubtype string, ParameterCategory string, TreatmentArm string, ArmN int, Dose decimal(18,6), DoseUnit string, PrimaryValue double, PrimaryValueType string, StudyContext string, Population string, Subpopulation string, SourceRowSeq int, SourceCellSeq int"


def obs(i, arm, value, dose=None, n=100, name="Nausea", kind="Percentage", doc="d"):
    return (i, doc, 1, name, None, "Gastrointestinal disorders", arm, n, None if dose is None else Decimal(dose), "mg", value, kind, None, None, None, i, 1)


def test_cohort_scenarios(spark):
    one = spark.createDataFrame([obs(1, "Drug A", 20.0)], OBS)
    assert stage5.risk_rows(one).count() == 0 and stage5.coverage(one).first().Status == "SINGLE_ARM"
    two = spark.createDataFrame([obs(1, "Drug A 50mg", 20.0, 50), obs(2, "Placebo", 10.0, 0), obs(3, "", 1.0), obs(4, "X", None, doc=None)], OBS)
    r = stage5.risk_rows(two).collect()
    assert len(r) == 1 and r[0].id == 1 and abs(r[0].RR - 2) < 1e-9 and r[0].CalculationFlags == "PLACEBO_COMPARATOR;IS_REFERENCE_DOSE"
    assert {x.id: x.Status for x in stage5.coverage(two).collect()} == {1: "RR_READY", 2: "COMPARATOR", 3: "INVALID_TREATMENT_ARM", 4: "NO_DOCUMENT_GUID"}
    many = spark.createDataFrame([obs(i, a, 10.0) for i, a in enumerate(("A", "B", "C"), 1)], OBS)
    assert {x.Status for x in stage5.coverage(many).collect()} == {"AMBIGUOUS_COMPARATOR"}
    order = spark.createDataFrame([obs(2, "Placebo", 10.0, 0), obs(1, "Drug A 50mg", 20.0, 50)], OBS)
    assert stage5.risk_rows(order).first().RR == r[0].RR


def test_classes(spark):
    df = spark.createDataFrame([("LOW_EVENT_COUNT;other", 50.0, 1.5, 2.0), ("", 5.0, 1.5, 2.0), (None, 50.0, 1.5, 2.0), (None, 50.0, 1.0, 9.0), (None, 20.0, 1.5, 2.0), (None, 50.0, None, 2.0)], "f string, e double, lo double, hi double")
    got = [r[0] for r in df.select(classify.precision(classify.flag_set(F.col("f")), F.col("e"), F.col("lo"), F.col("hi"))).collect()]
    assert got == ["Fragile", "Fragile", "Tight", "Wide", "Wide", "Fragile"]
    c = spark.createDataFrame([("Statin [EPC]",), ("x [MoA] ",), ("plain",), (None,)], "n string").select(classify.class_type(F.col("n"))).collect()
    assert [r[0] for r in c] == ["EPC", "MOA", "Other", "Other"]


def test_search_predicates(spark):
    df = spark.createDataFrame([("Aspirin",), ("IBUPROFEN",), (None,)], "n string")
    hits = lambda c: [r[0] for r in df.filter(c).collect()]
    assert search.terms(" Asp, ibu;asp ") == ["asp", "ibu"]
    assert hits(search.term_filter([F.col("n")], "asp")) == ["Aspirin"]
    assert hits(search.term_filter([F.col("n")], None, ["asp"])) == ["IBUPROFEN", None]
    assert hits(search.term_filter([F.col("n")], "  ")) == ["Aspirin", "IBUPROFEN", None]
    assert df.select(search.difference(F.col("n"), F.lit("Asprin"))).first()[0] == 4


def test_p_values_and_correlation(spark):
    assert abs(incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-4 and incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)
    assert student_p(0.5, 12) == pytest.approx(0.0978, abs=1e-3) and student_p(1.0, 12) is None and student_p(0.4, 2) is None
    rows = [(i, k, float(v)) for i, vs in (("a", (1, 2, 3, 4)), ("b", (1, 4, 9, 16)), ("c", (5, 5, 5, 5))) for k, v in enumerate(vs)]
    got = {(r.a, r.b): r.r for r in pair_correlations(spark.createDataFrame(rows, "item string, via int, v double"), "item", "via", "v").collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "c")] is None and got[("a", "a")] == 1.0


def test_a_document_grows_with_the_lines(spark, tmp_path):
    """Orders 300 apart share a document, and its positions hold within their tier."""
    keys = [12 + 300 * i for i in range(14)]
    lines = [(k, n, 2 if n == 1 else 3, k, "A", "F", 40.0 if n > 1 else 12.0, None) for k in keys for n in range(1, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    signals = QUERIES["ae_signals"](spark, str(tmp_path)).count()
    triage = QUERIES["ae_triage"](spark, str(tmp_path)).collect()
    assert signals == len(triage) > 14
    for tier in {r.Tier for r in triage}:
        assert sorted(r.Position for r in triage if r.Tier == tier) == list(range(1, 1 + next(r.TierCount for r in triage if r.Tier == tier)))
