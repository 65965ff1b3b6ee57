"""Printed tables to observations."""

import re

from pyspark.sql import functions as F

from tessera.functions import table_rows
from tessera.operators import grid, relops
from tessera.session import ship_package
from tessera.sources import text_blocks

CELLS = "TextTableID long, CellID long, RowSeq int, CellSeq int, RowGroupType string, CellType string, RowSpan int, ColSpan int, CellText string"


def table_of(spark, number, header, body):
    rows, i = [], 0
    for r, line in enumerate(header + body):
        for c, cell in enumerate(line):
            text, rs, cs = cell if isinstance(cell, tuple) else (cell, 1, 1)
            i += 1
            rows.append((number, i, r + 1, c, "Header" if r < len(header) else "Body", "th" if r < len(header) else "td", rs, cs, text))
    return spark.createDataFrame(rows, CELLS)


def test_adverse_event_table(spark):
    ship_package(spark)
    cells = table_of(
        spark, 1,
        [[("Adverse reaction", 2, 1), ("Drug A (N=200)", 1, 2), ("Placebo", 1, 1), ("p-value", 2, 1)], ["Any Grade n (%)", "Grade 3-4 %", "n (%)"]],
        [["N", "", "", "100", ""], [("Skin disorders", 1, 5)], ["Rash<sup>*</sup>", "20 (10%)", "2.5", "5 (5)", "0.03"], ["Nervous system disorders", "", "", "", ""], ["Headache", "—", "<1", "1/100", ""], ["Nausea", "30 (150)", "12", "", ""]],
    )
    tables = spark.createDataFrame([(1, "d1", "Table 2: reactions", "AdverseEvent", None)], "TextTableID long, DocumentGUID string, Caption string, TableCategory string, TitleDrug string")
    g = grid.reconstruct(cells)
    contexts = {r.Col: (r.Kind, r.Arm, r.HeaderN, r.Hint, r.Subtype) for r in table_rows.column_contexts(g).collect()}
    assert contexts == {0: ("label", None, None, None, None), 1: ("arm", "Drug A", 200, "n(%)", "Any Grade"), 2: ("arm", "Drug A", 200, "%", "Grade 3-4"), 3: ("arm", "Placebo", None, "n(%)", None), 4: ("pvalue", None, None, None, None)}
    out, compared, audit = table_rows.observations(g, tables)
    got = {(r.ParameterName, r.SourceCellSeq): r for r in out.collect()}
    assert set(got) == {("Rash", 1), ("Rash", 2), ("Rash", 3), ("Headache", 1), ("Headache", 2), ("Headache", 3), ("Nausea", 1), ("Nausea", 2)}
    rash = got["Rash", 1]
    assert (rash.TreatmentArm, rash.ArmN, rash.PrimaryValue, rash.PrimaryValueType, rash.SecondaryValue, rash.ParameterCategory, rash.PValue, rash.ParameterSubtype) == ("Drug A", 200, 10.0, "Percentage", 20.0, "Skin disorders", 0.03, "Any Grade")
    assert rash.ValidationFlags == "PCT_CHECK:PASS; AE_ARMN_FROM_HEADER_N"
    assert (got["Rash", 2].PrimaryValueType, got["Rash", 2].Unit) == ("Percentage", "%") and got["Rash", 3].ArmN == 100 and "AE_ARMN_FROM_METADATA_ROW" in got["Rash", 3].ValidationFlags
    dash, under, part = (got["Headache", c] for c in (1, 2, 3))
    assert dash.PrimaryValue == 0.5 and "PCT_DERIVED_FROM_DASH:ArmN=200" in dash.ValidationFlags and dash.ParameterCategory == "Nervous system disorders"
    assert under.PrimaryValue == 0.5 and "PCT_DERIVED_FROM_LT_ONE:ArmN=200" in under.ValidationFlags
    assert (part.PrimaryValue, part.PrimaryValueType, part.ArmN) == (1.0, "Count", 100)
    high = got["Nausea", 1]
    assert (high.PrimaryValue, high.SecondaryValue, high.PrimaryValueType, high.Unit) == (30.0, 150.0, "Numeric", None) and "PCT_GT100_REJECTED:150" in high.ValidationFlags
    assert compared.count() == 0
    assert {(r.Label, r.Reason) for r in audit.collect()} == {("N", "STRUCTURAL_DENOMINATOR"), ("Nervous system disorders", "STRUCTURAL_EMPTY")}


def test_efficacy_table_with_captions_and_comparisons(spark):
    ship_package(spark)
    cells = table_of(
        spark, 7, [["Outcome", "Drug B (n = 50)", "Control (N=60)", "Hazard ratio (90% CI)", "P value"]],
        [["Survival, months", "12 (3)", "9.5 (2.5)", "0.70 (0.50, 0.98)", "<0.05"], ["Survival, months", "12 (3)", "9.5 (2.5)", "0.70 (0.50, 0.98)", "<0.05"], ["", "responders", "8", "", ""], ["Dose", "5 mg", "10 mg daily", "", ""], ["Number of visits", "4", "5", "", ""]],
    )
    tables = spark.createDataFrame([(7, "d2", "Mean (SD) by group", "Efficacy", None)], "TextTableID long, DocumentGUID string, Caption string, TableCategory string, TitleDrug string")
    out, compared, audit = table_rows.observations(grid.reconstruct(cells), tables)
    got = {(r.SourceRowSeq, r.SourceCellSeq): r for r in out.collect()}
    first = min(k[0] for k in got)
    assert (got[first, 1].PrimaryValue, got[first, 1].PrimaryValueType, got[first, 1].SecondaryValue, got[first, 1].SecondaryValueType, got[first, 1].ParseRule) == (12.0, "Mean", 3.0, "SD", "caption_mean_sd")
    assert (got[first, 2].PrimaryValueType, got[first, 2].SecondaryValueType, got[first, 2].ArmN, got[first, 2].PValue) == ("Mean", "SD", 60, 0.05)
    recovered = [r for r in got.values() if r.ParameterName == "responders"]
    assert [(r.TreatmentArm, "LABEL_RECOVERED" in r.ValidationFlags) for r in recovered] == [("Control", True)]
    visits = sorted((r.TreatmentArm, r.PrimaryValueType, r.DoseRegimen) for r in got.values() if r.ParameterName == "Number of visits")
    assert visits == [("Control", "Count", "10 mg daily"), ("Drug B", "Count", "5 mg")]
    (c,) = compared.collect()  # the same comparison twice counts once
    assert (c.PrimaryValueType, c.PrimaryValue, c.LowerBound, c.UpperBound, c.BoundType, c.PValue) == ("HazardRatio", 0.7, 0.5, 0.98, "90CI", 0.05)
    assert {r.Reason for r in audit.collect()} == {"STRUCTURAL_DOSE"}


def test_arm_tests(spark):
    rows = spark.createDataFrame([(x,) for x in ("Drug A", "", None, "Table 3: reactions", "Cardiac disorders", "n (%)", "Grade 3-4", "Placebo")], "t string")
    assert [r[0] for r in rows.select(table_rows.invalid_arm(F.col("t"))).collect()] == [False, True, True, True, True, True, True, False]


def test_plain_cells_take_no_patterns(monkeypatch):
    from tessera.operators import grid

    monkeypatch.setattr(grid, "re", None)
    assert grid.clean(" 12\u00a0 \n(8%) ") == ("12 (8%)", []) and grid.clean(None) == ("", [])


def test_values_of_distinct_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("b", None)], "t string, n int")
    for max_sent in (0, 250_000):
        out = relops.by_distinct(rows, ["t", "n"], "v", F.uuid(), max_sent).collect()
        made = {(r.t, r.n): r.v for r in out}
        # Made once for each combination, nulls included, and the same for all of its rows.
        assert len(out) == 4 and set(made) == {("a", 1), (None, 1), ("b", None)} and len(set(made.values())) == 3 and all(r.v == made[r.t, r.n] for r in out)


def test_lines_meet_rows_without_being_sent_to_all_machines(spark, monkeypatch):
    from tessera.plans import registry

    read = []
    monkeypatch.setattr(text_blocks, "read", lambda files, f=text_blocks.read: read.append(1) or f(files))
    df = registry.QUERIES["table_grid"](spark, "/root/testdata/sf0.001")
    # The labels' XML is read once, for grids and captions, and behind it nothing is read that way.
    assert read == [1] and "MapInArrow [xml" not in df._jdf.queryExecution().toString()
    df.collect()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_audit_of_tables_that_are_not_known(spark):
    ship_package(spark)
    cells = table_of(spark, 3, [["Event", "Drug A (N=10)", "Placebo"]], [["N", "10", "12"], ["Rash", "1 (10%)", "2"]])
    tables = spark.createDataFrame([], "TextTableID long, DocumentGUID string, Caption string, TableCategory string, TitleDrug string")
    out, compared, audit = table_rows.observations(grid.reconstruct(cells), tables)
    assert out.count() == compared.count() == 0 and [(r.Label, r.Reason) for r in audit.collect()] == [("N", "STRUCTURAL_DENOMINATOR")]


def test_lines_come_as_one_list(spark):
    from tessera.plans import registry, table_queries  # noqa: F401

    keys = [r.k for r in table_queries.lines(spark, "/root/testdata/sf0.001").groupBy("k").count().filter("count >= 3").orderBy("k").limit(2).collect()]
    rows = spark.createDataFrame([(f"doc-{k}", s, c) for k in keys for s in (4, 5, 9) for c in (0, 1)], "Doc string, SourceRowSeq int, Col int")
    out = table_queries._with_lines(rows, spark, "/root/testdata/sf0.001")
    want = {f"doc-{r.k}": sorted(r.n)[-3:] for r in table_queries.lines(spark, "/root/testdata/sf0.001").groupBy("k").agg(F.collect_list("n").alias("n")).collect()}
    # The last rows are the last lines, and no shuffle asks for more than the document.
    got = {(r.Doc, r.SourceRowSeq, r.Col): r.n for r in out.collect()}
    assert len(got) == 12 and all(got[f"doc-{k}", s, c] == want[f"doc-{k}"][i] for k in keys for i, s in enumerate((4, 5, 9)) for c in (0, 1))
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("nth" in d for d in dealt)


def _adverse(spark):
    cells = table_of(spark, 3, [["Event", "Drug A (N=10)", "Placebo", "Hazard ratio (95% CI)"]], [["N", "10", "12", ""], ["Rash", "1 (10%)", "2", "0.70 (0.50, 0.98)"], ["Cardiac disorders", "", "", ""], ["Arrest", "2 (20%)", "1", ""]])
    tables = spark.createDataFrame([(3, "d", "Table 1: events", "AdverseEvent", None)], "TextTableID long, DocumentGUID string, Caption string, TableCategory string, TitleDrug string")
    return grid.reconstruct(cells), tables


def test_comparisons_ask_for_no_sizes_and_regimens(spark):
    ship_package(spark)
    rows = table_rows.placed_once(*_adverse(spark))
    plan = table_rows._valued(rows, "comparison").select("Text", "Label", "RowP", "ParameterCategory")._jdf.queryExecution().optimizedPlan().toString()
    # What only observations need, the sizes above a cell and the regimen of its column, isn't made.
    assert "RowN" not in plan and "DoseRegimen" not in plan
    (c,) = table_rows.comparisons(rows).collect()
    assert (c.ParameterName, c.PrimaryValue, c.LowerBound, c.ParameterCategory) == ("Rash", 0.7, 0.5, None)


def test_audit_asks_for_no_values(spark):
    ship_package(spark)
    rows = table_rows.placed_once(*_adverse(spark))
    audit = table_rows.suppressed(rows)
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert not any(c in plan for c in ("RowN", "DoseRegimen", "RowP", "ParameterCategory"))
    assert {(r.DocumentGUID, r.Label, r.Reason) for r in audit.collect()} == {("d", "N", "STRUCTURAL_DENOMINATOR"), ("d", "Cardiac disorders", "STRUCTURAL_EMPTY")}


def test_labelled_tables_take_no_windows(spark):
    ship_package(spark)
    one = table_of(spark, 1, [["Event", "Drug", "Drug"]], [["", "Any grade", "Severe"], ["Rash", "1", "2"]])
    two = table_of(spark, 2, [["Event", "Drug", "Drug"]], [["Rash", "1", "2"], ["", "Any", "Severe"]])
    whole = grid.reconstruct(one.unionByName(two))
    marked = whole.withColumn("Unlabelled", F.col("TextTableID") == 1)
    rows = lambda df: sorted(map(repr, df.select(whole.columns).collect()))
    assert rows(table_rows.promoted(marked)) == rows(table_rows.promoted(whole))
    assert {r.HeaderPath for r in table_rows.promoted(marked).filter("TextTableID = 1 and Col > 0").collect()} == {"Drug > Any grade", "Drug > Severe"}
    assert "Window" not in table_rows.promoted(marked)._jdf.queryExecution().optimizedPlan().toString()


def test_facts_of_keys_that_stand_elsewhere(spark):
    cells = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)], "i int, path string")
    few = cells.filter("i < 6").select("path").distinct()
    out = relops.by_distinct(few, ["path"], "v", F.uuid(), of=cells)
    # Facts are made of the cells' keys, and what asks for them is read once, behind them.
    assert {r.path for r in out.collect()} == {"p0", "p1", "p2"} and out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
