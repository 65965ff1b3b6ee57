"""Cell values by shape, header words, text blocks, and pharmacokinetic tables."""

from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import header_words, pk, table_rows, values
from tessera.operators import grid
from tessera.session import ship_package
from tessera.sources import spl, text_blocks
from tests.test_table_rows import table_of

SHAPES = [
    ("N = 5,310*", "n_equals", 5310.0, None, None), ("( n = 12 )", "n_equals", 12.0, None, None), ("1.2 mL/hr/kg", "value_trailing_unit", 1.2, None, "mL/h/kg"), ("9 mcg/mL/day", "value_trailing_unit", 9.0, None, "mcg/mL/d"),
    ("640 ng·hr/mL", "value_trailing_unit", 640.0, None, "ng·h/mL"), ("18.5 hours", "value_trailing_unit", 18.5, None, "h"), ("18.5 hello", "text_descriptive", None, None, None), ("5mg", "text_descriptive", None, None, None),
    ("0.9 (0.7 - 1.2)", "value_ci", 0.9, None, None), ("0.9 (1.2 - 0.7)", "text_descriptive", None, None, None), ("-1.5 (-3.0 - -0.5)", "value_ci", -1.5, None, None), ("-1.5 (-3.0, 0.5)", "diff_ci", -1.5, None, "pp"), ("12 (3, 40)", "rr_ci", 12.0, None, "%"),
    ("2.4 (0.6)†", "value_paren_dispersion", 2.4, 0.6, None), ("24 (6)†", "text_descriptive", None, None, None), ("24 (6)", "n_pct", 6.0, 24.0, "%"), ("1,024 (6)", "text_descriptive", None, None, None), ("2.4 (6%) low", "value_cv", 2.4, 6.0, None),
    ("3/40 (7.5%)", "frac_pct", 7.5, 3.0, "%"), ("3/1,400", "fraction_count", 3.0, 1400.0, None), ("3.5/40", "text_descriptive", None, None, None), ("−4 ± 1", "value_plusminus", -4.0, 1.0, None), ("4 (± 1) (N=9)", "value_plusminus_sample", 4.0, 1.0, None),
    ("2 to 8 weeks", "range_to", 5.0, None, None), ("<0.5 %", "inequality_percent", 0.5, None, "%"), ("-5%", "text_descriptive", None, None, None), ("P ≤ 0.01", "pvalue", 0.01, None, None), ("1.2.3", "text_descriptive", None, None, None), ("(12)", "text_descriptive", None, None, None),
    ("12,345.5", "plain_number", 12345.5, None, None), ("12.", "plain_number", 12.0, None, None), ("–", "dash_placeholder", None, None, None), ("Ж", "letter_code", None, None, None), ("n=0", "text_descriptive", None, None, None),
]


def test_shapes_of_cells(spark):
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SHAPES)], "i int, r string").select("i", values.parse_value(F.col("r")).alias("v")).collect()
    got = {SHAPES[r.i][0]: (r.v.rule, r.v.primary, r.v.secondary, r.v.unit) for r in rows}
    assert got == {s[0]: s[1:] for s in SHAPES}


def judged(spark, judge, texts):
    return [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(judge(F.col("t"))).collect()]


def test_header_words(spark):
    h = header_words
    assert judged(spark, h.is_axis, ["Adverse reactions", "n (%)", "Number (%) of patients with events", "Grade 3-4", "Drug A", "Body System / Term", None, "", "Percentage", "Incidence in trial 4", "Placebo"]) == [True, True, True, True, False, True, False, False, True, True, False]
    assert judged(spark, h.is_severity, ["≥ Grade 3", "Any grade n (%)", "All CTC grades", "Grades III/IV", "any", "all", "Grade of drug", "CTCAE Grade 1 or higher"]) == [True, True, True, True, True, False, False, True]
    assert judged(spark, h.is_statistic, ["Hazard Ratio (95% CI)", "p-value", "P", "OR (95% CI)", "Drug or placebo", "Risk Reduction", "Relative risk", "Risk group"]) == [True, True, True, True, False, True, True, False]
    assert judged(spark, h.comparison_type, ["HR", "Odds ratio", "Difference", "Relative Risk Reduction", "P value", "Ratio"]) == ["HazardRatio", "OddsRatio", "RiskDifference", "RelativeRiskReduction", "PValue", "RelativeRisk"]
    assert judged(spark, h.is_denominator_label, ["N", "Total N", "Number of patients (n)", "Subjects", "Number of visits", "Total"]) == [True, True, True, True, False, False]
    assert judged(spark, h.format_hint, ["Drug A n (%)", "Drug A (%)", "Drug %", "Drug A", "Auburn (%)"]) == ["n(%)", "(%)", "%", None, "(%)"]
    got = [tuple(r) for r in judged(spark, h.caption_hint, ["Mean (SD) values", "LS Mean (SE) change", "Least-squares means", "Geometric mean (CV%)", "Median (range)", "Median", "Mean (foo)", "Geometric mean ratio with 90% CI", "Counts", "Mean ± standard deviation", None, "Estimates (95 % CI)"])]
    assert got == [
        ("Mean", "SD", None, 1.0), ("LSMean", "SE", None, 1.0), ("LSMean", None, None, 0.85), ("GeometricMean", "CV_Percent", None, 1.0), ("Median", None, None, 1.0), ("Median", None, None, 0.85), (None, None, None, None), ("Ratio", None, "90CI", 1.0),
        (None, None, None, None), ("Mean", "SD", None, 1.0), (None, None, None, None), (None, None, "95CI", None),
    ]


def test_header_rows_in_the_body(spark):
    ship_package(spark)
    cells = table_of(spark, 3, [["Term", ("Treatment", 1, 2)]], [["", "Drug A (N=10)", "Placebo (N=12)"], ["", "Any grade", "Any grade"], ["Rash", "1", "2"], ["", "words", "more words"]])
    rows = table_rows.promoted(grid.reconstruct(cells)).orderBy("RowSeq", "Col").collect()
    assert [(r.HeaderPath, r.CellText) for r in rows] == [("Term", "Rash"), ("Treatment > Drug A (N=10) > Any grade", "1"), ("Treatment > Placebo (N=12) > Any grade", "2"), ("Term", ""), ("Treatment > Drug A (N=10) > Any grade", "words"), ("Treatment > Placebo (N=12) > Any grade", "more words")]


def test_text_blocks():
    xml = """<text xmlns="urn:hl7-org:v3">lead <paragraph>a<sup>1</sup><br/>b</paragraph><list listType="ordered"><caption>C</caption><item>x<list><item>in</item></list> y</item></list>
    <table ID="t1"><caption>T</caption><col/><thead><tr><th rowspan="2" colspan="z">H</th></tr></thead><tfoot><tr><td>foot</td></tr></tfoot><tr><td>1<table><tbody><tr><td>deep</td></tr></tbody></table></td><td/></tr></table></text>"""
    got = [(b["Kind"], b["Nth"], b["Parent"], b["Depth"], b["Seq"], b["Text"], b["RowGroup"], b["RowSpan"], b["TableNth"], b["RowSeq"]) for b in text_blocks.blocks(ElementTree.fromstring(xml), "s")]
    assert got == [
        ("Paragraph", 0, None, 0, 1, "lead", None, None, None, None), ("Paragraph", 1, None, 0, 2, "a<sup>1</sup><br/>b", None, None, None, None), ("List", 2, None, 0, 1, "C", None, None, None, None), ("ListItem", 3, 2, 1, 1, "x y", None, None, None, None),
        ("List", 4, 3, 2, 1, None, None, None, None, None), ("ListItem", 5, 4, 3, 1, "in", None, None, None, None), ("Table", 6, None, 0, 1, "T", None, None, None, None), ("TableColumn", 7, 6, 1, 1, None, None, None, 6, None), ("TableRow", 8, 6, 1, 1, None, "Header", None, 6, None),
        ("TableCell", 9, 8, 2, 1, "H", "Header", 2, 6, 1), ("TableRow", 10, 6, 1, 1, None, "Footer", None, 6, None), ("TableCell", 11, 10, 2, 1, "foot", "Footer", None, 6, 1), ("TableRow", 12, 6, 1, 1, None, "Body", None, 6, None), ("TableCell", 13, 12, 2, 1, "1", "Body", None, 6, 1),
        ("Table", 14, 13, 3, 1, None, None, None, 6, None), ("TableRow", 15, 14, 4, 1, None, "Body", None, 14, None), ("TableCell", 16, 15, 5, 1, "deep", "Body", None, 14, 1), ("TableCell", 17, 12, 2, 2, None, "Body", None, 6, 1),
    ]
    assert text_blocks.blocks(None, "s") == [] and text_blocks.blocks(ElementTree.fromstring('<text xmlns="urn:hl7-org:v3"/>'), "s") == []


def test_blocks_are_read_without_the_rest_of_a_label(spark):
    ship_package(spark)
    head = '<document xmlns="urn:hl7-org:v3"><id root="d"/><component><structuredBody><component><section><id root="s"/><text>'
    body = '<paragraph styleCode="b" ID="p">q <sup>1</sup></paragraph><table><caption>T</caption><tr><th rowspan="2">1<table><tr><td/></tr></table></th></tr></table>'
    tail = "</text></section></component></structuredBody></component></document>"
    files = spark.createDataFrame([(head + body + tail,), ("<broken",), (None,), (head.replace('<id root="d"/>', "") + "lone" + tail,)], "xml string")
    assert sorted(map(repr, text_blocks.read(files).collect())) == sorted(map(repr, text_blocks.of(spl.parsed(files)).collect()))
    # The walk alone makes the rows; the sections, products and elements of a label are not made.
    made = [b for batch in text_blocks._read(iter([pa.RecordBatch.from_pydict({"xml": [head + body + tail]})])) for b in batch.to_pylist()]
    assert [b["Kind"] for b in made] == ["Paragraph", "Table", "TableRow", "TableCell", "Table", "TableRow", "TableCell"] and {b["DocumentGUID"] for b in made} == {"d"}


def test_parameter_names(spark):
    texts = {"Cmax (ng/mL)": "Cmax", "Plasma Cmax*": "Cmax", "AUC0–∞ (ng·h/mL)": "AUC0-inf", "AUC(0 to inf)": "AUC0-inf", "Area under the curve (AUC0-24, mcg·h/mL)": "AUC0-24", "AUC₀₋₂₄": None, "AUCτ": "AUCtau", "AUC96h": "AUC", "t½ (h)": "t½", "Terminal half-life": "t½", "C24h": "Ctrough",
             "Maximum  Plasma Concentration, mg/L": "Cmax", "Serum": None, "Poor": None, None: None, "": None, "CL/F (L/h)": "CL/F", "Dose": None}
    got = judged(spark, pk.canonical, list(texts))
    assert {t: g for t, g in zip(texts, got, strict=True) if t != "AUC₀₋₂₄"} == {t: w for t, w in texts.items() if t != "AUC₀₋₂₄"}
    assert judged(spark, pk.header_unit, ["Cmax (ng/mL)", "AUC (0-inf, ng·hr/mL)", "Tmax, hr", "Cmax (day 1)", None]) == ["ng/mL", "ng·h/mL", "h", None, None]
    assert judged(spark, pk.qualifier, ["Steady-state Cmax", "Cmax,ss", "Single dose, fasted", "fed", "federal", None]) == ["steady_state", "steady_state", "single_dose", "fed", None, None]
    assert judged(spark, pk.label_class, ["50 mg twice daily", "Cmax", "Day 14", "Elderly subjects", "Something", None]) == ["dose", "parameter", "timepoint", "population", "other", "other"]
    d = pk.duration(F.col("t"))
    rows = spark.createDataFrame([("10 mg x 7 days",), ("for 2 Weeks",), ("5 mg single dose",), ("5 mg",), (None,)], "t string").select(d["time"], d["unit"], d["timepoint"]).collect()
    assert [tuple(r) for r in rows] == [(7.0, "days", "7 days"), (2.0, "weeks", "2 weeks"), (None, None, "single dose"), (None, None, None), (None, None, None)]


def observed(spark, cells, caption):
    ship_package(spark)
    tables = spark.createDataFrame([(1, "d", caption)], "TextTableID long, DocumentGUID string, Caption string")
    return pk.vote_units(pk.observations(grid.reconstruct(cells), tables))


def test_layouts_agree(spark):
    plain = table_of(spark, 1, [["Regimen", "Cmax (ng/mL)", "Tmax (h)"]], [["10 mg", "5.5 ± 1", "2"], ["20 mg", "9.5 ± 2", "3"]])
    turned = table_of(spark, 1, [["", "10 mg", "20 mg"]], [["Cmax (ng/mL)", "5.5 ± 1", "9.5 ± 2"], ["Tmax (h)", "2", "3"]])
    names = ("ParameterName", "DoseRegimen", "PrimaryValue", "PrimaryValueType", "SecondaryValue", "SecondaryValueType", "Unit", "ArmN")
    got = [sorted(tuple(r) for r in observed(spark, c, "Fasted (N=30)").select(*names).collect()) for c in (plain, turned)]
    assert got[0] == got[1] == [("Cmax", "10 mg", 5.5, "Mean", 1.0, "SD", "ng/mL", 30), ("Cmax", "20 mg", 9.5, "Mean", 2.0, "SD", "ng/mL", 30), ("Tmax", "10 mg", 2.0, "Mean", None, None, "h", 30), ("Tmax", "20 mg", 3.0, "Mean", None, None, "h", 30)]


def test_tables_are_rebuilt_once_and_texts_read_once(spark):
    cells = table_of(spark, 1, [["Regimen", "Cmax (ng/mL)"]], [["10 mg", "5.5 ± 1"], ["20 mg", "5.5 ± 1"]])
    out = observed(spark, cells, "Fasted (N=30)")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Neither the grid nor the grammar of values is part of the plan that gives the rows.
    assert "MapInArrow" not in plan and "value_plusminus_sample, Numeric" not in plan and len(plan) < 100_000
    assert out.count() == 2


ODD_TABLES = """<text xmlns="urn:hl7-org:v3">lone <table><caption>Cap <sup>1</sup></caption><thead><tr><th rowspan="2">A</th><th colspan="2"> B  b<sup>a</sup></th></tr><tr><th>C</th><th/></tr></thead>
<tbody><tr><td>x</td><caption>no</caption><td><paragraph>in</paragraph><table><tr><td>deep</td><td colspan="x">er</td></tr></table></td><td>after</td></tr><td>loose</td><tr><td>y</td><td>1<br/>2</td><td>z</td></tr></tbody><tfoot><tr><td colspan="3">a note</td></tr></tfoot></table>
<list><item>one<table><tr><td>t</td><td>u</td></tr><tr><td>v</td></tr></table></item></list><td>nowhere</td></text>"""


def test_tables_are_read_without_other_blocks():
    text = ElementTree.fromstring(ODD_TABLES)
    cells, tables = [], {}
    text_blocks.table_cells(text, cells.append, lambda nth, node: tables.update({nth: node}))
    names = ("TableNth", "Nth", "RowSeq", "Seq", "RowGroup", "CellType", "RowSpan", "ColSpan", "Text")
    made = text_blocks.blocks(text, "s")
    assert cells == [tuple(b[n] for n in names) for b in made if b["Kind"] == "TableCell"] and len(cells) == 18
    assert list(tables) == [b["Nth"] for b in made if b["Kind"] == "Table"]


def test_grids_are_rebuilt_where_labels_are_read(spark):
    ship_package(spark)
    label = '<document xmlns="urn:hl7-org:v3"><id root="{}"/><section><id root="s"/>{}</section></document>'
    files = spark.createDataFrame([(label.format("d1", ODD_TABLES),), ("<broken",), (None,), (label.format("d2", ODD_TABLES.replace("deep", "other")),)], "xml string")
    blocks = text_blocks.read(files).filter("Kind = 'TableCell'")
    cells = blocks.select(text_blocks.table_id(F.col("TableNth")), F.col("Nth").cast("long").alias("CellID"), "RowSeq", F.col("Seq").alias("CellSeq"), F.col("RowGroup").alias("RowGroupType"), "CellType", "RowSpan", "ColSpan", F.col("Text").alias("CellText"))
    want = grid.reconstruct(cells.filter("CellText is null or CellText <> 'loose'"))
    found = text_blocks.read(text_blocks.Tables(files.select(F.replace("xml", F.lit("<td>loose</td>"), F.lit("")).alias("xml"))))
    names = want.columns[1:]
    assert sorted(map(repr, found.select(names).collect())) == sorted(map(repr, want.select(names).collect()))
    facts = {(r.DocumentGUID, r.Caption, r.Known, r.Unlabelled) for r in found.filter("Leads").collect()}
    assert ("d1", "Cap <sup>1</sup>", True, False) in facts and found.filter("Leads").count() == found.select("TextTableID").distinct().count()
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString() and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_become_columns_without_dicts(monkeypatch):
    label = '<document xmlns="urn:hl7-org:v3"><id root="d"/><versionNumber value="2"/><component><structuredBody><component><section><id root="s"/><title>T</title>' + ODD_TABLES + "</section></component></structuredBody></component></document>"
    monkeypatch.setattr(text_blocks, "blocks", None)
    out = spl._parse([label, None, "<broken"])
    want = list(text_blocks.of_document(ElementTree.fromstring(label)))
    assert isinstance(out["blocks"], pa.ListArray) and [tuple(b.values()) for b in out["blocks"][0].as_py()] == want and [len(b) for b in out["blocks"].to_pylist()[1:]] == [0, 0]
    assert out["VersionNumber"].to_pylist() == [2, None, None] and out["DocumentGUID"].to_pylist() == ["d", None, None] and [e is None for e in out["error"].to_pylist()] == [True, False, False]


def test_orientation_reads_its_grid_once(spark):
    ship_package(spark)
    cells = table_of(spark, 1, [["Regimen", "Cmax (ng/mL)", "Tmax (h)"]], [["10 mg", "5.5", "1"], ["20 mg", "5.5", "1"], ["Dose", "AUC (ng·h/mL)", "n"], ["30 mg", "7", "12"]])
    votes = pk.orientation(grid.reconstruct(cells))
    plan = votes._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Join Inner" not in plan
    assert sorted(tuple(r) for r in votes.collect()) == [(1, 0, 2, 0, 0, 2, False), (1, 3, 1, 0, 0, 1, False)]


def test_many_tables_at_once_are_as_each_alone(spark):
    ship_package(spark)
    spans = [[("Term", 2, 1), ("Drug", 1, 2)], ["N", ("%", 3, 1)], [("", 1, 3)], ["a", "b"], [("x", 1, 3)], [("wide", 2, 2), "c<sup>*</sup>"], ["under"]]
    one = table_of(spark, 1, spans[:2], spans[2:])
    many = reduce(lambda a, b: a.unionByName(b), [one.withColumn("TextTableID", F.lit(k).cast("long")) for k in (1, 2)] + [table_of(spark, 3, [["h"]], [["v"]])])
    rows = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    alone = rows(grid.reconstruct(one))
    got = grid.reconstruct(many)
    assert rows(got.filter("TextTableID = 1")) == rows(got.filter("TextTableID = 2")) == alone and rows(got.filter("TextTableID = 3")) == [(1, "DataBody", 0, "h", "v", None, None)]
    paths = ("Term", "Drug > N", "Drug > %")
    assert [(r[0], *r[2:6]) for r in alone if r[0] >= 5] == [(r, c, paths[c], t, "x") for r, texts in ((5, ("wide", "wide", "c")), (6, ("wide", "wide", "under"))) for c, t in enumerate(texts)]


def test_blocks_units_and_statistics(spark):
    cells = table_of(
        spark, 1, [["", "", "", ""]],
        [[("Study 1 (fed)", 1, 4)], ["Group", "Dose", "n", "Cmax"], ["Units", "", "", "(ng/mL)"], ["Adults", "5 mg", "14", "120 (150)"], ["Elderly", "5 mg", "9", "118 (33)"], [("Study 2", 1, 4)], ["Group", "Dose", "n", "AUC0-24 (SE)"], ["Adults", "10 mg for 3 days", "7", "4.5 (0.5)"]],
    )
    rows = {(r.ParameterName, r.Population): r for r in observed(spark, cells, "Table 1").collect()}
    a, b, c = rows["Cmax", "Adults"], rows["Cmax", "Elderly"], rows["AUC0-24", "Adults"]
    assert (a.PrimaryValue, a.SecondaryValue, a.SecondaryValueType, a.Unit, a.ArmN, a.Dose, a.ParameterSubtype) == (120.0, 150.0, None, "ng/mL", 14, 5.0, "fed") and "PCT_GT100_REJECTED:150; PK_PCT_GT100_DEMOTED" in a.ValidationFlags
    assert (b.PrimaryValue, b.SecondaryValue, b.SecondaryValueType, b.PrimaryValueType) == (118.0, 33.0, "SD", "Mean") and "PLUSMINUS_TYPE_INFERRED:SD" in b.ValidationFlags and "PK_COMPLETE_SPINE" not in b.ValidationFlags
    assert (c.SecondaryValueType, c.StudyContext, c.DoseRegimen, c.Time, c.TimeUnit, c.Timepoint, c.ArmN, c.Unit) == ("SE", "Study 2", "10 mg for 3 days", 3.0, "days", "3 days", 7, None)


def test_unit_votes(spark):
    schema = "TextTableID int, ParameterName string, Unit string, ParseRule string, ValidationFlags string"
    paren = "value_paren_dispersion"
    rows = [(1, "Cmax", "a", "x", None), (1, "Cmax", "a", "x", None), (1, "Cmax", "b", "x", None), (1, "Cmax", None, "x", "F"), (2, "Cmax", "a", paren, None), (2, "Cmax", "b", "x", None), (2, "Cmax", None, paren, None), (3, "Cmax", "a", paren, None), (3, "Cmax", "a", paren, None), (3, "Cmax", "b", paren, None), (3, "Cmax", "c", paren, None), (3, "Cmax", None, paren, None), (4, "Cmax", None, "x", None)]
    got = {(r.TextTableID): (r.Unit, r.ValidationFlags) for r in pk.vote_units(spark.createDataFrame(rows, schema)).collect() if r.Unit is None or (r.ValidationFlags or "").find("VOTED") >= 0}
    assert got == {1: ("a", "F; PK_UNIT_SIBLING_VOTED"), 2: (None, None), 3: ("a", "PK_UNIT_SIBLING_VOTED:RESCUE_BOOST"), 4: (None, None)}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_texts(spark, rows):
    df = spark.createDataFrame(rows, "i int, t string")
    assert df.select(pk.canonical(F.col("t")), header_words.is_axis(F.col("t")), values.parse_value(F.col("t"))).count() == len(rows)
