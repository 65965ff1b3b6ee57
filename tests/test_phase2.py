"""Each pass of phase 2 on texts that it moves, and on those that it leaves; all rows go through one plan."""

from tessera.functions import phase2

SCHEMA = "id int, TableCategory string, TreatmentArm string, StudyContext string, DoseRegimen string, ParameterName string, ParameterSubtype string, Population string, Timepoint string, Unit string, ArmN int"
#: Texts of a row, and what differs behind the passes.
CASES = [
    (dict(TreatmentArm="Zorvan (N = 1,200)", DoseRegimen="5 mg N=7"), {"TreatmentArm": "Zorvan", "ArmN": 1200, "DoseRegimen": "5 mg", "Flags": "COL_STD:N_STRIPPED:TreatmentArm;COL_STD:N_STRIPPED:DoseRegimen:BARE", "Dose": "5.000000", "DoseUnit": "mg"}),
    (dict(Population="[n=3]", ArmN=9), {"Population": None, "Flags": "COL_STD:N_STRIPPED:Population"}),
    (dict(TableCategory="PK", DoseRegimen="Mean ± Standard Deviation"), {"DoseRegimen": None, "Flags": "COL_STD:DOSEREGIMEN_STAT_ECHO_DROPPED"}),
    (dict(TableCategory="ddi", DoseRegimen="Oaktan"), {"TableCategory": "DrugInteraction", "DoseRegimen": None, "ParameterSubtype": "Oaktan", "Flags": "COL_STD:COADMIN_ROUTED"}),
    (dict(DoseRegimen="Elderly subjects"), {"DoseRegimen": None, "Population": "Elderly subjects", "Flags": "COL_STD:POPULATION_EXTRACTED"}),
    (dict(DoseRegimen="Day 14", Timepoint="x"), {"DoseRegimen": None, "Flags": "COL_STD:TIMEPOINT_EXTRACTED"}),
    (dict(DoseRegimen="Co-administered Drug"), {"DoseRegimen": None, "Flags": "COL_STD:ROW_TYPE=HEADER"}),
    (dict(TableCategory="Efficacy", DoseRegimen="10 mg twice"), {"Dose": "10.000000", "DoseUnit": "mg"}),
    (dict(ParameterName="Table 4 of things"), {"ParameterName": None, "Flags": "COL_STD:ROW_TYPE=CAPTION"}),
    (dict(ParameterName="n"), {"ParameterName": None, "Flags": "COL_STD:ROW_TYPE=HEADER"}),
    (dict(TableCategory="PK", ParameterName="200"), {"ParameterName": None, "DoseRegimen": "200", "Flags": "COL_STD:PARAM_WAS_DOSE"}),
    (dict(ParameterName="weight &gt; 5 &amp; up"), {"ParameterName": "weight > 5 & up", "Flags": "COL_STD:HTML_ENTITY_DECODED"}),
    (dict(ParameterName="R a s h"), {"ParameterName": "Rash", "Flags": "COL_STD:OCR_COLLAPSED"}),
    (dict(TableCategory="DrugInteraction", ParameterName="oaktan"), {"ParameterName": None, "ParameterSubtype": "oaktan", "Flags": "COL_STD:COADMIN_ROUTED"}),
    (dict(TreatmentArm="Number of patients"), {"TreatmentArm": None, "Flags": "COL_STD:ARM_WAS_HEADER"}),
    (dict(TableCategory="PK", TreatmentArm="Zorvan 150 mg/day"), {"TreatmentArm": "Zorvan", "DoseRegimen": "150 mg/day", "Dose": "150.000000", "DoseUnit": "mg/d", "Flags": "COL_STD:DOSE_EXTRACTED;COL_STD:DOSE_SCANNED"}),
    (dict(TreatmentArm="Treatment"), {"TreatmentArm": None, "Flags": "COL_STD:ARM_WAS_GENERIC"}),
    (dict(TreatmentArm="STAR-2"), {"TreatmentArm": None, "StudyContext": "STAR-2", "Flags": "COL_STD:ARM_WAS_STUDY"}),
    (dict(TreatmentArm="PLACEBO"), {}),
    (dict(TreatmentArm="ZORVAN"), {}),
    (dict(TableCategory="PK", ParameterName="Cmax", ParameterSubtype="trough (serum, mcg/mL)"), {"Unit": "mcg/mL", "ParameterSubtype": "trough, serum", "Flags": "COL_STD:PK_SUBPARAM_UNIT_EXTRACTED"}),
    (dict(TableCategory="PK", ParameterName="Peak Concentration, fasted (ng/mL)"), {"ParameterName": "Cmax", "ParameterSubtype": "fasted", "Flags": "COL_STD:PK_NAME_CANONICALIZED"}),
    (dict(TableCategory="PK", ParameterName="Adults", ParameterSubtype="AUC0-24"), {"ParameterName": "AUC0-24", "ParameterSubtype": None, "StudyContext": "Adults", "Flags": "COL_STD:PK_NAME_SUBTYPE_SWAPPED"}),
    (dict(TableCategory="PK", ParameterName="Something else"), {"ParameterName": None, "StudyContext": "Something else", "Flags": "COL_STD:PK_NAME_CLEANED_NONCANON"}),
    (dict(TableCategory="PK", ParameterName="INR"), {"Flags": "COL_STD:PK_NON_PK_MARKER_DETECTED"}),
    (dict(Unit="µg / mL"), {"Unit": "mcg/mL", "Flags": "COL_STD:UNIT_NORMALIZED"}),
    (dict(Unit="ng·h/mL"), {}),
    (dict(Unit="odd"), {}),
    (dict(Unit="Value (ng·hr/mL)"), {"Unit": "ng·h/mL", "Flags": "COL_STD:UNIT_NORMALIZED"}),
    (dict(Unit="Mean (SD)"), {"Unit": None, "Flags": "COL_STD:UNIT_HEADER_LEAK"}),
    (dict(Unit="x) y"), {"Unit": None, "Flags": "COL_STD:UNIT_HEADER_LEAK:POST_EXTRACT"}),
    (dict(TableCategory="PK", StudyContext="single 20 mg tablet"), {"Dose": "20.000000", "DoseUnit": "mg", "Flags": "COL_STD:DOSE_SCANNED"}),
    (dict(TableCategory="AE", StudyContext="single 20 mg tablet"), {"TableCategory": "AdverseEvent"}),
    (dict(TreatmentArm="Placebo 20 mg"), {}),
    (dict(), {}),
]


def test_each_pass(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [{"id": i, **texts} for i, (texts, _) in enumerate(CASES)]
    out = phase2.apply(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA), ["Zorvan", "Oaktan"]).collect()
    for r in sorted(out, key=lambda r: r.id):
        got, row = r.asDict(), rows[r.id]
        kept = {k: v for k, v in got.items() if v != row.get(k) and k not in ("Dose", "DoseUnit", "PrimaryValueType", "ParameterCategory")} | {k: str(got[k]) for k in ("Dose", "DoseUnit") if got[k] is not None}
        assert kept == CASES[r.id][1], row


def test_empty_tables_and_clashing_names(spark):
    few = spark.createDataFrame([(1, "Treatment", "kept")], "id int, TreatmentArm string, extra string")
    out = phase2.apply(few, [])
    assert out.columns[:3] == ["id", "TreatmentArm", "extra"] and out.first().TreatmentArm is None and out.first().extra == "kept" and phase2.apply(few.limit(0), []).count() == 0
