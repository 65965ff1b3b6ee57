"""Phase 2 of standardisation: contents of observations' columns moved to where they belong, in a fixed order of passes.

A pass first decides what a row's text is, by the first case that holds, in a column of its own; then each column takes what
that case gives it.  Later passes read what earlier ones moved.  Systems by dictionary are ``terms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import header_words as words
from tessera.functions import pk, values
from tessera.functions.standardize import is_drug
from tessera.functions.stage5 import PLACEBO

TEXTS = ("TreatmentArm", "StudyContext", "DoseRegimen", "ParameterName", "ParameterSubtype", "Population", "Timepoint", "Unit")
NEEDED = {**{c: "string" for c in TEXTS}, "TableCategory": "string", "ArmN": "int", "Dose": "decimal(18,6)", "DoseUnit": "string", "PrimaryValueType": "string", "ParameterCategory": "string"}
#: Words that headers leak into units, labels of arms that name none, and words of statistics.
LEAKS = ("regimen", "dosage", "patients", "subjects", "mean", "median", "parameter", "study", "treatment")
GENERIC_ARMS = ("treatment", "arm", "group", "treated", "active", "drug", "total", "overall", "all patients", "comparison")
STATISTICS = ("mean", "median", "sd", "se", "cv", "standard", "deviation", "error", "range", "geometric", "min", "max", "n")
#: Markers that aren't pharmacokinetic.
PD_MARKERS = ("ace inhibition", "anti-xa activity", "aptt", "bone mineral density", "cd4 count", "ecl50", "fev1", "heart rate", "hba1c", "inr", "ldl cholesterol", "platelet aggregation", "testosterone suppression", "viral load")
#: Spellings of table categories.
CATEGORIES = {"ADVERSE_EVENT": "AdverseEvent", "ADVERSEEVENT": "AdverseEvent", "AE": "AdverseEvent", "PK": "PK", "PHARMACOKINETIC": "PK", "PHARMACOKINETICS": "PK", "DRUG_INTERACTION": "DrugInteraction", "DRUGINTERACTION": "DrugInteraction", "DDI": "DrugInteraction", "EFFICACY": "Efficacy"}


def category(text: Column) -> Column:
    """One spelling for a table's category; unknown ones stay, null is null."""
    key = F.upper(F.regexp_replace(F.trim(text), r"[\s-]+", "_"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), key), text)


def is_pd_marker(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*PD_MARKERS), F.lit(False))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


class _Rows:
    """Rows under their passes: set() assigns columns and flags by case."""

    def __init__(self, df: DataFrame):
        self.df = df

    def set(self, case: Column, assigned: dict[str, dict[str, Column]], flags: dict[str, str]) -> None:
        """assigned: by column, by case, the new value; a column without the case keeps its own."""
        self.df = self.df.withColumn("_case", F.coalesce(case, F.lit("")))
        new = {}
        for column, by_case in assigned.items():
            out = F.col(column)
            for name, value in by_case.items():
                out = F.when(F.col("_case") == name, value).otherwise(out)
            new[column] = out
        flag = F.lit(None).cast("string")
        for name, text in flags.items():
            flag = F.when(F.col("_case") == name, text).otherwise(flag)
        new["_flags"] = F.concat("_flags", F.when(flag.isNotNull(), F.array(flag)).otherwise(F.array().cast("array<string>")))
        self.df = self.df.withColumns(new).drop("_case")


def _inline_sizes(r: _Rows) -> None:
    """``(N=12)`` anywhere in a text, or ``N=12`` at its end, goes to ArmN, which the first one fills."""
    bracketed, bare = r"(?i)\s*[\(\[\{]\s*n\s*=\s*(\d[\d,]*)\s*[\)\]\}]", r"(?i)[\s^]+n\s*=\s*(\d[\d,]*)\s*$"
    for c in TEXTS:
        t = F.col(c)
        case = F.when(t.rlike(bracketed), "in").when(t.rlike(bare), "bare")
        size = lambda p, t=t: F.replace(F.regexp_extract(t, p, 1), F.lit(","), F.lit("")).try_cast("int")
        cut = lambda p, t=t: _or_null(F.regexp_replace(t, p, " "))
        r.set(case, {"ArmN": {"in": F.coalesce("ArmN", size(bracketed)), "bare": F.coalesce("ArmN", size(bare))}, c: {"in": cut(bracketed), "bare": cut(bare)}}, {"in": f"COL_STD:N_STRIPPED:{c}", "bare": f"COL_STD:N_STRIPPED:{c}:BARE"})


def _dose_regimens(r: _Rows, drugs: Column) -> None:
    """What stands for a regimen and is none: statistics' names, parameters, other drugs, populations, timepoints, a header."""
    t = F.trim("DoseRegimen")
    kind = pk.label_class(t)
    ws = words.words(t)
    echo = (F.size(ws) > 0) & F.forall(ws, lambda w: w.isin(*STATISTICS))
    amount, unit = values.dose(t)
    case = (
        F.when(_blank(t), "").when(echo, "echo").when(kind == "parameter", "parameter").when(kind == "dose", "dose")
        .when(is_drug(t, drugs) & F.col("TableCategory").isin("PK", "DrugInteraction"), "drug").when(kind == "population", "population").when(kind == "timepoint", "timepoint")
        .when(F.regexp_replace(F.lower(t), "[^a-z]", "") == "coadministereddrug", "header")
    )
    gone = F.lit(None).cast("string")
    fill = lambda c: F.when(_blank(F.col(c)), t).otherwise(F.col(c))
    r.set(
        case,
        {
            "ParameterSubtype": {"parameter": fill("ParameterSubtype"), "drug": fill("ParameterSubtype")}, "Population": {"population": fill("Population")}, "Timepoint": {"timepoint": fill("Timepoint")},
            "Dose": {"dose": F.coalesce("Dose", amount.cast("decimal(18,6)"))}, "DoseUnit": {"dose": F.when(F.col("Dose").isNull(), unit).otherwise(F.col("DoseUnit"))},
            "DoseRegimen": {k: gone for k in ("echo", "parameter", "drug", "population", "timepoint", "header")},
        },
        {"echo": "COL_STD:DOSEREGIMEN_STAT_ECHO_DROPPED", "parameter": "COL_STD:PK_SUBPARAM_ROUTED", "drug": "COL_STD:COADMIN_ROUTED", "population": "COL_STD:POPULATION_EXTRACTED", "timepoint": "COL_STD:TIMEPOINT_EXTRACTED", "header": "COL_STD:ROW_TYPE=HEADER"},
    )


def _names(r: _Rows, drugs: Column) -> None:
    """Captions and headers that stand for a name, doses, other drugs; entities and letters that were printed apart."""
    t = F.trim("ParameterName")
    decoded = t
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#177;", "±"), ("&plusmn;", "±"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(sign))
    dosed = (F.col("TableCategory") == "PK") & t.rlike(r"^\d{1,4}$")
    case = (
        F.when(_blank(t), "").when(F.lower(t).rlike(r"^table\s+\w"), "caption").when(F.lower(t).isin("n", "n=", "number"), "header").when(dosed, "dose")
        .when((F.col("TableCategory") == "DrugInteraction") & is_drug(t, drugs) & pk.canonical(t).isNull(), "drug").when(decoded != t, "entity")
    )
    gone = F.lit(None).cast("string")
    r.set(
        case,
        {
            "DoseRegimen": {"dose": F.when(_blank(F.col("DoseRegimen")), t).otherwise(F.col("DoseRegimen"))}, "ParameterSubtype": {"drug": F.when(_blank(F.col("ParameterSubtype")), t).otherwise(F.col("ParameterSubtype"))},
            "ParameterName": {**{k: gone for k in ("caption", "header", "dose", "drug")}, "entity": decoded},
        },
        {"caption": "COL_STD:ROW_TYPE=CAPTION", "header": "COL_STD:ROW_TYPE=HEADER", "dose": "COL_STD:PARAM_WAS_DOSE", "drug": "COL_STD:COADMIN_ROUTED", "entity": "COL_STD:HTML_ENTITY_DECODED"},
    )
    # Four single letters in a row or more were one word.
    apart = F.col("ParameterName").rlike(r"^(?:\p{L} ){3,}\p{L}$")
    r.set(F.when(apart, "apart"), {"ParameterName": {"apart": F.replace("ParameterName", F.lit(" "), F.lit(""))}}, {"apart": "COL_STD:OCR_COLLAPSED"})


def _arms(r: _Rows, drugs: Column) -> None:
    """Headers, labels that name no arm, doses behind a drug, and studies that stand for an arm."""
    t = F.trim("TreatmentArm")
    dose_at = F.regexp_extract(t, r"(?i)^(.*?\p{L})\s+(\d[\d,.]*\s*(?:mg|mcg|µg|g|mL|units?|IU)\b.*)$", 1), F.regexp_extract(t, r"(?i)^(.*?\p{L})\s+(\d[\d,.]*\s*(?:mg|mcg|µg|g|mL|units?|IU)\b.*)$", 2)
    other = ~F.coalesce(F.col("TableCategory").isin("AdverseEvent", "Efficacy"), F.lit(False))
    study = t.rlike(r"^[A-Z][A-Z0-9-]{2,11}$") & ~is_drug(t, drugs) & pk.canonical(t).isNull() & ~t.rlike(f"(?i){PLACEBO}")
    case = F.when(_blank(t), "").when(words.is_axis(t), "header").when(other & (dose_at[1] != "") & is_drug(dose_at[0], drugs), "dose").when(F.lower(t).isin(*GENERIC_ARMS), "generic").when(study, "study")
    gone = F.lit(None).cast("string")
    r.set(
        case,
        {
            "DoseRegimen": {"dose": F.when(_blank(F.col("DoseRegimen")), dose_at[1]).otherwise(F.col("DoseRegimen"))}, "StudyContext": {"study": F.when(_blank(F.col("StudyContext")), t).otherwise(F.col("StudyContext"))},
            "TreatmentArm": {"header": gone, "dose": dose_at[0], "generic": gone, "study": gone},
        },
        {"header": "COL_STD:ARM_WAS_HEADER", "dose": "COL_STD:DOSE_EXTRACTED", "generic": "COL_STD:ARM_WAS_GENERIC", "study": "COL_STD:ARM_WAS_STUDY"},
    )


def _subtype_units(r: _Rows) -> None:
    """A unit in the subtype's last bracket, perhaps behind a qualifier, goes to Unit."""
    t = pk.fold(F.col("ParameterSubtype"))
    unit = pk.header_unit(t)
    inner = F.regexp_extract(t, r"\(([^()]+)\)\s*$", 1)
    base, before = F.trim(F.regexp_replace(t, r"\s*\([^()]+\)\s*$", "")), F.trim(F.regexp_extract(inner, r"^(.*),[^,]*$", 1))
    fits = F.col("TableCategory").isin("PK", "DrugInteraction") & (inner != "") & unit.isNotNull()
    rest = F.nullif(F.concat_ws(", ", F.nullif(base, F.lit("")), F.nullif(before, F.lit(""))), F.lit(""))
    r.set(F.when(fits, "unit"), {"Unit": {"unit": F.when(_blank(F.col("Unit")), unit).otherwise(F.col("Unit"))}, "ParameterSubtype": {"unit": rest}}, {"unit": "COL_STD:PK_SUBPARAM_UNIT_EXTRACTED"})


def _parameters(r: _Rows) -> None:
    """Canonical names in PK tables: the name's own, else the subtype's; other names are parked in the study context, markers are flagged."""
    name, sub = F.trim("ParameterName"), F.trim("ParameterSubtype")
    own, theirs = pk.canonical(name), pk.canonical(sub)
    is_pk = F.coalesce(F.col("TableCategory") == "PK", F.lit(False))
    case = F.when(~is_pk, "").when(own.isNotNull() & (own == F.col("ParameterName")), "").when(own.isNotNull(), "own").when(theirs.isNotNull(), "swap").when(is_pd_marker(name) | is_pd_marker(sub), "marker").when(~_blank(name), "park")
    parked = F.when(_blank(F.col("StudyContext")), name).otherwise(F.col("StudyContext"))
    r.set(
        case,
        {"StudyContext": {"swap": F.when(_blank(name), F.col("StudyContext")).otherwise(parked), "park": parked}, "ParameterSubtype": {"swap": pk.qualifier(sub), "own": F.coalesce(_or_null(sub), pk.qualifier(name))}, "ParameterName": {"own": own, "swap": theirs, "park": F.lit(None).cast("string")}},
        {"own": "COL_STD:PK_NAME_CANONICALIZED", "swap": "COL_STD:PK_NAME_SUBTYPE_SWAPPED", "marker": "COL_STD:PK_NON_PK_MARKER_DETECTED", "park": "COL_STD:PK_NAME_CLEANED_NONCANON"},
    )
    again = is_pk & pk.canonical(F.col("ParameterSubtype")).isNotNull()
    r.set(F.when(again, "again"), {"ParameterSubtype": {"again": pk.qualifier(F.col("ParameterSubtype"))}}, {"again": "COL_STD:PK_SUBTYPE_SCRUBBED"})


def _units(r: _Rows, drugs: Column) -> None:
    """Units have one spelling; what headers leaked is no unit; one in brackets is taken out."""
    folded = F.trim(pk.fold(F.col("Unit")))
    r.df = r.df.withColumn("_t", folded).withColumn("_tight", F.regexp_replace(F.regexp_replace("_t", r"\s*([/·])\s*", "$1"), r"(?<=\p{L})\s*\.\s*(?=\p{L})", "·"))
    r.df = r.df.withColumns({"_inner": F.trim(F.regexp_extract("_tight", r"\(([^()]+)\)", 1)), "_spelled": values.normalise_unit(F.col("_tight")), "_like": values._unit_like(F.col("_tight"))})
    t, inner = F.col("_t"), F.col("_inner")
    ws = words.words(t)
    opened, closed = F.length(t) - F.length(F.replace(t, F.lit("("), F.lit(""))), F.length(t) - F.length(F.replace(t, F.lit(")"), F.lit("")))
    named = F.exists(ws, lambda w: F.array_contains(drugs, w))
    case = (
        F.when(_blank(t), "").when(F.col("_like"), "known").when(F.length(t) > 30, "leak").when(named | F.exists(ws, lambda w: w.isin(*LEAKS)), "leak")
        .when(values._unit_like(inner), "inner").when(opened != closed, "torn")
    )
    gone = F.lit(None).cast("string")
    r.set(case, {"Unit": {"leak": gone, "torn": gone, "inner": values.normalise_unit(inner)}}, {"leak": "COL_STD:UNIT_HEADER_LEAK", "torn": "COL_STD:UNIT_HEADER_LEAK:POST_EXTRACT", "inner": "COL_STD:UNIT_NORMALIZED"})
    fits = ~_blank(t) & F.col("_like") & (F.col("_spelled") != F.col("Unit"))
    r.set(F.when(fits, "spelled"), {"Unit": {"spelled": F.col("_spelled")}}, {"spelled": "COL_STD:UNIT_NORMALIZED"})
    r.df = r.df.drop("_t", "_tight", "_inner", "_spelled", "_like")


def _doses(r: _Rows) -> None:
    """A dose that no column has yet: from the regimen, then the arm; outside of adverse events also from name, subtype and context.  Placebo has none."""
    looked = ("DoseRegimen", "TreatmentArm", "ParameterName", "ParameterSubtype", "StudyContext")
    r.df = r.df.withColumns({f"_d{k}": F.struct(*[v.alias(n) for n, v in zip(("a", "u"), values.dose(F.col(c)), strict=True)]) for k, c in enumerate(looked)})
    found = [(F.col(f"_d{k}.a"), F.col(f"_d{k}.u")) for k in range(len(looked))]
    near, all_ = found[:2], found
    pick = lambda options, k: F.coalesce(*[F.when(o[0].isNotNull(), o[k]) for o in options])
    placebo = F.coalesce(F.col("TreatmentArm").rlike(f"(?i){PLACEBO}"), F.lit(False))
    case = F.when(placebo | F.col("Dose").isNotNull(), "").when((F.col("TableCategory") == "AdverseEvent") & pick(near, 0).isNotNull(), "near").when((F.col("TableCategory") != "AdverseEvent") & pick(all_, 0).isNotNull(), "all")
    r.set(case, {"DoseUnit": {"near": pick(near, 1), "all": pick(all_, 1)}, "Dose": {"near": pick(near, 0).cast("decimal(18,6)"), "all": pick(all_, 0).cast("decimal(18,6)")}}, {"near": "COL_STD:DOSE_SCANNED", "all": "COL_STD:DOSE_SCANNED"})


def apply(df: DataFrame, drugs: list[str]) -> DataFrame:
    """df with its columns put right and Flags: the passes' flags joined by semicolons, null where none did anything.

    Columns that df lacks count as null and are added.  drugs: known drugs' names, as many as a caller's filter has; blank texts
    are nulls like any other.
    """
    missing = {c: F.lit(None).cast(kind) for c, kind in NEEDED.items() if c not in df.columns}
    kept = df.columns
    r = _Rows(df.withColumns({**missing, "_flags": F.array().cast("array<string>")}).withColumn("TableCategory", category(F.col("TableCategory"))))
    known = F.array(*[F.lit(d.lower()) for d in drugs]) if drugs else F.array().cast("array<string>")
    _inline_sizes(r)
    _dose_regimens(r, known)
    _names(r, known)
    _arms(r, known)
    _subtype_units(r)
    _parameters(r)
    _units(r, known)
    _doses(r)
    flags = F.nullif(F.array_join("_flags", ";"), F.lit(""))
    return r.df.withColumn("Flags", flags).select(*kept, *[c for c in NEEDED if c not in kept], "Flags")
