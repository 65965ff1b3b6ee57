"""Pharmacokinetic tables to observations: parameter names, orientation, blocks with headers of their own, units, regimens.

Each decision is a vote or a window over (table), (table, block) or (table, row), so tables of all layouts go through one
plan.  A block is what follows a header row in a table's body, by gaps and islands: a row belongs to the last header
row above it.  Studies side by side part by the upper levels of their columns' header paths.  What a text says by itself
is found once for each distinct text of all tables and joined to where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import header_words as words
from tessera.functions import values
from tessera.functions.table_rows import ci_level
from tessera.operators import relops
from tessera.session import stored

#: Pharmacokinetic parameters and the names that they go by; spacing, brackets and case don't matter.
PARAMETERS = {
    "Cmax": ("Cmax", "Cmax,ss", "Cmax1", "Cmax2", "Peak Conc.", "Maximum Plasma Concentration", "Maximum Concentration", "Peak Plasma Concentration", "Peak Concentration", "Peak concentration at steady state"),
    "Cmin": ("Cmin", "Cmin,ss", "Cminip", "Minimum Plasma Concentration", "Minimum Concentration"),
    "Ctrough": ("Ctrough", "Cthrough", "Trough Concentration", "Trough Plasma Concentration", "Predose Concentration"),
    "Cavg": ("Cavg", "Css,avg", "Average Concentration", "Average Plasma Concentration"),
    "Css": ("Css", "Steady State Concentration"),
    "Tmax": ("Tmax", "Tmax1", "Tmax2", "Time to Peak", "Time to Maximum Concentration", "Time to Peak Concentration"),
    "t½": ("t½", "t1/2", "Half-life", "Elimination Half-life", "Terminal Half-life"),
    "MRT": ("MRT", "Mean Residence Time"),
    "MAT": ("MAT", "Mean Absorption Time"),
    "tlag": ("tlag", "Lag Time", "Absorption Lag Time"),
    "AUC0-inf": ("AUC0-inf", "AUC0-∞", "AUC0-infinity", "AUCinf", "AUC∞", "AUC0 to inf"),
    "AUC0-24": ("AUC0-24", "AUC0-24h", "AUC24", "AUC24h"),
    "AUC0-12": ("AUC0-12", "AUC0-12h", "AUC12", "AUC12h"),
    "AUC0-t": ("AUC0-t", "AUC0 to t"),
    "AUClast": ("AUClast", "AUCtldc", "AUC to last measurable concentration", "AUC to last detectable concentration"),
    "AUCtau": ("AUCtau", "AUC0-tau", "AUCτ", "AUCT", "AUC over dosing interval"),
    "AUC": ("AUC", "Total AUC", "Overall AUC", "Area Under the Curve", "Area Under Curve", "Area Under the Concentration-Time Curve"),
    "CL/F": ("CL/F", "CLss/F", "Apparent Clearance", "Apparent Oral Clearance"),
    "CL": ("CL", "CLss", "Clearance", "Total Clearance", "Systemic Clearance"),
    "CLr": ("CLr", "Renal Clearance"),
    "Vd/F": ("Vd/F", "V/F", "Vz/F", "Apparent Volume of Distribution"),
    "Vss": ("Vss", "Vdss", "Volume of Distribution at Steady State"),
    "Vd": ("Vd", "Volume of Distribution"),
    "ke": ("ke", "kel", "Elimination Rate Constant"),
    "ka": ("ka", "Absorption Rate Constant"),
    "λz": ("λz", "Lambda z", "Terminal Rate Constant"),
    "F": ("F", "Bioavailability", "Absolute Bioavailability"),
}
#: What a measured fluid is called before a parameter.
FLUIDS = ("serum", "plasma", "blood", "whole blood", "urine", "cerebrospinal fluid", "csf")
#: States that a divider or a name carries, and the words that show them.
QUALIFIERS = {"single_dose": ("single dose",), "multiple_dose": ("multiple dose",), "steady_state": ("steady state", ",ss"), "fasted": ("fasted",), "fed": ("fed",)}
#: Headers of columns that hold the dose, the size of a group, or a population.
DOSE_HEADERS, SIZE_HEADERS = ("dose", "regimen", "dosage", "route"), ("n", "sample size")
POPULATIONS = ("age", "group", "population", "subgroup", "cohort", "volunteers", "subjects", "patients")
TIME_UNITS = {"hours": ("h", "hr", "hrs", "hour", "hours"), "minutes": ("min", "mins", "minute", "minutes"), "seconds": ("s", "sec", "second", "seconds"), "days": ("d", "day", "days"), "weeks": ("week", "weeks"), "months": ("month", "months"), "years": ("year", "years")}


def fold(text: Column) -> Column:
    """Compatible signs have one form: middle dots, strokes, micro, subscripts, halves, infinity, Greek tau, dashes and blanks."""
    t = F.translate(F.coalesce(text, F.lit("")), "⋅∙•×µ⁄∕₀₁₂₃₄₅₆₇₈₉–—−  ", "····μ//0123456789---  ")
    for sign, plain in (("½", "1/2"), ("∞", "inf"), ("τ", "tau")):
        t = F.replace(t, F.lit(sign), F.lit(plain))
    return t


def key(text: Column) -> Column:
    """What a name is looked up by: folded, in small letters, without footnote marks, blanks, brackets and signs between words."""
    t = F.regexp_replace(F.lower(fold(text)), r"[*†‡§¶#]+\s*$", "")
    return F.regexp_replace(F.replace(F.regexp_replace(t, r"(\d)\s+to\s+", "$1"), F.lit("infinity"), F.lit("inf")), r"[\s_,().\-]+", "")


def _plain_key(name: str) -> str:
    """key() of a fixed name."""
    out = name.lower()
    for sign, plain in (("½", "1/2"), ("∞", "inf"), ("τ", "tau"), ("infinity", "inf"), ("0 to ", "0")):
        out = out.replace(sign, plain)
    return "".join(c for c in out if c not in " _,().-")


_LOOKUP = {_plain_key(a): name for name, aliases in PARAMETERS.items() for a in aliases}


def canonical(text: Column) -> Column:
    """The parameter that a header or label names; null for others.

    The whole text is tried, then without a bracket at its end (a unit), then without a fluid before it; what a bracket
    at the end names, up to a comma, goes first.  An area over hours or days without a name of their own is the plain area, a concentration at
    a number of hours the trough.
    """
    table = F.create_map(*[F.lit(x) for kv in _LOOKUP.items() for x in kv])
    find = lambda k: F.coalesce(F.try_element_at(table, k), F.when(k.rlike(r"^auc(?!0)\d+[hd]?$|^auc0\d+d$"), "AUC").when(k.rlike(r"^c\d+h?$"), "Ctrough"))
    fluids = r"^\s*(?:" + "|".join(sorted(FLUIDS, key=len, reverse=True)) + r")\s+"

    def tried(t: Column) -> Column:
        inner, bare = F.trim(F.regexp_extract(t, r"\(([^()]+)\)\s*$", 1)), F.trim(F.regexp_replace(t, r"\s*\([^()]*\)\s*[*†‡§¶#]*\s*$", ""))
        return values.let(F.struct(inner.alias("i"), bare.alias("b"), F.trim(F.substring_index(bare, ",", 1)).alias("n")), lambda p: F.array(
            F.when((p["i"] != "") & ~values._unit_like(p["i"]), F.trim(F.substring_index(p["i"], ",", 1))), t, F.when(p["b"] != t, p["b"]), F.when(p["n"] != p["b"], p["n"]),
            F.when(F.lower(p["n"]).rlike(fluids), F.regexp_replace(F.lower(p["n"]), fluids, "")),
        ))

    names = lambda t: F.transform(F.filter(tried(t), lambda c: c.isNotNull()), lambda c: values.let(key(c), find))
    # Cells of numbers and signs alone name nothing.
    return F.when(text.rlike(r"[\p{L}½]"), F.try_element_at(F.filter(values.let(fold(text), names), lambda n: n.isNotNull()), F.lit(1)))


def header_unit(text: Column) -> Column:
    """The unit in a header's last bracket or behind its last comma; null where that is none."""

    def some(u: Column) -> Column:
        return values.let(F.trim(u), lambda x: F.when(values._unit_like(x), values.normalise_unit(x)))

    def read(t: Column) -> Column:
        inside = F.regexp_extract(t, r"\(([^()]+)\)\s*[*†‡§¶#]*\s*$", 1)
        return F.coalesce(some(inside), some(F.regexp_extract(inside, r",\s*([^,]+)$", 1)), some(F.regexp_extract(t, r",\s*([^,()]+)$", 1)))

    return F.when(text.rlike(r"[(,]"), values.let(fold(text), read))


def qualifier(text: Column) -> Column:
    """The state that a text names: single or multiple dose, steady state, fasted, fed; null without one."""
    t = F.replace(F.lower(fold(text)), F.lit("-"), F.lit(" "))
    out = F.lit(None).cast("string")
    for name, shown in reversed(QUALIFIERS.items()):
        out = F.when(_has(t, shown), name).otherwise(out)
    return out


def _has(text: Column, phrases: tuple[str, ...]) -> Column:
    hits = [text.rlike(rf"\b{p}\b") if p[0].isalpha() else text.contains(p) for p in phrases]
    return F.coalesce(hits[0] if len(hits) == 1 else hits[0] | hits[1], F.lit(False))


def time_unit(text: Column) -> Column:
    """The full name of a time unit; null for others."""
    table = {x: name for name, forms in TIME_UNITS.items() for x in forms}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(text)))


def duration(regimen: Column) -> dict[str, Column]:
    """Time, its unit and the timepoint's text: ``x 7 days`` and ``for 2 weeks``, or a single dose without a time."""
    found = r"(?i)(?:\bx|\bfor)\s*(\d+)\s*(days?|weeks?|months?|hours?)\b"
    n, unit = F.regexp_extract(regimen, found, 1).try_cast("double"), time_unit(F.regexp_extract(regimen, found, 2))
    single = F.when(F.lower(regimen).rlike(r"\bsingle\b"), "single dose")
    point = F.when(n.isNotNull(), F.concat_ws(" ", n.cast("int").cast("string"), unit)).otherwise(single)
    return {"time": n, "unit": F.when(n.isNotNull(), unit), "timepoint": point}


def label_class(text: Column) -> Column:
    """parameter, dose, timepoint, population or other."""
    t = F.trim(F.coalesce(text, F.lit("")))
    amount, _ = values.dose(t)
    ws = words.words(t)
    time_only = t.rlike(r"(?i)^(?:day|week|month|hour|cycle)s?\s+\d+$|^\d+\s*(?:h|hr|hours?|days?|weeks?)$")
    return (
        F.when(canonical(t).isNotNull(), "parameter")
        .when(time_only, "timepoint")
        .when(amount.isNotNull(), "dose")
        .when(F.arrays_overlap(ws, F.array(*[F.lit(x) for x in POPULATIONS])), "population")
        .otherwise("other")
    )


def _is_dose_header(text: Column) -> Column:
    return F.coalesce(F.element_at(F.transform(F.array(words.words(text)), lambda w: (F.size(w) > 0) & F.forall(w, lambda x: x.isin(*DOSE_HEADERS))), 1), F.lit(False))


def _is_size_header(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.replace(text, F.lit("="), F.lit("")))).isin(*SIZE_HEADERS), F.lit(False))


def _path() -> Column:
    return F.split(F.coalesce("HeaderPath", F.lit("")), " > ")


def _leaf() -> Column:
    return F.element_at(_path(), -1)


def _above() -> Column:
    path = _path()
    return F.nullif(F.array_join(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), " > "), F.lit(""))


def _facts(text: Column) -> list[Column]:
    """What a text says by itself, as a parameter's name, a label, a unit, a regimen, a divider or a caption."""
    unit_text, (amount, dose_unit), time = fold(F.regexp_replace(text, r"^\(|\)$", "")), values.dose(text), duration(text)
    return [
        canonical(text).alias("canon"), label_class(text).alias("kind"), _is_dose_header(text).alias("dosehead"), _is_size_header(text).alias("sizehead"), values._unit_like(unit_text).alias("isunit"), values.normalise_unit(unit_text).alias("unit"),
        header_unit(text).alias("inunit"), qualifier(text).alias("state"), amount.alias("amount"), dose_unit.alias("doseunit"), time["time"].alias("time"), time["unit"].alias("timeunit"), time["timepoint"].alias("timepoint"),
        values.header_n(text).alias("n"), _dispersion(text).alias("spread"), ci_level(text).alias("ci"),
    ]


class _Read:
    """The data cells of a grid, stored with their trimmed Text, and the facts of all texts that stand in them, over them or in captions."""

    def __init__(self, grid: DataFrame, captions: DataFrame | None = None):
        self.cells = stored(grid.filter("RowClass = 'DataBody'").withColumn("Text", F.trim(F.coalesce("CellText", F.lit("")))))
        around = self.cells.select("HeaderPath", "Category", "Footnotes").distinct()
        texts = self.cells.select(F.col("Text").alias("t")).distinct().unionByName(around.select(F.explode(F.array("HeaderPath", _leaf(), _above(), "Category", "Footnotes")).alias("t")))
        if captions is not None:
            texts = texts.unionByName(captions.select(F.col("Caption").alias("t")))
        facts = stored(texts.filter("t is not null").distinct().select("t", *_facts(F.col("t"))))
        small = facts.limit(relops.MAX_SENT + 1).count() <= relops.MAX_SENT
        self.facts = F.broadcast(facts) if small else facts.hint("merge")

    def say(self, df: DataFrame, text: str, name: str, *fields: str) -> DataFrame:
        """df with a struct of what the texts of a column say."""
        mine = self.facts.select(F.col("t").alias("_t"), F.struct(*fields).alias(name))
        return df.join(mine, F.col(text) == F.col("_t"), "left").drop("_t")


def headed(read: _Read) -> DataFrame:
    """Data cells with what heads them: Block, Head (the column's header in that block), Study, Label, and the unit that a row of units gives.

    A row of headers holds parameters, and besides only dose, size and blank cells; it starts a block and is no data row.  A
    row of units, whose cells are all units, holds for the rows below it in its block.
    """
    row = Window.partitionBy("TextTableID", "RowSeq")
    # Dealt by table, one shuffle serves the windows.
    cells = read.say(read.cells.repartition("TextTableID"), "Text", "_says", "canon", "dosehead", "sizehead", "isunit", "unit")
    value = (F.col("Col") > 0) & (F.col("Text") != "")
    par, head = F.col("_says.canon").isNotNull(), F.col("_says.dosehead") | F.col("_says.sizehead")
    total = lambda c: F.sum(F.when(value & c, 1).otherwise(0)).over(row)
    cells = cells.withColumns({"_n": total(F.lit(True)), "_pars": total(par), "_heads": total(par | head), "_units": total(F.col("_says.isunit")), "Label": F.max(F.when(F.col("Col") == 0, F.col("Text"))).over(row)})
    is_sub = (F.col("_pars") > 0) & (F.col("_heads") == F.col("_n"))
    is_unit = ~is_sub & (F.col("_n") > 0) & (F.col("_units") == F.col("_n")) & (F.lower("Label").isin("", "unit", "units"))
    down = Window.partitionBy("TextTableID", "Col").orderBy("RowSeq")
    cells = cells.withColumns({"_sub": is_sub, "_isunit": is_unit})
    last = F.last(F.when(F.col("_sub"), F.struct(F.col("RowSeq").alias("at"), F.col("Text").alias("t"))), True).over(down)
    cells = cells.withColumn("_last", last).withColumn("Block", F.coalesce(F.col("_last.at"), F.lit(0)))
    unit = F.last(F.when(F.col("_isunit"), F.struct(F.col("_says.unit").alias("u"))), True).over(Window.partitionBy("TextTableID", "Col", "Block").orderBy("RowSeq"))
    # Above a block's own headers stands the table's header, which all of its columns share, so the divider tells the study.
    head, study = F.coalesce(F.col("_last.t"), _leaf()), F.when(F.col("Block") == 0, _above())
    return cells.withColumns({"Head": head, "Study": study, "RowUnit": unit["u"]}).filter(~F.col("_sub") & ~F.col("_isunit")).drop("_says", "_n", "_pars", "_heads", "_units", "_sub", "_isunit", "_last")


_NAMING = ("canon", "kind", "dosehead", "sizehead", "inunit", "state", "spread")


def voted(read: _Read) -> DataFrame:
    """The headed cells with the votes of both axes of their block, Transposed, and what Head and Label say.

    Columns that name parameters and rows that name doses speak for the usual layout, the reverse for the transposed one;
    the larger number of votes decides, and a tie is the usual layout.
    """
    cells = read.say(read.say(headed(read), "Head", "_head", *_NAMING), "Label", "_label", *_NAMING)
    block = Window.partitionBy("TextTableID", "Block")
    # Rows are as wide as their table, so a block's first row has all of its columns.
    cells = cells.withColumns({"_top": F.min("RowSeq").over(block), "_widest": F.max("Col").over(block)})
    total = lambda where, said, kind: F.sum(F.when(where & (F.coalesce(F.col(said), F.lit("other")) == kind), 1).otherwise(0)).over(block)
    column, row = (F.col("Col") > 0) & (F.col("RowSeq") == F.col("_top")), F.col("Col") == 0
    cells = cells.withColumns({f"{axis}{name}s": total(where, said, name.lower()) for axis, where, said in (("Column", column, "_head.kind"), ("Row", row, "_label.kind")) for name in ("Parameter", "Dose")})
    return cells.withColumn("Transposed", F.col("RowParameters") + F.col("ColumnDoses") > F.col("ColumnParameters") + F.col("RowDoses"))


def orientation(grid: DataFrame) -> DataFrame:
    """Per table and block of a grid: the votes of both axes and Transposed."""
    cells = voted(_Read(grid)).filter("Col = 0 and RowSeq = _top and _widest > 0")
    return cells.select("TextTableID", "Block", "ColumnParameters", "ColumnDoses", "RowParameters", "RowDoses", "Transposed")


def _dispersion(text: Column) -> Column:
    """SD, SE or CV_Percent where a text names one; null without."""
    ws = words.words(text)
    has = lambda *x: F.arrays_overlap(ws, F.array(*[F.lit(v) for v in x]))
    return F.when(has("sd") | (has("standard") & has("deviation")), "SD").when(has("se", "sem") | (has("standard") & has("error")), "SE").when(has("cv"), "CV_Percent")


def _flags(*flags: Column) -> Column:
    return F.nullif(F.concat_ws("; ", *flags), F.lit(""))


def observations(grid: DataFrame, tables: DataFrame) -> DataFrame:
    """Observations of pharmacokinetic tables (TextTableID, DocumentGUID, Caption) of any layout.

    ParameterName is the canonical name where the text has one; ArmN comes from a size column, the regimen or the caption;
    a plus-minus without a named kind is a standard deviation and flagged; a percent over 100 is a number with a statistic
    in brackets; a row with name, value, type and unit is as sure as a validated one.
    """
    read = _Read(grid, tables)
    c = voted(read)
    row = Window.partitionBy("TextTableID", "RowSeq")
    straight = ~F.col("Transposed")
    is_dose, is_size = F.coalesce("_head.dosehead", F.lit(False)), F.coalesce("_head.sizehead", F.lit(False))
    dose_text = F.max(F.when((F.col("Col") > 0) & straight & is_dose, F.nullif(F.col("Text"), F.lit("")))).over(row)
    size = F.max(F.when((F.col("Col") > 0) & straight & is_size, F.replace("Text", F.lit(","), F.lit("")).try_cast("int"))).over(row)
    c = c.withColumns({"_dose": dose_text, "_size": size})
    c = c.filter((F.col("Col") > 0) & (F.col("Text") != "") & ~(straight & (is_dose | is_size)))
    by_layout = lambda turned, usual: F.when(F.col("Transposed"), F.col(turned)).otherwise(F.col(usual))
    c = c.join(tables.select("TextTableID", "DocumentGUID", "Caption").hint("merge"), "TextTableID")
    c = c.withColumns({"_name": by_layout("Label", "Head"), "_other": by_layout("Head", "Label"), "_named": by_layout("_label", "_head"), "_kind": F.coalesce(by_layout("_head.kind", "_label.kind"), F.lit("other"))})
    c = c.withColumn("DoseRegimen", F.coalesce("_dose", F.when(F.col("_kind") == "dose", F.col("_other"))))
    for text, name, fields in (("DoseRegimen", "_regimen", ("amount", "doseunit", "time", "timeunit", "timepoint", "n")), ("Study", "_study", ("state", "n")), ("Category", "_divider", ("state",)), ("Caption", "_caption", ("state", "n", "spread", "ci")), ("HeaderPath", "_over", ("spread",)), ("Footnotes", "_foot", ("spread",))):
        c = read.say(c, text, name, *fields)
    in_regimen, in_caption = F.col("_regimen.n"), F.col("_caption.n")
    c = c.withColumns({"ArmN": F.coalesce("_size", in_regimen, "_study.n", in_caption), "_armflag": F.when(F.col("_size").isNull() & in_regimen.isNull() & in_caption.isNotNull(), "PK_CAPTION_ARMN_FALLBACK")})
    c = c.withColumns({"_canon": F.col("_named.canon"), "_inunit": F.col("_named.inunit"), "_spread": F.coalesce("_over.spread", "_named.spread", "_foot.spread", "_caption.spread"), "_state": F.coalesce("_named.state", "_divider.state", "_study.state", "_caption.state"), "_undivided": F.col("_divider.state").isNull(), "_ci": F.col("_caption.ci")})
    c = stored(c.select("DocumentGUID", "TextTableID", "RowSeq", "Col", "Text", "Study", "Category", "Footnotes", "RowUnit", "Transposed", "DoseRegimen", "ArmN", "_armflag", "_name", "_other", "_kind", "_canon", "_inunit", "_spread", "_state", "_undivided", "_ci", *[F.col(f"_regimen.{f}").alias(f"_{f}") for f in ("amount", "doseunit", "time", "timeunit", "timepoint")]))
    c = relops.by_distinct(c, ["Text", "ArmN"], "v", values.parse_value(F.col("Text"), F.col("ArmN")))
    high = (F.col("v.type") == "Percentage") & (F.col("v.primary") > 100) & F.col("v.secondary").isNotNull() & (F.col("v.rule") == "n_pct")
    shown = F.regexp_replace(F.col("v.primary").cast("string"), r"\.0$", "")
    spread = F.col("v.rule").isin("value_plusminus", "value_plusminus_sample", "value_paren_dispersion")
    # n (x) beside a parameter is a value with a statistic, no count with a percent.
    paired = (F.col("v.rule") == "n_pct") & ~F.col("Text").contains("%") & F.col("_canon").isNotNull() & ~high
    swapped = high | paired
    known = F.col("_spread")
    primary, second = F.when(swapped, F.col("v.secondary")).otherwise(F.col("v.primary")), F.when(swapped, F.col("v.primary")).otherwise(F.col("v.secondary"))
    kind_of = F.when(swapped | (F.col("v.type") == "Numeric"), "Mean").otherwise(F.col("v.type"))
    second_kind = F.when(spread | paired, F.coalesce(known, F.lit("SD"))).when(~high, F.col("v.secondary_type"))
    inferred = F.when((spread | paired) & known.isNull(), "PLUSMINUS_TYPE_INFERRED:SD")
    rejected = F.when(high, F.concat(F.lit("PCT_GT100_REJECTED:"), shown, F.lit("; PK_PCT_GT100_DEMOTED")))
    unit = F.coalesce(F.when(~swapped & (F.col("v.rule") == "value_trailing_unit"), F.col("v.unit")), "_inunit", "RowUnit")
    rule = F.when(high, F.concat("v.rule", F.lit("+pk_pct_gt100_demoted"))).when(paired, F.concat("v.rule", F.lit("+pk_statistic"))).otherwise(F.col("v.rule"))
    complete = primary.isNotNull() & (kind_of != "Text") & unit.isNotNull() & (F.col("_name") != "")
    raised = complete & (F.col("v.confidence") < values.CHECKED)
    study = _flags(F.col("Study"), F.when(F.col("_undivided"), F.col("Category")))
    return c.filter("not v.excluded").select(
        "DocumentGUID", "TextTableID", F.col("RowSeq").alias("SourceRowSeq"), F.col("Col").alias("SourceCellSeq"), F.lit("PK").alias("TableCategory"), F.coalesce("_canon", F.trim("_name")).alias("ParameterName"), F.col("_state").alias("ParameterSubtype"),
        study.alias("StudyContext"), "DoseRegimen", F.col("_amount").alias("Dose"), F.col("_doseunit").alias("DoseUnit"), F.when(F.col("_kind").isin("population", "other"), F.nullif("_other", F.lit(""))).alias("Population"),
        F.coalesce(F.when(F.col("_kind") == "timepoint", F.col("_other")), "_timepoint").alias("Timepoint"), F.col("_time").alias("Time"), F.col("_timeunit").alias("TimeUnit"), "ArmN", primary.alias("PrimaryValue"), kind_of.alias("PrimaryValueType"),
        second.alias("SecondaryValue"), second_kind.alias("SecondaryValueType"), F.when(~swapped, F.col("v.lower")).alias("LowerBound"), F.when(~swapped, F.col("v.upper")).alias("UpperBound"),
        F.when(~swapped & F.col("v.lower").isNotNull(), F.coalesce(F.when(F.col("v.bound_type") == "CI", F.col("_ci")), "v.bound_type")).alias("BoundType"), unit.alias("Unit"), rule.alias("ParseRule"),
        F.when(raised, F.lit(values.CHECKED)).otherwise(F.col("v.confidence")).alias("ParseConfidence"), "Footnotes",
        _flags(F.when(~swapped, F.col("v.flags")), rejected, inferred, "_armflag", F.when(F.col("Transposed"), "PK_TRANSPOSED_LAYOUT"), F.when(raised, "PK_COMPLETE_SPINE_CONFIDENCE")).alias("ValidationFlags"),
    )


def vote_units(obs: DataFrame) -> DataFrame:
    """Rows without a unit take that of their table's rows of the same parameter, if those agree, and say so.

    A unit wins with more than half of the rows that have one; where at least half of all rows hold a dispersion in
    brackets, a third is enough if no other unit has as many.
    """
    of = Window.partitionBy("TextTableID", "ParameterName")
    each = Window.partitionBy("TextTableID", "ParameterName", "Unit")
    rows = obs.withColumns({"_all": F.count(F.lit(1)).over(of), "_with": F.count("Unit").over(of), "_paren": F.sum(F.when(F.col("ParseRule").isin("value_paren_dispersion", "n_pct+pk_statistic"), 1).otherwise(0)).over(of), "_mine": F.count("Unit").over(each)})
    best = F.max(F.struct(F.col("_mine").alias("n"), F.col("Unit").alias("u"))).over(of)
    rows = rows.withColumn("_best", best)
    ties = F.min(F.when(F.col("_mine") == F.col("_best.n"), F.col("Unit"))).over(of)
    unique = ties == F.col("_best.u")
    enough = (F.col("_all") >= 2) & (F.col("_best.n") > 0)
    plain = enough & (2 * F.col("_best.n") > F.col("_with"))
    rescue = enough & ~plain & (2 * F.col("_paren") >= F.col("_all")) & (3 * F.col("_best.n") >= F.col("_with")) & unique
    fill = F.col("Unit").isNull() & (plain | rescue)
    flag = F.when(fill, F.when(plain, F.lit("PK_UNIT_SIBLING_VOTED")).otherwise(F.lit("PK_UNIT_SIBLING_VOTED:RESCUE_BOOST")))
    rows = rows.withColumns({"_u": F.when(fill, F.col("_best.u")).otherwise(F.col("Unit")), "_f": _flags(F.col("ValidationFlags"), flag)})
    return rows.drop("Unit", "ValidationFlags", "_all", "_with", "_paren", "_mine", "_best").withColumnsRenamed({"_u": "Unit", "_f": "ValidationFlags"}).select(obs.columns)
