"""From reconstructed tables to observations: column contexts, arms, denominators, values, comparisons.

All steps are column expressions and windows over (table), (table, row) or (table, column), so many tables go
through one plan; the grid's cells are rows from the start.  ``observations`` gives the schema that the
cohort statistics read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import header_words as words
from tessera.functions import values
from tessera.functions.standardize import subject_counts
from tessera.operators import relops
from tessera.session import stored

# Flags of where an arm's size comes from.
FROM_ROW, FROM_HEADER, FROM_FRACTION, FROM_COUNTS, CONFLICT = "AE_ARMN_FROM_METADATA_ROW", "AE_ARMN_FROM_HEADER_N", "AE_ARMN_FROM_FRACTION_DENOMINATOR", "AE_ARMN_FROM_COUNT_PERCENT_INFERENCE", "AE_ARMN_REJECTED_CONFLICTING_N"


def invalid_arm(text: Column) -> Column:
    """Blank, a caption, a body system or a value axis: no treatment arm."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | words.is_caption(t) | words.is_body_system(t) | words.is_axis(t)


def ci_level(text: Column) -> Column:
    """``95% CI`` gives 95CI; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?i)(\d{2})\s*%\s*(?:ci|confidence)", 0), r"(?i)\s*%\s*(?:ci|confidence)", "CI"), F.lit(""))


def _bare(part: Column) -> Column:
    """A header part without size, format hint and footnote marks."""
    t = F.regexp_replace(part, r"(?i)[\(\[]?\s*\bn\s*=\s*\d[\d,]*\s*[\)\]]?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)(?:\bn\s*)?\(?\s*%\s*\)?\s*$", ""), r"[*†‡§¶#]+\s*$", ""))


def promoted(grid: DataFrame) -> DataFrame:
    """The grid with header rows that stand in its body taken into the header paths.

    Such a row comes before all others, has no label, and its cells are words: names of arms, severities or axes.  Where
    the grid says which tables are Unlabelled in their first row, the others are left as they are.
    """
    if "Unlabelled" in grid.columns:
        labelled = grid.filter("not Unlabelled").withColumn("HeaderPath", F.coalesce("HeaderPath", F.lit("")))
        return stored(promoted(grid.filter("Unlabelled").drop("Unlabelled"))).unionByName(labelled.drop("Unlabelled"))
    row, table = Window.partitionBy("TextTableID", "RowSeq"), Window.partitionBy("TextTableID")
    text = F.trim(F.coalesce("CellText", F.lit("")))
    worded = text.rlike(r"^\p{L}") & ~words.is_p_value(text)
    value = (F.col("Col") > 0) & (text != "")
    # Dealt by table, one shuffle serves the windows.
    cells = grid.repartition("TextTableID").withColumns({"_values": F.sum(F.when(value, 1).otherwise(0)).over(row), "_words": F.sum(F.when(value & worded, 1).otherwise(0)).over(row), "_label": F.max(F.when(F.col("Col") == 0, text)).over(row)})
    is_header = (F.col("RowClass") == "DataBody") & (F.col("_label") == "") & (F.col("_values") > 1) & (F.col("_values") == F.col("_words"))
    # The first row that is none ends them; rows are as wide as the table, so one column's order is the table's.
    cells = cells.withColumn("_first", F.coalesce(F.min(F.when(~is_header, F.col("RowSeq"))).over(table), F.lit(2**31 - 1)))
    above = F.col("RowSeq") < F.col("_first")
    down = Window.partitionBy("TextTableID", "Col")
    names = F.array_sort(F.collect_list(F.when(above & (text != ""), F.struct("RowSeq", text.alias("t")))).over(down))
    path = F.concat_ws(" > ", F.nullif(F.col("HeaderPath"), F.lit("")), F.nullif(F.array_join(F.transform(names, lambda n: n["t"]), " > "), F.lit("")))
    return cells.withColumn("HeaderPath", path).filter(~above).select(grid.columns)


def column_contexts(grid: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row per table and column: Kind (label, arm, comparison, pvalue, unresolved), Arm, HeaderN, Hint, Subtype, Context, Statistic.

    The arm is the last part of the header path that can be one; parts above it are its context, a
    severity below it the subtype.  A column without an arm takes the table's product title (titles:
    TextTableID, TitleDrug) where it is the table's only value column.
    """
    c = relops.by_distinct(grid.select("TextTableID", "Col", "HeaderPath").distinct(), ["HeaderPath"], "_h", _header_facts(F.col("HeaderPath")), of=grid)
    arm = F.col("_h.Arm")
    if titles is not None:
        c = c.withColumn("_alone", F.count(F.when(F.col("Col") > 0, 1)).over(Window.partitionBy("TextTableID")) == 1).join(titles.select("TextTableID", "TitleDrug"), "TextTableID", "left")
        arm = _titled(F.col("_alone"))
    return c.select("TextTableID", "Col", *_context(arm))


def _titled(alone: Column) -> Column:
    """The arm of a column, or the table's product title where it is the table's only value column."""
    return F.coalesce("_h.Arm", F.when(alone & (F.col("Col") > 0), F.col("TitleDrug")))


def _context(arm: Column) -> list[Column]:
    """A column's context from the facts of its header path."""
    kind = F.when(F.col("Col") == 0, "label").when(F.col("_h._compares") & F.col("_h._p"), "pvalue").when(F.col("_h._compares"), "comparison").when(arm.isNotNull(), "arm").otherwise("unresolved")
    return [kind.alias("Kind"), arm.alias("Arm"), *[F.col(f"_h.{c}").alias(c) for c in ("HeaderN", "Hint", "Subtype", "Context")], F.when(F.col("Col") > 0, F.col("_h._statistic")).alias("Statistic"), F.col("_h.Level").alias("Level")]


def _header_facts(path: Column) -> Column:
    """What a header path says by itself: Arm, HeaderN, Hint, Subtype, Context, Level, and whether and what it compares."""

    def judged(x: Column) -> Column:
        last = lambda a: F.try_element_at(a, F.lit(-1))
        statistic = words.is_statistic(x["leaf"])
        context = F.nullif(F.array_join(F.slice(x["arms"], F.lit(1), F.greatest(F.size(x["arms"]) - 1, F.lit(0))), " > "), F.lit(""))
        return F.struct(
            last(x["arms"]).alias("Arm"), last(x["sizes"]).alias("HeaderN"), words.format_hint(x["leaf"]).alias("Hint"), F.nullif(_bare(last(x["severe"])), F.lit("")).alias("Subtype"), context.alias("Context"),
            ci_level(x["leaf"]).alias("Level"), statistic.alias("_compares"), words.is_p_value(x["leaf"]).alias("_p"), F.when(statistic, words.comparison_type(x["leaf"])).alias("_statistic"),
        )

    def read(parts: Column) -> Column:
        arms = F.filter(F.transform(parts, _bare), lambda p: ~invalid_arm(p) & ~words.is_statistic(p))
        sizes = F.filter(F.transform(parts, values.header_n), lambda n: n.isNotNull())
        return F.struct(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("leaf"), arms.alias("arms"), sizes.alias("sizes"), F.filter(parts, words.is_severity).alias("severe"))

    return values.let(F.filter(F.split(F.coalesce(path, F.lit("")), " > "), lambda p: F.trim(p) != ""), lambda parts: values.let(read(parts), judged))


#: What a text says where it is its row's label.
_AS_LABEL = ("sizes", "doses", "axis", "system", "counted", "percents", "p")


def _text_facts(cell: Column) -> Column:
    """What a cell's text says by itself, as a value and as a label."""

    def read(t: Column) -> Column:
        return F.struct(
            t.alias("text"), t.rlike(r"[A-Za-z]{3}").alias("worded"), t.rlike(r"(?i)^\(?\s*(?:n\s*=\s*)?\d[\d,]*\s*\)?$").alias("whole"), t.rlike(r"(?i)^\d[\d,.]*\s*(?:mg|mcg|µg|g|mL|units?|IU)\b.*$").alias("dose"),
            F.regexp_extract(t, r"(\d*\.?\d+)\s*$", 1).try_cast("double").alias("last"), F.replace(F.regexp_extract(t, r"(\d[\d,]*)", 1), F.lit(","), F.lit("")).try_cast("int").alias("size"),
            words.is_denominator_label(t).alias("sizes"), words.is_dose_label(t).alias("doses"), words.is_axis(t).alias("axis"), words.is_body_system(t).alias("system"),
            t.rlike(r"(?i)\bnumber of\b|\bcount\b").alias("counted"), t.rlike(r"%|(?i)percent").alias("percents"), words.is_p_value(t).alias("p"),
        )

    return values.let(F.trim(F.coalesce(cell, F.lit(""))), read)


def placed(grid: DataFrame, tables: DataFrame) -> DataFrame:
    """Data cells of a stored grid with their table's document, caption and category, their column's context, their row's label, what kind of row it is, and the category that holds there.

    RowKind: denominator (label and whole numbers only), dose (label and doses), empty (a label without
    values; one that names a body system starts that category), echo (the label repeats an arm or an axis
    without values), data.
    """
    row, so_far, down = Window.partitionBy("TextTableID", "RowSeq"), Window.partitionBy("TextTableID").orderBy("RowSeq"), Window.partitionBy("TextTableID", "Col").orderBy("RowSeq")
    # Dealt by table, one shuffle serves the windows and the join, which needs no order but that of the rows.
    cells = relops.by_distinct(grid.repartition("TextTableID"), ["HeaderPath"], "_h", _header_facts(F.col("HeaderPath")), of=grid)
    cells = relops.by_distinct(cells, ["CellText"], "_t", _text_facts(F.col("CellText")), of=grid)
    text = F.col("_t.text")
    own = F.struct(text.alias("t"), *[F.col(f"_t.{f}").alias(f) for f in _AS_LABEL])
    # A row without a label in its first column takes its first descriptive cell.
    worded = F.when(F.col("_t.worded") & (F.col("Col") > 0), F.struct("Col", own.alias("own")))
    value = (F.col("Col") > 0) & (text != "")
    total = lambda c: F.sum(F.when(value & c, 1).otherwise(0)).over(row)
    p = F.max(F.when((F.col("Col") > 0) & F.col("_h._compares") & F.col("_h._p"), F.col("_t.last"))).over(row)
    # Rows are as wide as the table, so a row's last column tells how many the table has.
    cells = cells.withColumns({"_alone": F.max("Col").over(row) == 1, "first": F.max(F.when(F.col("Col") == 0, own)).over(row), "found": F.min(worded).over(row), "filled": total(F.lit(True)), "whole": total(F.col("_t.whole")), "doses": total(F.col("_t.dose")), "RowP": p})
    lone = F.coalesce("first.t", F.lit("")) == ""
    cells = cells.withColumns({"_l": F.when(lone, F.col("found.own")).otherwise(F.col("first")), "Recovered": lone & F.col("found").isNotNull()})
    says = lambda f: F.coalesce(F.col(f"_l.{f}"), F.lit(False))
    kind = (
        F.when((F.col("filled") > 0) & (F.col("whole") == F.col("filled")) & says("sizes"), "denominator")
        .when((F.col("filled") > 0) & (F.col("doses") == F.col("filled")) & says("doses"), "dose")
        .when((F.col("filled") == 0) & says("axis"), "echo")
        .when(F.col("filled") == 0, "empty")
        .otherwise("data")
    )
    cells = cells.withColumns({"RowKind": kind, "Text": text, "Label": F.col("_l.t"), "LabelCounts": says("counted"), "LabelPercents": says("percents"), "LabelP": says("p"), "_system": says("system"), "_size": F.col("_t.size")}).drop("first", "found", "filled", "whole", "doses", "_l", "_t")
    system = F.last(F.when((F.col("RowKind") == "empty") & F.col("_system"), F.col("Label")), True).over(so_far)
    cells = cells.withColumn("ParameterCategory", F.coalesce(system, "Category"))
    known = tables.select("TextTableID", "DocumentGUID", "Caption", "TableCategory", "TitleDrug", F.lit(True).alias("Known"))
    cells = cells.join(known.hint("merge"), "TextTableID", "left")
    cells = cells.select(*[c for c in cells.columns if c not in ("_h", "_alone", "TitleDrug")], *_context(_titled(F.col("_alone"))))
    size = F.when(F.col("RowKind") == "denominator", F.col("_size"))
    cells = cells.withColumns({"RowN": F.last(size, True).over(down), "DoseRegimen": F.last(F.when(F.col("RowKind") == "dose", F.nullif(F.col("Text"), F.lit(""))), True).over(down)})
    return cells.drop("_system", "_size", "Category", "HeaderPath", "CellText", "RowClass")


def suppressed(cells: DataFrame) -> DataFrame:
    """The audit of rows that give no observation: DocumentGUID, TextTableID, RowSeq, Label, Reason."""
    reason = F.when(F.col("RowKind") != "data", F.concat(F.lit("STRUCTURAL_"), F.upper("RowKind"))).when(F.coalesce("Label", F.lit("")) == "", F.lit("NO_LABEL"))
    return cells.filter("Col = 0").select("DocumentGUID", "TextTableID", "RowSeq", "Label", reason.alias("Reason")).filter("Reason is not null")


def _flag(flags: Column, more: Column) -> Column:
    return F.nullif(F.concat_ws("; ", flags, more), F.lit(""))


def arm_sizes(cells: DataFrame) -> DataFrame:
    """cells, which are read several times, with ArmN and ArmNFlag: from a denominator row above, else the header, else the cell's fraction, else the column's counts and percents.

    Where a row and the header disagree, the row's size is kept and flagged.
    """
    read = values.let(values.parse_value(F.col("Text")), lambda v: F.struct(*[v[f].alias(f) for f in ("rule", "primary", "secondary", "sample_size")]))
    cells = relops.by_distinct(cells, ["Text"], "_v", read)
    # Counts and percents are the last resort, so columns whose header has a size take no part.
    sized, open_ = cells.filter("HeaderN is not null"), cells.filter("HeaderN is null")
    pairs = open_.filter("RowKind = 'data' and Kind = 'arm' and _v.rule = 'n_pct'").select("TextTableID", "Col", F.col("_v.secondary").cast("long").alias("n"), F.col("_v.primary").cast("decimal(18,4)").alias("pct"))
    counted = subject_counts(pairs).withColumnRenamed("N", "CountN")
    rows = open_.join(counted.hint("merge"), ["TextTableID", "Col"], "left")
    rows = rows.unionByName(sized.withColumn("CountN", F.lit(None).cast(rows.schema["CountN"].dataType)))
    fraction = F.when(F.col("_v.rule").isin("frac_pct", "fraction_count"), F.col("_v.sample_size")).cast("int")
    rows = rows.withColumn("CellN", F.when(fraction > 0, fraction)).drop("_v")
    flag = (
        F.when(F.col("RowN") != F.col("HeaderN"), f"{FROM_ROW}; {CONFLICT}")
        .when(F.col("RowN").isNotNull(), FROM_ROW)
        .when(F.col("HeaderN").isNotNull(), FROM_HEADER)
        .when(F.col("CellN").isNotNull(), FROM_FRACTION)
        .when(F.col("CountN").isNotNull(), FROM_COUNTS)
    )
    return rows.withColumns({"ArmN": F.coalesce("RowN", "HeaderN", "CellN", F.col("CountN").cast("int")), "ArmNFlag": flag}).drop("RowN", "CellN", "CountN")


def caption_says(caption: Column) -> Column:
    """What a caption says of the numbers below: its hint, and whether they are percents."""
    c = F.coalesce(caption, F.lit(""))
    return F.struct(words.caption_hint(c).alias("hint"), c.rlike(r"%|(?i)percent|incidence").alias("percents"))


def contextual_value(text: Column, arm_n: Column, category: Column, hint: Column, label_counts: Column, label_percents: Column, caption: Column, p_context: Column) -> Column:
    """parse_value in its place: dashes and ``<1`` become estimates, bare numbers take the column's type, percents over 100 are rejected.

    Of the label it is asked whether it speaks of counts or percents, and caption is what caption_says() gives.
    """
    v = values.parse_value(text, arm_n)
    fields = [f.strip().split(" ")[0] for f in "rule, type, confidence, excluded, primary, secondary, secondary_type, lower, upper, bound_type, p_value, p_qualifier, unit, sample_size, flags".split(",")]

    def changed(x: Column, **new: Column) -> Column:
        return F.struct(*[(new[f].cast(kind) if f in new else x[f]).alias(f) for f, kind in zip(fields, _KINDS, strict=True)])

    null = F.lit(None)
    ae = category.isin("AdverseEvent", "Efficacy")
    counts = label_counts | F.coalesce(hint.isin("n", "N"), F.lit(False))
    percents = ~counts & F.coalesce(hint.contains("%") | label_percents | caption["percents"], F.lit(False))
    estimate = F.when(arm_n > 0, F.bround(F.lit(100.0) / arm_n, 1)).otherwise(F.lit(0.1))
    source = F.when(arm_n > 0, F.concat(F.lit("ArmN="), arm_n.cast("string"))).otherwise(F.lit("fallback=0.1"))
    under = lambda x, mark: changed(x, primary=estimate, type=F.lit("Percentage"), excluded=F.lit(False), p_value=null, p_qualifier=null, unit=F.lit("%"), rule=F.concat(x["rule"], F.lit("+lt_one_percent_context")), flags=_flag(x["flags"], F.concat(F.lit(f"PCT_DERIVED_FROM_{mark}:"), source)))
    may_estimate = (category == "AdverseEvent") | percents

    def retyped(x: Column) -> Column:
        return (
            F.when(ae & p_context, changed(x, type=F.when(x["primary"].isNotNull(), F.lit("PValue")).otherwise(x["type"]), p_value=F.coalesce(x["p_value"], x["primary"]), unit=null))
            .when(ae & may_estimate & text.rlike(r"^\s*<\s*1\s*$"), under(x, "LT_ONE"))
            .when(ae & may_estimate & (x["rule"] == "dash_placeholder"), under(x, "DASH"))
            .when(ae & (x["type"] == "Numeric") & counts, changed(x, type=F.lit("Count"), unit=null, flags=_flag(x["flags"], F.lit("COUNT_CONTEXT_PROMOTION"))))
            .when(ae & (x["type"] == "Numeric") & percents, changed(x, type=F.lit("Percentage"), unit=F.lit("%"), flags=_flag(x["flags"], F.lit("PCT_CONTEXT_PROMOTION"))))
            .otherwise(x)
        )

    def guarded(x: Column) -> Column:
        pair = (x["rule"] == "n_pct") & x["secondary"].isNotNull()
        shown = F.regexp_replace(x["primary"].cast("string"), r"\.0$", "")
        rejected = changed(
            x, primary=F.when(pair, x["secondary"]).otherwise(x["primary"]), secondary=F.when(pair, x["primary"]).otherwise(x["secondary"]), secondary_type=F.when(~pair, x["secondary_type"]),
            type=F.when(counts, F.lit("Count")).otherwise(F.lit("Numeric")), unit=null, rule=F.concat(x["rule"], F.lit("+pct_gt100_rejected")), flags=_flag(x["flags"], F.concat(F.lit("PCT_GT100_REJECTED:"), shown)),
        )
        return F.when(ae & (x["type"] == "Percentage") & (x["primary"] > 100), rejected).otherwise(x)

    def hinted(x: Column, h: Column) -> Column:
        shown = F.concat(h["type"], F.coalesce(F.concat(F.lit(" ("), h["second"], F.lit(")")), F.lit("")))
        kept = x["confidence"] * h["share"]
        bound = F.when(x["lower"].isNotNull(), F.coalesce(h["bound"], x["bound_type"])).otherwise(x["bound_type"])
        typed = changed(x, type=h["type"], confidence=kept, rule=F.concat(x["rule"], F.lit("+caption")), bound_type=bound, secondary_type=F.when(x["secondary"].isNotNull(), F.coalesce(x["secondary_type"], h["second"])).otherwise(x["secondary_type"]), flags=_flag(x["flags"], F.concat(F.lit("CAPTION_HINT:caption:"), shown)))
        name = F.lower(F.concat(F.lit("caption_"), h["type"], F.lit("_"), h["second"]))
        again = F.concat(F.lit("CAPTION_REINTERPRET:n_pct→"), h["type"], F.lit("("), h["second"], F.lit(")"))
        swapped = changed(x, primary=x["secondary"], secondary=x["primary"], type=h["type"], secondary_type=h["second"], unit=null, confidence=kept, rule=name, flags=_flag(x["flags"], again))
        numeric = F.when((x["rule"] == "n_pct") & h["second"].isNotNull(), swapped).when(x["type"] == "Numeric", typed).otherwise(x)
        return F.when(h["type"].isNotNull(), numeric).otherwise(changed(x, bound_type=bound))

    let = values.let
    return let(v, lambda a: let(retyped(a), lambda b: let(guarded(b), lambda c: let(caption["hint"], lambda h: hinted(c, h)))))


_KINDS = ("string", "string", "double", "boolean", "double", "double", "string", "double", "double", "string", "double", "string", "string", "double", "string")


def row_cells(grid: DataFrame, tables: DataFrame) -> DataFrame:
    """The placed cells of tables (TextTableID, DocumentGUID, Caption, TableCategory, TitleDrug), stored, as each of the results reads them."""
    return stored(placed_once(grid, tables))


def placed_once(grid: DataFrame, tables: DataFrame) -> DataFrame:
    """The placed cells, not stored: what a single reader doesn't ask for isn't made."""
    return placed(promoted(grid) if "Unlabelled" in grid.columns else stored(promoted(grid)), tables)


def _valued(cells: DataFrame, kind: str) -> DataFrame:
    return cells.filter(F.col("Kind") == kind).filter("Known and RowKind = 'data' and Text <> '' and coalesce(Label, '') <> '' and not (Recovered and Text = Label)")


def _base() -> list:
    name = F.trim(F.regexp_replace(F.coalesce("Label", F.lit("")), r"[*†‡§¶#]+\s*$", ""))
    return [F.col("DocumentGUID"), F.col("TextTableID"), F.col("RowSeq").alias("SourceRowSeq"), F.col("Col").alias("SourceCellSeq"), F.col("TableCategory"), name.alias("ParameterName"), "ParameterCategory"]


def observed(rows: DataFrame) -> DataFrame:
    """One observation per arm cell that has a text, of row_cells()."""
    cells = stored(_valued(arm_sizes(relops.by_distinct(rows, ["Caption"], "Says", caption_says(F.col("Caption")))), "arm"))
    v = contextual_value(F.col("Text"), F.col("ArmN"), F.col("TableCategory"), F.col("Hint"), F.col("LabelCounts"), F.col("LabelPercents"), F.col("Says"), F.col("LabelP"))
    seen = relops.by_distinct(cells, ["Text", "ArmN", "TableCategory", "Hint", "LabelCounts", "LabelPercents", "LabelP", "Says"], "v", v)
    parsed = [F.col(f"v.{s}").alias(n) for s, n in (("primary", "PrimaryValue"), ("type", "PrimaryValueType"), ("secondary", "SecondaryValue"), ("secondary_type", "SecondaryValueType"), ("lower", "LowerBound"), ("upper", "UpperBound"), ("unit", "Unit"), ("rule", "ParseRule"), ("confidence", "ParseConfidence"))]
    flags = F.nullif(F.concat_ws("; ", "v.flags", "ArmNFlag", F.when(F.col("Recovered"), "LABEL_RECOVERED")), F.lit("")).alias("ValidationFlags")
    return seen.filter("not v.excluded").select(*_base(), F.col("Subtype").alias("ParameterSubtype"), F.col("Arm").alias("TreatmentArm"), "ArmN", F.col("Context").alias("StudyContext"), "DoseRegimen", *parsed, F.coalesce("v.p_value", "RowP").alias("PValue"), "Footnotes", flags)


def comparisons(rows: DataFrame) -> DataFrame:
    """The cells of statistic columns of row_cells(), each once, with the row's p-value."""
    cells = stored(_valued(rows, "comparison").select("DocumentGUID", "TextTableID", "RowSeq", "Col", "TableCategory", "Label", "ParameterCategory", "Statistic", "Level", "Text", "RowP"))
    compared = relops.by_distinct(cells, ["Text"], "v", values.parse_value(F.col("Text"))).filter("not v.excluded")
    bound = F.when(F.col("v.lower").isNotNull(), F.coalesce("Level", F.lit("95CI"))).alias("BoundType")
    compared = compared.select(*_base(), F.lit("Comparison").alias("TreatmentArm"), F.col("Statistic").alias("PrimaryValueType"), F.col("v.primary").alias("PrimaryValue"), F.col("v.lower").alias("LowerBound"), F.col("v.upper").alias("UpperBound"), bound, F.col("RowP").alias("PValue"))
    same = Window.partitionBy("TextTableID", "ParameterName", "PrimaryValueType", "PrimaryValue", "LowerBound", "UpperBound").orderBy("SourceRowSeq", "SourceCellSeq")
    return compared.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").drop("_nth")


def observations(grid: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, comparisons, audit) of tables from their grid; the audit holds the rows that gave none."""
    rows = row_cells(grid, tables)
    return observed(rows), comparisons(rows), suppressed(rows)
