"""Standardisation of observations: misplaced arms and contexts, value types, body systems, table routing.

Each pass is an ordered CASE over struct values, so all rules stay native and their order is explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import values

# Words that describe formats, severities and contexts.
HINTS = r"^\s*(?:n\s*\(%\)|n\s*%|%|\(%\)|mean(?: ?\(?sd\)?)?|no\.?\s*\(%\))\s*$"
SEVERITY = r"(?i)^\s*(?:all grades?|any grade|grades?\s*[1-5](?:\s*[-–/]\s*[1-5])?|mild|moderate|severe|serious)\s*$"
DESCRIPTOR = r"(?i)^\s*(?:adverse (?:reactions?|events?)|incidence|percent(?:age)? of patients|number of patients|treatment|patients)\s*$"
ARM_N = r"(?i)^\s*[\(\[]?\s*n\s*=\s*(\d[\d,]*)\s*[\)\]]?\s*$"
WITH_N = r"(?i)^(.*?)\s*[\(\[]\s*n\s*=\s*(\d[\d,]*)\s*[\)\]]\s*$"
DOSE_ONLY = r"(?i)^\s*\d[\d,.]*\s*(?:mg|mcg|µg|g|mL|units?|IU)(?:/\w+)*(?:\s*(?:once|twice|three times)?\s*(?:daily|/day|bid|qd))?\s*$"


def is_drug(col: Column, drugs: Column) -> Column:
    """Whether a text is a known drug name; drugs: an array of lower-case names."""
    return F.coalesce(F.array_contains(drugs, F.lower(F.trim(col))), F.lit(False))


def arms_and_contexts(df: DataFrame, drugs: list[str], title_drug: str | None = None) -> DataFrame:
    """Phase 1 on TreatmentArm, StudyContext, ArmN, DoseRegimen, ParameterSubtype; Flags says what was done.

    First the bracketed number, then the first of: arm is a number of patients, a format hint, a
    severity, a dose, a bare number under a context that describes a dose; drug with dose in the arm.  Then
    always: context with a number of patients, context that is a drug, context that is a descriptor, and a format hint
    behind the arm's name, which makes a bare number in PrimaryValueType and Unit (where df has them) a percentage.
    """
    known = F.array(*[F.lit(d.lower()) for d in drugs]) if drugs else F.array().cast("array<string>")
    arm, ctx, n, dose, sub = (F.col(c) for c in ("TreatmentArm", "StudyContext", "ArmN", "DoseRegimen", "ParameterSubtype"))
    text = F.lit(None).cast("string")
    number = lambda c, pattern, g: F.replace(F.regexp_extract(c, pattern, g), F.lit(","), F.lit("")).try_cast("int")

    def state(a=arm, c=ctx, k=n, d=dose, s=sub, flag=None):
        return F.struct(a.cast("string").alias("TreatmentArm"), c.cast("string").alias("StudyContext"), k.cast("int").alias("ArmN"), d.cast("string").alias("DoseRegimen"), s.cast("string").alias("ParameterSubtype"), (F.lit(flag) if flag else text).alias("flag"))

    from_context = F.when(is_drug(ctx, known), ctx)
    kept_context = F.when(~is_drug(ctx, known), ctx)
    described, unit = dose_descriptor(ctx)
    named = F.trim(F.regexp_replace(described, r"(?i)\s+(?:tablets?|capsules?|oral solution)\s*$", ""))
    by_dose = F.when(is_drug(described, known), described).when(is_drug(named, known), named)
    bare = F.coalesce(arm.rlike(r"^\s*\d[\d,.]*\s*$"), F.lit(False)) & described.isNotNull()
    drug_dose = r"^(\S.*?)\s+(\d[\d,.]*\s*(?:mg|mcg|µg|g|mL|units?|IU)(?:/\w+)*.*)$"
    first = (
        F.when(arm.rlike(WITH_N), state(a=F.regexp_extract(arm, WITH_N, 1), k=number(arm, WITH_N, 2), flag="COL_STD:ARM_BRACKET_N"))
        .when(arm.rlike(ARM_N), state(a=from_context, c=kept_context, k=number(arm, ARM_N, 1), flag="COL_STD:ARM_WAS_N"))
        .when(arm.rlike(HINTS), state(a=from_context, c=kept_context, flag="COL_STD:ARM_WAS_FMT"))
        .when(arm.rlike(SEVERITY), state(a=from_context, c=kept_context, s=F.coalesce(sub, arm), flag="COL_STD:ARM_WAS_SEVERITY"))
        .when(arm.rlike(DOSE_ONLY), state(a=F.coalesce(from_context, by_dose, F.lit(title_drug)), c=F.when(by_dose.isNull(), kept_context), d=F.coalesce(dose, arm), flag="COL_STD:ARM_WAS_DOSE"))
        .when(bare, state(a=F.coalesce(by_dose, described), c=text, d=F.concat_ws(" ", F.trim(arm), F.concat(unit, F.lit("/day"))), flag="COL_STD:ARM_WAS_BARE_DOSE"))
        .when(dose.isNull() & arm.rlike(drug_dose) & is_drug(F.regexp_extract(arm, drug_dose, 1), known), state(a=F.regexp_extract(arm, drug_dose, 1), d=F.regexp_extract(arm, drug_dose, 2), flag="COL_STD:SPLIT_DRUG_DOSE"))
        .otherwise(state())
    )
    fields = ("TreatmentArm", "StudyContext", "ArmN", "DoseRegimen", "ParameterSubtype")
    df = df.withColumn("_1", first).withColumns({f: F.col(f"_1.{f}") for f in fields})
    second = (
        F.when(ctx.rlike(WITH_N), state(a=F.when(is_drug(arm, known), arm).otherwise(F.regexp_extract(ctx, WITH_N, 1)), c=text, k=number(ctx, WITH_N, 2), flag="COL_STD:CTX_WAS_ARM_N"))
        .when(is_drug(ctx, known) & ~is_drug(arm, known), state(a=ctx, c=text, flag="COL_STD:SWAP_ARM_CTX"))
        .when(ctx.rlike(DESCRIPTOR), state(c=text, flag="COL_STD:CTX_WAS_DESC"))
        .otherwise(state())
    )
    df = df.withColumn("_2", second).withColumns({f: F.col(f"_2.{f}") for f in fields})
    hint = r"(?i)^(.+?)\s+(n\s*\(\s*%\s*\)|%)\s*$"
    hinted = F.coalesce(arm.rlike(hint), F.lit(False))
    df = df.withColumn("_3", hinted).withColumn("TreatmentArm", F.when(hinted, F.trim(F.regexp_extract(arm, hint, 1))).otherwise(arm))
    if {"PrimaryValueType", "Unit"} <= set(df.columns):
        numeric = F.col("_3") & F.coalesce(F.col("PrimaryValueType") == "Numeric", F.lit(False))
        df = df.withColumns({"Unit": F.when(numeric, "%").otherwise(F.col("Unit")), "PrimaryValueType": F.when(numeric, "Percentage").otherwise(F.col("PrimaryValueType"))})
    return df.withColumn("Flags", F.concat_ws(";", "_1.flag", "_2.flag", F.when(F.col("_3"), "COL_STD:ARM_STRIP_PCT"))).drop("_1", "_2", "_3")


def dose_descriptor(text: Column) -> tuple[Column, Column]:
    """(drug, unit) of a context that describes a dose: a name, then ``dose`` or ``dosage``, perhaps a unit (per day) in a bracket; nulls for others."""
    bracket = F.lower(F.trim(F.regexp_extract(text, r"\(([^()]*)\)\s*$", 1)))
    unit = F.trim(F.regexp_replace(bracket, r"\s*(?:/|per)\s*day$", ""))
    body = F.trim(F.regexp_replace(text, r"\s*\([^()]*\)\s*$", ""))
    last = F.lower(F.substring_index(body, " ", -1))
    name = F.trim(F.regexp_replace(body.substr(F.lit(1), F.length(body) - F.length(last)), r"(?i)^target\s+", ""))
    fits = last.isin("dose", "dosage") & (name != "") & ((bracket == "") | unit.isin("mg", "mcg", "µg", "g"))
    return F.when(fits, name), F.when(fits, F.nullif(unit, F.lit("")))


def mean_type(caption: Column) -> Column:
    c = F.lower(F.coalesce(caption, F.lit("")))
    return F.when(c.contains("arithmetic"), "ArithmeticMean").when(c.contains("geometric"), "GeometricMean").when(c.rlike(r"\bls\b|least.squares?"), "LSMean").when(c.contains("median"), "Median").otherwise("ArithmeticMean")


def risk_type(category: Column, caption: Column) -> Column:
    c = F.lower(F.coalesce(caption, F.lit("")))
    ratio = F.when(c.contains("hazard"), "HazardRatio").when(c.contains("odds"), "OddsRatio").otherwise("RelativeRisk")
    return F.when(category.isin("PK", "DrugInteraction"), F.when(c.contains("geometric"), "GeometricMean").otherwise("ArithmeticMean")).otherwise(ratio)


def numeric_type(category: Column, unit: Column, value: Column, lower: Column, upper: Column) -> Column:
    """The type of a bare number by its category; null where it stays open."""
    return (
        F.when((category == "AdverseEvent") & (unit == "%"), "Percentage")
        .when((category == "AdverseEvent") & unit.isNull() & (value == F.floor(value)), "Count")
        .when(category == "PK", "ArithmeticMean")
        .when(category == "DrugInteraction", "GeometricMeanRatio")
        .when((category == "Efficacy") & (lower.isNotNull() | upper.isNotNull()), "HazardRatio")
    )


#: Section codes and the category of their tables.
SECTION_CATEGORY = {"34090-1": "PK", "43682-4": "PK", "34084-4": "AdverseEvent", "34092-7": "Efficacy"}


def route(code: Column, caption: Column) -> Column:
    """The category of a table: by section code, else by words of its caption; SKIP without a sign."""
    c = F.lower(F.coalesce(caption, F.lit("")))
    by_code = F.element_at(F.create_map(*[F.lit(x) for kv in SECTION_CATEGORY.items() for x in kv]), F.coalesce(code, F.lit("")))
    by_text = F.when(c.rlike("interaction|coadminist|co-administ"), "DrugInteraction").when(c.rlike("adverse|side effect"), "AdverseEvent").when(c.rlike("pharmacokinetic|cmax|auc|half-life"), "PK").when(c.rlike("efficacy|hazard|survival|response rate"), "Efficacy")
    return F.coalesce(F.when(c.rlike("coadminist|co-administ|drug interaction"), "DrugInteraction"), by_code, by_text, F.lit("SKIP"))


# Body systems with words that place a term in them, in order; names that are no terms.
SYSTEMS = (
    ("Cardiac disorders", "cardiac|myocard|arrhythm|tachycard|bradycard|palpitation"),
    ("Gastrointestinal disorders", "nausea|vomit|diarrh|constipat|abdominal|dyspepsia|stomatitis|flatulence"),
    ("Nervous system disorders", "headache|dizz|somnolence|seizure|neuropath|tremor|syncope|paresthesia"),
    ("Skin and subcutaneous tissue disorders", "rash|prurit|dermat|urticaria|alopecia|acne|eczema"),
    ("Respiratory, thoracic and mediastinal disorders", "cough|dyspn|pneumonitis|nasal|pharyng|bronch"),
    ("Infections and infestations", "infection|influenza|sinusitis|bronchitis|pneumonia|herpes"),
    ("Psychiatric disorders", "insomnia|anxiety|depress|agitation|hallucinat"),
    ("Musculoskeletal and connective tissue disorders", "arthralgia|myalgia|back pain|muscle|arthritis"),
    ("General disorders and administration site conditions", "fatigue|pyrexia|asthenia|edema|oedema|injection site|chills"),
    ("Hepatobiliary disorders", "hepat|jaundice|cholest"),
    ("Renal and urinary disorders", "renal|urinary|nephro|dysuria"),
    ("Blood and lymphatic system disorders", "anemia|anaemia|neutropenia|thrombocytop|leukopenia"),
)
NO_TERMS = ("total", "any adverse event", "any", "overall", "n", "number of patients", "other")


def term(name: Column) -> tuple[Column, Column]:
    """(canonical name or null for what is no term, body system or null)."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"<[^>]*>|[*†‡§]", ""), r"\s+", " "))
    bad = (t == "") | F.lower(t).isin(*NO_TERMS) | t.rlike(r"^[\d.,%<>≥≤ ]+$")
    clean = F.when(~bad, F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))))
    system = F.lit(None).cast("string")
    for label, words in reversed(SYSTEMS):
        system = F.when(F.lower(clean).rlike(words), label).otherwise(system)
    return clean, system


def standardise_terms(df: DataFrame) -> DataFrame:
    """ParameterName and ParameterCategory in standard forms; rows whose name is no term go; Flags says what changed."""
    clean, system = term(F.col("ParameterName"))
    rows = df.withColumns({"_n": clean, "_s": system}).filter("_n is not null")
    changed = F.concat_ws(";", F.when(F.col("_n") != F.col("ParameterName"), F.lit("AE_STD:NAME")), F.when(F.col("_s").isNotNull() & ~F.col("_s").eqNullSafe(F.col("ParameterCategory")), F.lit("AE_STD:SOC")), F.when(F.coalesce("_s", "ParameterCategory").isNull(), F.lit("AE_STD:SOC_UNMAPPED")))
    return rows.withColumns({"StdFlags": changed, "ParameterName": F.col("_n"), "ParameterCategory": F.coalesce("_s", "ParameterCategory")}).drop("_n", "_s")


def placebo_doses(df: DataFrame) -> DataFrame:
    """Placebo rows without a dose get 0 and their table's most frequent other unit (ties: the least)."""
    from pyspark.sql import Window

    from tessera.functions.stage5 import is_placebo

    placebo = is_placebo(F.col("TreatmentArm"), F.lit(None).cast("double"))
    counts = df.filter(~placebo & F.col("DoseUnit").isNotNull()).groupBy("TextTableID", F.lower("DoseUnit").alias("u")).agg(F.count(F.lit(1)).alias("n"), F.min("DoseUnit").alias("unit"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("TextTableID").orderBy(F.col("n").desc(), "u"))).filter("r = 1").select("TextTableID", "unit")
    rows = df.join(best, "TextTableID", "left")
    fill = placebo & F.col("Dose").isNull() & F.col("unit").isNotNull() & ~((F.col("TableCategory") == "AdverseEvent") & (F.col("unit") == "%"))
    return rows.withColumns({"DoseUnit": F.when(fill, F.col("unit")).otherwise(F.col("DoseUnit")), "Dose": F.when(fill, F.lit(0)).otherwise(F.col("Dose")).cast("decimal(18,6)")}).drop("unit")


def vote_units(df: DataFrame) -> DataFrame:
    """Null units of a table's parameter take the unit that more than half of its other rows have."""
    from pyspark.sql import Window

    counts = df.filter(F.col("Unit").isNotNull()).groupBy("TextTableID", "ParameterName", "Unit").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("TextTableID", "ParameterName")
    best = counts.withColumn("all", F.sum("n").over(w)).filter(F.col("n") * 2 > F.col("all")).select("TextTableID", "ParameterName", F.col("Unit").alias("voted"))
    rows = df.join(best, ["TextTableID", "ParameterName"], "left")
    return rows.withColumns({"UnitVoted": F.col("Unit").isNull() & F.col("voted").isNotNull(), "Unit": F.coalesce("Unit", "voted")}).drop("voted")


def subject_counts(cells: DataFrame) -> DataFrame:
    """The one N that all cells of a column agree on.

    cells: TextTableID, Col, n, pct.  A cell above 0 of n and p percent allows each N of at least n with
    round(100 n / N, 1) = p, half up: the whole numbers N with 100 n / (p + 0.05) < N <= 100 n / (p - 0.05).
    Three cells at least, and exactly one N left.
    """
    t = F.round(F.col("pct").cast("decimal(38,10)") * 10, 0).cast("long")
    fits = F.col("pct").cast("decimal(38,10)") * 10 == t
    rows = cells.filter((F.col("n") > 0) & (F.col("pct") > 0)).select("TextTableID", "Col", F.col("n").cast("long").alias("n"), F.when(fits, t).alias("t"))
    spans = rows.withColumns({"low": F.expr("greatest(n, n * 2000 div (2 * t + 1) + 1)"), "high": F.expr("n * 2000 div (2 * t - 1)")})
    found = spans.groupBy("TextTableID", "Col").agg(F.count(F.lit(1)).alias("cells"), F.count("t").alias("whole"), F.max("low").alias("N"), F.min("high").alias("high"))
    return found.filter("cells >= 3 and whole = cells and N = high").select("TextTableID", "Col", "N")
