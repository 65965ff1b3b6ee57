"""What the words of a printed table's headers, labels and caption say, judged by sets of word classes.

A text is split into small-letter words (percent signs and comparison signs are words); each test asks which classes
its words belong to.  So spellings, brackets and word order don't matter, and a class is extended by a word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = ("n", "%", "no", "number", "percent", "percentage", "count", "frequency", "incidence", "proportion")
PEOPLE = ("patients", "patient", "subjects", "subject", "participants", "participant")
TOPICS = ("event", "events", "reaction", "reactions", "experience", "experiences", "term", "terms", "outcome", "outcomes", "variable", "variables", "parameter", "parameters", "comparison", "soc", "meddra")
AROUND_TOPICS = ("adverse", "preferred", "system", "organ", "class", "body")
LINKS = ("of", "the", "with", "in", "and", "or", "to", "a", "s")
GRADES = ("grade", "grades")
AROUND_GRADES = ("any", "all", "ctc", "ctcae", "nci", "toxicity", "severity", "higher", "greater", ">", "≥", "i", "ii", "iii", "iv", "v")
SIZES = ("n", "size")
DOSES = ("dose", "dosage", "regimen")
SPREADS = ("range", "iqr", "interquartile", "min", "max")
#: Names of body systems, of the dictionary's system organ classes without "disorders" and of older lists.
BODY_SYSTEMS = (
    "blood and lymphatic system", "body as a whole", "cardiac", "cardiovascular", "congenital", "congenital, familial and genetic", "ear", "ear and labyrinth", "endocrine", "eye", "gastrointestinal",
    "general", "general disorders and administration site conditions", "hepatic", "hepatobiliary", "immune system", "infections and infestations", "injury, poisoning and procedural complications",
    "investigations", "metabolic and nutritional", "metabolism and nutrition", "musculoskeletal", "musculoskeletal and connective tissue", "neoplasms benign, malignant and unspecified", "nervous system",
    "ocular", "pregnancy, puerperium and perinatal", "product issues", "psychiatric", "renal and urinary", "reproductive system and breast", "respiratory", "respiratory, thoracic and mediastinal",
    "skin", "skin and appendages", "skin and subcutaneous tissue", "social circumstances", "special senses", "surgical and medical procedures", "urogenital", "vascular",
)


def words(text: Column) -> Column:
    """The words of a text in order; one that stands for no text has none."""
    t = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(">="), F.lit("≥")), F.lit("%"), F.lit(" % "))
    return F.filter(F.split(F.regexp_replace(t, "([≥>])", " $1 "), r"[^\p{L}\d%≥>]+"), lambda w: w != "")


def _bound(text: Column, judge) -> Column:
    """judge of the text's words, which are made once."""
    return F.coalesce(F.element_at(F.transform(F.array(words(text)), judge), 1), F.lit(False))


def _any(ws: Column, *classes: tuple[str, ...]) -> Column:
    return F.exists(ws, lambda w: w.isin(*[x for c in classes for x in c]))


def _all(ws: Column, *classes: tuple[str, ...]) -> Column:
    return (F.size(ws) > 0) & F.forall(ws, lambda w: w.isin(*[x for c in classes for x in c]))


def is_severity(text: Column) -> Column:
    """``Grade 3-4``, ``Any grade n (%)``, ``≥ Grade 3``, ``Any``: grades and what goes with them, and nothing else."""
    known = lambda w: w.isin(*GRADES, *AROUND_GRADES, *LINKS, "n", "%") | w.rlike(r"^\d+$")
    return _bound(text, lambda ws: (F.size(ws) > 0) & F.forall(ws, known) & (_any(ws, GRADES) | (ws == F.array(F.lit("any")))))


def is_axis(text: Column) -> Column:
    """Whether a header names what is counted or how, and no treatment; severities are axes too."""

    def judge(ws: Column) -> Column:
        first = F.try_element_at(ws, F.lit(1))
        known = _all(ws, MEASURES, PEOPLE, TOPICS, AROUND_TOPICS, LINKS) & _any(ws, MEASURES, TOPICS)
        of_people = first.isin(*MEASURES) & F.array_contains(ws, "of") & _any(ws, PEOPLE)
        return known | of_people | (first == "incidence") | ((first == "body") & (F.try_element_at(ws, F.lit(2)) == "system")) | (first == "meddra")

    return _bound(text, judge) | is_severity(text)


def is_caption(text: Column) -> Column:
    """``Table 2: ...``, or a sentence on how often adverse events occur."""
    numbered = F.coalesce(F.lower(F.trim(text)).rlike(r"^table\s+[\w-]+\s*[:.-]"), F.lit(False))
    return numbered | _bound(text, lambda ws: _any(ws, ("incidence", "frequency", "percent", "percentage")) & F.array_contains(ws, "of") & F.array_contains(ws, "adverse") & _any(ws, ("reaction", "reactions", "event", "events", "experience", "experiences")))


def is_body_system(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")
    return t.isin(*BODY_SYSTEMS) | F.regexp_replace(t, " disorders$", "").isin(*BODY_SYSTEMS)


def is_p_value(text: Column) -> Column:
    """``p``, ``P-value``, ``p value``."""
    return _bound(text, lambda ws: (ws == F.array(F.lit("p"))) | (F.array_position(ws, "p") > 0) & _any(ws, ("value", "values")) | _any(ws, ("pvalue", "pvalues")))


def is_statistic(text: Column) -> Column:
    """Whether a column compares arms: ratios, differences, reductions of risk, p-values."""
    shortened = F.coalesce(F.lower(text).rlike(r"\bor\s*\("), F.lit(False))
    named = lambda ws: _any(ws, ("ratio", "difference", "hr", "rr")) | (F.array_contains(ws, "risk") & _any(ws, ("relative", "reduction")))
    return _bound(text, named) | shortened | is_p_value(text)


def comparison_type(text: Column) -> Column:
    """The kind of comparison that a header names; a ratio of risks where it doesn't say."""

    def judge(ws: Column) -> Column:
        has = lambda *names: F.arrays_overlap(ws, F.array(*[F.lit(x) for x in names]))
        return (
            F.when(has("risk") & has("reduction"), "RelativeRiskReduction")
            .when(has("difference"), "RiskDifference")
            .when(has("hazard", "hr"), "HazardRatio")
            .when(has("odds", "or"), "OddsRatio")
            .otherwise("RelativeRisk")
        )

    return F.when(is_p_value(text), "PValue").otherwise(F.element_at(F.transform(F.array(words(text)), judge), 1))


def is_denominator_label(text: Column) -> Column:
    """``N``, ``Total N``, ``Number of patients (n)``, ``Subjects``."""
    return _bound(text, lambda ws: _all(ws, SIZES, PEOPLE, ("total", "sample", "number", "of")) & _any(ws, SIZES, PEOPLE))


def is_dose_label(text: Column) -> Column:
    return _bound(text, lambda ws: _all(ws, DOSES))


def format_hint(text: Column) -> Column:
    """What a header's end says of its cells: ``n(%)``, ``(%)`` or ``%``; null without a sign."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    lone_n = t.rlike(r"(^|[^\p{L}])n\(%\)$") | F.lower(F.coalesce(text, F.lit(""))).rlike(r"\bn\s*\(\s*%\s*\)\s*$")
    return F.when(lone_n, "n(%)").when(t.endswith("(%)"), "(%)").when(t.endswith("%"), "%")


#: A statistic's centre with the word before it, and the bracket or sign behind it.
_CENTRE = r"(?:\b(geometric|ls|squares?)\s+)?\b(mean|median)s?\b(\s+ratio)?\s*(?:\(([^)]*)\)|(?:±|\+/?-)\s*([\p{L} ]+))?"


def caption_hint(caption: Column) -> Column:
    """struct(type, second, bound, share): what a caption says of the numbers below; type is null where it says nothing.

    A centre (mean, geometric or least-squares mean, median, ratio of means) with a named dispersion behind it is sure;
    one without keeps 85 % of the confidence; a bracket of other words is no hint.  A level of limits alone gives the bound.
    """
    text = F.lower(F.coalesce(caption, F.lit("")))
    level = F.concat(F.nullif(F.regexp_extract(text, r"(\d{2})\s*%\s*ci\b", 1), F.lit("")), F.lit("CI"))

    def read(m: Column) -> Column:
        part = lambda g: F.regexp_extract(m, _CENTRE, g)
        parts = F.struct(part(1).alias("before"), part(2).alias("centre"), (part(3) != "").alias("ratio"), part(4).alias("held"), words(F.concat_ws(" ", part(4), part(5))).alias("ws"))
        return _let(parts, lambda p: _let(F.struct(*[p[k].alias(k) for k in ("centre", "ratio", "held", "ws")], _kind(p).alias("kind"), _second(p["ws"]).alias("second")), judged))

    def judged(p: Column) -> Column:
        median = p["kind"] == "Median"
        named = (p["second"].isNotNull() & ~median) | (_any(p["ws"], SPREADS) & median) | (p["ratio"] & level.isNotNull())
        share = F.when(named, 1.0).when((p["held"] == "") | p["ratio"], 0.85)
        return F.struct(p["kind"].alias("type"), F.when(~median, p["second"]).alias("second"), share.alias("share"))

    def best(found: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(found, lambda h: h["share"] == 1.0), F.lit(1)), F.try_element_at(found, F.lit(1)))

    hints = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_CENTRE), F.lit(0)), read), lambda h: h["share"].isNotNull())
    return _let(_let(hints, best), lambda one: F.struct(one["type"].alias("type"), one["second"].alias("second"), level.alias("bound"), one["share"].alias("share")))


def _kind(p: Column) -> Column:
    return F.when(p["ratio"], "Ratio").when(p["centre"] == "median", "Median").when(p["before"] == "geometric", "GeometricMean").when(p["before"] != "", "LSMean").otherwise("Mean")


def _second(ws: Column) -> Column:
    return F.when(_any(ws, ("sd", "deviation")), "SD").when(_any(ws, ("se", "error")), "SE").when(F.array_contains(ws, "cv"), "CV_Percent")


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
