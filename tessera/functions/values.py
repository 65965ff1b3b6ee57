"""The cell value grammar, doses and units, as native column expressions.

A cell is read in three steps.  It is cut at its first bracket into a head, what the bracket holds and a tail; in each,
numbers become the sign 0, which leaves a short shape such as ``0/0`` with ``0%``.  The shapes' separators decide
which rule holds, and the rule takes its fields from the list of the cell's numbers by place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DASH = "[-–—−]"
#: Unit words that stand alone, amounts that stand over others, and what they stand over.
LONE_UNITS = ("mcg", "mg", "h", "hr", "hrs", "hour", "hours", "min", "day", "days", "week", "weeks", "month", "months", "%", "%cv", "mmhg")
AMOUNTS = ("mcg", "µg", "μg", "ug", "ng", "pg", "mg", "g", "kg", "ml", "dl", "l", "iu", "u", "meq", "mosm", "mmol", "nmol", "beats")
PER_UNITS = ("ml", "dl", "l", "g", "kg", "m²", "m2", "min", "h", "hr", "day", "d")
#: Confidence by how sure a match is.
SURE, CHECKED, AMBIGUOUS, EXCLUDED, UNREAD = 1.0, 0.95, 0.9, 0.8, 0.5
_FIELDS = ("primary", "secondary", "secondary_type", "lower", "upper", "bound_type", "p_value", "p_qualifier", "unit", "sample_size", "flags")
_NUMBERS = ("primary", "secondary", "lower", "upper", "p_value", "sample_size")
#: Cells that mean no value.
EMPTY = ("N/A", "NA", "ND", "NR", "NC", "NDD")
#: How far a printed percent may be from the one that its counts give.
PCT_TOLERANCE = 1.5


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _result(rule: str, kind: str, fields: dict[str, Column], confidence: float, excluded: bool) -> Column:
    out = [F.lit(rule).alias("rule"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(excluded).alias("excluded")]
    for f in _FIELDS:
        kind_of = "double" if f in _NUMBERS else "string"
        out.append(fields.get(f, F.lit(None)).cast(kind_of).alias(f))
    return F.struct(*out)


def _short(x: Column) -> Column:
    """A number as text with one decimal at most, and none where it is whole."""
    return F.regexp_replace(x.cast("decimal(30,1)").cast("string"), r"\.0$", "")


def _share(count: Column, whole: Column) -> Column:
    """count in percent of whole, to one decimal, halves to the even digit."""
    return F.when(whole > 0, F.bround(count / whole * 100, 1)).otherwise(F.lit(0.0))


def _checked(count: Column, whole: Column, percent: Column) -> Column:
    """Whether a printed percent is that of its counts."""
    derived = _share(count, whole)
    return F.when(F.abs(derived - percent) < PCT_TOLERANCE, F.lit("PCT_CHECK:PASS")).otherwise(F.concat(F.lit("PCT_CHECK:WARN:"), _short(derived)))


def parse_value(raw: Column, arm_n: Column | None = None) -> Column:
    """struct(rule, type, confidence, excluded, primary, secondary, ..., sample_size, flags) of a cell.

    Null, blank and not-available cells are excluded, as are dash runs and single capital letters.  A
    range has its middle as value.  Percents beside counts are checked against the fraction's or the
    arm's size; ``n (<p%)`` is n in percent of the arm's size, 0.1 where that isn't known.  Limits must rise and
    sizes must not be 0.  Footnote marks may stand behind sizes and dispersions.  No rule gives the type Text.
    """
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""))
    n = F.lit(None).cast("double") if arm_n is None else arm_n.cast("double")
    # Bound in lambdas, each step is evaluated once, and the long CASE as it is instead of as generated code of its length.
    return let(F.struct(t.alias("t"), n.alias("n")), lambda x: _parsed(x["t"], x["n"]))


def _canonical(text: Column) -> Column:
    """Small letters without blanks; one sign for plus-minus, one for dashes, and ~ for a minus that belongs to the number behind it."""
    t = F.regexp_replace(F.lower(text), r"\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\+/?-", "±"), _DASH, "-")
    return F.regexp_replace(t, r"(?<![\d%.])-(?=\d)", "~")


#: A number with thousands' commas, as heads have them, and without, as lists in brackets have them.
_GROUPED, _BARE = r"~?\d+(?:,\d{3})*\.?\d*", r"~?\d+\.?\d*"


def _cut(t: Column, n: Column) -> Column:
    """Head, bracket and tail of a cell, with the footnote marks behind it and a bracket around it apart; tight: no blank begins a bracket."""
    return let(F.regexp_replace(t, r"[*†‡§¶#\s]+$", ""), lambda body: let(F.struct(body.alias("b"), F.locate("(", body).alias("o"), F.locate(")", body).alias("c"), F.length(body).alias("l")), lambda p: _parts_of(t, n, p)))


def _parts_of(t: Column, n: Column, p: Column) -> Column:
    body, opened, closed, size = (p[k] for k in ("b", "o", "c", "l"))
    wrapped = (opened == 1) & (closed == size)
    held = (opened > 0) & (closed > opened) & ~wrapped
    head = F.when(wrapped, body.substr(F.lit(2), size - 2)).when(opened > 0, body.substr(F.lit(1), opened - 1)).otherwise(body)
    inside = F.when(held, body.substr(opened + 1, closed - opened - 1)).otherwise("")
    tail = F.when(held, body.substr(closed + 1, size)).otherwise("")
    bracket = F.when(wrapped, "wrapped").when(opened > 0, "bracket").otherwise("none")
    return F.struct(t.alias("t"), n.alias("n"), _canonical(head).alias("head"), _canonical(inside).alias("inside"), _canonical(tail).alias("tail"), bracket.alias("bracket"), (size < F.length(t)).alias("marked"), (~inside.startswith(" ")).alias("tight"))


def _parsed(t: Column, n: Column) -> Column:
    signed = lambda texts: F.transform(texts, lambda x: F.replace(F.replace(x, F.lit("~"), F.lit("-")), F.lit(","), F.lit("")).try_cast("double"))

    def shaped(c: Column) -> Column:
        lists = F.concat(*[F.regexp_extract_all(c[k], F.lit(p), F.lit(0)) for k, p in (("head", _GROUPED), ("inside", _BARE), ("tail", _GROUPED))])
        shape = [F.regexp_replace(c[k], p, "0").alias(s) for k, p, s in (("head", _GROUPED, "h"), ("inside", _BARE, "i"), ("tail", _GROUPED, "r"))]
        return let(lists, lambda texts: F.struct(c["t"].alias("t"), c["n"].alias("n"), c["bracket"].alias("bracket"), c["marked"].alias("marked"), c["tight"].alias("tight"), texts.alias("texts"), signed(texts).alias("x"), *shape))

    return let(_cut(t, n), lambda c: let(shaped(c), _decided))


def _unit_like(text: Column) -> Column:
    """Whether a text is a lone unit, or an amount (perhaps times hours) over one or two others."""

    def judge(words: Column) -> Column:
        over = F.split(F.element_at(words, 1), "[·*]")
        amount = F.element_at(over, 1).isin(*AMOUNTS) & ((F.size(over) == 1) | ((F.size(over) == 2) & F.try_element_at(over, F.lit(2)).isin("h", "hr")))
        per = F.forall(F.slice(words, 2, 9), lambda w: w.isin(*PER_UNITS))
        return F.when(F.size(words) == 1, words[0].isin(*LONE_UNITS)).otherwise(amount & per & (F.size(words) <= 3))

    return let(F.split(F.lower(text), "/"), judge)


def _decided(c: Column) -> Column:
    """The result of a cell by its shapes; x holds its numbers by place."""
    t, n, h, i, r, x = (c[k] for k in ("t", "n", "h", "i", "r", "x"))
    at = lambda k: F.try_element_at(x, F.lit(k + 1))
    text_at = lambda k: F.coalesce(F.try_element_at(c["texts"], F.lit(k + 1)), F.lit(""))
    whole = lambda k: ~text_at(k).contains(".") & ~text_at(k).contains(",")
    no_point = lambda k: ~text_at(k).contains(".")
    plus = ~F.exists(c["texts"], lambda v: v.startswith("~"))
    clean, bare = ~c["marked"], c["bracket"] == "none"
    held = (c["bracket"] == "bracket") & (r == "")
    band = F.replace(i, F.lit("%"), F.lit(""))
    one, share = h == "0", i.isin("0", "0%")
    out = F.when(t.rlike(rf"^{_DASH}+$"), _result("dash_placeholder", "Text", {}, EXCLUDED, True)).when((t == "") | F.upper(t).isin(*EMPTY), _result("empty_or_na", "Text", {}, EXCLUDED, True))
    out = out.when(t.rlike(r"^\p{Lu}$"), _result("letter_code", "CodedExclusion", {}, SURE, True))

    def rule(name: str, fits: Column, kind: str, confidence: float, **fields: Column) -> None:
        nonlocal out
        out = out.when(F.coalesce(fits, F.lit(False)), _result(name, kind, fields, confidence, False))

    lit, sd = F.lit, {"primary": at(0), "secondary": at(1), "lower": at(0) - at(1), "upper": at(0) + at(1)}
    counts = {"primary": at(2), "secondary": at(0), "secondary_type": lit("Count"), "sample_size": at(1), "unit": lit("%")}
    rule("frac_pct", clean & held & c["tight"] & plus & (h == "0/0") & share & whole(0) & whole(1), "Percentage", SURE, **counts, flags=_checked(at(0), at(1), at(2)))
    rule("fraction_count", clean & (bare | held) & plus & (h == "0/0") & no_point(0) & no_point(1) & (at(1) > 0), "Count", SURE, primary=at(0), secondary=at(1), secondary_type=lit("Denominator"), sample_size=at(1))
    rule("n_pct", clean & held & c["tight"] & plus & one & share & whole(0), "Percentage", SURE, primary=at(1), secondary=at(0), secondary_type=lit("Count"), unit=lit("%"), flags=F.when(n > 0, _checked(at(0), n, at(1))))
    source = F.when(n > 0, F.concat(lit("ArmN="), n.cast("long").cast("string"))).otherwise(lit("fallback=0.1"))
    shown = F.regexp_replace(at(1).cast("string"), r"\.0$", "")
    under = F.concat(lit("INEQUALITY_UPPER:"), F.substring(i, 1, 1), lit("; PCT_DERIVED_FROM_COUNT_LT:"), source, lit("; PCT_LT_DISPLAY:"), shown)
    least = F.when(n > 0, F.bround(at(0) / n * 100, 1)).otherwise(lit(0.1))
    rule("count_inequality_percent", clean & held & plus & one & band.isin("<0", "≤0"), "Percentage", SURE, primary=least, secondary=at(0), secondary_type=lit("Count"), unit=lit("%"), flags=under)
    limits = {"primary": at(0), "lower": at(1), "upper": at(2)}
    rule("rr_ci", clean & held & plus & h.isin("0", "0%") & (band == "0,0"), "RelativeRiskReduction", SURE, **limits, bound_type=lit("95CI"), unit=lit("%"))
    rule("diff_ci", clean & held & one & (i == "0,0"), "RiskDifference", SURE, **limits, bound_type=lit("95CI"), unit=lit("pp"))
    rule("value_ci", clean & held & one & i.isin("0-0", "0to0") & (at(1) < at(2)), "Numeric", CHECKED, **limits, bound_type=lit("CI"))
    rule("value_plusminus", clean & bare & (h == "0±0"), "Numeric", CHECKED, **sd, secondary_type=lit("SD"), bound_type=lit("SD"))
    rule("value_plusminus_sample", clean & (c["bracket"] == "bracket") & one & (i == "±0") & r.isin("", "(n=0)"), "Numeric", CHECKED, **sd, sample_size=at(2))
    rule("value_cv", (c["bracket"] == "bracket") & c["tight"] & plus & one & (i == "0%") & whole(1), "Mean", SURE, primary=at(0), secondary=at(1), secondary_type=lit("CV_Percent"))
    rule("value_paren_dispersion", held & one & (i == "0") & text_at(0).contains("."), "Numeric", CHECKED, **sd)
    rule("range_to", plus & h.startswith("0to0"), "Range", AMBIGUOUS, primary=(at(0) + at(1)) / 2, lower=at(0), upper=at(1), bound_type=lit("Range"))
    rule("percentage", clean & bare & plus & (h == "0%"), "Percentage", SURE, primary=at(0), unit=lit("%"))
    rule("inequality_percent", clean & bare & plus & h.isin("<0%", "≤0%"), "Percentage", SURE, primary=at(0), unit=lit("%"), flags=F.concat(lit("INEQUALITY_UPPER:"), F.substring(h, 1, 1)))
    rule("n_equals", (c["bracket"] != "bracket") & plus & (h == "n=0") & no_point(0) & (at(0) > 0), "SampleSize", SURE, primary=at(0), sample_size=at(0))
    sign = F.substring(F.regexp_replace(h, "^p", ""), 1, 1)
    rule("pvalue", clean & bare & plus & F.concat(sign, lit("0")).eqNullSafe(F.regexp_replace(h, "^p", "")) & sign.isin("<", ">", "=", "≤", "≥"), "PValue", SURE, primary=at(0), p_qualifier=sign, p_value=at(0))
    unit = F.regexp_extract(t, r"\d\.?\s+(\S+)$", 1)
    rule("value_trailing_unit", clean & bare & h.rlike("^0[^0]") & (unit != "") & _unit_like(unit) & (F.size(c["texts"]) <= 2), "Numeric", CHECKED, primary=at(0), unit=normalise_unit(unit))
    rule("plain_number", clean & bare & one, "Numeric", AMBIGUOUS, primary=at(0))
    return out.otherwise(_result("text_descriptive", "Text", {}, UNREAD, False))


#: Spellings of units; days are shortened behind a stroke only.
UNITS = {"µg": "mcg", "μg": "mcg", "ug": "mcg", "units": "U", "unit": "U", "hrs": "h", "hr": "h", "hours": "h", "hour": "h"}


def normalise_unit(col: Column) -> Column:
    """Footnote marks go; micrograms, hours, per-day forms and units have one spelling, wherever they stand in a chain."""
    u = F.trim(F.regexp_replace(col, r"[*†‡§]+", ""))
    for k, v in UNITS.items():
        u = F.regexp_replace(u, rf"(?i)(?<![a-z]){k}(?![a-z])", v)
    return F.regexp_replace(F.regexp_replace(u, r"(?i)/\s*day(?![a-z])", "/d"), r"/\s+", "/")


_DOSE = r"(\d[\d,]*\.?\d*)\s*(mg|mcg|µg|g|mL|U|units|IU)((?:/(?:kg|m2|day|d|h|hr))*)"


def dose(text: Column) -> tuple[Column, Column]:
    """(amount, unit); of a range the high end; null for texts without a digit or of any dose."""
    t = F.regexp_replace(text, r"[*†‡§]", "")
    none = ~t.rlike(r"\d") | F.lower(t).rlike(r"\b(any|all) doses?\b")
    high = rf"\d[\d,]*\.?\d*\s*(?:to|–|-)\s*{_DOSE}"
    is_range = t.rlike(high)
    pick = lambda g: F.when(is_range, F.regexp_extract(t, high, g)).otherwise(F.regexp_extract(t, _DOSE, g))
    amount, unit = pick(1), F.concat(pick(2), pick(3))
    daily = t.rlike(r"(?i)(once daily|daily|per day|qd\b)") & ~unit.contains("/d")
    unit = F.when(daily, F.concat(unit, F.lit("/d"))).otherwise(unit)
    return F.when(~none & (amount != ""), number(amount)), F.when(~none & (amount != ""), normalise_unit(unit))


def header_n(text: Column) -> Column:
    """The number in (N = 12), [N=12], n=12."""
    return F.nullif(F.regexp_extract(text, r"(?i)\bn\s*=\s*(\d[\d,]*)", 1), F.lit("")).try_cast("int")


def arm_name(text: Column) -> Column:
    """An arm header without its number, format hint and trailing footnote marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)[\(\[]?\s*n\s*=\s*\d[\d,]*\s*[\)\]]?|n?\s*\(?%\)?$", ""), r"[*†‡§]+$", ""))


def strip_html(html: Column) -> Column:
    """Scripts, styles, comments and tags go; breaks and entities become characters; white space collapses."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", " "), r"<[^>]*>", "")
    for k, v in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
