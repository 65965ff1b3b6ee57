"""Entity resolution between approval lists and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Corporate suffixes with their jurisdiction, and words without weight in company names.
SUFFIXES = {"INC": "US", "CORP": "US", "LLC": "US", "CO": "US", "COMPANY": "US", "LTD": "UK", "PLC": "UK", "GMBH": "DE", "AG": "DE", "SPA": "IT", "SRL": "IT", "SL": "ES", "SAS": "FR", "BV": "NL", "NV": "NL", "SE": "EU"}
NOISE = ("PHARMACEUTICALS", "PHARMACEUTICAL", "PHARMA", "LABORATORIES", "LABS", "HEALTHCARE")
BEST = 0.67


def company(name: Column, strip_noise: bool = False) -> Column:
    """A company's name without case, punctuation, corporate suffixes and an outer THE."""
    t = F.replace(F.replace(F.upper(name), F.lit("&"), F.lit(" ")), F.lit("."), F.lit(""))
    t = F.concat(F.lit(" "), F.regexp_replace(t, "[^A-Z0-9]+", " "), F.lit(" "))
    for _ in range(2):  # suffixes may stand side by side
        t = F.regexp_replace(t, " (" + "|".join(SUFFIXES) + ") ", " ")
    if strip_noise:
        t = F.regexp_replace(t, " (" + "|".join(NOISE) + ") ", " ")
    t = F.trim(F.regexp_replace(t, " +", " "))
    return F.trim(F.regexp_replace(t, "^THE | THE$", ""))


def jurisdiction(name: Column) -> Column:
    """That of the last corporate suffix; null without one."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.replace(F.upper(name), F.lit("."), F.lit("")), "[^A-Z0-9]+", "  "), F.lit(" "))
    found = F.regexp_extract_all(t, F.lit(" (" + "|".join(SUFFIXES) + ") "), F.lit(1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.try_element_at(found, F.lit(-1)))


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: F.length(w) >= 2))


def similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """(Jaccard, share of a's tokens that b has) of token arrays; null for empty ones."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), both / F.nullif(F.size(a), F.lit(0))


def match_companies(applicants: DataFrame, organisations: DataFrame) -> DataFrame:
    """(applicant, organisation, tier, score): equal normalised names first; of the rest the best token matches, ties kept.

    Candidates share a token, so names are compared through an equality join; names of different
    jurisdictions never match.
    """
    a = applicants.select("applicant", company(F.col("applicant")).alias("ka"), jurisdiction(F.col("applicant")).alias("ja"))
    o = organisations.select("organisation", company(F.col("organisation")).alias("ko"), jurisdiction(F.col("organisation")).alias("jo"))
    agree = F.col("ja").isNull() | F.col("jo").isNull() | (F.col("ja") == F.col("jo"))
    one = a.join(o, F.col("ka") == F.col("ko")).filter(agree).select("applicant", "organisation", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    rest = a.join(one.select("applicant").distinct(), "applicant", "left_anti").withColumn("ta", tokens(F.col("ka")))
    near = o.withColumn("to", tokens(F.col("ko")))
    pairs = rest.withColumn("w", F.explode("ta")).join(near.withColumn("w", F.explode("to")), "w").drop("w").distinct()
    jaccard, contained = similarity(F.col("ta"), F.col("to"))
    scored = pairs.filter(agree).withColumn("score", F.greatest(jaccard, contained)).filter(F.col("score") >= BEST)
    best = scored.withColumn("_r", F.rank().over(Window.partitionBy("applicant").orderBy(F.col("score").desc()))).filter("_r = 1")
    return one.unionByName(best.select("applicant", "organisation", F.lit(2).alias("tier"), "score"))


def application(number: Column) -> tuple[Column, Column]:
    """(A or N, number) of an application number; nulls for other kinds."""
    t = F.upper(F.trim(number))
    kind, rest = F.regexp_extract(t, r"^(ANDA|NDA)\s*(.+)$", 1), F.regexp_extract(t, r"^(ANDA|NDA)\s*(.+)$", 2)
    return F.when(kind == "ANDA", "A").when(kind == "NDA", "N"), F.nullif(F.trim(rest), F.lit(""))


def bioequivalent_winners(labels: DataFrame, listing: DataFrame) -> DataFrame:
    """Documents that win any (ingredient, form, route) group: NDA before ANDA, then latest date, version, GUID.

    labels: DocumentGUID, ApplicationNumber, EffectiveDate, VersionNumber; listing: ApplType, ApplNo,
    Ingredient, DosageForm, Route, IsRLD, ApprovalDate, of which each application's listed drug first,
    then the earliest approval, gives the group.
    """
    kind, number = application(F.col("ApplicationNumber"))
    first = Window.partitionBy("ApplType", "ApplNo").orderBy(F.col("IsRLD").desc(), F.col("ApprovalDate").asc_nulls_last(), "Ingredient", "DosageForm", "Route")
    rep = listing.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    rows = labels.withColumns({"ApplType": kind, "ApplNo": number}).join(rep, ["ApplType", "ApplNo"])
    best = Window.partitionBy("Ingredient", "DosageForm", "Route").orderBy(F.col("ApplType").desc(), F.col("EffectiveDate").desc_nulls_last(), F.col("VersionNumber").desc_nulls_last(), "DocumentGUID")
    return rows.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select("DocumentGUID", "Ingredient", "DosageForm", "Route", "ApplType")
