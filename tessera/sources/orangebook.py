"""Readers of the approval lists: tilde-delimited products, patents and exclusivities, and use codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of each file, in order.
COLUMNS = {
    "products": ("Ingredient", "DFRoute", "TradeName", "Applicant", "Strength", "ApplType", "ApplNo", "ProductNo", "TECode", "ApprovalDateText", "RLD", "RS", "Type", "ApplicantFullName"),
    "patent": ("ApplType", "ApplNo", "ProductNo", "PatentNo", "PatentExpireDateText", "DrugSubstanceFlag", "DrugProductFlag", "PatentUseCode", "DelistFlag", "SubmissionDateText"),
    "exclusivity": ("ApplType", "ApplNo", "ProductNo", "ExclusivityCode", "ExclusivityDateText"),
}
PREMARKET = "approved prior to jan 1, 1982"


def split_lines(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a text column ``value``: the header and blank lines go, lines with another number of fields are rejected."""
    names = COLUMNS[kind]
    text = lines.select(F.regexp_replace("value", r"\r$", "").alias("value")).filter(F.trim("value") != "")
    parts = text.withColumn("p", F.split("value", "~", -1)).filter(~F.lower(F.trim(F.col("p")[0])).isin("ingredient", "appl_type"))
    good = parts.filter(F.size("p") == len(names)).select(*[F.nullif(F.trim(F.col("p")[i]), F.lit("")).alias(n) for i, n in enumerate(names)])
    return good, parts.filter(F.size("p") != len(names)).select("value")


def read(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    return split_lines(spark.read.text(path), kind)


def date(text: Column) -> Column:
    """Apr 12, 2023; other texts, as that of old approvals, give null."""
    return F.try_to_date(F.trim(text), "MMM d, yyyy")


def form_and_route(text: Column) -> tuple[Column, Column]:
    """Parted at the last semicolon; blank parts are null."""
    has = text.contains(";")
    part = lambda g: F.nullif(F.trim(F.regexp_extract(text, r"^(.*);([^;]*)$", g)), F.lit(""))
    return F.when(has, part(1)).otherwise(F.nullif(F.trim(text), F.lit(""))), F.when(has, part(2))


def yes(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "yes", F.lit(False))


def flag(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)) == "Y", F.lit(False))


def products(rows: DataFrame) -> DataFrame:
    form, route = form_and_route(F.col("DFRoute"))
    return rows.select("Ingredient", form.alias("DosageForm"), route.alias("Route"), "TradeName", "Applicant", "ApplicantFullName", "Strength", "ApplType", "ApplNo", "ProductNo", "TECode", "Type", date(F.col("ApprovalDateText")).alias("ApprovalDate"), F.coalesce(F.lower(F.trim("ApprovalDateText")) == PREMARKET, F.lit(False)).alias("ApprovalDateIsPremarket"), yes(F.col("RLD")).alias("IsRLD"), yes(F.col("RS")).alias("IsRS"))


def patents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Patents with their product's key; those of unknown products keep a null one."""
    keys = known.select("ApplType", "ApplNo", "ProductNo", F.concat_ws("-", "ApplType", "ApplNo", "ProductNo").alias("ProductKey"))
    made = rows.select("ApplType", "ApplNo", "ProductNo", "PatentNo", date(F.col("PatentExpireDateText")).alias("PatentExpireDate"), flag(F.col("DrugSubstanceFlag")).alias("IsDrugSubstance"), flag(F.col("DrugProductFlag")).alias("IsDrugProduct"), "PatentUseCode", flag(F.col("DelistFlag")).alias("IsDelisted"), date(F.col("SubmissionDateText")).alias("SubmissionDate"))
    return made.join(keys, ["ApplType", "ApplNo", "ProductNo"], "left")


def exclusivities(rows: DataFrame, known: DataFrame) -> DataFrame:
    keys = known.select("ApplType", "ApplNo", "ProductNo", F.concat_ws("-", "ApplType", "ApplNo", "ProductNo").alias("ProductKey"))
    return rows.select("ApplType", "ApplNo", "ProductNo", "ExclusivityCode", date(F.col("ExclusivityDateText")).alias("ExclusivityDate")).join(keys, ["ApplType", "ApplNo", "ProductNo"], "left")


def use_codes(spark: SparkSession, path: str) -> DataFrame:
    """Patent use codes and definitions from a JSON array."""
    return spark.read.schema("Code string, Definition string").json(path, multiLine=True)
