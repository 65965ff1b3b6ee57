"""Standardisation passes on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import mlqc, quality, standardize
from tessera.plans.registry import query
from tessera.session import table

_ARM = "CASE p_partkey % 6 WHEN 0 THEN concat('Drug A (N=', cast(p_size + 1 AS {t}), ')') WHEN 1 THEN concat('n = ', cast(p_size + 1 AS {t})) WHEN 2 THEN 'n (%)' WHEN 3 THEN 'Grade 3' WHEN 4 THEN concat(cast(p_size + 1 AS {t}), ' mg') ELSE 'Drug B' END"


@query("standardise_arms", f"""WITH a AS (SELECT p_partkey k, p_size, {_ARM.format(t='VARCHAR')} arm, CASE p_partkey % 4 WHEN 0 THEN 'Drug C' WHEN 1 THEN 'Adverse reactions' END ctx FROM part),
b AS (SELECT k, CASE k % 6 WHEN 0 THEN 'Drug A' WHEN 5 THEN 'Drug B' ELSE CASE WHEN ctx = 'Drug C' THEN ctx END END a1, CASE WHEN k % 6 IN (0, 5) THEN ctx ELSE CASE WHEN ctx <> 'Drug C' THEN ctx END END c1,
  CASE WHEN k % 6 IN (0, 1) THEN p_size + 1 END n, CASE k % 6 WHEN 4 THEN arm END d, CASE k % 6 WHEN 3 THEN arm END s, ['COL_STD:ARM_BRACKET_N','COL_STD:ARM_WAS_N','COL_STD:ARM_WAS_FMT','COL_STD:ARM_WAS_SEVERITY','COL_STD:ARM_WAS_DOSE',NULL][k % 6 + 1] f FROM a)
SELECT k, a1 arm, CASE WHEN c1 <> 'Adverse reactions' THEN c1 END ctx, coalesce(n, 0) n, d regimen, s subtype, concat_ws(';', f, CASE WHEN c1 = 'Adverse reactions' THEN 'COL_STD:CTX_WAS_DESC' END) flags FROM b""")  # fmt: skip
def standardise_arms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_ARM.format(t="STRING")).alias("TreatmentArm"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Drug C' WHEN 1 THEN 'Adverse reactions' END").alias("StudyContext"), F.lit(None).cast("int").alias("ArmN"), F.lit(None).cast("string").alias("DoseRegimen"), F.lit(None).cast("string").alias("ParameterSubtype"))
    r = standardize.arms_and_contexts(p, ["Drug A", "Drug B", "Drug C"])
    return r.select("k", F.col("TreatmentArm").alias("arm"), F.col("StudyContext").alias("ctx"), F.coalesce("ArmN", F.lit(0)).alias("n"), F.col("DoseRegimen").alias("regimen"), F.col("ParameterSubtype").alias("subtype"), F.col("Flags").alias("flags"))


@query("standardise_terms", """WITH t AS (SELECT p_partkey k, CASE p_partkey % 5 WHEN 0 THEN 'HEADACHE*' WHEN 1 THEN 'total' WHEN 2 THEN 'skin  Rash' WHEN 3 THEN 'Unknown thing' ELSE 'nausea' END nm, CASE WHEN p_partkey % 2 = 0 THEN 'Skin and subcutaneous tissue disorders' END cat FROM part),
u AS (SELECT *, CASE k % 5 WHEN 0 THEN 'Headache' WHEN 2 THEN 'Skin rash' WHEN 3 THEN 'Unknown thing' WHEN 4 THEN 'Nausea' END cn, CASE k % 5 WHEN 0 THEN 'Nervous system disorders' WHEN 2 THEN 'Skin and subcutaneous tissue disorders' WHEN 4 THEN 'Gastrointestinal disorders' END sy FROM t WHERE k % 5 <> 1)
SELECT k, cn name, coalesce(sy, cat) category, concat_ws(';', CASE WHEN cn <> nm THEN 'AE_STD:NAME' END, CASE WHEN sy IS NOT NULL AND sy IS DISTINCT FROM cat THEN 'AE_STD:SOC' END, CASE WHEN coalesce(sy, cat) IS NULL THEN 'AE_STD:SOC_UNMAPPED' END) flags FROM u""")  # fmt: skip
def standardise_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr("CASE p_partkey % 5 WHEN 0 THEN 'HEADACHE*' WHEN 1 THEN 'total' WHEN 2 THEN 'skin  Rash' WHEN 3 THEN 'Unknown thing' ELSE 'nausea' END").alias("ParameterName"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'Skin and subcutaneous tissue disorders' END").alias("ParameterCategory"))
    return standardize.standardise_terms(p).select("k", F.col("ParameterName").alias("name"), F.col("ParameterCategory").alias("category"), F.col("StdFlags").alias("flags"))


@query("unit_votes", """WITH t AS (SELECT p_partkey k, p_brand tb, p_type nm, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'mg' ELSE 'ng' END u FROM part),
v AS (SELECT tb, nm, u, count(*) n, sum(count(*)) OVER (PARTITION BY tb, nm) al FROM t WHERE u IS NOT NULL GROUP BY 1, 2, 3)
SELECT k, coalesce(t.u, v.u) unit, t.u IS NULL AND v.u IS NOT NULL voted FROM t LEFT JOIN v ON v.tb = t.tb AND v.nm = t.nm AND v.n * 2 > v.al""")  # fmt: skip
def unit_votes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("TextTableID"), F.col("p_type").alias("ParameterName"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'mg' ELSE 'ng' END").alias("Unit"))
    return standardize.vote_units(p).select("k", F.col("Unit").alias("unit"), F.col("UnitVoted").alias("voted"))


@query("table_routing", """SELECT p_partkey k, CASE p_partkey % 5 WHEN 0 THEN 'PK' WHEN 1 THEN 'AdverseEvent' WHEN 2 THEN 'DrugInteraction' WHEN 3 THEN 'Efficacy' ELSE 'SKIP' END category FROM part""")
def table_routing(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    code = F.expr("CASE p_partkey % 5 WHEN 0 THEN '34090-1' WHEN 2 THEN '34084-4' END")
    caption = F.expr("CASE p_partkey % 5 WHEN 1 THEN 'Table 2: Adverse Reactions' WHEN 2 THEN 'Effect of coadministered drugs' WHEN 3 THEN 'Overall survival' ELSE 'Table' END")
    return p.select(F.col("p_partkey").alias("k"), standardize.route(code, caption).alias("category"))


#: Share of rows whose category is planted wrong, as one of so many.
PLANTED = 25


@query("ml_quality_check")
def ml_quality_check(spark, sf_dir):
    """Text classifiers learn categories from one half of the documents each and check the other half, so all are checked.

    The category is the document's language, and one of PLANTED rows, by a hash of its id, carries another one: those have to
    be suggested.  Rows without a text or a category take no part.
    """
    docs = table(spark, sf_dir, "documents").filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    wrong = F.crc32(F.concat(F.lit("planted"), F.col("doc_id").cast("string"))) % PLANTED == 0
    other = F.element_at(F.array_except(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.array("lang")), 1)
    p = docs.select("doc_id", "text", F.when(wrong, other).otherwise(F.col("lang")).alias("category"), wrong.alias("planted"))
    halves = [p.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == i) for i in (0, 1)]
    checked = [mlqc.check(mlqc.fit(halves[1 - i], "text", "category"), halves[i], "text", "category") for i in (0, 1)]
    return checked[0].unionByName(checked[1]).select("doc_id", "category", "planted", "predicted", F.round("confidence", 4).alias("confidence"), "suggested")


@query("subject_counts", """WITH c AS (SELECT l_suppkey a, l_linenumber b, CAST(l_quantity AS BIGINT) n, 100 + l_suppkey % 300 m FROM lineitem), t AS (SELECT *, (2000 * n + m) // (2 * m) t FROM c WHERE n > 0)
SELECT a "TextTableID", b "Col", max(greatest(n, 2000 * n // (2 * t + 1) + 1)) "N" FROM t WHERE t > 0 GROUP BY 1, 2 HAVING count(*) >= 3 AND max(greatest(n, 2000 * n // (2 * t + 1) + 1)) = min(2000 * n // (2 * t - 1))""")
def subject_counts(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey TextTableID", "l_linenumber Col", "cast(l_quantity as bigint) n", "100 + l_suppkey % 300 m")
    return standardize.subject_counts(cells.selectExpr("TextTableID", "Col", "n", "cast((2000 * n + m) div (2 * m) as decimal(18,1)) / 10 pct"))


_CAPTIONS = "element_at(array('Arithmetic means of', 'Geometric mean of', 'LS mean change in', 'Least-squares means of', 'Median time to', 'Hazard of', 'Odds of', 'Share of'), cast(p_partkey % 8 as int) + 1)"
_SQL_CAPTIONS = "['Arithmetic means of', 'Geometric mean of', 'LS mean change in', 'Least-squares means of', 'Median time to', 'Hazard of', 'Odds of', 'Share of'][p_partkey % 8 + 1]"


@query("value_types", f"""WITH c AS (SELECT p_partkey k, lower({_SQL_CAPTIONS} || ' ' || p_name) c, ['AdverseEvent', 'PK', 'DrugInteraction', 'Efficacy'][p_size % 4 + 1] g, CASE WHEN p_size % 3 = 0 THEN '%' WHEN p_size % 3 = 1 THEN 'mg' END u, p_retailprice v, CASE WHEN p_size % 5 = 0 THEN p_size::DOUBLE END low FROM part)
SELECT k, CASE WHEN contains(c, 'arithmetic') THEN 'ArithmeticMean' WHEN contains(c, 'geometric') THEN 'GeometricMean' WHEN regexp_matches(c, '\\bls\\b|least.squares?') THEN 'LSMean' WHEN contains(c, 'median') THEN 'Median' ELSE 'ArithmeticMean' END mean_type,
 CASE WHEN g IN ('PK', 'DrugInteraction') THEN CASE WHEN contains(c, 'geometric') THEN 'GeometricMean' ELSE 'ArithmeticMean' END WHEN contains(c, 'hazard') THEN 'HazardRatio' WHEN contains(c, 'odds') THEN 'OddsRatio' ELSE 'RelativeRisk' END risk_type,
 CASE WHEN g = 'AdverseEvent' AND u = '%' THEN 'Percentage' WHEN g = 'AdverseEvent' AND u IS NULL AND v = floor(v) THEN 'Count' WHEN g = 'PK' THEN 'ArithmeticMean' WHEN g = 'DrugInteraction' THEN 'GeometricMeanRatio' WHEN g = 'Efficacy' AND low IS NOT NULL THEN 'HazardRatio' END numeric_type FROM c""")  # fmt: skip
def value_types(spark, sf_dir):
    """What a mean, a risk and a bare number are, by caption and category."""
    p = table(spark, sf_dir, "part")
    caption = F.concat_ws(" ", F.expr(_CAPTIONS), "p_name")
    category = F.expr("element_at(array('AdverseEvent', 'PK', 'DrugInteraction', 'Efficacy'), cast(p_size % 4 as int) + 1)")
    unit = F.expr("case when p_size % 3 = 0 then '%' when p_size % 3 = 1 then 'mg' end")
    low = F.expr("case when p_size % 5 = 0 then cast(p_size as double) end")
    return p.select(F.col("p_partkey").alias("k"), standardize.mean_type(caption).alias("mean_type"), standardize.risk_type(category, caption).alias("risk_type"), standardize.numeric_type(category, unit, F.col("p_retailprice"), low, F.lit(None).cast("double")).alias("numeric_type"))


@query("observation_quality", """WITH c AS (SELECT l_orderkey o, l_linenumber n, CASE WHEN l_quantity > 5 THEN l_quantity END v, CASE l_returnflag WHEN 'A' THEN 'Text' WHEN 'N' THEN 'Percentage' END t, CASE WHEN l_linestatus = 'O' THEN 'AdverseEvent' END g, CASE WHEN l_linenumber < 6 THEN 'name' END m, 20 - l_quantity low FROM lineitem)
SELECT o, n, ((v IS NOT NULL)::INT + (t IS NOT NULL)::INT + (g IS NOT NULL)::INT + (m IS NOT NULL)::INT) / 4.0::DOUBLE completeness,
 round(least(0.9::DOUBLE, CASE WHEN v IS NULL THEN 0.2::DOUBLE ELSE 1 END * CASE WHEN t IS NULL THEN 0.2::DOUBLE ELSE 1 END * CASE WHEN t = 'Text' THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN g IS NULL THEN 0.4::DOUBLE ELSE 1 END * CASE WHEN m IS NULL THEN 0.3::DOUBLE ELSE 1 END
  * CASE WHEN v IS NULL OR m IS NULL THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN low < 0 THEN 0.7::DOUBLE ELSE 1 END), 9) parse_quality FROM c""")  # fmt: skip
def observation_quality(spark, sf_dir):
    """The share of fields that are there, and the product of penalties for what is missing or odd."""
    li = table(spark, sf_dir, "lineitem")
    v, t = F.when(F.col("l_quantity") > 5, F.col("l_quantity")), F.expr("case l_returnflag when 'A' then 'Text' when 'N' then 'Percentage' end")
    g, m = F.when(F.col("l_linestatus") == "O", "AdverseEvent"), F.when(F.col("l_linenumber") < 6, "name")
    q = quality.parse_quality(v, t, g, m, v.isNull() | m.isNull(), 20 - F.col("l_quantity"), F.lit(0.9))
    return li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), quality.completeness([v, t, g, m]).alias("completeness"), F.round(q, 9).alias("parse_quality"))
