"""Adverse-event queries on the driver's tables: cohorts, risks, coverage, dashboard views, correlations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import classify, stage5, stats
from tessera.functions.correlation import p_value, pair_correlations
from tessera.functions.terms import sized
from tessera.operators.relops import positions, top1_per_key
from tessera.plans.domain import TABLES, tables, with_tables
from tessera.plans.registry import query
from tessera.session import ship_package, stored, table

#: Observations laid over order lines; the text runs in Spark and in the oracle.
OBS = """select k * 10 + n as id, case when k % 97 = 0 then null else concat('doc-', cast(cast(floor(k / 70) as bigint) as string)) end as DocumentGUID, cast(k % 7 as int) as TextTableID,
 case p % 9 when 0 then ' headache ' when 1 then 'Headache' when 2 then 'NAUSEA' when 3 then 'nausea' when 4 then 'Rash' when 5 then null when 6 then 'Dizziness' else 'Fatigue' end as ParameterName,
 cast(null as string) as ParameterSubtype, case p % 9 when 4 then 'Skin disorders' when 6 then 'Nervous system disorders' else 'General disorders' end as ParameterCategory,
 case n when 1 then 'Placebo' when 2 then 'Drug A 50mg' when 3 then 'Drug A 100mg' when 4 then 'Standard of care' when 5 then 'Drug B' when 6 then 'Drug C' else ' ' end as TreatmentArm,
 case when s % 10 = 0 then null else cast(100 + s % 3 * 50 as int) end as ArmN,
 cast(case when k % 2 = 0 then case n when 2 then 50 when 3 then 100 end end as decimal(18,6)) as Dose, case when n in (2, 3) then case when s % 13 = 0 then 'mcg' else 'mg' end end as DoseUnit,
 case when q > 49 then null when f = 'N' and q > 48 then 120.0 else q end as PrimaryValue, case when f = 'R' and st = 'O' then 'Mean' when f = 'R' then 'Count' else 'Percentage' end as PrimaryValueType,
 cast(null as string) as StudyContext, case when s % 2 = 0 then 'Adults' end as Population, cast(null as string) as Subpopulation, cast(n as int) as SourceRowSeq, cast(1 as int) as SourceCellSeq from {Line}"""


#: The same, laid over 300 documents however many lines there are, so that a document's part and its cohorts grow with the input.
WIDE_OBS = OBS.replace("cast(cast(floor(k / 70) as bigint) as string)", "cast(k % 300 as string)")


def observations(spark, sf_dir, sql=OBS, line=None):
    line = line or spark.sql(TABLES["Line"], lineitem=table(spark, sf_dir, "lineitem"))
    return spark.sql(sql, Line=line)


_OBS = with_tables("Line") + f", obs AS ({OBS.replace('{Line}', 'Line')})"
_NORM = "upper(regexp_replace(trim(coalesce({0}, '')), '\\s+', ' ', 'g'))"
#: From observations (obs) to risks; table_queries reads it as well.
COHORT_STEPS = f""",
elig AS (SELECT *, {_NORM.format('ParameterName')} kn, {_NORM.format('Population')} kp, {_NORM.format('TreatmentArm')} ka,
  regexp_matches(TreatmentArm, '(?i)(placebo|sham|vehicle)') OR coalesce(Dose = 0, false) pl, coalesce(Dose > 0, false) dosed,
  regexp_matches(TreatmentArm, '(?i)(control|comparator|standard of care|active control)') ctl
  FROM obs WHERE DocumentGUID IS NOT NULL AND trim(TreatmentArm) <> '' AND trim(coalesce(ParameterName, '')) <> '' AND PrimaryValue IS NOT NULL),
n1 AS (SELECT * REPLACE (CASE WHEN coalesce(ArmN > 0, false) THEN ArmN WHEN lo = hi THEN lo END AS ArmN), coalesce(lo <> hi, false) conflict FROM (
  SELECT *, min(CASE WHEN ArmN > 0 THEN ArmN END) OVER a lo, max(CASE WHEN ArmN > 0 THEN ArmN END) OVER a hi FROM elig WINDOW a AS (PARTITION BY DocumentGUID, TextTableID, kn, kp, ka))),
n2 AS (SELECT *, count(*) OVER c n_rows, count(DISTINCT ka) OVER (PARTITION BY DocumentGUID, TextTableID, kn, kp) n_arms,
   count(DISTINCT CASE WHEN ctl THEN ka END) OVER (PARTITION BY DocumentGUID, TextTableID, kn, kp) n_ctl,
   max(CASE WHEN pl THEN 1 ELSE 0 END) OVER c any_pl, min(CASE WHEN dosed THEN Dose END) OVER c low FROM n1 WINDOW c AS (PARTITION BY DocumentGUID, TextTableID, kn, kp)),
n3 AS (SELECT *, CASE WHEN n_rows <= 1 THEN 'SINGLE_ARM' WHEN any_pl = 1 THEN 'PLACEBO_COMPARATOR' WHEN low IS NOT NULL THEN 'LOW_DOSE_COMPARATOR' WHEN n_ctl = 1 THEN 'CONTROL_COMPARATOR'
   WHEN n_ctl > 1 THEN 'AMBIGUOUS_COMPARATOR' WHEN n_arms = 2 THEN 'ACTIVE_COMPARATOR' WHEN n_arms > 2 THEN 'AMBIGUOUS_COMPARATOR' ELSE 'NO_COMPARATOR' END flag FROM n2),
n4 AS (SELECT *, CASE flag WHEN 'PLACEBO_COMPARATOR' THEN pl WHEN 'LOW_DOSE_COMPARATOR' THEN coalesce(Dose = low, false) WHEN 'CONTROL_COMPARATOR' THEN ctl WHEN 'ACTIVE_COMPARATOR' THEN true ELSE false END cand FROM n3),
n5 AS (SELECT *, cand AND row_number() OVER (PARTITION BY DocumentGUID, TextTableID, kn, kp ORDER BY cand DESC, SourceRowSeq, SourceCellSeq, id) = 1 is_comp,
   first_value(DoseUnit) OVER (PARTITION BY DocumentGUID, TextTableID, kn, kp ORDER BY coalesce(Dose = low, false) DESC, SourceRowSeq, SourceCellSeq, id) ref_unit FROM n4),
comp AS (SELECT DocumentGUID, TextTableID, kn, kp, id cid, TreatmentArm carm, ArmN cn, PrimaryValue cv, PrimaryValueType ct FROM n5 WHERE is_comp),
t1 AS (SELECT n.*, c.* EXCLUDE (DocumentGUID, TextTableID, kn, kp) FROM n5 n JOIN comp c USING (DocumentGUID, TextTableID, kn, kp) WHERE NOT is_comp),
t2 AS (SELECT *, CASE WHEN PrimaryValueType <> ct THEN 'MIXED_VALUE_TYPES' WHEN PrimaryValueType = 'Percentage' AND PrimaryValue > 100 THEN 'PERCENT_OUT_OF_RANGE' WHEN PrimaryValueType = 'Percentage' AND ArmN IS NULL THEN 'NO_ARMN'
   WHEN PrimaryValueType NOT IN ('Percentage', 'Count') THEN 'UNCOMPARABLE_VALUE_TYPE' WHEN ct = 'Percentage' AND cv > 100 THEN 'PERCENT_OUT_OF_RANGE' WHEN ct = 'Percentage' AND cn IS NULL THEN 'NO_ARMN' END early,
   CASE WHEN PrimaryValueType = 'Percentage' AND PrimaryValue <= 100 THEN ArmN * PrimaryValue / 100.0 WHEN PrimaryValueType = 'Count' THEN PrimaryValue END ev, CASE WHEN ct = 'Percentage' AND cv <= 100 THEN cn * cv / 100.0 WHEN ct = 'Count' THEN cv END ec FROM t1),
t3 AS (SELECT *, coalesce(early, CASE WHEN ArmN IS NULL OR ArmN <= 0 THEN 'NO_ARMN' WHEN cn IS NULL OR cn <= 0 THEN 'NO_COMPARATOR_N' WHEN ev IS NULL OR ec IS NULL OR ev < 0 OR ec < 0 THEN 'INVALID_EVENT_COUNT' WHEN ev > ArmN OR ec > cn THEN 'EVENTS_EXCEED_ARMN' END) reason,
   CASE WHEN ev = 0 OR ec = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END h FROM t2),
t4 AS (SELECT *, CASE WHEN reason IS NULL THEN ((ev + h) / (ArmN + 2 * h)) / ((ec + h) / (cn + 2 * h)) END rr,
   CASE WHEN reason IS NULL THEN sqrt(greatest(0, 1 / (ev + h) - 1 / (ArmN + 2 * h) + 1 / (ec + h) - 1 / (cn + 2 * h))) END se FROM t3),
risk AS (SELECT *, exp(ln(rr) - 1.959963984540054 * se) lo95, exp(ln(rr) + 1.959963984540054 * se) hi95,
   CASE WHEN rr IS NOT NULL THEN CASE WHEN low IS NULL OR Dose IS NULL OR Dose <= 0 THEN 'NO_DOSE_RANGE' WHEN DoseUnit IS DISTINCT FROM ref_unit THEN 'DOSE_UNIT_MISMATCH' WHEN Dose = low THEN 'IS_REFERENCE_DOSE' END END dose_flag FROM t4)
"""
_COHORTS = _OBS + COHORT_STEPS
_WIDE_COHORTS = with_tables("Line") + f", obs AS ({WIDE_OBS.replace('{Line}', 'Line')})" + COHORT_STEPS
_NN = """, nn AS (SELECT *, ev / nullif(ArmN::DOUBLE, 0) rt, ec / nullif(cn::DOUBLE, 0) rc FROM risk WHERE rr IS NOT NULL),
sig AS (SELECT *, abs(1 / nullif(rt - rc, 0)) need, CASE WHEN rt > rc THEN 'NNH' WHEN rt < rc THEN 'NNT' END need_type,
  CASE WHEN lo95 > 1 AND hi95 > 1 THEN 'Elevated' WHEN lo95 < 1 AND hi95 < 1 THEN 'Protective' ELSE 'NotSignificant' END sg FROM nn),
prec AS (SELECT *, CASE WHEN h > 0 OR ev < 10 THEN 'Fragile' WHEN log10(hi95) - log10(lo95) >= 0.5 OR ev < 30 THEN 'Wide' ELSE 'Tight' END pr FROM sig),
tiers AS (SELECT *, CASE WHEN pr = 'Fragile' THEN 'Fragile' WHEN sg <> 'Elevated' THEN 'Reassure' WHEN pr = 'Tight' AND need <= 50 THEN 'Counsel'
   WHEN regexp_matches(lower(ParameterCategory), 'cardiac|hepatobiliary|renal|respiratory|nervous|blood|immune') OR need > 50 THEN 'Watch' ELSE 'Counsel' END tier,
   CASE WHEN pr = 'Fragile' THEN 'LowConfidence' WHEN sg = 'Elevated' THEN 'PlausiblyCausal' WHEN sg = 'Protective' THEN 'Protective' ELSE 'NotSignificantlyElevated' END verdict FROM prec)
"""


@query("ae_risk_rows", _COHORTS + """SELECT id, cid ComparatorID, flag ComparatorFlag, ev EventsTreatment, ec EventsComparator, reason Reason, round(rr, 8) RR, round(lo95, 8) RRLowerBound, round(hi95, 8) RRUpperBound,
 round(CASE WHEN rr IS NOT NULL AND dose_flag IS NULL THEN exp(ln(rr) / ln(Dose::DOUBLE / low::DOUBLE)) END, 6) DNRR,
 concat_ws(';', flag, CASE WHEN conflict THEN 'ARMN_CONFLICT' END, reason, CASE WHEN rr IS NOT NULL AND h > 0 THEN 'ZERO_CELL_CORRECTED' END, dose_flag) CalculationFlags FROM risk""")  # fmt: skip
def ae_risk_rows(spark, sf_dir):
    r = stage5.risk_rows(observations(spark, sf_dir))
    return r.select("id", "ComparatorID", "ComparatorFlag", F.when(F.col("EventsTreatment").isNotNull(), F.col("EventsTreatment")).alias("EventsTreatment"), "EventsComparator", "Reason", *[F.round(c, 8).alias(c) for c in ("RR", "RRLowerBound", "RRUpperBound")], F.round("DNRR", 6).alias("DNRR"), "CalculationFlags")


@query("ae_coverage", _COHORTS + """SELECT id, CASE WHEN DocumentGUID IS NULL THEN 'NO_DOCUMENT_GUID' WHEN trim(TreatmentArm) = '' THEN 'INVALID_TREATMENT_ARM' WHEN trim(coalesce(ParameterName, '')) = '' THEN 'STRUCTURAL_AE_ROW' ELSE 'NO_PRIMARY_VALUE' END Status
 FROM obs WHERE id NOT IN (SELECT id FROM elig)
UNION ALL SELECT id, 'COMPARATOR' FROM n5 WHERE is_comp UNION ALL SELECT id, coalesce(reason, 'RR_READY') FROM risk
UNION ALL SELECT id, flag FROM n5 WHERE NOT is_comp AND id NOT IN (SELECT id FROM risk)""")  # fmt: skip
def ae_coverage(spark, sf_dir):
    return stage5.coverage(observations(spark, sf_dir))


def signals(spark, sf_dir, sql=OBS, line=None):
    """Risk rows with number needed, significance, precision, tier and verdict.  Term is a key of the cohorts, so a filter on it comes before them."""
    r = stage5.risk_rows(observations(spark, sf_dir, sql, line)).filter("RR is not null")
    n = stage5.number_needed(F.col("EventsTreatment"), F.col("ArmN"), F.col("EventsComparator"), F.col("ComparatorN"), F.col("RRLowerBound"), F.col("RRUpperBound"))
    r = r.withColumns({"NumberNeeded": n["nn"], "NumberNeededType": n["nn_type"], "NNLower": n["nn_lower"], "NNUpper": n["nn_upper"], "RiskT": n["risk_t"], "RiskC": n["risk_c"]})
    r = r.withColumn("Significance", classify.significance_of(stats.significance(F.col("RRLowerBound"), F.col("RRUpperBound"))))
    r = r.withColumn("Precision", classify.precision(classify.flag_set(F.col("CalculationFlags")), F.col("EventsTreatment"), F.col("RRLowerBound"), F.col("RRUpperBound")))
    return r.withColumns({"Tier": classify.tier(F.col("Precision"), F.col("Significance"), F.col("NumberNeeded"), F.col("ParameterCategory")), "Verdict": classify.verdict(F.col("Precision"), F.col("Significance")), "Term": F.col("k_ParameterName")})


@query("ae_signals", _WIDE_COHORTS + _NN + """SELECT id, need_type NumberNeededType, round(need, 6) NumberNeeded, round(least(abs(1 / nullif(rc * (lo95 - 1), 0)), abs(1 / nullif(rc * (hi95 - 1), 0))), 5) NNLower, sg Significance, pr "Precision", tier Tier, verdict Verdict FROM tiers""")
def ae_signals(spark, sf_dir):
    return signals(spark, sf_dir, WIDE_OBS).select("id", "NumberNeededType", F.round("NumberNeeded", 6).alias("NumberNeeded"), F.round("NNLower", 5).alias("NNLower"), "Significance", "Precision", "Tier", "Verdict")


@query("ae_most_powered_stratum", _COHORTS + """SELECT id, DocumentGUID FROM (SELECT *, row_number() OVER (PARTITION BY DocumentGUID, kn, ParameterCategory, Dose, DoseUnit, flag, kp ORDER BY ArmN DESC NULLS LAST, cn DESC NULLS LAST, hi95 - lo95 NULLS LAST, id) rn FROM risk WHERE rr IS NOT NULL) WHERE rn = 1""")
def ae_most_powered_stratum(spark, sf_dir):
    r = stage5.risk_rows(observations(spark, sf_dir)).filter("RR is not null")
    order = [F.col("ArmN").desc_nulls_last(), F.col("ComparatorN").desc_nulls_last(), (F.col("RRUpperBound") - F.col("RRLowerBound")).asc_nulls_last(), F.col("id")]
    return top1_per_key(r, ["DocumentGUID", "k_ParameterName", "ParameterCategory", "Dose", "DoseUnit", "ComparatorFlag", "k_Population"], order).select("id", "DocumentGUID")


def _near(need):
    """A leading part of an order by numbers needed, nulls last, with a bounded number of values."""
    return F.coalesce(F.least(F.floor(need), F.lit(4096)), F.lit(4097))


@query("ae_triage", _WIDE_COHORTS + _NN + """SELECT id, tier Tier, kn Term, round(min(need) OVER (PARTITION BY tier, kn), 6) ClusterNumberNeeded, count(*) OVER (PARTITION BY tier) TierCount,
 row_number() OVER (PARTITION BY tier ORDER BY min(need) OVER (PARTITION BY tier, kn) NULLS LAST, kn, need NULLS LAST, rr DESC, id) Position FROM tiers WHERE DocumentGUID = 'doc-12'""".replace("row_number() OVER (PARTITION BY tier ORDER BY min(need) OVER (PARTITION BY tier, kn) NULLS LAST", "row_number() OVER (PARTITION BY tier ORDER BY mn NULLS LAST").replace("FROM tiers WHERE", "FROM (SELECT *, min(need) OVER (PARTITION BY tier, kn) mn FROM tiers WHERE DocumentGUID = 'doc-12') WHERE"))  # fmt: skip
def ae_triage(spark, sf_dir):
    s = signals(spark, sf_dir, WIDE_OBS).filter("DocumentGUID = 'doc-12'")
    terms = s.groupBy("Tier", "Term").agg(F.min("NumberNeeded").alias("mn"), F.count(F.lit(1)).alias("n"))
    tiers = terms.groupBy("Tier").agg(F.sum("n").alias("TierCount"))
    s = s.join(terms.drop("n"), ["Tier", "Term"]).join(tiers, "Tier")
    order = [F.col("mn").asc_nulls_last(), F.col("Term"), F.col("NumberNeeded").asc_nulls_last(), F.col("RR").desc(), F.col("id")]
    leading = [F.coalesce("mn", F.lit(float("inf"))), F.col("Term"), _near(F.col("NumberNeeded"))]
    return positions(s, leading, order, "Position", ["Tier"]).select("id", "Tier", "Term", F.round("mn", 6).alias("ClusterNumberNeeded"), "TierCount", "Position")


@query("ae_forest_and_quadrant", _WIDE_COHORTS + _NN + """SELECT id, row_number() OVER (ORDER BY rr DESC, kn, id) Position, round(greatest(0, least(1, 1 - (log10(hi95) - log10(lo95)) / 3)), 6) x, round(greatest(0, least(1, (log10(rr) + 1.5) / 3)), 6) y, round(8 + 1.6 * sqrt(ev), 6) size FROM tiers WHERE DocumentGUID = 'doc-12'""")
def ae_forest_and_quadrant(spark, sf_dir):
    s = signals(spark, sf_dir, WIDE_OBS).filter("DocumentGUID = 'doc-12'")
    q = classify.quadrant(F.col("RR"), F.col("RRLowerBound"), F.col("RRUpperBound"), F.col("EventsTreatment"))
    placed = positions(s, [-F.least(F.floor(F.col("RR") * 256), F.lit(8192))], [F.col("RR").desc(), F.col("Term"), F.col("id")], "Position")
    return placed.select("id", "Position", *[F.round(q[c], 6).alias(c) for c in ("x", "y", "size")])


_RANK = "CASE verdict WHEN 'PlausiblyCausal' THEN 0 WHEN 'Protective' THEN 1 WHEN 'NotSignificantlyElevated' THEN 2 ELSE 4 END"


@query("ae_reverse_lookup", _WIDE_COHORTS + _NN + f"""SELECT id, DocumentGUID, verdict Verdict, row_number() OVER (ORDER BY {_RANK}, need NULLS LAST, rr DESC, DocumentGUID, id) Position,
 NOT bool_or(verdict = 'PlausiblyCausal') OVER () AllReassuring FROM tiers WHERE kn = 'NAUSEA'""")  # fmt: skip
def ae_reverse_lookup(spark, sf_dir):
    s = signals(spark, sf_dir, WIDE_OBS).filter("Term = 'NAUSEA'")
    order = [classify.verdict_rank(F.col("Verdict")), F.col("NumberNeeded").asc_nulls_last(), F.col("RR").desc(), F.col("DocumentGUID"), F.col("id")]
    placed = positions(s, [classify.verdict_rank(F.col("Verdict")), _near(F.col("NumberNeeded"))], order, "Position")
    reassuring = s.agg((~F.bool_or(F.col("Verdict") == "PlausiblyCausal")).alias("AllReassuring"))
    return placed.join(F.broadcast(reassuring)).select("id", "DocumentGUID", "Verdict", "Position", "AllReassuring")


_REP = "row_number() OVER (PARTITION BY DocumentGUID, kn ORDER BY CASE WHEN pr = 'Fragile' THEN 1 ELSE 0 END, CASE WHEN sg = 'NotSignificant' THEN 1 ELSE 0 END, need NULLS LAST, rr DESC, id)"


def representatives(s):
    """Per document and term: not fragile first, then significant, then least number needed, then highest risk."""
    order = [F.when(F.col("Precision") == "Fragile", 1).otherwise(0), F.when(F.col("Significance") == "NotSignificant", 1).otherwise(0), F.col("NumberNeeded").asc_nulls_last(), F.col("RR").desc(), F.col("id")]
    return top1_per_key(s, ["DocumentGUID", "Term"], order)


@query("ae_interchange", _COHORTS + _NN + f""", rep AS (SELECT * FROM (SELECT *, {_REP} rn FROM tiers) WHERE rn = 1)
SELECT coalesce(a.kn, b.kn) Term, round(a.rr, 6) RRA, round(b.rr, 6) RRB, CASE WHEN b.rr IS NULL THEN 'OnlyA' WHEN a.rr IS NULL THEN 'OnlyB'
  WHEN abs(log10(a.rr) - log10(b.rr)) < 0.15 OR (a.sg = 'NotSignificant' AND b.sg = 'NotSignificant') THEN 'Similar' WHEN a.rr > b.rr THEN 'AWorse' ELSE 'BWorse' END Class
FROM (SELECT * FROM rep WHERE DocumentGUID = 'doc-12') a FULL JOIN (SELECT * FROM rep WHERE DocumentGUID = 'doc-30') b ON a.kn = b.kn""")  # fmt: skip
def ae_interchange(spark, sf_dir):
    r = representatives(signals(spark, sf_dir).filter(F.col("DocumentGUID").isin("doc-12", "doc-30")))
    side = lambda g, x: r.filter(F.col("DocumentGUID") == g).select("Term", F.col("RR").alias(f"RR{x}"), F.col("Significance").alias(f"S{x}"))
    both = side("doc-12", "A").join(side("doc-30", "B"), "Term", "full_outer")
    return both.select("Term", F.round("RRA", 6).alias("RRA"), F.round("RRB", 6).alias("RRB"), classify.comparison(F.col("SA"), F.col("RRA"), F.col("SB"), F.col("RRB")).alias("Class"))


@query("ae_product_summary", _COHORTS + _NN + """SELECT DocumentGUID, count(*) RowCount, sum(CASE WHEN sg = 'Elevated' THEN 1 ELSE 0 END)::BIGINT ElevatedCount, sum(CASE WHEN flag = 'PLACEBO_COMPARATOR' THEN 1 ELSE 0 END)::BIGINT PlaceboCount,
 count(DISTINCT ParameterCategory) SocCount, count(DISTINCT Dose) DoseCount, round(avg(CASE WHEN sg = 'Elevated' THEN rr END), 6) MeanElevatedRR,
 round(100 * (0.25 * least(1, sum(CASE WHEN flag = 'PLACEBO_COMPARATOR' THEN 1 ELSE 0 END) / count(*)::DOUBLE) + 0.05 * least(1, sum(CASE WHEN flag <> 'PLACEBO_COMPARATOR' THEN 1 ELSE 0 END) / count(*)::DOUBLE)
  + 0.25 * least(1, sum(CASE WHEN sg = 'Elevated' THEN 1 ELSE 0 END) / count(*)::DOUBLE) + 0.15 * least(1, count(DISTINCT Dose) / 3.0::DOUBLE) + 0.20 * least(1, count(DISTINCT ParameterCategory) / 10.0::DOUBLE) + 0.10 * least(1, count(*) / 40.0::DOUBLE))) Score
FROM tiers GROUP BY 1""")  # fmt: skip
def ae_product_summary(spark, sf_dir):
    s = signals(spark, sf_dir)
    total = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    g = s.groupBy("DocumentGUID").agg(
        F.count(F.lit(1)).alias("RowCount"), total(F.col("Significance") == "Elevated").alias("ElevatedCount"), total(F.col("ComparatorFlag") == "PLACEBO_COMPARATOR").alias("PlaceboCount"),
        F.countDistinct("ParameterCategory").alias("SocCount"), F.countDistinct("Dose").alias("DoseCount"), F.round(F.avg(F.when(F.col("Significance") == "Elevated", F.col("RR"))), 6).alias("MeanElevatedRR"),
    )
    active = F.col("RowCount") - F.col("PlaceboCount")
    return g.withColumn("Score", classify.product_score(F.col("PlaceboCount"), active, F.col("ElevatedCount"), F.col("RowCount"), F.col("DoseCount"), F.col("SocCount")))


_MONTHS = """WITH m AS (SELECT c_nationkey item, date_trunc('month', o_orderdate) via, avg(o_totalprice) v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
, p AS (SELECT a.item a, b.item b, a.v x, b.v y FROM m a JOIN m b ON a.via = b.via AND a.item <= b.item),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE ry FROM p),
r AS (SELECT a, b, count(*) n, CASE WHEN a = b THEN 1.0::DOUBLE ELSE corr(rx, ry) END r FROM rk GROUP BY 1, 2) """


@query("ae_correlation_map", _MONTHS + "SELECT a, b, n, round(r, 8) r, round(CASE WHEN abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END, 6) t FROM r")
def ae_correlation_map(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("item"), F.date_trunc("month", "o_orderdate").alias("via")).agg(F.avg("o_totalprice").alias("v"))
    return pair_correlations(m, "item", "via", "v").select("a", "b", "n", F.round("r", 8).alias("r"), F.round("t", 6).alias("t"))


#: Student's distribution for whole degrees of freedom f as a finite sum of powers of the cosine of atan(t / sqrt(f)).
STUDENT = """, s AS (SELECT unnest(range(0, 500)) k), w AS (SELECT k, sum(CASE WHEN k = 0 THEN 0 ELSE ln((2 * k - 1) / (2.0::DOUBLE * k)) END) OVER (ORDER BY k) even, sum(CASE WHEN k = 0 THEN 0 ELSE ln(2.0::DOUBLE * k / (2 * k + 1)) END) OVER (ORDER BY k) odd FROM s),
th AS (SELECT a, b, n - 2 f, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) th FROM r WHERE n >= 3 AND abs(r) < 1),
pv AS (SELECT a, b, any_value(1 - CASE WHEN f % 2 = 0 THEN sin(th) * e ELSE 2 / pi() * (th + CASE WHEN f = 1 THEN 0 ELSE sin(th) * cos(th) * o END) END) p FROM (
 SELECT a, b, f, th, sum(CASE WHEN k <= (f - 2) / 2 THEN exp(even + 2 * k * ln(cos(th))) END) OVER (PARTITION BY a, b) e, sum(CASE WHEN k <= (f - 3) / 2 THEN exp(odd + 2 * k * ln(cos(th))) END) OVER (PARTITION BY a, b) o FROM th JOIN w ON k <= f / 2) GROUP BY a, b)
"""


@query("ae_correlation_p_values", _MONTHS + STUDENT + "SELECT a, b, n, round(r, 8) r, round(CASE WHEN abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END, 6) t, round(p, 8) p FROM r LEFT JOIN pv USING (a, b)")
def ae_correlation_p_values(spark, sf_dir):
    ship_package(spark)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("item"), F.date_trunc("month", "o_orderdate").alias("via")).agg(F.avg("o_totalprice").alias("v"))
    found = pair_correlations(m, "item", "via", "v")
    return found.select("a", "b", "n", F.round("r", 8).alias("r"), F.round("t", 6).alias("t"), F.round(p_value(F.col("r"), F.col("n").cast("double")), 8).alias("p"))


@query("ae_heatmap", """WITH m AS (SELECT c_mktsegment seg, c_nationkey nat, median(o_totalprice) v, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT seg, nat, round(v, 4) v, n, dense_rank() OVER (ORDER BY seg) - 1 row_index, dense_rank() OVER (ORDER BY nat) - 1 col_index FROM m""")  # fmt: skip
def ae_heatmap(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat")).agg(F.median("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    axis = lambda k: (F.dense_rank().over(Window.orderBy(k)) - 1)
    return m.select("seg", "nat", F.round("v", 4).alias("v"), "n", axis("seg").alias("row_index"), axis("nat").alias("col_index"))




_LABELS = ("Product", "Section", "Ingredient", "IngredientSubstance")
_CATALOG = (_COHORTS + _NN).replace(with_tables("Line"), with_tables("Line", *_LABELS), 1)


@query("ae_catalog", _CATALOG + """, doc AS (SELECT 'doc-' || DocumentID DocumentGUID, ProductID, ProductName FROM Product JOIN Section USING (SectionID)),
first_product AS (SELECT DocumentGUID, min_by(ProductName, ProductID) ProductName, count(*) Products FROM doc GROUP BY 1),
active AS (SELECT DocumentGUID, string_agg(DISTINCT UNII, '+' ORDER BY UNII) UNII FROM doc JOIN Ingredient USING (ProductID) JOIN IngredientSubstance USING (IngredientSubstanceID) WHERE ClassCode <> 'IACT' AND UNII IS NOT NULL GROUP BY 1)
SELECT DocumentGUID, ProductName, Products, UNII, coalesce(contains(UNII, '+'), false) IsCombo, CASE WHEN contains(UNII, '+') THEN 'Combo' WHEN UNII IS NOT NULL THEN 'Mono' ELSE 'Unknown' END Kind,
 count(*) RowCount, sum(CASE WHEN sg = 'Elevated' THEN 1 ELSE 0 END)::BIGINT ElevatedCount, count(DISTINCT kn) TermCount FROM tiers JOIN first_product USING (DocumentGUID) LEFT JOIN active USING (DocumentGUID) GROUP BY ALL""")  # fmt: skip
def ae_catalog(spark, sf_dir):
    """One row per document with signals: its first product, its active substances joined by +, whether they are several, and its counts."""
    t = tables(spark, sf_dir, once=True)
    s = stored(signals(spark, sf_dir, OBS, t["Line"]).groupBy("DocumentGUID").agg(F.count(F.lit(1)).alias("RowCount"), F.sum(F.when(F.col("Significance") == "Elevated", 1).otherwise(0)).alias("ElevatedCount"), F.countDistinct("Term").alias("TermCount")))
    # Products and substances of documents without signals leave before they are put together.
    sections = t["Section"].select("SectionID", F.concat(F.lit("doc-"), F.col("DocumentID").cast("string")).alias("DocumentGUID")).join(sized(s.select("DocumentGUID"), 1_000_000), "DocumentGUID", "left_semi")
    docs = stored(t["Product"].join(sections, "SectionID").select("DocumentGUID", "ProductID", "ProductName"))
    first = docs.groupBy("DocumentGUID").agg(F.min_by("ProductName", "ProductID").alias("ProductName"), F.count(F.lit(1)).alias("Products"))
    active = docs.join(t["Ingredient"].filter("ClassCode <> 'IACT'"), "ProductID").join(t["IngredientSubstance"].filter("UNII is not null"), "IngredientSubstanceID")
    active = active.groupBy("DocumentGUID").agg(F.array_join(F.array_sort(F.collect_set("UNII")), "+").alias("UNII"))
    several = F.coalesce(F.contains("UNII", F.lit("+")), F.lit(False))
    kind = F.when(several, "Combo").when(F.col("UNII").isNotNull(), "Mono").otherwise("Unknown")
    return s.join(first, "DocumentGUID").join(active, "DocumentGUID", "left").select("DocumentGUID", "ProductName", "Products", "UNII", several.alias("IsCombo"), kind.alias("Kind"), "RowCount", "ElevatedCount", "TermCount")


@query("ae_most_powered_by_kind", _CATALOG + """, doc AS (SELECT 'doc-' || DocumentID DocumentGUID, ProductID FROM Product JOIN Section USING (SectionID)),
active AS (SELECT DocumentGUID, count(DISTINCT UNII) n FROM doc JOIN Ingredient USING (ProductID) JOIN IngredientSubstance USING (IngredientSubstanceID) WHERE ClassCode <> 'IACT' AND UNII IS NOT NULL GROUP BY 1),
r AS (SELECT kn Term, CASE WHEN n > 1 THEN 'Combo' ELSE 'Mono' END Kind, DocumentGUID, id, ArmN, rr, row_number() OVER (PARTITION BY kn, n > 1 ORDER BY ArmN DESC, rr DESC, DocumentGUID, id) nth FROM tiers JOIN active USING (DocumentGUID))
SELECT Term, Kind, DocumentGUID, id, ArmN::DOUBLE ArmN, round(rr, 6) RR FROM r WHERE nth = 1""")  # fmt: skip
def ae_most_powered_by_kind(spark, sf_dir):
    """Per term, and single or several substances: the signal with the largest arm, then the highest risk."""
    t = tables(spark, sf_dir)
    docs = t["Product"].join(t["Section"].select("SectionID", F.concat(F.lit("doc-"), F.col("DocumentID").cast("string")).alias("DocumentGUID")), "SectionID").select("DocumentGUID", "ProductID")
    active = docs.join(t["Ingredient"].filter("ClassCode <> 'IACT'"), "ProductID").join(t["IngredientSubstance"].filter("UNII is not null"), "IngredientSubstanceID").groupBy("DocumentGUID").agg(F.countDistinct("UNII").alias("n"))
    rows = signals(spark, sf_dir).join(active, "DocumentGUID").withColumn("Kind", F.when(F.col("n") > 1, "Combo").otherwise("Mono"))
    best = top1_per_key(rows, ["Term", "Kind"], [F.col("ArmN").desc(), F.col("RR").desc(), F.col("DocumentGUID"), F.col("id")])
    return best.select("Term", "Kind", "DocumentGUID", "id", F.col("ArmN").cast("double").alias("ArmN"), F.round("RR", 6).alias("RR"))
