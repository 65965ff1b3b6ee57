"""Risk statistics on the driver's tables: brands are products, returned lines are events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.plans.registry import query
from tessera.session import table

_CELLS = """
WITH cells AS (
  SELECT p_brand,
    sum(CASE WHEN l_linestatus='O' AND l_quantity > 40 THEN 1 ELSE 0 END)::DOUBLE a,
    sum(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END)::DOUBLE n1,
    sum(CASE WHEN l_linestatus='F' AND l_quantity > 40 THEN 1 ELSE 0 END)::DOUBLE c,
    sum(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END)::DOUBLE n2
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
fix AS (SELECT *, CASE WHEN a=0 OR c=0 THEN 0.5 ELSE 0.0 END h FROM cells),
r AS (SELECT *, ((a+h)/(n1+2*h))/((c+h)/(n2+2*h)) rr,
  sqrt(greatest(0, 1/(a+h)-1/(n1+2*h)+1/(c+h)-1/(n2+2*h))) se
  FROM fix WHERE n1>0 AND n2>0)
"""


@query(
    "relative_risk_by_brand",
    _CELLS
    + """
SELECT p_brand, a AS events_treatment, n1 AS arm_n, c AS events_comparator, n2 AS comparator_n,
  round(rr, 6) AS rr, round(exp(ln(rr)-1.959963984540054*se), 6) AS rr_lower,
  round(exp(ln(rr)+1.959963984540054*se), 6) AS rr_upper,
  CASE WHEN exp(ln(rr)-1.959963984540054*se)>1 THEN 'elevated'
       WHEN exp(ln(rr)+1.959963984540054*se)<1 THEN 'protective' ELSE 'not significant' END AS significance
FROM r""",
)
def relative_risk_by_brand(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")

    def count(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("double")

    treated, hit = F.col("l_linestatus") == "O", F.col("l_quantity") > 40
    control = F.col("l_linestatus") == "F"
    cells = (
        line.join(part, line.l_partkey == part.p_partkey)
        .groupBy("p_brand")
        .agg(
            count(treated & hit).alias("events_treatment"),
            count(treated).alias("arm_n"),
            count(control & hit).alias("events_comparator"),
            count(control).alias("comparator_n"),
        )
        .filter((F.col("arm_n") > 0) & (F.col("comparator_n") > 0))
    )
    r = stats.relative_risk(*(F.col(c) for c in ("events_treatment", "arm_n", "events_comparator", "comparator_n")))
    return cells.select(
        "p_brand", "events_treatment", "arm_n", "events_comparator", "comparator_n",
        F.round(r["rr"], 6).alias("rr"), F.round(r["rr_lower"], 6).alias("rr_lower"), F.round(r["rr_upper"], 6).alias("rr_upper"),
        stats.significance(r["rr_lower"], r["rr_upper"]).alias("significance"),
    )
