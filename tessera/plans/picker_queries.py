"""Pickers, trial designs and substring matching on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import pickers
from tessera.plans.ae_queries import _OBS, observations
from tessera.plans.registry import query
from tessera.session import table


@query("ae_map_picker", """WITH d AS (SELECT DISTINCT s_nationkey g, l_orderkey % 300 v, p_type i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
p AS (SELECT a.g, a.i a, b.i b, count(*) n FROM d a JOIN d b ON a.g = b.g AND a.v = b.v AND a.i < b.i GROUP BY 1, 2, 3), u AS (SELECT g, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END)::BIGINT usable, max(n) best FROM p GROUP BY 1),
s AS (SELECT g, count(DISTINCT v) vias, count(DISTINCT i) items FROM d GROUP BY 1)
SELECT g, vias, items, coalesce(usable, 0) usable, coalesce(best, 0) best, items * (items - 1) // 2 pairs, CASE WHEN items < 2 THEN 'TOO_FEW_ITEMS' WHEN vias < 3 THEN 'TOO_FEW_VIAS' WHEN coalesce(usable, 0) = 0 THEN 'NO_USABLE_PAIR' END reason,
 items >= 2 AND vias >= 3 AND coalesce(usable, 0) > 0 renderable FROM s LEFT JOIN u USING (g)""")  # fmt: skip
def ae_map_picker(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return pickers.map_picker(rows.select(F.col("s_nationkey").alias("g"), (F.col("l_orderkey") % 300).alias("v"), F.col("p_type").alias("i")), "g", "v", "i")


@query("ae_trial_design", _OBS + r""", a AS (SELECT *, regexp_matches(TreatmentArm, '(?i)(placebo|sham|vehicle)') OR coalesce(Dose = 0, false) pl, lower(trim(TreatmentArm)) arm,
 CASE lower(trim(TreatmentArm)) WHEN 'drug a 50mg' THEN 'drug a' WHEN 'drug a 100mg' THEN 'drug a' ELSE lower(trim(TreatmentArm)) END root FROM obs WHERE DocumentGUID IS NOT NULL AND trim(TreatmentArm) <> ''),
g AS (SELECT DocumentGUID, TextTableID, count(DISTINCT arm) arms, max(CASE WHEN pl THEN 1 ELSE 0 END) = 1 p, count(DISTINCT CASE WHEN NOT pl THEN arm END) ac, count(DISTINCT CASE WHEN NOT pl THEN root END) rt FROM a GROUP BY 1, 2)
SELECT DocumentGUID, TextTableID, arms, CASE WHEN arms <= 1 THEN CASE WHEN p THEN 'PLACEBO_ONLY' ELSE 'SINGLE_ARM' END WHEN p AND ac = 0 THEN 'PLACEBO_ONLY' WHEN p AND ac > 1 AND rt = 1 THEN 'STEPPED_DOSE_PLUS_PLACEBO'
 WHEN NOT p AND ac > 1 AND rt = 1 THEN 'STEPPED_DOSE_MONOTHERAPY' WHEN NOT p AND rt > 1 THEN 'ACTIVE_ONLY' WHEN p AND ac >= 1 THEN 'PLACEBO_PLUS_ACTIVE' ELSE 'AMBIGUOUS' END design FROM g""")  # fmt: skip
def ae_trial_design(spark, sf_dir):
    o = observations(spark, sf_dir).filter("DocumentGUID is not null and trim(TreatmentArm) <> ''")
    return pickers.trial_design(o, ["DocumentGUID", "TextTableID"])


@query("ingredient_substring_match", """WITH n AS (SELECT DISTINCT upper(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END) x FROM part), s AS (SELECT DISTINCT upper(p_name) x FROM part)
SELECT n.x "name", s.x substance FROM n JOIN s ON n.x = s.x
UNION ALL SELECT n.x, s.x FROM n, s WHERE n.x NOT IN (SELECT x FROM s) AND length(n.x) >= 3 AND contains(s.x, n.x)""")  # fmt: skip
def ingredient_substring_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"))
    return pickers.substring_matches(names, p.select(F.col("p_name").alias("substance")))
