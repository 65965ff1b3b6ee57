"""Class maps over order lines: brands and types as classes, part names as terms, suppliers as drugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import class_maps
from tessera.plans.ae_queries import STUDENT
from tessera.plans.domain import TABLES, with_tables
from tessera.plans.registry import query
from tessera.session import ship_package, stored, table

#: Effects are sixteenths, so medians and ties are exact.
SEEN = """select concat(p_brand, ' ', p_type) as Class, concat(p_brand, ' ', lower(p_type), case when p_type in ('PROMO', 'LARGE') then ' [EPC]' when p_type = 'SMALL' then ' [moa] ' else '' end) as Name, p_name as Term, l.s as Drug, l.q / 16.0 - 1 as LogRR
 from {Line} l join {part} on l.p = p_partkey where p_retailprice < 1000 or p_type <> 'MEDIUM'"""
#: Shared terms below which a pair is not drawn.
LEAST = 4


def _read(spark, sf_dir):
    ship_package(spark)
    seen = spark.sql(SEEN, Line=spark.sql(TABLES["Line"], lineitem=table(spark, sf_dir, "lineitem")), part=table(spark, sf_dir, "part")).withColumn("LogRR", F.col("LogRR").cast("double"))
    # Each page and count reads the classes' values again: they are made from the lines once.
    values = stored(class_maps.per_class_term(seen))
    return seen, values, class_maps.cells(values, LEAST)


_V = with_tables("Line") + f""", seen AS ({SEEN.replace('{Line}', 'Line').replace('{part}', 'part')}), v AS (SELECT Class c, Term t, median(LogRR::DOUBLE) x, count(*) n, count(DISTINCT Drug) dr FROM seen GROUP BY 1, 2),
pr AS (SELECT a.c a, b.c b, a.x x, b.x y FROM v a JOIN v b ON a.t = b.t AND a.c < b.c),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE ry FROM pr),
g AS (SELECT a, b, count(*) n, CASE WHEN count(*) >= 2 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END raw FROM rk GROUP BY 1, 2)"""


@query("class_map", _V + f", r AS (SELECT a, b, n, CASE WHEN n >= {LEAST} THEN round(raw, 12) END r FROM g)" + STUDENT + f"""SELECT a "A", b "B", g.n "PairCount", round(raw, 8) "Raw", round(r.r, 8) "Coefficient", g.n < {LEAST} "InsufficientN", round(p, 8) "PValue", coalesce(p < 0.05, false) "IsSignificant" FROM g JOIN r USING (a, b) LEFT JOIN pv USING (a, b)""")
def class_map(spark, sf_dir):
    """Every pair of classes with a common term: coefficient, what a floor leaves of it, and its p-value."""
    *_, cells = _read(spark, sf_dir)
    found = class_maps.with_p(cells)
    return found.select("A", "B", "PairCount", F.round("Raw", 8).alias("Raw"), F.round("Coefficient", 8).alias("Coefficient"), "InsufficientN", F.round("PValue", 8).alias("PValue"), "IsSignificant")


_AXIS = _V + f""", dw AS (SELECT a, b, n FROM g WHERE n >= {LEAST}), en AS (SELECT a c FROM dw UNION SELECT b FROM dw), nm AS (SELECT Class c, min(Name) nm, count(DISTINCT Drug) d FROM seen GROUP BY 1),
ax AS (SELECT c, nm, CASE WHEN regexp_matches(nm, '\\[[^\\]]*\\]\\s*$') THEN upper(trim(regexp_extract(nm, '\\[([^\\]]*)\\]\\s*$', 1))) ELSE 'Other' END ty, d, (SELECT count(*) FROM v WHERE v.c = nm.c) tc, c IN (SELECT c FROM en) h FROM nm),
ps AS (SELECT *, row_number() OVER (ORDER BY h DESC, tc DESC, d DESC, upper(nm), c) pos FROM ax)"""


@query("class_axis", _AXIS + """ SELECT c "Class", nm "Name", ty "Type", tc "TermCount", d "DrugCount", h "HasRenderableMap", pos::INT "Position" FROM ps""")
def class_axis(spark, sf_dir):
    """All classes in the order of the map's axis."""
    seen, values, cells = _read(spark, sf_dir)
    return class_maps.axis(seen, values, cells.filter("not InsufficientN"), seen.select("Class", "Name"))


@query("class_page", _AXIS + """, k AS (SELECT dw.* FROM dw JOIN ps x ON x.c = a AND x.ty = 'EPC' JOIN ps y ON y.c = b AND y.ty = 'EPC'), rn AS (SELECT c, pos, row_number() OVER (ORDER BY pos) - 1 pp FROM ps WHERE ty = 'EPC' AND c IN (SELECT a FROM k UNION SELECT b FROM k)),
z AS (SELECT 3 size, least(6, greatest((SELECT count(*) FROM rn) - 1, 0)) st), pl AS (SELECT k.n, x.pp i, y.pp j FROM k JOIN rn x ON x.c = a JOIN rn y ON y.c = b),
wh AS (SELECT count(*) w FROM pl WHERE i BETWEEN 6 AND 8 AND j BETWEEN 6 AND 8), be AS (SELECT i, j FROM pl, z ORDER BY CASE WHEN i BETWEEN 6 AND 8 OR j BETWEEN 6 AND 8 THEN 0 ELSE 1 END, least(abs(i - st), abs(j - st)), n DESC, least(i, j), greatest(i, j) LIMIT 1),
ch AS (SELECT c, pos, pp FROM rn, z, wh WHERE w > 0 AND pp BETWEEN 6 AND 8 UNION ALL SELECT c, pos, pp FROM (SELECT c, pos, pp, row_number() OVER (ORDER BY CASE WHEN pp IN (be.i, be.j) THEN -1 WHEN pp >= st THEN pp - st ELSE pp + (SELECT count(*) FROM rn) END, pp) turn FROM rn, z, wh, be WHERE w = 0) WHERE turn <= 3)
SELECT c "Class", pos::INT "Position", (row_number() OVER (ORDER BY pp) - 1)::INT "Index" FROM ch""")  # fmt: skip
def class_page(spark, sf_dir):
    """The third page, of three classes of one type, of the axis; a page that draws nothing takes the nearest pair in."""
    seen, values, cells = _read(spark, sf_dir)
    drawn = stored(cells.filter("not InsufficientN"))
    page, _ = class_maps.window(stored(class_maps.axis(seen, values, drawn, seen.select("Class", "Name"))), drawn, 3, 3, "EPC")
    return page


@query("class_facets", _AXIS + """ SELECT ty "Type", count(*) "ClassCount", bool_or(h) "HasRenderableMap" FROM ps GROUP BY 1""")
def class_facets(spark, sf_dir):
    seen, values, cells = _read(spark, sf_dir)
    return class_maps.facets(class_maps.axis(seen, values, cells.filter("not InsufficientN"), seen.select("Class", "Name")))


@query("class_pair_detail", _V + """ SELECT a.t "Term", a.x "LogRRX", b.x "LogRRY", a.n "CountX", b.n "CountY", a.dr "DrugsX", b.dr "DrugsY", round(exp(a.x), 8) "RRX", round(exp(b.x), 8) "RRY" FROM v a JOIN v b ON a.t = b.t WHERE a.c = 'Brand#1 PROMO' AND b.c = 'Brand#2 LARGE'""")
def class_pair_detail(spark, sf_dir):
    """The terms behind one cell of the map."""
    _, values, _ = _read(spark, sf_dir)
    return class_maps.drill_down(values, "Brand#1 PROMO", "Brand#2 LARGE").select("Term", "LogRRX", "LogRRY", "CountX", "CountY", "DrugsX", "DrugsY", F.round("RRX", 8).alias("RRX"), F.round("RRY", 8).alias("RRY"))
