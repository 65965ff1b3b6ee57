"""Pharmacokinetic tables in three layouts laid over orders, and phrase matching over part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import phrases, pk
from tessera.operators import grid
from tessera.plans.domain import TABLES, with_tables
from tessera.plans.registry import query
from tessera.session import ship_package, spread_small, table

#: An order is a table; its first three lines are its doses (m mg for line n) with two parameters each, x with y as standard deviation.
DOSED = """select k, n, k % 3 as layout, cast(n * 10 as string) as m, cast(cast(q as int) + n as string) as x, cast(cast(q as int) % 7 + 1 as string) as y, cast(p % 50 + 1 as string) as t from {Line} where n <= 3"""
_CELL = ("CellID", "RowSeq", "CellSeq", "RowGroupType", "CellType", "RowSpan", "ColSpan", "CellText")


def cells(spark, sf_dir):
    """Layout 0: doses down, parameters across; 1: parameters down, doses across; 2: a title over all columns, headers in the body, and a study before each."""
    rows = spark.sql(DOSED, Line=spark.sql(TABLES["Line"], lineitem=table(spark, sf_dir, "lineitem")))
    lit = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")

    def cell(i, r, c, group, kind, cs, x):
        return F.struct(*[v.alias(n) for n, v in zip(_CELL, ((F.lit(i) if isinstance(i, int) else i).cast("long"), (F.lit(r) if isinstance(r, int) else r).cast("int"), (F.lit(c) if isinstance(c, int) else c).cast("int"), F.lit(group), F.lit(kind), F.lit(1), F.lit(cs), lit(x)), strict=True)])

    pair, dose = F.concat("x", F.lit(".5 ± "), "y"), F.concat(F.col("m"), F.lit(" mg for 7 days"))
    one = rows.groupBy("k", "layout").agg(F.count(F.lit(1)).alias("many"))
    plain = [cell(i, 1, i, "Header", "th", 1, x) for i, x in enumerate(("Regimen", "Cmax (ng/mL)", "Half-life (hr)"))]
    turned = [cell(0, 1, 0, "Header", "th", 1, "Parameter")]
    names = [cell(100 + i, 2 + i, 0, "Body", "td", 1, x) for i, x in enumerate(("Plasma Cmax (ng/mL)", "t½ (h)"))]
    title = [cell(0, 1, 0, "Body", "td", 3, "Pharmacokinetics (N=24)")]
    heads = [cell(20 + 10 * b + i, 10 * b + 3, i, "Body", "td", 1, x) for b in (0, 1) for i, x in enumerate((("Subjects", "Dose", "Cmax, ng/mL"), ("Subjects", "Dose", "Terminal half-life (h)"))[b])]
    studies = [cell(19 + 10 * b, 10 * b + 2, 0, "Body", "td", 3, x) for b, x in enumerate(("Study 1, fasted", "Study 2, fasted"))]
    fixed = F.when(F.col("layout") == 0, F.array(*plain)).when(F.col("layout") == 1, F.array(*turned, *names)).otherwise(F.array(*title, *studies, *heads))
    n = F.col("n")
    by_row = F.array(*[cell(1000 + n * 10 + i, n + 1, i, "Body", "td", 1, x) for i, x in enumerate((dose, pair, F.col("t")))])
    by_col = F.array(cell(500 + n, 1, n, "Header", "th", 1, dose), cell(1000 + n, 2, n, "Body", "td", 1, pair), cell(2000 + n, 3, n, "Body", "td", 1, F.col("t")))
    by_block = F.array(*[cell(1000 + 100 * b + n * 10 + i, n + 10 * b + 3, i, "Body", "td", 1, x) for b, v in ((0, pair), (1, F.col("t"))) for i, x in enumerate(("Adults", dose, v))])
    own = F.when(F.col("layout") == 0, by_row).when(F.col("layout") == 1, by_col).otherwise(by_block)
    both = one.select("k", F.explode(fixed).alias("c")).unionByName(rows.select("k", F.explode(own).alias("c")))
    return both.select(F.col("k").alias("TextTableID"), "c.*")


def tables(spark, sf_dir):
    keys = spark.sql(DOSED, Line=spark.sql(TABLES["Line"], lineitem=table(spark, sf_dir, "lineitem"))).select(F.col("k").alias("TextTableID")).distinct()
    return keys.select("TextTableID", F.concat(F.lit("doc-"), F.col("TextTableID").cast("string")).alias("DocumentGUID"), F.lit("Fasted subjects (N=24)").alias("Caption"))


def _observed(spark, sf_dir):
    ship_package(spark)
    spread_small(spark)
    return pk.vote_units(pk.observations(grid.reconstruct(cells(spark, sf_dir)), tables(spark, sf_dir)))


_D = with_tables("Line") + f", l AS ({DOSED.replace('{Line}', 'Line')})"


@query("pk_observations", _D + """SELECT 'doc-' || k "DocumentGUID", 'Cmax' "ParameterName", m || ' mg for 7 days' "DoseRegimen", m::DOUBLE "Dose", 'mg' "DoseUnit", 7.0::DOUBLE "Time", 'days' "TimeUnit", 24.0::DOUBLE "ArmN", (x || '.5')::DOUBLE "PrimaryValue", 'Mean' "PrimaryValueType", y::DOUBLE "SecondaryValue", 'SD' "SecondaryValueType", 'ng/mL' "Unit", 'fasted' "ParameterSubtype",
 layout = 1 turned FROM l UNION ALL SELECT 'doc-' || k, 't½', m || ' mg for 7 days', m::DOUBLE, 'mg', 7.0::DOUBLE, 'days', 24.0::DOUBLE, t::DOUBLE, 'Mean', NULL, NULL, 'h', 'fasted', layout = 1 FROM l""")  # fmt: skip
def pk_observations(spark, sf_dir):
    """The same rows from plain, transposed and compound layouts."""
    o = _observed(spark, sf_dir)
    return o.select("DocumentGUID", "ParameterName", "DoseRegimen", F.col("Dose").cast("double").alias("Dose"), "DoseUnit", "Time", "TimeUnit", F.col("ArmN").cast("double").alias("ArmN"), "PrimaryValue", "PrimaryValueType", "SecondaryValue", "SecondaryValueType", "Unit", "ParameterSubtype", F.contains("ValidationFlags", F.lit("PK_TRANSPOSED_LAYOUT")).alias("turned"))


@query("pk_orientation", _D + """, t AS (SELECT k, layout, count(*) n FROM l GROUP BY 1, 2)
SELECT k "TextTableID", 0 "Block", CASE layout WHEN 0 THEN 2 ELSE 0 END "ColumnParameters", CASE layout WHEN 1 THEN n ELSE 0 END "ColumnDoses", CASE layout WHEN 1 THEN 2 ELSE 0 END "RowParameters", CASE layout WHEN 0 THEN n ELSE 0 END "RowDoses", layout = 1 "Transposed" FROM t WHERE layout < 2""")  # fmt: skip
def pk_orientation(spark, sf_dir):
    """Votes of the tables whose headers stand above; compound ones vote for each block."""
    ship_package(spark)
    spread_small(spark)
    votes = pk.orientation(grid.reconstruct(cells(spark, sf_dir))).filter("Block = 0")
    return votes.select("TextTableID", "Block", "ColumnParameters", "ColumnDoses", "RowParameters", "RowDoses", "Transposed")


_ALIASES = "SELECT DISTINCT p_name \"Alias\", concat('part ', p_name) \"Canonical\" FROM part UNION SELECT DISTINCT p_type, concat('type ', p_type) FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), concat('word ', split_part(p_name, ' ', 1)) FROM part UNION SELECT DISTINCT concat(split_part(p_name, ' ', 2), ' tau'), concat('tau ', split_part(p_name, ' ', 2)) FROM part"
_TEXT = "concat(CASE WHEN p_size % 2 = 0 THEN p_type ELSE concat('x', p_type) END, ' (', upper(p_name), '), ', p_name, CASE p_size % 3 WHEN 0 THEN ' τ' WHEN 1 THEN ' taus' ELSE '' END, '/', p_type, 's ', p_brand)"


@query("pk_phrase_match", f"""WITH a AS (SELECT lower("Alias") al, min("Canonical") cn FROM ({_ALIASES}) GROUP BY 1), t AS (SELECT p_partkey id, lower(replace({_TEXT}, 'τ', 'tau')) t FROM part),
s AS (SELECT id, t, unnest(range(0, length(t))) p FROM t), w AS (SELECT * FROM s WHERE p = 0 OR regexp_matches(substring(t, p::INT, 1), '[\\s,(/]')),
m AS (SELECT id, p, al, cn, row_number() OVER (PARTITION BY id, p ORDER BY length(al) DESC) nth FROM w JOIN a ON substring(t, p::INT + 1, length(al)) = al AND (p + length(al) = length(t) OR regexp_matches(substring(t, p::INT + length(al) + 1, 1), '[^\\w]')))
SELECT id, p::INT "Start", al "Alias", cn "Canonical" FROM m WHERE nth = 1""")  # fmt: skip
def pk_phrase_match(spark, sf_dir):
    """All names, their first words and types, as aliases, found in a text made of each part's columns."""
    p = table(spark, sf_dir, "part")
    aliases = spark.sql(_ALIASES.replace('"', "`").replace("FROM part", "FROM {part}"), part=p)
    return phrases.matches(p.select(F.col("p_partkey").alias("id"), F.expr(_TEXT).alias("text")), aliases)
