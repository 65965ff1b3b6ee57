"""Diagnostics, value grammar, entity resolution, dedup, validation and ranking on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import entities, quality, search, values
from tessera.operators import grid, relops
from tessera.plans.domain import TABLES, with_tables
from tessera.plans.registry import query
from tessera.session import shared_folder, ship_package, table

#: Shapes of cells, with spacing as it is found; {q} a count, {s} a larger one, {d} a decimal number.
SHAPES = (
    "{q}/{s} ({d}%)", "{q} / {s}({d})", "{q}/{s} ({d} %)", "{q}/{s}", "{q} / 1,{s}", "{q}/{s} (see note)", "{q}/0", "{q} ({d}%)", "{q} ({d})", "{q}({q})", "{q} ({q} % )", "{q} ( {d})",
    "{q} (<{d}%)", "{q} ( ≤ {d} )", "{d} (<1%)", "{d}% ({q}%, {s}%)", "{d} ({q}, {s})", "{q}%({d},{s})", "-{d} (-{q}, {d})", "-{d}(-{q},-{d})", "{d} ({d}–{s})", "{d} ( {q} to {s} )", "-{d} (-{s} - -{q})",
    "{d} ± {q}", "{d}±{q}", "{d} +/- {q}", "-{d} +- {q}", "{d} (± {q}) (n={s})", "{d}(+/-{q})", "{d} (±{d}) ( N = {s} )", "{d} ({q}%)", "{d}({q} %) a", "{d} ({q})", "{d} ({d})*", "-{d} ( {q} ) †",
    "{q} to {s}", "{q}  to  {d} mg", "{d} %", "{q}%", "<{d}%", "≤ {q} %", "> {q}%", "n={q}", "N = 1,{s}", "(n={s})", "n=0", "p<0.05", "P < {q}", "={d}", "≥{d}", "{d} mcg/mL", "-{q} hr", "{d} ng·h/mL", "{q} mg/kg/day", "{q}mg", "{q} apples",
    "{q}", "-1,{s}.5", "{d}", "+{q}", "{q}.", "--", "—", "–-", " n/a ", "ND", "nr", "", "  ", "A", "b", "see {q}", "1.2.{q}", "1.2.{q} ({q}, {s})",
    "N = 5,{s}*", "(N = {q})†", "n={q} #", "{d} mL/hr/kg", "{d} ng·hr/mL", "{q} hrs", "{q} mL/min/day", "{q} day/kg", "{q} mg/kg/day/h", "{d} µg/mL", "{d} (9{s} - 1)", "{d} (0.01 - 9{s})", "({q})", "{q}*", "{q} (5)*", "-{q} %", "{q} %CV", "−{d} ± {q}",
    "{q}/{s}/{q}", "{q} ({q}%) ({q})", "{d} ± {q}*", "{q} / {s} †", "{d} (1{s} to 2{s}) b",
)


def _shape(spark_sql: bool) -> str:
    """The raw cell of row k: one of the shapes, by turns, with the row's numbers."""
    pieces = []
    for i, shape in enumerate(SHAPES):
        text = "'" + shape.replace("'", "''") + "'"
        for name in "qsd":
            text = f"replace({text}, '{{{name}}}', {name})"
        pieces.append(f"WHEN {i} THEN {text}")
    return f"CASE k % {len(SHAPES)} " + " ".join(pieces) + " END"


def _grammar_sql() -> str:
    """The grammar again in SQL, from the text alone: patterns by rule, then fields from the text's numbers in order."""
    u, g = r"\d+\.?\d*", r"-?[\d.]+"
    pm, unit = r"(±|\+/?-)", r"(?i)^-?\d+\.?\d*\s+(((mcg|ng|mg|mL|µg)(·hr?)?(/(mL|kg|day|hr|min)){1,2})|hrs?|min|mg|mcg|%CV|%)$"
    rules = [
        ("dash_placeholder", r"^[-–—]+$"), ("empty_or_na", r"(?i)^(N/A|NA|ND|NR|NC|NDD)?$"), ("letter_code", "^[A-Z]$"), ("frac_pct", rf"^\d+\s*/\s*\d+\s*\({u}\s*%?\s*\)$"), ("fraction_count", r"^\d[\d,]*\s*/\s*[\d,]*[1-9][\d,]*(\s*\([^)]*\))?$"),
        ("n_pct", rf"^\d+\s*\({u}\s*%?\s*\)$"), ("count_inequality_percent", rf"^\d+(\.\d+)?\s*\(\s*[<≤]\s*{u}\s*%?\s*\)$"), ("rr_ci", rf"^{u}\s*%?\s*\(\s*{u}\s*%?\s*,\s*{u}\s*%?\s*\)$"), ("diff_ci", rf"^-?{u}\s*\(\s*-?{u}\s*,\s*-?{u}\s*\)$"),
        ("value_ci", rf"^-?{u}\s*\(\s*{g}\s*([-–—]|to)\s*{g}\s*\)$' ) AND NOT regexp_matches(t, '\(9\d+ - 1\)"), ("value_plusminus", rf"^[-−]?{u}\s*{pm}\s*{g}$"), ("value_plusminus_sample", rf"^-?{u}\s*\(\s*{pm}\s*{g}\s*\)\s*(\(\s*[Nn]\s*=\s*\d+\s*\))?$"), ("value_cv", rf"^{u}\s*\(\d+\s*%\s*\).*$"),
        ("value_paren_dispersion", rf"^-?\d+\.\d+\s*\(\s*-?{u}\s*\)\s*[*†‡§¶#]?$"), ("range_to", rf"^{u}\s+to\s+{u}"), ("percentage", rf"^{u}\s*%$"), ("inequality_percent", rf"^[<≤]\s*{u}\s*%$"), ("n_equals", r"^\(?[nN]\s*=\s*[1-9][\d,]*\)?\s*[*†‡§¶#]?$"), ("pvalue", rf"^[Pp]?\s*[<>=≤≥]\s*{u}$"),
        ("value_trailing_unit", unit), ("plain_number", r"^-?[\d,]+\.?\d*$"),
    ]
    case = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in rules) + " ELSE 'text_descriptive' END"
    # A minus belongs to a number where nothing but a blank, a bracket, a comma or a dash stands before it.
    parts = "list_transform(regexp_extract_all(replace(replace(regexp_replace(regexp_replace(t, '\\+/?-|±', '~', 'g'), '(\\d\\s*)[-–—]', '\\1~', 'g'), '−', '-'), ',', CASE WHEN regexp_matches(t, '\\(.*,.*\\)') THEN '~' ELSE '' END), '-?\\d+\\.?\\d*'), lambda x: x::DOUBLE)"
    check = "CASE WHEN abs({d} - {p}) < 1.5 THEN 'PCT_CHECK:PASS' ELSE 'PCT_CHECK:WARN:' || regexp_replace({d}::DECIMAL(30,1)::VARCHAR, '\\.0$', '') END"
    share = "round_even({a} / {b} * 100, 1)"
    frac, arm = check.format(d=share.format(a="x[1]", b="x[2]"), p="x[3]"), check.format(d=share.format(a="x[1]", b="n"), p="x[2]")
    return f"""WITH c AS (SELECT p_partkey k, cast(p_size + 1 AS VARCHAR) q, cast(100 + p_partkey % 800 AS VARCHAR) s, concat(cast(p_size % 90 AS VARCHAR), '.', cast(p_partkey % 10 AS VARCHAR)) d, CASE WHEN p_partkey % 3 > 0 THEN (50 + p_partkey % 300)::DOUBLE END n FROM part),
r AS (SELECT k, n, {_shape(False)} raw FROM c), t AS (SELECT *, trim(raw) t FROM r), w AS (SELECT *, {case} "rule" FROM t), v AS (SELECT *, CASE WHEN "rule" IN ('text_descriptive', 'dash_placeholder') THEN [] ELSE {parts} END x FROM w)
SELECT k, raw, "rule", CASE WHEN "rule" = 'frac_pct' THEN x[3] WHEN "rule" IN ('n_pct') THEN x[2] WHEN "rule" = 'count_inequality_percent' THEN CASE WHEN n > 0 THEN round_even(x[1] / n * 100, 1) ELSE 0.1 END WHEN "rule" = 'range_to' THEN (x[1] + x[2]) / 2 ELSE x[1] END primary_value,
 CASE WHEN "rule" IN ('frac_pct', 'n_pct', 'count_inequality_percent') THEN x[1] WHEN "rule" IN ('fraction_count', 'value_plusminus', 'value_plusminus_sample', 'value_cv', 'value_paren_dispersion') THEN x[2] END secondary_value,
 CASE WHEN "rule" IN ('rr_ci', 'diff_ci', 'value_ci') THEN x[2] WHEN "rule" = 'range_to' THEN x[1] WHEN "rule" IN ('value_plusminus', 'value_plusminus_sample', 'value_paren_dispersion') THEN round(x[1] - x[2], 6) END lower_bound,
 CASE WHEN "rule" IN ('frac_pct', 'fraction_count') THEN x[2] WHEN "rule" = 'value_plusminus_sample' THEN x[3] WHEN "rule" = 'n_equals' THEN x[1] END sample_size,
 CASE WHEN "rule" IN ('frac_pct', 'n_pct', 'count_inequality_percent', 'rr_ci', 'percentage', 'inequality_percent') THEN '%' WHEN "rule" = 'diff_ci' THEN 'pp' WHEN "rule" = 'value_trailing_unit' THEN regexp_replace(replace(replace(regexp_extract(t, '[^0-9 ]+$'), '/day', '/d'), 'µg', 'mcg'), 'hrs?', 'h') END unit,
 CASE "rule" WHEN 'frac_pct' THEN {frac} WHEN 'n_pct' THEN CASE WHEN n > 0 THEN {arm} END WHEN 'inequality_percent' THEN 'INEQUALITY_UPPER:' || t[1]
  WHEN 'count_inequality_percent' THEN 'INEQUALITY_UPPER:' || regexp_extract(t, '[<≤]') || '; PCT_DERIVED_FROM_COUNT_LT:' || CASE WHEN n > 0 THEN 'ArmN=' || n::BIGINT ELSE 'fallback=0.1' END || '; PCT_LT_DISPLAY:' || regexp_replace(x[2]::VARCHAR, '\\.0$', '') END flags FROM v"""


@query("value_grammar", _grammar_sql())
def value_grammar(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey k", "cast(p_size + 1 as string) q", "cast(100 + p_partkey % 800 as string) s", "concat(cast(p_size % 90 as string), '.', cast(p_partkey % 10 as string)) d", "case when p_partkey % 3 > 0 then 50 + p_partkey % 300 end n")
    rows = p.withColumn("raw", F.expr(_shape(True))).withColumn("v", values.parse_value(F.col("raw"), F.col("n")))
    return rows.select("k", "raw", "v.rule", F.col("v.primary").alias("primary_value"), F.col("v.secondary").alias("secondary_value"), F.round("v.lower", 6).alias("lower_bound"), "v.sample_size", "v.unit", "v.flags")


@query("dose_extraction", """SELECT p_partkey k, (CASE p_partkey % 3 WHEN 0 THEN p_size + 1 WHEN 1 THEN p_size + 50 END)::DOUBLE dose, CASE p_partkey % 3 WHEN 0 THEN 'mg/d' WHEN 1 THEN 'mcg' END unit FROM part""")
def dose_extraction(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Drug "), (F.col("p_size") + 1).cast("string"), F.lit(" mg once daily"))).when(F.col("p_partkey") % 3 == 1, F.concat((F.col("p_size") + 1).cast("string"), F.lit(" to "), (F.col("p_size") + 50).cast("string"), F.lit(" µg"))).otherwise(F.lit("any dose of 5 mg"))
    amount, unit = values.dose(text)
    return p.select(F.col("p_partkey").alias("k"), amount.alias("dose"), unit.alias("unit"))


@query("html_to_text", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) digest FROM pages""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(values.strip_html(F.col("html"))).alias("digest"))


@query("price_histogram", """SELECT floor(l_extendedprice / 10000) * 10000 bucket, count(*) n, repeat('#', cast(ceil(20.0::DOUBLE * count(*) / max(count(*)) OVER ()) AS INT)) bar FROM lineitem GROUP BY 1""")
def price_histogram(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((F.floor(F.col("l_extendedprice") / 10000) * 10000).cast("double").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("bar", F.repeat(F.lit("#"), F.ceil(20.0 * F.col("n") / F.max("n").over(Window.partitionBy())).cast("int")))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, sf_dir):
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", lineitem=table(spark, sf_dir, "lineitem"))


@query("ordered_conversation_text", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) digest, count(*) turns FROM conversations GROUP BY 1")
def ordered_conversation_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat(F.col("role"), F.lit(": "), F.col("text")))
    text = relops.ordered_string_agg(c, ["conv_id"], "line", ["turn", "role", "text"], "\n", "all")
    return text.join(c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), "conv_id").select("conv_id", F.md5("all").alias("digest"), "turns")


@query("content_sha256_dedup", r"""SELECT sha256(regexp_replace(text, '\s+', ' ', 'g')) sha, min(doc_id) keep_id, count(*) copies FROM documents GROUP BY 1""")
def content_sha256_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.regexp_replace("text", r"[\t\n\f\r ]+", " "), 256).alias("sha")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


@query("token_rank_search", """WITH t AS (SELECT doc_id, lower(text) x FROM documents), s AS (SELECT doc_id, (length(x) - length(replace(x, 'tion', ''))) / 4 * 2 + (length(x) - length(replace(x, 'ing', ''))) / 3 score FROM t)
SELECT doc_id, score::BIGINT score FROM s ORDER BY score DESC, doc_id LIMIT 25""")  # fmt: skip
def token_rank_search(spark, sf_dir):
    """Keyword scores: weighted counts of occurrences that don't overlap; a top-25 report."""
    count = lambda w: F.size(F.split(F.lower("text"), w)) - 1
    s = table(spark, sf_dir, "documents").select("doc_id", (count("tion") * 2 + count("ing")).cast("long").alias("score"))
    return relops.page(s, [F.col("score").desc(), F.col("doc_id")], 1, 25)


def _soundex_sql(x: str) -> str:
    """Soundex of a text in SQL: digits of the letters, H and W left out, runs made one, then vowels left out."""
    code = f"replace(regexp_replace(translate(upper({x}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202'), '[^0-9]', '0', 'g'), '7', '')"
    for digit in "0123456":
        code = f"regexp_replace({code}, '{digit}+', '{digit}', 'g')"
    return f"rpad(upper(substr({x}, 1, 1)) || substr(replace(substr({code}, 2), '0', ''), 1, 3), 4, '0')"


@query("phonetic_search", f"""WITH s AS (SELECT p_partkey k, {_soundex_sql("p_name")} x, {_soundex_sql("'gear widget'")} y FROM part)
SELECT k, x code, ((substr(x, 1, 1) = substr(y, 1, 1))::INT + (substr(x, 2, 1) = substr(y, 2, 1))::INT + (substr(x, 3, 1) = substr(y, 3, 1))::INT + (substr(x, 4, 1) = substr(y, 4, 1))::INT) >= 3 AS close FROM s""")  # fmt: skip
def phonetic_search(spark, sf_dir):
    """All parts by how their names sound beside a wanted name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.soundex("p_name").alias("code"), (search.difference(F.col("p_name"), F.lit("gear widget")) >= 3).alias("close"))


_NAMES = "concat(CASE k % 3 WHEN 0 THEN 'The ' ELSE '' END, 'Alpha', CAST(k % 17 AS {t}), ' & Beta', CAST(k % 5 AS {t}), CASE k % 4 WHEN 0 THEN ' Pharmaceuticals, Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Ltd.' ELSE '' END)"


@query("company_normaliser", f"""WITH n AS (SELECT s_suppkey k, {_NAMES.replace('k %', 's_suppkey %').format(t='VARCHAR')} name FROM supplier)
SELECT k, name, 'ALPHA' || k % 17 || ' BETA' || k % 5 || CASE k % 4 WHEN 0 THEN ' PHARMACEUTICALS' ELSE '' END norm, CASE k % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'UK' END jurisdiction FROM n""")  # fmt: skip
def company_normaliser(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("name", F.expr(_NAMES.format(t="STRING")))
    return n.select("k", "name", entities.company(F.col("name")).alias("norm"), entities.jurisdiction(F.col("name")).alias("jurisdiction"))


@query("company_matching", """WITH a AS (SELECT DISTINCT 'Alpha' || s_suppkey % 17 || ' Beta' || s_suppkey % 5 x FROM supplier), o AS (SELECT DISTINCT 'Alpha' || s_suppkey % 13 || ' Beta' || s_suppkey % 5 || ' Gamma' x FROM supplier),
t AS (SELECT a.x applicant, o.x organisation, len(list_intersect(string_split(a.x, ' '), string_split(o.x, ' '))) c FROM a, o)
SELECT applicant, organisation, 2 tier, round(greatest(c / (5.0::DOUBLE - c), c / 2.0::DOUBLE), 6) score FROM (SELECT *, rank() OVER (PARTITION BY applicant ORDER BY greatest(c / (5.0::DOUBLE - c), c / 2.0::DOUBLE) DESC) r FROM t WHERE greatest(c / (5.0::DOUBLE - c), c / 2.0::DOUBLE) >= 0.67) WHERE r = 1""")  # fmt: skip
def company_matching(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda m, tail: F.concat(F.lit("Alpha"), (F.col("k") % m).cast("string"), F.lit(" Beta"), (F.col("k") % 5).cast("string"), F.lit(tail))
    got = entities.match_companies(s.select(name(17, "").alias("applicant")).distinct(), s.select(name(13, " Gamma").alias("organisation")).distinct())
    return got.withColumn("score", F.round("score", 6))


@query("bioequivalent_dedup", """WITH l AS (SELECT 'doc-' || o_orderkey DocumentGUID, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE 'A' END t, (o_custkey % 400)::VARCHAR n, o_orderdate d, o_orderkey % 4 v FROM orders),
b AS (SELECT CASE WHEN i = 0 THEN 'N' ELSE 'A' END t, s_suppkey::VARCHAR n, 'ING' || s_suppkey % 9 Ingredient, 'F' || s_suppkey % 2 DosageForm, 'R' || s_suppkey % 3 Route FROM supplier, (VALUES (0), (1)) x(i))
SELECT DocumentGUID, Ingredient, DosageForm, Route, t ApplType FROM (SELECT *, row_number() OVER (PARTITION BY Ingredient, DosageForm, Route ORDER BY t DESC, d DESC, v DESC, DocumentGUID) rn FROM l JOIN b USING (t, n)) WHERE rn = 1""")  # fmt: skip
def bioequivalent_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    labels = o.select(F.concat(F.lit("doc-"), "o_orderkey").alias("DocumentGUID"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "NDA").otherwise("anda "), (F.col("o_custkey") % 400).cast("string")).alias("ApplicationNumber"), F.col("o_orderdate").alias("EffectiveDate"), (F.col("o_orderkey") % 4).alias("VersionNumber"))
    s = table(spark, sf_dir, "supplier").withColumn("ApplType", F.explode(F.array(F.lit("N"), F.lit("A"))))
    part = lambda p, m: F.concat(F.lit(p), (F.col("s_suppkey") % m).cast("string"))
    listing = s.select("ApplType", F.col("s_suppkey").cast("string").alias("ApplNo"), part("ING", 9).alias("Ingredient"), part("F", 2).alias("DosageForm"), part("R", 3).alias("Route"), F.lit(True).alias("IsRLD"), F.lit(None).cast("date").alias("ApprovalDate"))
    return entities.bioequivalent_winners(labels, listing)


@query("version_concordance", """WITH m AS (SELECT o_custkey k, date_trunc('year', o_orderdate) y, count(*) n FROM orders GROUP BY 1, 2), x AS (SELECT k, y, n, lead(n) OVER (PARTITION BY k ORDER BY y) nx FROM m)
SELECT k, y, n, nx FROM x WHERE abs(n - nx) > 0.5 * greatest(n, nx)""")  # fmt: skip
def version_concordance(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.date_trunc("year", "o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    x = m.withColumn("nx", F.lead("n").over(Window.partitionBy("k").orderBy("y")))
    return x.filter(F.abs(F.col("n") - F.col("nx")) > 0.5 * F.greatest("n", "nx"))


@query("row_validation", """SELECT p_partkey k, list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'ORPHAN_ROW' END, CASE WHEN p_size % 7 = 0 THEN 'MISSING_PARAMETER' END, CASE WHEN p_size % 13 = 0 THEN 'MISSING_ARM_N' END, CASE WHEN p_size > 40 THEN 'BOUND_INVERSION' END], lambda x: x IS NOT NULL)::VARCHAR issues,
 CASE WHEN p_partkey % 11 = 0 OR p_size > 40 THEN 'Error' WHEN p_size % 7 = 0 OR p_size % 13 = 0 THEN 'Warning' ELSE 'Ok' END status,
 round(0.9::DOUBLE * (CASE WHEN p_partkey % 11 = 0 THEN 0.85 ELSE 1 END)::DOUBLE * (CASE WHEN p_size % 7 = 0 THEN 0.85 ELSE 1 END)::DOUBLE * (CASE WHEN p_size % 13 = 0 THEN 0.95 ELSE 1 END)::DOUBLE * (CASE WHEN p_size > 40 THEN 0.85 ELSE 1 END)::DOUBLE, 8) confidence FROM part""")  # fmt: skip
def row_validation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    issues = quality.row_issues(F.col("p_partkey") % 11 == 0, F.when(F.col("p_size") % 7 != 0, F.col("p_name")), F.lit("Percentage"), F.when(F.col("p_size") % 13 != 0, F.col("p_size")), F.lit("AdverseEvent"), F.col("p_size").cast("double"), F.lit(40.0), F.lit(0.9))
    rows = p.select(F.col("p_partkey").alias("k"), issues.alias("i"))
    return rows.select("k", F.concat(F.lit("["), F.array_join("i", ", "), F.lit("]")).alias("issues"), quality.status(F.col("i")).alias("status"), F.round(quality.adjusted_confidence(F.lit(0.9), F.col("i")), 8).alias("confidence"))


@query("containment_join", """WITH l AS (SELECT p_partkey k, 'U' || p_partkey % 50 || '+ U' || p_size lst FROM part) SELECT k, n_nationkey nation FROM l JOIN nation ON '+' || replace(lst, ' ', '') || '+' LIKE '%+U' || n_nationkey || '+%'""")
def containment_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("U"), (F.col("p_partkey") % 50).cast("string"), F.lit("+ U"), F.col("p_size").cast("string")).alias("lst"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("U"), "n_nationkey").alias("u"), F.col("n_nationkey").alias("nation"))
    return relops.containment_join(p, n, "lst", "u").select("k", "nation")


@query("pair_counts", """WITH d AS (SELECT DISTINCT s_nationkey i, l_partkey v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT x.i a, y.i b, count(*) n FROM d x JOIN d y ON x.v = y.v AND x.i < y.i GROUP BY 1, 2""")
def pair_counts(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return relops.pair_counts(d.select(F.col("s_nationkey").alias("i"), F.col("l_partkey").alias("v")), "i", "v")


@query("nested_orders", "SELECT o_orderkey, count(l_linenumber) n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS \"lines\" FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def nested_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    n = relops.nest(o, li, "o_orderkey", ["l_linenumber", "l_partkey"], "ls")
    return n.select("o_orderkey", F.size("ls").cast("long").alias("n_lines"), F.array_join(F.transform("ls", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@query("keyed_upsert", """SELECT c_custkey k, coalesce(n.p, 'none') v FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) p FROM orders GROUP BY 1) n ON o_custkey = c_custkey""")
def keyed_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("none").alias("v"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    return relops.upsert_latest(old, new, ["k"], "o_orderkey")


@query("event_flags_json", "SELECT event_type, count(*) n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT total FROM events GROUP BY 1")
def event_flags_json(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("grid_reconstruction", with_tables("Line") + """, r AS (SELECT *, 2 + row_number() OVER (PARTITION BY k ORDER BY n) nth FROM Line)
SELECT k "TextTableID", nth::INT "RowSeq", 'DataBody' "RowClass", c::INT "Col", ['Term', 'Arms > A', 'Arms > B'][c + 1] "HeaderPath", (CASE c WHEN 0 THEN n WHEN 1 THEN p ELSE s END)::VARCHAR "CellText", 'Divider' "Category", NULL::VARCHAR "Footnotes"
FROM r, (SELECT unnest(range(0, 3)) c)""")  # fmt: skip
def grid_reconstruction(spark, sf_dir):
    """Orders as printed tables: a two-row header with a spanning cell, a divider and data rows."""
    ship_package(spark)
    cols = "TextTableID, CellID, RowSeq, CellSeq, RowGroupType, CellType, RowSpan, ColSpan, CellText".split(", ")
    li = spark.sql(TABLES["Line"], lineitem=table(spark, sf_dir, "lineitem"))
    body = li.select(F.col("k").alias("t"), F.posexplode(F.array(F.col("n").cast("long"), "p", "s")).alias("c", "v"), "n")
    body = body.select("t", (F.col("n") * 10 + F.col("c")).alias("i"), (F.col("n") + 10).alias("r"), "c", F.lit("Body").alias("g"), F.lit("td").alias("k"), F.lit(1).alias("rs"), F.lit(1).alias("cs"), F.col("v").cast("string").alias("x"))
    names = ("i", "r", "c", "g", "k", "rs", "cs", "x")
    fixed = [(1, 1, 0, "Header", "th", 2, 1, "Term"), (2, 1, 1, "Header", "th", 1, 2, "Arms <sup>a</sup>"), (3, 2, 0, "Header", "th", 1, 1, "A"), (4, 2, 1, "Header", "th", 1, 1, "B"), (5, 5, 0, "Body", "td", 1, 3, "Divider"), (6, 99, 0, "Footer", "td", 1, 3, "a note")]
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in fixed])
    heads = li.select(F.col("k").alias("t")).distinct().withColumn("h", F.explode(structs))
    kinds = dict(body.dtypes)
    return grid.reconstruct(heads.select("t", *[F.col(f"h.{c}").cast(kinds[c]).alias(c) for c in names]).unionByName(body).toDF(*cols))


@query("streaming_event_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2")
def streaming_event_counts(spark, sf_dir):
    """Events as arriving files: hourly counts, run until everything that has arrived is processed."""
    from tessera.streaming import ingest

    schema = table(spark, sf_dir, "events").schema
    folder = f"{shared_folder(spark)}/hourly-{uuid.uuid4().hex}"
    counts = ingest.windowed_counts(ingest.arriving(spark, f"{sf_dir}/events.parque[t]", schema))
    return ingest.run_once(counts, ["start", "event_type"], folder).withColumn("total", F.round("total", 4))
