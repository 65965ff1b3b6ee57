"""Dictionaries, near names, populations, ranked searches, application and ingredient matches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import applications, populations, terms, text_index
from tessera.plans.domain import TABLES, with_tables
from tessera.plans.registry import query
from tessera.session import ship_package, table

_KEY = "regexp_replace(upper({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
#: Event names as they are printed, and the tables that they are looked up in; the same text runs in Spark and in the oracle.
EVENTS = """select l.k, l.n, case when l.f = 'A' then concat(upper(p_name), '*') when l.f = 'N' then concat(p_name, ' ', p_type) else concat(' ', replace(p_name, ' ', '  ')) end as ParameterName,
 case when l.q > 45 then null when l.st = 'O' then concat(split_part(p_name, ' ', 2), ' disorders') else p_brand end as ParameterCategory from {Line} l join {part} on l.p = p_partkey"""
LOOKUPS = {
    "dictionary": "select distinct p_name as Name, concat(split_part(p_name, ' ', 2), ' disorders') as System from {part} where p_name like 'b%' or p_name like 's%'",
    "variants": "select distinct concat(p_name, ' ', p_type) as Variant, p_name as Name from {part} where p_type in ('PROMO', 'SMALL')",
    "categories": "select distinct p_brand as Alias, case when p_brand like '%1' then 'ring disorders' end as System from {part} where p_brand like '%1' or p_brand like '%2'",
    "excluded": "select distinct p_name as Name from {part} where p_name like 'cold anvil'",
}
PATTERNS = [("GIZMO", "gizmo disorders"), ("ROD", "rod disorders")]
_CASE = "CASE " + " ".join(f"WHEN contains({{0}}, '{p}') THEN '{s}'" for p, s in PATTERNS) + " END"


def _part(sql: str) -> str:
    return sql.replace("{part}", "part").replace("{Line}", "Line")


_TERMS = with_tables("Line") + f""", ev AS ({_part(EVENTS)}), d AS (SELECT *, {_KEY.format('Name')} dk FROM ({_part(LOOKUPS['dictionary'])})), v AS (SELECT Name vn, {_KEY.format('Variant')} vk FROM ({_part(LOOKUPS['variants'])})), c AS (SELECT System cs, {_KEY.format('Alias')} ck FROM ({_part(LOOKUPS['categories'])})),
x AS (SELECT {_KEY.format('Name')} xk FROM ({_part(LOOKUPS['excluded'])})), o AS (SELECT DISTINCT System os, {_KEY.format('System')} ok FROM d),
r AS (SELECT ev.*, {_KEY.format('ParameterName')} nk, {_KEY.format("coalesce(ParameterCategory, '')")} gk FROM ev),
j AS (SELECT r.*, vn, CASE WHEN vn IS NULL THEN nk ELSE {_KEY.format('vn')} END lk FROM r LEFT JOIN v ON vk = nk WHERE nk NOT IN (SELECT xk FROM x)),
m AS (SELECT j.*, d.Name sp, d.System sy, os, cs, ck IS NOT NULL met, {_CASE.format('lk')} np, {_CASE.format('gk')} cp FROM j LEFT JOIN d ON dk = lk LEFT JOIN o ON ok = gk LEFT JOIN c ON ck = gk),
t AS (SELECT *, trim(regexp_replace(regexp_replace(ParameterName, '[*]+$', ''), '\\s+', ' ', 'g')) cl, coalesce(sy, np) bn, CASE WHEN os IS NOT NULL THEN os WHEN met AND cs IS NULL THEN NULL ELSE coalesce(cs, cp) END bc FROM m),
u AS (SELECT *, coalesce(vn, sp, upper(substr(cl, 1, 1)) || lower(substr(cl, 2))) nm, coalesce(bn, bc) sys FROM t)"""


@query("term_dictionary", _TERMS + """ SELECT k, n, nm "ParameterName", sys "ParameterCategory", CASE WHEN vn IS NOT NULL THEN 'variant' WHEN sp IS NOT NULL THEN 'dictionary' ELSE 'text' END "NameLayer",
 CASE WHEN sy IS NOT NULL THEN 'name' WHEN np IS NOT NULL THEN 'name-pattern' WHEN os IS NOT NULL THEN 'category' WHEN met AND cs IS NULL THEN 'category-none' WHEN cs IS NOT NULL THEN 'category-alias' WHEN cp IS NOT NULL THEN 'category-pattern' ELSE 'unmapped' END "SystemLayer",
 nullif(concat_ws(';', CASE WHEN nm <> ParameterName THEN 'AE_STD:NAME' END, CASE WHEN sys IS NULL THEN 'AE_STD:SOC_UNMAPPED' WHEN ParameterCategory IS NULL THEN 'AE_STD:SOC_FILLED' WHEN sys <> ParameterCategory THEN CASE WHEN bn IS NOT NULL AND bc IS NOT NULL AND bn <> bc THEN 'AE_STD:SOC_ALIGNED' ELSE 'AE_STD:SOC' END END), '') "StdFlags" FROM u""")  # fmt: skip
def term_dictionary(spark, sf_dir):
    """Canonical names and systems of all event rows by layers of dictionary tables."""
    return _standardised(spark, sf_dir).select("k", "n", "ParameterName", "ParameterCategory", "NameLayer", "SystemLayer", "StdFlags")


def _standardised(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    line = spark.sql(TABLES["Line"], lineitem=table(spark, sf_dir, "lineitem"))
    looked = {n: spark.sql(sql, part=part) for n, sql in LOOKUPS.items()}
    return terms.standardise(spark.sql(EVENTS, Line=line, part=part), looked["dictionary"], looked["variants"], looked["categories"], looked["excluded"], PATTERNS)


@query("unmapped_terms", _TERMS + """ SELECT nm "ParameterName", CASE WHEN met AND cs IS NULL THEN 'category-none' ELSE 'unmapped' END "SystemLayer", count(*) n FROM u WHERE sys IS NULL GROUP BY 1, 2""")
def unmapped_terms(spark, sf_dir):
    return terms.unmapped(_standardised(spark, sf_dir))


@query("near_names", """WITH n AS (SELECT DISTINCT concat(p_name, ' ', p_brand) x FROM part), p AS (SELECT a.x a, b.x b, 1 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x))::DOUBLE s FROM n a JOIN n b ON a.x < b.x)
SELECT a, b, round(s, 9) similarity FROM p WHERE s >= 0.8 - 1e-12""")  # fmt: skip
def near_names(spark, sf_dir):
    """All pairs of distinct names within a fifth of the longer one's length."""
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return populations.near(names).select("a", "b", F.round("similarity", 9).alias("similarity"))


_TITLES = "select p_partkey as id, case when p_size % 3 = 0 then null else concat('Table 2: use in ', upper(p_name), ' (', p_type, ')') end as Caption, case when p_size % 2 = 0 then concat(split_part(p_name, ' ', 1), ' gear, general') when p_size % 5 = 0 then '' end as SectionTitle, concat('part/', p_name) as ParentTitle from {part}"


@query("table_population", f"""WITH t AS ({_part(_TITLES)}), a AS (SELECT DISTINCT p_name al, concat('Users of ', p_name) cn FROM part),
u AS (SELECT id, 1 w, lower(Caption) x FROM t UNION ALL SELECT id, 2, lower(SectionTitle) FROM t UNION ALL SELECT id, 3, lower(ParentTitle) FROM t),
m AS (SELECT id, w, cn FROM (SELECT id, w, cn, row_number() OVER (PARTITION BY id, w ORDER BY length(al) DESC, strpos(x, al)) nth FROM u JOIN a ON contains(x, al)) WHERE nth = 1),
n AS (SELECT t.*, c.cn c, coalesce(s.cn, CASE WHEN c.cn IS NULL THEN p.cn END) s FROM t LEFT JOIN m c ON c.id = t.id AND c.w = 1 LEFT JOIN m s ON s.id = t.id AND s.w = 2 LEFT JOIN m p ON p.id = t.id AND p.w = 3),
r AS (SELECT *, 1 - levenshtein(lower(c), lower(s)) / greatest(length(c), length(s))::DOUBLE alike FROM n)
SELECT id, CASE WHEN alike >= 0.5 THEN CASE WHEN length(c) >= length(s) THEN c ELSE s END ELSE coalesce(s, c) END "Population", round(CASE WHEN alike >= 0.5 THEN least(0.95, 0.7 + alike * 0.3) WHEN alike IS NOT NULL THEN 0.4 WHEN s IS NOT NULL THEN 0.8 WHEN c IS NOT NULL THEN 0.7 ELSE 0 END, 9)::DOUBLE "PopulationConfidence" FROM r""")  # fmt: skip
def table_population(spark, sf_dir):
    """Populations from captions against section titles, by an alias table made of all part names."""
    ship_package(spark)
    part = table(spark, sf_dir, "part")
    aliases = part.select(F.col("p_name").alias("Alias"), F.concat(F.lit("Users of "), "p_name").alias("Canonical")).distinct()
    found = populations.table_population(spark.sql(_TITLES, part=part), aliases)
    return found.select("id", "Population", F.round("PopulationConfidence", 9).alias("PopulationConfidence"))


_ASKED = "select distinct concat(p_type, ' ', p_brand) as qid, concat('Which ', p_type, ' part is of ', p_brand, ' with a big heart?') as text from {part}"
_SYNONYMS = "select 'Big Heart' as Key, 'gear' as Synonym union all select 'big heart', 'red ring' union all select 'promo part', 'cold' union all select 'heart big', 'never'"
_ENTRIES = "select p_partkey as id, concat(p_name, '; ', p_type, ' ', p_brand, '; ', upper(p_name), ' ', p_name) as text from {part}"
_PREPARED = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


@query("indication_match", f"""WITH q AS (SELECT qid, {_PREPARED.format('text')} t FROM ({_part(_ASKED)})), e AS (SELECT id, replace({_PREPARED.format('text')}, ' ', '  ') t FROM ({_part(_ENTRIES)})),
w AS (SELECT DISTINCT qid, unnest(string_split(trim(t), ' ')) term FROM q), stop AS (SELECT unnest({list(text_index.STOP_WORDS)}) s),
k AS (SELECT qid, lower(Synonym) term FROM q JOIN ({_SYNONYMS}) ON contains(t, ' ' || lower(Key) || ' ')),
a AS (SELECT qid, term FROM w WHERE length(term) > 1 AND term NOT IN (SELECT s FROM stop) UNION SELECT qid, term FROM k),
p AS (SELECT DISTINCT term, ' ' || replace(term, ' ', '  ') || ' ' pc FROM a), h AS (SELECT term, id, (length(t) - length(replace(t, pc, ''))) // length(pc) n FROM p JOIN e ON contains(t, pc)),
s AS (SELECT qid, id, sum(n) score FROM a JOIN h USING (term) GROUP BY 1, 2)
SELECT qid, id, score::BIGINT "Score", nth::INT "Rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) nth FROM s) WHERE nth <= 10""")  # fmt: skip
def indication_match(spark, sf_dir):
    """The ten best entries of each of many questions, by their words, synonyms and phrases; a top report for each."""
    part = table(spark, sf_dir, "part")
    entries = spark.sql(_ENTRIES, part=part)
    asked = text_index.terms(spark.sql(_ASKED, part=part), spark.sql(_SYNONYMS))
    return text_index.best_of_texts(entries, asked, 10).select("qid", "id", F.col("Score").cast("bigint").alias("Score"), "Rank")


_LABELLED = "select distinct case s_suppkey % 3 when 0 then concat('NDA', cast(s_suppkey * 3 + 100 as string)) when 1 then concat('anda ', cast(s_suppkey + 100 as string)) else concat('BLA-', cast(s_suppkey * 7 as string)) end as a from {supplier}"
_LISTED = "select distinct case s_suppkey % 4 when 0 then concat('nda', cast(s_suppkey + 100 as string)) when 1 then concat('N', cast(s_suppkey + 100 as string)) else concat('ANDA', cast(s_suppkey * 13 + 1000 as string)) end as b from {supplier}"


def _numbers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return spark.sql(_LABELLED, supplier=s), spark.sql(_LISTED, supplier=s)


_N = f"WITH l AS (SELECT *, replace(upper(a), ' ', '') f, regexp_replace(a, '[^0-9]', '', 'g') d FROM ({_LABELLED.replace('{supplier}', 'supplier')})), r AS (SELECT *, replace(upper(b), ' ', '') g, regexp_replace(b, '[^0-9]', '', 'g') e FROM ({_LISTED.replace('{supplier}', 'supplier')}))"


@query("application_exact", _N + """ SELECT a, b, 'exact' "Tier" FROM l JOIN r ON f = g UNION ALL SELECT a, b, 'digits' FROM l JOIN r ON d = e WHERE f NOT IN (SELECT g FROM r)""")
def application_exact(spark, sf_dir):
    return applications.by_number(*_numbers(spark, sf_dir))


@query("application_substring", _N + " SELECT a, b FROM l JOIN r ON length(d) >= 3 AND length(e) >= 3 AND contains(e, d)")
def application_substring(spark, sf_dir):
    return applications.inside(*_numbers(spark, sf_dir))


#: An order's ingredients in the order of its lines, with repeats, and each set of them once, backwards and with its last name again.
_LISTS = "select k as a, array_join(transform(array_sort(collect_list(struct(n, w))), x -> x.w), ' ; ') as list from (select k, n, split_part(p_name, ' ', 1) as w from {Line} join {part} on p = p_partkey) x group by k"


@query("ingredient_sets", with_tables("Line") + """, w AS (SELECT k, n, split_part(p_name, ' ', 1) w FROM Line JOIN part ON p = p_partkey), s AS (SELECT k, list_sort(list(DISTINCT upper(w))) x FROM w GROUP BY 1)
SELECT k a, array_to_string(list_reverse(x), ';') || ';' || x[1] b, len(x)::INT "Names" FROM s""")  # fmt: skip
def ingredient_sets(spark, sf_dir):
    """Ingredient lists that name the same set, whatever their order and repeats."""
    line = spark.sql(TABLES["Line"], lineitem=table(spark, sf_dir, "lineitem"))
    left = spark.sql(_LISTS, Line=line, part=table(spark, sf_dir, "part"))
    names = left.select(applications.ingredients(F.col("list")).alias("x")).distinct()
    right = names.select(F.concat_ws(";", F.reverse("x"), F.element_at("x", 1)).alias("b")).select("b", F.col("b").alias("list"))
    return applications.same_ingredients(left, right)
