"""The parameterised label queries with one set of parameters each, and their SQL: filters, orders and pages over the views' SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import label_queries  # noqa: F401  (registers the views)
from tessera.plans import label_search as S
from tessera.plans import label_views as V
from tessera.plans.domain import tables, with_tables
from tessera.plans.registry import ORACLES, query
from tessera.session import table


def searched(name: str, view: str, f: Callable[[S.Tables], DataFrame], where: str = "true", order: str | None = None, limit: int | None = None, offset: int = 0, columns: str = "*") -> None:
    """Register a search over a view: the SQL filters, orders and pages the view's own SQL."""
    sql = f"SELECT {columns} FROM ({ORACLES[view]}) WHERE {where}"
    if limit is not None:
        sql += f" ORDER BY {order} LIMIT {limit} OFFSET {offset}"
    query(name, sql)(lambda spark, sf_dir: f(tables(spark, sf_dir)))


_APP = "upper(replace(ApplicationNumber, ' ', ''))"
searched("search_by_application", "view_products_by_application", lambda t: S.by_application(t, "nda 12", (2, 40)), f"{_APP} = 'NDA12' OR starts_with({_APP}, 'NDA12') OR contains({_APP}, '12')", "ProductID, DocumentGUID", 40, 40)
searched("search_application_summaries", "view_application_summary", lambda t: S.application_summaries(t, "bla; anda1"), "lower(ApplicationNumber) LIKE '%bla%' OR lower(ApplicationNumber) LIKE '%anda1%'")
searched("search_by_class", "view_products_by_class", lambda t: S.by_class(t, "[moa], gear"), "lower(ClassDisplayName) LIKE '%[moa]%' OR lower(ClassDisplayName) LIKE '%gear%'")
searched("search_by_class_exact", "view_products_by_class", lambda t: S.by_class_exact(t, "N40"), "ClassCode = 'N40'")
searched("search_class_edges", "view_class_hierarchy", lambda t: S.class_edges(t, (3, 100)), order="ParentName, ChildName, ParentCode, ChildCode", limit=100, offset=200)
searched("search_class_summaries", "view_class_summary", lambda t: S.class_summaries(t, (1, 75)), order="ProductCount DESC, ClassCode", limit=75)
searched("search_active_counts", "view_active_ingredient_summary", lambda t: S.ingredient_counts(t, True, "ring, widget", 5), "(lower(SubstanceName) LIKE '%ring%' OR lower(SubstanceName) LIKE '%widget%') AND ProductCount >= 5")
searched("search_inactive_counts", "view_inactive_ingredient_summary", lambda t: S.ingredient_counts(t, False, None, 3), "ProductCount >= 3")
searched("search_by_ingredient_code", "view_products_by_ingredient", lambda t: S.by_ingredient(t, "U120", "ignored"), "UNII = 'U120'")
searched("search_by_ingredient_text", "view_products_by_ingredient", lambda t: S.by_ingredient(t, None, "BOLT 4"), "lower(SubstanceName) LIKE '%bolt%' OR lower(SubstanceName) LIKE '%4%'")
searched("search_ingredient_summaries", "view_ingredient_summary", lambda t: S.ingredient_summaries(t, "gear", 10), "lower(SubstanceName) LIKE '%gear%' AND ProductCount >= 10")
searched("search_ingredients_advanced", "view_ingredients_active", lambda t: S.ingredients(t, "active", None, "4", None, "NDA", "red gear"), "ApplicationType = 'NDA' AND lower(SubstanceName) LIKE '%4%' AND (lower(ProductName) LIKE '%red%' OR lower(ProductName) LIKE '%gear%')")
searched("search_by_ndc", "view_products_by_ndc", lambda t: S.by_ndc(t, "10012-"), "lower(ProductCode) LIKE '%10012-%'")
searched("search_by_package_ndc", "view_package_by_ndc", lambda t: S.by_package_ndc(t, "-77-"), "lower(PackageCode) LIKE '%-77-%'")
searched("search_by_labeler", "view_products_by_labeler", lambda t: S.by_labeler(t, "#000000012 #000000345"), "lower(LabelerName) LIKE '%#000000012%' OR lower(LabelerName) LIKE '%#000000345%'")
searched("search_labeler_summaries", "view_labeler_summary", lambda t: S.labeler_summaries(t, (2, 60)), order="ProductCount DESC, OrganizationID", limit=60, offset=60)
searched("search_documents_of_set", "view_document_navigation", lambda t: S.documents(t, "set-77"), "SetGUID = 'set-77'")
searched("search_latest_documents", "view_document_navigation", lambda t: S.documents(t, None, True), "IsLatestVersion = 1")
searched("search_versions", "view_version_history", lambda t: S.versions(t, "set-77"), "SetGUID = 'set-77' OR DocumentGUID = 'set-77'")
searched("search_sections", "view_section_navigation", lambda t: S.sections(t, "34067-9").withColumn("ParentSectionID", F.col("ParentSectionID").cast("string")), "lower(SectionCode) LIKE '%34067-9%'")
searched("search_section_types", "view_section_type_summary", S.section_types)
searched("search_section_texts", "view_section_content", lambda t: S.section_texts(t, 7), "DocumentID = 7")
searched("search_markdown", "view_section_markdown", lambda t: S.markdown(t, "doc-7"), "DocumentGUID = 'doc-7'")
searched("search_interactions", "view_drug_interaction_lookup", lambda t: S.interactions(t, ["U12", "U400"]), "UNII IN ('U12', 'U400')")
searched("search_controlled", "view_dea_schedule", lambda t: S.controlled(t, "C2"), "DEAScheduleCode = 'C2'")
searched("search_products", "view_product_summary", lambda t: S.products(t, "red gear"), "lower(ProductName) LIKE '%red%' OR lower(ProductName) LIKE '%gear%'")
searched("search_inventory", "view_inventory", lambda t: S.inventory(t, "TOTALS"), "Category = 'TOTALS'")
searched("search_latest_labels", "view_latest_label", lambda t: S.latest_labels(t, None, "ring", "4"), "lower(ProductName) LIKE '%ring%' AND lower(SubstanceName) LIKE '%4%'")
searched("search_indications", "view_indications", lambda t: S.indications(t, None, "ring"), "lower(ProductName) LIKE '%ring%'")
_TEXT = "lower(ClassDisplayName) LIKE '%{0}%' OR contains('{0}', lower(ClassDisplayName))"
searched("search_classes_for_query", "view_class_summary", lambda t: S.classes_for_query(t, "Red Widget"), _TEXT.format("red widget"))
searched("search_classes_by_synonym", "view_class_summary", lambda t: S.classes_for_query(t, "something for the gear box", {"gear box": ["gear", "ring"]}), _TEXT.format("something for the gear box") + " OR lower(ClassDisplayName) LIKE '%gear%' OR lower(ClassDisplayName) LIKE '%ring%'")


@query("search_related_of_product", with_tables("Product", "MarketingCategory", "Ingredient", "IngredientSubstance") + """, m AS (
 SELECT DISTINCT 'SameApplicationNumber' kind, ApplicationOrMonographIDValue via, ProductID, ProductName FROM MarketingCategory JOIN Product USING (ProductID) WHERE ApplicationOrMonographIDValue IS NOT NULL
 UNION ALL SELECT DISTINCT 'SameActiveIngredient', UNII, ProductID, ProductName FROM Ingredient JOIN IngredientSubstance USING (IngredientSubstanceID) JOIN Product USING (ProductID) WHERE ClassCode <> 'IACT' AND UNII IS NOT NULL)
SELECT a.ProductID SourceProductID, b.ProductID RelatedProductID, b.ProductName RelatedProductName, a.via SharedValue, a.kind RelationshipType FROM (SELECT * FROM m WHERE ProductID = 71) a JOIN m b ON a.kind = b.kind AND a.via = b.via
WHERE a.ProductID <> b.ProductID AND a.ProductName <> b.ProductName""")  # fmt: skip
def search_related_of_product(spark, sf_dir):
    return S.related(tables(spark, sf_dir), 71)


@query("search_related_ingredients", f"""WITH v AS ({ORACLES["view_ingredients_all"]}), hit AS (SELECT DISTINCT ProductID FROM v WHERE lower(SubstanceName) LIKE '%gear 7%'),
g AS (SELECT ProductID, ProductName, list_sort(list(DISTINCT SubstanceName) FILTER (ClassCode <> 'IACT')) a, list_sort(list(DISTINCT SubstanceName) FILTER (ClassCode = 'IACT')) i FROM v WHERE ProductID IN (SELECT ProductID FROM hit) GROUP BY 1, 2)
SELECT ProductID, ProductName, coalesce(array_to_string(a, '; '), '') Active, coalesce(array_to_string(i, '; '), '') Inactive FROM g""")  # fmt: skip
def search_related_ingredients(spark, sf_dir):
    found = S.related_ingredients(tables(spark, sf_dir), "gear_7")
    return found.select("ProductID", "ProductName", F.array_join("Active", "; ").alias("Active"), F.array_join("Inactive", "; ").alias("Inactive"))


@query("search_sharing_ingredients", f"""WITH v AS ({ORACLES["view_ingredients_all"]}) SELECT DISTINCT ProductID, ProductName FROM v WHERE UNII IN (SELECT UNII FROM v WHERE ApplicationNumber = '12')""")
def search_sharing_ingredients(spark, sf_dir):
    return S.sharing_ingredients(tables(spark, sf_dir), "12")


@query("search_latest_label_sections", f"""WITH l AS ({ORACLES["view_latest_label"]}), c AS ({ORACLES["view_section_content"]}), d AS (SELECT o_orderkey DocumentID, 'doc-' || o_orderkey DocumentGUID FROM orders)
SELECT UNII, ProductName, DocumentGUID, c.* FROM l JOIN d USING (DocumentGUID) JOIN c USING (DocumentID) WHERE UNII = 'U500'""")  # fmt: skip
def search_latest_label_sections(spark, sf_dir):
    out = S.latest_label_sections(tables(spark, sf_dir, once=True), "U500")
    return out.select("UNII", "ProductName", "DocumentGUID", "DocumentID", "SectionID", "SectionCode", "Title", "ContentText", "SequenceNumber")


@query("search_expiring_patents", f"""WITH v AS (SELECT * FROM ({ORACLES["view_orange_book_patents"]}) WHERE PatentExpireDate BETWEEN TIMESTAMP '2026-02-01' AND TIMESTAMP '2026-02-01' + INTERVAL 12 MONTH AND (lower(TradeName) LIKE '%1%'))
SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.ApplNo = v.ApplNo AND x.PatentNo = v.PatentNo || '*PED')""")  # fmt: skip
def search_expiring_patents(spark, sf_dir):
    return S.expiring_patents(tables(spark, sf_dir), "2026-02-01", 12, trade_name="1")


@query("search_patent_count", f"""SELECT count(DISTINCT PatentNo) Patents FROM ({ORACLES["view_orange_book_patents"]}) WHERE PatentExpireDate BETWEEN TIMESTAMP '2026-02-01' AND TIMESTAMP '2026-02-01' + INTERVAL 6 MONTH""")
def search_patent_count(spark, sf_dir):
    return S.expiring_patents(tables(spark, sf_dir), "2026-02-01", 6, drop_twins=False).agg(F.countDistinct("PatentNo").alias("Patents"))


@query("search_activity_of_user", "SELECT event_id, ts, user_id, event_type FROM events WHERE user_id = 42 AND event_type = (SELECT min(event_type) FROM events)")
def search_activity_of_user(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    first = log.agg(F.min("event_type")).first()[0]
    return S.activity(log, user=42, endpoint=first)


@query("search_activity_in_range", "SELECT event_id, ts, user_id, event_type FROM events WHERE ts BETWEEN (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events) AND (SELECT date_trunc('day', min(ts)) + INTERVAL 3 DAY FROM events)")
def search_activity_in_range(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    first = log.agg(F.date_trunc("day", F.min(F.col("ts").cast("timestamp"))).alias("d")).select(*[F.date_format(F.col("d") + F.make_interval(days=F.lit(n)), "yyyy-MM-dd HH:mm:ss").alias(f"d{n}") for n in (1, 3)]).first()
    return S.activity(log, since=first["d1"], until=first["d3"])


@query("search_favourites", f"""SELECT user_id, DocumentGUID, created, ProductName FROM (SELECT user_id, 'doc-' || event_id DocumentGUID, ts created FROM events) JOIN (SELECT DocumentGUID, ProductName FROM ({ORACLES["view_product_summary"]})) USING (DocumentGUID) WHERE user_id = 42""")
def search_favourites(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("doc-"), F.col("event_id").cast("string")).alias("DocumentGUID"), F.col("ts").alias("created"))
    summaries = V.product_summary(tables(spark, sf_dir)).select("DocumentGUID", "ProductName")
    return S.favourites(marks, summaries, 42).select("user_id", "DocumentGUID", "created", "ProductName")


@query("search_favourite_toggle", """WITH m AS (SELECT DISTINCT user_id, 'doc-' || event_id % 50 DocumentGUID FROM events)
SELECT user_id, DocumentGUID FROM m WHERE NOT (user_id = 42 AND DocumentGUID = 'doc-7') UNION ALL SELECT 42, 'doc-7' WHERE NOT EXISTS (SELECT 1 FROM m WHERE user_id = 42 AND DocumentGUID = 'doc-7')""")  # fmt: skip
def search_favourite_toggle(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("doc-"), (F.col("event_id") % 50).cast("string")).alias("DocumentGUID"), F.lit("2026-01-01").alias("created")).distinct()
    return S.toggle(marks, 42, "doc-7", "2026-01-02").select("user_id", "DocumentGUID")
