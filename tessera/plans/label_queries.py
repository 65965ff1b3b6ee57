"""Registered label views and searches, with their SQL over the same label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import search
from tessera.operators.relops import page
from tessera.plans import label_views as V
from tessera.plans.domain import line_reads, tables, with_tables
from tessera.plans.registry import query

_SPINE = ("Product", "Section", "StructuredBody", "Document", "DocumentAuthor", "Organization")
_LAB = """, lab AS (SELECT a.DocumentID, a.OrganizationID, o.OrganizationName LabelerName FROM DocumentAuthor a
  LEFT JOIN Organization o USING (OrganizationID) WHERE AuthorType = 'Labeler')"""
_SP = (
    _LAB
    + """, sp AS (SELECT p.*, s.DocumentID, s.SectionCode, d.DocumentGUID, d.SetGUID, d.VersionNumber, d.EffectiveTime, lab.OrganizationID, lab.LabelerName
  FROM Product p JOIN Section s USING (SectionID) JOIN StructuredBody b ON b.StructuredBodyID = s.StructuredBodyID
  JOIN Document d ON d.DocumentID = b.DocumentID LEFT JOIN lab ON lab.DocumentID = d.DocumentID)"""
)
_CONTENT = """, items AS (SELECT SectionTextContentID, string_agg(ItemText, ' ' ORDER BY SequenceNumber, TextListItemID) ListText FROM TextListItem GROUP BY 1),
content AS (SELECT s.DocumentID, s.SectionID, s.SectionCode, s.Title,
   string_agg(coalesce(c.ContentText, i.ListText), ' ' ORDER BY c.SequenceNumber, c.SectionTextContentID) ContentText
  FROM Section s JOIN SectionTextContent c ON c.SectionID = s.SectionID LEFT JOIN items i ON i.SectionTextContentID = c.SectionTextContentID
  GROUP BY 1, 2, 3, 4 HAVING length(string_agg(coalesce(c.ContentText, i.ListText), ' ')) > 3)"""


def view(name: str, need: tuple[str, ...], sql: str, f, spine: str = "") -> None:
    """Register one view: f takes the label tables."""
    head = with_tables(*(_SPINE if spine == _SP else ("DocumentAuthor", "Organization") if spine == _LAB else ()), *need)
    once = line_reads(*(_SPINE if spine == _SP else ()), *need) > 2
    query(name, head + spine + "\n" + sql)(lambda spark, sf_dir: f(tables(spark, sf_dir, once)))


view("view_products_by_application", ("MarketingCategory",), """SELECT ApplicationOrMonographIDValue ApplicationNumber, CategoryCode, CategoryDisplayName, ApprovalDate, ProductID, ProductName, DocumentGUID, SetGUID, VersionNumber, LabelerName
FROM MarketingCategory JOIN sp USING (ProductID) WHERE ApplicationOrMonographIDValue IS NOT NULL""", V.products_by_application, _SP)  # fmt: skip
view("view_application_summary", ("MarketingCategory",), """SELECT ApplicationOrMonographIDValue ApplicationNumber, CategoryCode, CategoryDisplayName, min(ApprovalDate) EarliestApproval, max(ApprovalDate) LatestApproval,
 count(DISTINCT ProductID) ProductCount, count(DISTINCT DocumentGUID) DocumentCount, count(DISTINCT SetGUID) LabelSetCount, max(EffectiveTime) MostRecentLabel
FROM MarketingCategory JOIN sp USING (ProductID) WHERE ApplicationOrMonographIDValue IS NOT NULL GROUP BY 1, 2, 3""", V.application_summary, _SP)  # fmt: skip
_CLASS = """FROM PharmacologicClass c JOIN PharmacologicClassLink l USING (PharmacologicClassID) JOIN ActiveMoiety m USING (PharmSubstanceID)
 JOIN IngredientSubstance s ON s.IngredientSubstanceID = m.IngredientSubstanceID JOIN Ingredient i ON i.IngredientSubstanceID = s.IngredientSubstanceID AND i.ClassCode <> 'IACT'
 JOIN sp ON sp.ProductID = i.ProductID
WHERE NOT EXISTS (SELECT 1 FROM PharmClassDosageFormExclusion e WHERE e.ClassCode = c.ClassCode AND e.FormDisplayName = sp.FormDisplayName AND e.IsActive = 1)"""
_CLASS_NEED = ("PharmacologicClass", "PharmacologicClassLink", "ActiveMoiety", "IngredientSubstance", "Ingredient", "PharmClassDosageFormExclusion")
_CLASS_COLS = "SELECT c.ClassCode, ClassDisplayName, SubstanceName, UNII, sp.ProductID, ProductName, FormDisplayName, DocumentGUID, LabelerName "
view("view_products_by_class", _CLASS_NEED, _CLASS_COLS + _CLASS + " AND UNII IS NOT NULL", V.class_products, _SP)
view("view_class_by_active_ingredient", _CLASS_NEED, _CLASS_COLS + _CLASS, lambda t: V.class_products(t, need_unii=False), _SP)
view("view_class_hierarchy", ("PharmacologicClass", "PharmacologicClassHierarchy"), """SELECT p.ClassCode ParentCode, p.ClassDisplayName ParentName, c.ClassCode ChildCode, c.ClassDisplayName ChildName FROM PharmacologicClassHierarchy h
JOIN PharmacologicClass p ON p.PharmacologicClassID = h.ParentPharmacologicClassID JOIN PharmacologicClass c ON c.PharmacologicClassID = h.ChildPharmacologicClassID""", V.class_hierarchy)  # fmt: skip
view("view_class_summary", _CLASS_NEED[:5], """SELECT c.ClassCode, c.ClassDisplayName, count(DISTINCT s.UNII) SubstanceCount, count(DISTINCT i.ProductID) ProductCount, count(DISTINCT m.ActiveMoietyID) MoietyCount
FROM PharmacologicClass c LEFT JOIN PharmacologicClassLink l USING (PharmacologicClassID) LEFT JOIN ActiveMoiety m USING (PharmSubstanceID)
LEFT JOIN IngredientSubstance s ON s.IngredientSubstanceID = m.IngredientSubstanceID AND NOT EXISTS (SELECT 1 FROM Ingredient x JOIN IngredientSubstance y USING (IngredientSubstanceID) WHERE x.ClassCode = 'IACT' AND y.UNII = s.UNII)
LEFT JOIN Ingredient i ON i.IngredientSubstanceID = s.IngredientSubstanceID AND s.UNII IS NOT NULL GROUP BY 1, 2""", V.class_summary)  # fmt: skip
view("view_products_by_ingredient", ("IngredientSubstance", "Ingredient", "ActiveMoiety"), """SELECT s.IngredientSubstanceID, UNII, SubstanceName, ClassCode, MoietyName, sp.ProductID, ProductName, DocumentGUID, LabelerName
FROM IngredientSubstance s JOIN Ingredient i USING (IngredientSubstanceID) JOIN sp USING (ProductID) LEFT JOIN ActiveMoiety m ON m.IngredientSubstanceID = s.IngredientSubstanceID""", V.products_by_ingredient, _SP)  # fmt: skip
view("view_ingredient_summary", ("IngredientSubstance", "Ingredient"), """SELECT s.IngredientSubstanceID, UNII, SubstanceName, OriginatingElement, count(DISTINCT sp.ProductID) ProductCount, count(DISTINCT DocumentGUID) DocumentCount, count(DISTINCT OrganizationID) LabelerCount
FROM IngredientSubstance s LEFT JOIN Ingredient i USING (IngredientSubstanceID) LEFT JOIN sp ON sp.ProductID = i.ProductID GROUP BY 1, 2, 3, 4""", V.ingredient_summary, _SP)  # fmt: skip
view("view_products_by_ndc", ("ProductIdentifier", "GenericMedicine", "MarketingCategory"), """SELECT IdentifierValue ProductCode, IdentifierType, sp.ProductID, ProductName, GenericName, ApplicationOrMonographIDValue, LabelerName
FROM ProductIdentifier JOIN sp USING (ProductID) LEFT JOIN GenericMedicine g ON g.ProductID = sp.ProductID LEFT JOIN MarketingCategory m ON m.ProductID = sp.ProductID""", V.products_by_ndc, _SP)  # fmt: skip
view("view_package_by_ndc", ("PackageIdentifier", "PackagingLevel"), """SELECT IdentifierValue PackageCode, QuantityNumerator, PackageFormDisplayName, sp.ProductID, ProductName, DocumentGUID, LabelerName
FROM PackageIdentifier JOIN PackagingLevel l USING (PackagingLevelID) JOIN sp ON sp.ProductID = l.ProductID""", V.package_by_ndc, _SP)  # fmt: skip
view("view_products_by_labeler", ("OrganizationIdentifier",), """SELECT sp.OrganizationID, LabelerName, IdentifierValue OrgIdentifier, ProductID, ProductName, DocumentGUID, SetGUID, VersionNumber, EffectiveTime
FROM sp LEFT JOIN OrganizationIdentifier i ON i.OrganizationID = sp.OrganizationID WHERE sp.OrganizationID IS NOT NULL""", V.products_by_labeler, _SP)  # fmt: skip
view("view_labeler_summary", ("Document", "Product", "Section"), """SELECT lab.OrganizationID, LabelerName, count(DISTINCT ProductID) ProductCount, count(DISTINCT d.DocumentID) DocumentCount, count(DISTINCT SetGUID) LabelSetCount, min(EffectiveTime) EarliestLabel, max(EffectiveTime) MostRecentLabel
FROM lab JOIN Document d ON d.DocumentID = lab.DocumentID LEFT JOIN (SELECT ProductID, DocumentID FROM Product JOIN Section USING (SectionID)) p ON p.DocumentID = d.DocumentID GROUP BY 1, 2""", V.labeler_summary, _LAB)  # fmt: skip
view("view_document_navigation", ("Document", "Section", "Product"), """SELECT DocumentID, DocumentGUID, SetGUID, VersionNumber, EffectiveTime,
 (SELECT count(DISTINCT ProductID) FROM Section s JOIN Product p ON p.SectionID = s.SectionID WHERE s.DocumentID = d.DocumentID) ProductCount,
 (SELECT count(*) FROM Document x WHERE x.SetGUID = d.SetGUID) TotalVersions, CASE WHEN VersionNumber = (SELECT max(VersionNumber) FROM Document x WHERE x.SetGUID = d.SetGUID) THEN 1 ELSE 0 END IsLatestVersion FROM Document d""", V.document_navigation)  # fmt: skip
view("view_version_history", ("Document", "RelatedDocument"), """SELECT SetGUID, DocumentGUID, VersionNumber, EffectiveTime, ReferencedDocumentGUID PredecessorDocGUID, LabelerName
FROM Document d LEFT JOIN RelatedDocument r ON r.SourceDocumentID = d.DocumentID AND RelationshipTypeCode = 'RPLC' LEFT JOIN lab ON lab.DocumentID = d.DocumentID""", V.version_history, _LAB)  # fmt: skip
view("view_section_navigation", ("Section", "SectionHierarchy", "SectionTextContent"), """SELECT s.SectionID, s.SectionGUID, s.SectionCode, s.Title, s.DocumentID, CAST(h.ParentSectionID AS VARCHAR) ParentSectionID, p.SectionCode ParentSectionCode, p.Title ParentTitle,
 (SELECT count(*) FROM SectionTextContent c WHERE c.SectionID = s.SectionID) ContentBlockCount
FROM Section s LEFT JOIN SectionHierarchy h ON h.ChildSectionID = s.SectionID LEFT JOIN Section p ON p.SectionID = h.ParentSectionID""",
     lambda t: V.section_navigation(t).withColumn("ParentSectionID", F.col("ParentSectionID").cast("string")))
view("view_section_type_summary", ("Section", "Document"), """SELECT SectionCode, SectionDisplayName, count(*) SectionCount, count(DISTINCT s.DocumentID) DocumentCount, count(DISTINCT SetGUID) LabelSetCount
FROM Section s JOIN Document d ON d.DocumentID = s.DocumentID WHERE SectionCode IS NOT NULL GROUP BY 1, 2""", V.section_type_summary)  # fmt: skip
view("view_drug_interaction_lookup", ("Ingredient", "IngredientSubstance", "ProductIdentifier", "ActiveMoiety", "PharmacologicClassLink", "PharmacologicClass"), """SELECT sp.ProductID, ProductName, n.IdentifierValue NDC, UNII, SubstanceName, MoietyName, c.ClassCode PharmClassCode, DocumentGUID
FROM Ingredient i JOIN IngredientSubstance s USING (IngredientSubstanceID) JOIN sp USING (ProductID) LEFT JOIN ProductIdentifier n ON n.ProductID = sp.ProductID AND n.IdentifierType = 'NDC'
LEFT JOIN ActiveMoiety m ON m.IngredientSubstanceID = s.IngredientSubstanceID LEFT JOIN PharmacologicClassLink l ON l.PharmSubstanceID = m.PharmSubstanceID LEFT JOIN PharmacologicClass c ON c.PharmacologicClassID = l.PharmacologicClassID
WHERE i.ClassCode IN ('ACTIB', 'ACTIM', 'ACTIR')""", V.interaction_lookup, _SP)  # fmt: skip
view("view_dea_schedule", ("Policy",), """SELECT PolicyCode DEAScheduleCode, PolicyDisplayName DEASchedule, ProductID, ProductName, DocumentGUID, LabelerName FROM Policy JOIN sp USING (ProductID) WHERE PolicyClassCode = 'DEADrugSchedule'""", V.dea_schedule, _SP)
view("view_product_summary", ("GenericMedicine", "ProductIdentifier", "ProductRouteOfAdministration", "Policy", "Ingredient"), """SELECT ProductID, ProductName, FormDisplayName, DocumentGUID, LabelerName,
 (SELECT min(GenericName) FROM GenericMedicine g WHERE g.ProductID = sp.ProductID) GenericName, (SELECT min(IdentifierValue) FROM ProductIdentifier g WHERE g.ProductID = sp.ProductID AND IdentifierType = 'NDC') PrimaryNDC,
 (SELECT min(RouteDisplayName) FROM ProductRouteOfAdministration g WHERE g.ProductID = sp.ProductID) Route, (SELECT min(PolicyDisplayName) FROM Policy g WHERE g.ProductID = sp.ProductID AND PolicyClassCode = 'DEADrugSchedule') DEASchedule,
 (SELECT count(*) FROM Ingredient g WHERE g.ProductID = sp.ProductID AND ClassCode <> 'IACT') ActiveIngredientCount FROM sp""", V.product_summary, _SP)  # fmt: skip
view("view_related_products", ("Product", "Section", "StructuredBody", "Document", "MarketingCategory", "Ingredient", "IngredientSubstance"), """, b AS (
 SELECT ProductID, ProductName, SectionID, DocumentGUID FROM Product JOIN Section USING (SectionID) JOIN StructuredBody sb USING (StructuredBodyID) JOIN Document d ON d.DocumentID = sb.DocumentID),
m AS (SELECT 'SameApplicationNumber' RelationshipType, 0::BIGINT of_id, ApplicationOrMonographIDValue SharedValue, b.* FROM MarketingCategory JOIN b USING (ProductID) WHERE ApplicationOrMonographIDValue IS NOT NULL
 UNION ALL SELECT 'SameActiveIngredient', IngredientSubstanceID, UNII, b.* FROM Ingredient JOIN IngredientSubstance USING (IngredientSubstanceID) JOIN b USING (ProductID) WHERE ClassCode IN ('ACTIB', 'ACTIM', 'ACTIR') AND UNII IS NOT NULL)
SELECT x.ProductID SourceProductID, x.ProductName SourceProductName, x.DocumentGUID SourceDocumentGUID, y.ProductID RelatedProductID, y.ProductName RelatedProductName, y.DocumentGUID RelatedDocumentGUID, RelationshipType, SharedValue
FROM m x JOIN m y USING (RelationshipType, of_id, SharedValue) WHERE x.ProductID <> y.ProductID AND NOT (x.ProductName = y.ProductName AND x.SectionID = y.SectionID)""", V.related_pairs)  # fmt: skip
view("search_related_products", ("Product", "MarketingCategory", "Ingredient", "IngredientSubstance"), """, app AS (SELECT ProductID, ProductName, ApplicationOrMonographIDValue via FROM MarketingCategory JOIN Product USING (ProductID) WHERE ApplicationOrMonographIDValue = 'NDA4'),
act AS (SELECT ProductID, ProductName, UNII via FROM Ingredient JOIN IngredientSubstance USING (IngredientSubstanceID) JOIN Product USING (ProductID) WHERE ClassCode <> 'IACT' AND UNII = 'U17')
SELECT a.ProductID SourceProductID, b.ProductID RelatedProductID, b.ProductName RelatedProductName, a.via SharedValue, 'SameApplicationNumber' RelationshipType FROM app a JOIN app b ON a.via = b.via AND a.ProductID <> b.ProductID AND a.ProductName <> b.ProductName
UNION ALL SELECT a.ProductID, b.ProductID, b.ProductName, a.via, 'SameActiveIngredient' FROM act a JOIN act b ON a.via = b.via AND a.ProductID <> b.ProductID AND a.ProductName <> b.ProductName""",
     lambda t: V.related_products(t, "NDA4", "U17"))
view("view_section_content", ("Section", "SectionTextContent", "TextListItem"), _CONTENT + """ SELECT *, row_number() OVER (PARTITION BY DocumentID ORDER BY SectionCode NULLS FIRST, SectionID) SequenceNumber FROM content""", V.section_content)
view("view_section_markdown", ("Section", "SectionTextContent", "TextListItem", "Document"), """, items AS (SELECT SectionTextContentID, string_agg('- ' || ItemText, chr(10) ORDER BY SequenceNumber, TextListItemID) ListText FROM TextListItem GROUP BY 1)
SELECT DocumentGUID, DocumentGUID || '|' || coalesce(SectionCode, 'NONE') || '|' || s.SectionID SectionKey, SectionCode,
 coalesce('## ' || s.Title || chr(10) || chr(10), '') || string_agg(coalesce(replace(replace(ContentText, '<content styleCode="bold">', '**'), '</content>', ''), ListText), chr(10) || chr(10) ORDER BY c.SequenceNumber, c.SectionTextContentID) FullSectionText
FROM Section s JOIN SectionTextContent c ON c.SectionID = s.SectionID LEFT JOIN items i ON i.SectionTextContentID = c.SectionTextContentID JOIN Document d ON d.DocumentID = s.DocumentID GROUP BY 1, 2, 3, Title""".replace("GROUP BY 1, 2, 3, Title", "GROUP BY DocumentGUID, s.SectionID, SectionCode, s.Title"), V.section_markdown)  # fmt: skip
_INGR = """SELECT p.ProductID, ProductName, UNII, SubstanceName, ClassCode, CategoryDisplayName ApplicationType, regexp_replace(ApplicationOrMonographIDValue, '^(sANDA|sNDA|sBLA|ANDA|NDA|BLA|DMF|OTC|PMA|IND)', '') ApplicationNumber
FROM Ingredient i LEFT JOIN IngredientSubstance s USING (IngredientSubstanceID) JOIN Product p ON p.ProductID = i.ProductID LEFT JOIN MarketingCategory m ON m.ProductID = p.ProductID"""
for _kind, _where in (("all", ""), ("active", " WHERE ClassCode <> 'IACT'"), ("inactive", " WHERE ClassCode = 'IACT'")):
    view(f"view_ingredients_{_kind}", ("Ingredient", "IngredientSubstance", "Product", "MarketingCategory"), _INGR + _where, lambda t, k=_kind: V.ingredient_view(t, k))
for _active, _having in ((True, "<>"), (False, "=")):
    view(f"view_{'active' if _active else 'inactive'}_ingredient_summary", ("Ingredient", "IngredientSubstance"), f"""SELECT IngredientSubstanceID, UNII, SubstanceName, ClassCode, count(DISTINCT ProductID) ProductCount
FROM Ingredient JOIN IngredientSubstance USING (IngredientSubstanceID) GROUP BY 1, 2, 3, 4 HAVING ClassCode {_having} 'IACT'""", lambda t, a=_active: V.activity_summary(t, a))  # fmt: skip
view("view_latest_label", ("Ingredient", "IngredientSubstance"), """SELECT UNII, SubstanceName, ProductName, DocumentGUID, EffectiveTime FROM (
 SELECT UNII, SubstanceName, ProductName, DocumentGUID, EffectiveTime, row_number() OVER (PARTITION BY UNII, ProductName ORDER BY EffectiveTime DESC, DocumentGUID, sp.ProductID, SubstanceName) rn
 FROM Ingredient i JOIN IngredientSubstance USING (IngredientSubstanceID) JOIN sp ON sp.ProductID = i.ProductID WHERE ClassCode <> 'IACT' AND UNII IS NOT NULL) WHERE rn = 1""", V.latest_label, _SP)  # fmt: skip
view("view_indications", ("Ingredient", "IngredientSubstance", "Product", "Section", "SectionTextContent", "TextListItem"), _CONTENT + """ SELECT DISTINCT UNII, SubstanceName, ProductName, ContentText
FROM Ingredient i JOIN IngredientSubstance USING (IngredientSubstanceID) JOIN Product p ON p.ProductID = i.ProductID JOIN content c ON c.SectionID = p.SectionID
WHERE ClassCode <> 'IACT' AND trim(ContentText) <> '' AND c.SectionID IN (SELECT SectionID FROM Section WHERE upper(SectionDisplayName) LIKE 'INDICATION%')""", V.indications)  # fmt: skip


def _top(source: str, key: str, category: str, k: int, base: int) -> str:
    return f"""SELECT '{category}' Category, x Dimension, n ItemCount, {base} + row_number() OVER (ORDER BY n DESC, x) SortOrder FROM (
 SELECT {key} x, count(*) n, rank() OVER (ORDER BY count(*) DESC) r FROM {source} WHERE {key} IS NOT NULL GROUP BY 1) WHERE r <= {k}"""


view("view_inventory", ("Document", "Product", "IngredientSubstance", "PharmacologicClass", "MarketingCategory"), "\nUNION ALL ".join(
    [f"SELECT 'TOTALS' Category, '{label}' Dimension, count(*) ItemCount, {i} SortOrder FROM {name}" for i, (name, label) in enumerate((("Document", "Documents"), ("Product", "Products"), ("Organization", "Organizations"), ("IngredientSubstance", "Substances"), ("PharmacologicClass", "Classes")), 1)]
    + [f"SELECT * FROM ({x})" for x in (_top("MarketingCategory", "CategoryDisplayName", "BY_CATEGORY", 20, 100), _top("lab", "LabelerName", "TOP_LABELERS", 15, 200), _top("Product", "FormDisplayName", "TOP_FORMS", 10, 300))]),
    V.inventory, _LAB)
view("view_orange_book_patents", ("OBProduct", "OBPatent", "OBUseCode", "MarketingCategory"), """, labels AS (SELECT DISTINCT regexp_replace(ApplicationOrMonographIDValue, '^NDA', '') ApplNo, DocumentGUID FROM MarketingCategory JOIN sp USING (ProductID) WHERE CategoryDisplayName = 'NDA')
SELECT DISTINCT p.ApplNo, TradeName, Ingredient, replace(Strength, ' **Discontinued**', ' ') Strength, t.PatentNo, PatentExpireDate,
 CASE WHEN EXISTS (SELECT 1 FROM OBPatent x WHERE x.OrangeBookProductID = t.OrangeBookProductID AND x.PatentNo = t.PatentNo || '*PED') THEN 1 ELSE 0 END HasPediatricExtension, t.PatentUseCode, Definition, DocumentGUID
FROM OBProduct p JOIN OBPatent t ON t.OrangeBookProductID = p.OrangeBookProductID LEFT JOIN labels l ON l.ApplNo = p.ApplNo LEFT JOIN OBUseCode u ON u.PatentUseCode = t.PatentUseCode
WHERE ApplType = 'N' AND PatentExpireDate IS NOT NULL""", V.orange_book_patents, _SP)  # fmt: skip


# Searches: filters, fixed orders and pages over the views.
view("search_application_number", ("MarketingCategory",), """SELECT ApplicationOrMonographIDValue ApplicationNumber, ProductID, ProductName FROM MarketingCategory JOIN sp USING (ProductID)
WHERE upper(replace(ApplicationOrMonographIDValue, ' ', '')) = 'NDA12' OR upper(ApplicationOrMonographIDValue) LIKE 'NDA12%' OR ApplicationOrMonographIDValue LIKE '%12%' ORDER BY ProductID LIMIT 50 OFFSET 50""",
     lambda t: page(V.products_by_application(t).filter((F.upper(F.replace("ApplicationNumber", F.lit(" "), F.lit(""))) == "NDA12") | F.upper("ApplicationNumber").startswith("NDA12") | F.col("ApplicationNumber").contains("12")).select("ApplicationNumber", "ProductID", "ProductName"), [F.col("ProductID")], 2, 50), _SP)
view("search_class_terms", _CLASS_NEED, _CLASS_COLS + _CLASS + " AND UNII IS NOT NULL AND (lower(ClassDisplayName) LIKE '%ring%' OR lower(ClassDisplayName) LIKE '%red%') AND (ProductName IS NULL OR lower(ProductName) NOT LIKE '%widget%')",
     lambda t: V.class_products(t).filter(search.term_filter([F.col("ClassDisplayName")], "Ring; RED")).filter(search.term_filter([F.col("ProductName")], None, ["widget"])), _SP)
view("search_ingredient", ("IngredientSubstance", "Ingredient"), """SELECT UNII, SubstanceName, ProductID, ProductName FROM IngredientSubstance JOIN Ingredient USING (IngredientSubstanceID) JOIN Product USING (ProductID)
WHERE lower(SubstanceName) LIKE '%gear 1%' ORDER BY SubstanceName, ProductName, ProductID LIMIT 100""",
     lambda t: page(V.products_by_ingredient(t).filter(search.like(F.col("SubstanceName"), "gear 1")).select("UNII", "SubstanceName", "ProductID", "ProductName"), [F.col("SubstanceName"), F.col("ProductName"), F.col("ProductID")], 1, 100), _SP)
view("search_products_sharing_ingredients", ("Ingredient", "IngredientSubstance", "MarketingCategory"), """SELECT DISTINCT sp.ProductID, ProductName FROM Ingredient i JOIN IngredientSubstance s USING (IngredientSubstanceID) JOIN sp ON sp.ProductID = i.ProductID
WHERE UNII IN (SELECT UNII FROM Ingredient JOIN IngredientSubstance USING (IngredientSubstanceID) JOIN MarketingCategory USING (ProductID) WHERE ApplicationOrMonographIDValue = 'NDA12')""",
     lambda t: V.products_by_ingredient(t).join(t["MarketingCategory"].filter("ApplicationOrMonographIDValue = 'NDA12'").join(t["Ingredient"], "ProductID").join(t["IngredientSubstance"], "IngredientSubstanceID").select("UNII").distinct(), "UNII", "left_semi").select("ProductID", "ProductName").distinct(), _SP)
view("search_documents_latest", ("Document",), """SELECT DocumentGUID, SetGUID, EffectiveTime FROM (SELECT *, max(VersionNumber) OVER (PARTITION BY SetGUID) m FROM Document) WHERE VersionNumber = m ORDER BY EffectiveTime DESC, DocumentID LIMIT 200""",
     lambda t: page(V.document_navigation(t).filter("IsLatestVersion = 1"), [F.col("EffectiveTime").desc(), F.col("DocumentID")], 1, 200).select("DocumentGUID", "SetGUID", "EffectiveTime"))
view("search_patents_window", ("OBProduct", "OBPatent"), """SELECT TradeName, PatentNo, PatentExpireDate FROM OBProduct JOIN OBPatent USING (OrangeBookProductID)
WHERE PatentExpireDate BETWEEN TIMESTAMP '2026-01-15' AND TIMESTAMP '2026-01-15' + INTERVAL 2 MONTH ORDER BY PatentExpireDate, TradeName, PatentNo""",
     lambda t: page(t["OBProduct"].join(t["OBPatent"], "OrangeBookProductID").filter(F.col("PatentExpireDate").between(F.lit("2026-01-15").cast("timestamp"), F.add_months(F.lit("2026-01-15").cast("date"), 2).cast("timestamp"))).select("TradeName", "PatentNo", "PatentExpireDate"), [F.col("PatentExpireDate"), F.col("TradeName"), F.col("PatentNo")]))
view("search_patents_without_twins", ("OBPatent",), """SELECT PatentNo, OrangeBookProductID FROM OBPatent p WHERE NOT EXISTS (SELECT 1 FROM OBPatent x WHERE x.OrangeBookProductID = p.OrangeBookProductID AND x.PatentNo = p.PatentNo || '*PED')""",
     lambda t: t["OBPatent"].join(t["OBPatent"].filter(F.col("PatentNo").endswith("*PED")).select("OrangeBookProductID", F.regexp_replace("PatentNo", r"\*PED$", "").alias("PatentNo")), ["OrangeBookProductID", "PatentNo"], "left_anti").select("PatentNo", "OrangeBookProductID"))
