"""The label views: named, composable DataFrame functions over the label tables.

Each takes the tables by name (see domain.TABLES for their columns).  All share one join spine,
product -> section -> body -> document -> labeler, built once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.terms import sized
from tessera.operators.relops import distinct_counts, ordered_string_agg, top1_per_key, topk_with_ties
from tessera.session import stored

Tables = dict[str, DataFrame]


def labelers(t: Tables) -> DataFrame:
    """DocumentID, OrganizationID, LabelerName of authors who are labelers."""
    author = t["DocumentAuthor"].filter(F.col("AuthorType") == "Labeler").select("DocumentID", "OrganizationID")
    return author.join(t["Organization"].select("OrganizationID", F.col("OrganizationName").alias("LabelerName")), "OrganizationID", "left")


def spine(t: Tables) -> DataFrame:
    """Products with their document, and the labeler where there is one."""
    section = t["Section"].select("SectionID", "StructuredBodyID", "SectionCode")
    document = t["Document"].select("DocumentID", "DocumentGUID", "SetGUID", "VersionNumber", "EffectiveTime")
    joined = t["Product"].join(section, "SectionID").join(t["StructuredBody"], "StructuredBodyID").join(document, "DocumentID")
    return joined.join(labelers(t), "DocumentID", "left")


def coded_spine(t: Tables) -> DataFrame:
    """ProductID, OrganizationID, and for DocumentGUID a number: the least id of its documents, null where it is null.

    For counts of distinct values, which shuffle and hold numbers then.
    """
    least = F.min("DocumentID").over(Window.partitionBy("DocumentGUID"))
    document = t["Document"].select("DocumentID", F.when(F.col("DocumentGUID").isNotNull(), least).alias("GuidID"))
    joined = t["Product"].select("ProductID", "SectionID").join(t["Section"].select("SectionID", "StructuredBodyID"), "SectionID").join(t["StructuredBody"], "StructuredBodyID")
    return joined.join(document, "DocumentID").join(labelers(t).select("DocumentID", "OrganizationID"), "DocumentID", "left").select("ProductID", "GuidID", "OrganizationID")


def products_by_application(t: Tables) -> DataFrame:
    m = t["MarketingCategory"].filter(F.col("ApplicationOrMonographIDValue").isNotNull())
    return m.join(spine(t), "ProductID").select(F.col("ApplicationOrMonographIDValue").alias("ApplicationNumber"), "CategoryCode", "CategoryDisplayName", "ApprovalDate", "ProductID", "ProductName", "DocumentGUID", "SetGUID", "VersionNumber", "LabelerName")


def application_summary(t: Tables) -> DataFrame:
    m = t["MarketingCategory"].filter(F.col("ApplicationOrMonographIDValue").isNotNull()).withColumnRenamed("ApplicationOrMonographIDValue", "ApplicationNumber")
    return (
        m.join(spine(t), "ProductID")
        .groupBy("ApplicationNumber", "CategoryCode", "CategoryDisplayName")
        .agg(F.min("ApprovalDate").alias("EarliestApproval"), F.max("ApprovalDate").alias("LatestApproval"), F.countDistinct("ProductID").alias("ProductCount"), F.countDistinct("DocumentGUID").alias("DocumentCount"), F.countDistinct("SetGUID").alias("LabelSetCount"), F.max("EffectiveTime").alias("MostRecentLabel"))
    )


def _class_chain(t: Tables) -> DataFrame:
    """Classes with the substances that their active moieties are of."""
    c = t["PharmacologicClass"].join(t["PharmacologicClassLink"], "PharmacologicClassID")
    return c.join(t["ActiveMoiety"].select("PharmSubstanceID", "IngredientSubstanceID"), "PharmSubstanceID").join(t["IngredientSubstance"], "IngredientSubstanceID")


def class_products(t: Tables, need_unii: bool = True) -> DataFrame:
    """Products by class of an active ingredient, without dosage forms that are excluded for the class."""
    ing = t["Ingredient"].filter(F.col("ClassCode") != "IACT").select("ProductID", "IngredientSubstanceID")
    rows = _class_chain(t).join(ing, "IngredientSubstanceID").join(spine(t), "ProductID")
    if need_unii:
        rows = rows.filter(F.col("UNII").isNotNull())
    gone = t["PharmClassDosageFormExclusion"].filter("IsActive = 1").select("ClassCode", "FormDisplayName")
    out = rows.join(gone, ["ClassCode", "FormDisplayName"], "left_anti")
    return out.select("ClassCode", "ClassDisplayName", "SubstanceName", "UNII", "ProductID", "ProductName", "FormDisplayName", "DocumentGUID", "LabelerName")


def class_hierarchy(t: Tables) -> DataFrame:
    c = t["PharmacologicClass"]
    parent = c.select(F.col("PharmacologicClassID").alias("ParentPharmacologicClassID"), F.col("ClassCode").alias("ParentCode"), F.col("ClassDisplayName").alias("ParentName"))
    child = c.select(F.col("PharmacologicClassID").alias("ChildPharmacologicClassID"), F.col("ClassCode").alias("ChildCode"), F.col("ClassDisplayName").alias("ChildName"))
    return t["PharmacologicClassHierarchy"].join(parent, "ParentPharmacologicClassID").join(child, "ChildPharmacologicClassID").select("ParentCode", "ParentName", "ChildCode", "ChildName")


def class_summary(t: Tables) -> DataFrame:
    """Counts by class; substances that are inactive somewhere are left out before the outer joins."""
    inactive = t["Ingredient"].filter("ClassCode = 'IACT'").join(t["IngredientSubstance"], "IngredientSubstanceID").filter("UNII is not null").select("UNII").distinct()
    substances = t["IngredientSubstance"].join(inactive, "UNII", "left_anti").select("IngredientSubstanceID", "UNII")
    moiety = t["ActiveMoiety"].select("PharmSubstanceID", "IngredientSubstanceID", "ActiveMoietyID")
    # A class is its code and name; the least of its ids stands for them where products are counted.
    key = ["ClassCode", "ClassDisplayName"]
    classes = t["PharmacologicClass"].withColumn("ClassID", F.min("PharmacologicClassID").over(Window.partitionBy(*key)))
    rows = classes.join(t["PharmacologicClassLink"], "PharmacologicClassID", "left").join(moiety, "PharmSubstanceID", "left").join(substances, "IngredientSubstanceID", "left")
    rows = stored(rows.select("ClassID", *key, "IngredientSubstanceID", "UNII", "ActiveMoietyID"))
    facts = rows.groupBy("ClassID", *key).agg(F.countDistinct("UNII").alias("SubstanceCount"), F.countDistinct("ActiveMoietyID").alias("MoietyCount"))
    ing = t["Ingredient"].select("ProductID", "IngredientSubstanceID")
    products = rows.filter("UNII is not null").select("ClassID", "IngredientSubstanceID").distinct().join(ing, "IngredientSubstanceID").groupBy("ClassID").agg(F.countDistinct("ProductID").alias("ProductCount"))
    return facts.join(products, "ClassID", "left").select(*key, "SubstanceCount", F.coalesce("ProductCount", F.lit(0).cast("bigint")).alias("ProductCount"), "MoietyCount")


def products_by_ingredient(t: Tables) -> DataFrame:
    rows = t["IngredientSubstance"].join(t["Ingredient"], "IngredientSubstanceID").join(spine(t), "ProductID")
    moiety = t["ActiveMoiety"].select("IngredientSubstanceID", "MoietyName", "MoietyUNII")
    return rows.join(moiety, "IngredientSubstanceID", "left").select("IngredientSubstanceID", "UNII", "SubstanceName", "ClassCode", "MoietyName", "ProductID", "ProductName", "DocumentGUID", "LabelerName")


def ingredient_summary(t: Tables) -> DataFrame:
    """Counts by substance, made on ids alone; names come to them afterwards."""
    rows = t["Ingredient"].select("ProductID", "IngredientSubstanceID").join(coded_spine(t), "ProductID")
    counts = {"ProductCount": "ProductID", "DocumentCount": "GuidID", "LabelerCount": "OrganizationID"}
    found = distinct_counts(rows, ["IngredientSubstanceID"], counts)
    key = ["IngredientSubstanceID", "UNII", "SubstanceName", "OriginatingElement"]
    return t["IngredientSubstance"].select(*key).distinct().join(found, "IngredientSubstanceID", "left").select(*key, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts])


def products_by_ndc(t: Tables) -> DataFrame:
    rows = t["ProductIdentifier"].join(spine(t), "ProductID").join(t["GenericMedicine"], "ProductID", "left").join(t["MarketingCategory"].select("ProductID", "ApplicationOrMonographIDValue"), "ProductID", "left")
    return rows.select(F.col("IdentifierValue").alias("ProductCode"), "IdentifierType", "ProductID", "ProductName", "GenericName", "ApplicationOrMonographIDValue", "LabelerName")


def package_by_ndc(t: Tables) -> DataFrame:
    return t["PackageIdentifier"].join(t["PackagingLevel"], "PackagingLevelID").join(spine(t), "ProductID").select(F.col("IdentifierValue").alias("PackageCode"), "QuantityNumerator", "PackageFormDisplayName", "ProductID", "ProductName", "DocumentGUID", "LabelerName")


def products_by_labeler(t: Tables) -> DataFrame:
    rows = spine(t).filter(F.col("OrganizationID").isNotNull()).join(t["OrganizationIdentifier"], "OrganizationID", "left")
    return rows.select("OrganizationID", "LabelerName", F.col("IdentifierValue").alias("OrgIdentifier"), "ProductID", "ProductName", "DocumentGUID", "SetGUID", "VersionNumber", "EffectiveTime")


def labeler_summary(t: Tables) -> DataFrame:
    """Counts by labeler: documents and sets on documents, products by the labeler's id alone."""
    docs = labelers(t).join(t["Document"].select("DocumentID", "SetGUID", "EffectiveTime"), "DocumentID")
    own = docs.groupBy("OrganizationID", "LabelerName").agg(F.countDistinct("DocumentID").alias("DocumentCount"), F.countDistinct("SetGUID").alias("LabelSetCount"), F.min("EffectiveTime").alias("EarliestLabel"), F.max("EffectiveTime").alias("MostRecentLabel"))
    author = t["DocumentAuthor"].filter(F.col("AuthorType") == "Labeler").select("DocumentID", "OrganizationID").join(t["Document"].select("DocumentID"), "DocumentID", "left_semi").distinct()
    products = t["Product"].select("ProductID", "SectionID").join(t["Section"].select("SectionID", "DocumentID"), "SectionID").select("ProductID", "DocumentID")
    counted = author.join(products, "DocumentID").groupBy(F.col("OrganizationID").alias("_of")).agg(F.countDistinct("ProductID").alias("_n"))
    rows = own.join(counted, F.col("OrganizationID").eqNullSafe(F.col("_of")), "left")
    return rows.select("OrganizationID", "LabelerName", F.coalesce("_n", F.lit(0).cast("bigint")).alias("ProductCount"), "DocumentCount", "LabelSetCount", "EarliestLabel", "MostRecentLabel")


def document_navigation(t: Tables) -> DataFrame:
    by_set = Window.partitionBy("SetGUID")
    products = t["Section"].join(t["Product"], "SectionID").groupBy("DocumentID").agg(F.countDistinct("ProductID").alias("ProductCount"))
    d = t["Document"].withColumns({"TotalVersions": F.count(F.lit(1)).over(by_set), "IsLatestVersion": (F.col("VersionNumber") == F.max("VersionNumber").over(by_set)).cast("int")})
    return d.join(products, "DocumentID", "left").select("DocumentID", "DocumentGUID", "SetGUID", "VersionNumber", "EffectiveTime", F.coalesce("ProductCount", F.lit(0)).alias("ProductCount"), "TotalVersions", "IsLatestVersion")


def version_history(t: Tables) -> DataFrame:
    replaced = t["RelatedDocument"].filter("RelationshipTypeCode = 'RPLC'").select(F.col("SourceDocumentID").alias("DocumentID"), F.col("ReferencedDocumentGUID").alias("PredecessorDocGUID"))
    return t["Document"].join(replaced, "DocumentID", "left").join(labelers(t), "DocumentID", "left").select("SetGUID", "DocumentGUID", "VersionNumber", "EffectiveTime", "PredecessorDocGUID", "LabelerName")


def section_navigation(t: Tables) -> DataFrame:
    parent = t["Section"].select(F.col("SectionID").alias("ParentSectionID"), F.col("SectionCode").alias("ParentSectionCode"), F.col("Title").alias("ParentTitle"))
    content = t["SectionTextContent"].groupBy("SectionID").agg(F.count(F.lit(1)).alias("ContentBlockCount"))
    up = t["SectionHierarchy"].select("ParentSectionID", F.col("ChildSectionID").alias("SectionID"))
    rows = t["Section"].join(up, "SectionID", "left").join(parent, "ParentSectionID", "left").join(content, "SectionID", "left")
    return rows.select("SectionID", "SectionGUID", "SectionCode", "Title", "DocumentID", "ParentSectionID", "ParentSectionCode", "ParentTitle", F.coalesce("ContentBlockCount", F.lit(0)).alias("ContentBlockCount"))


def section_type_summary(t: Tables) -> DataFrame:
    rows = t["Section"].filter("SectionCode is not null").join(t["Document"].select("DocumentID", "SetGUID"), "DocumentID")
    return rows.groupBy("SectionCode", "SectionDisplayName").agg(F.count(F.lit(1)).alias("SectionCount"), F.countDistinct("DocumentID").alias("DocumentCount"), F.countDistinct("SetGUID").alias("LabelSetCount"))


def interaction_lookup(t: Tables) -> DataFrame:
    """Active ingredients by product; what belongs to a substance is joined to it first, so wide rows are shuffled once."""
    ing = t["Ingredient"].filter(F.col("ClassCode").isin("ACTIB", "ACTIM", "ACTIR")).select("ProductID", "IngredientSubstanceID")
    ndc = t["ProductIdentifier"].filter("IdentifierType = 'NDC'").select("ProductID", F.col("IdentifierValue").alias("NDC"))
    moiety = t["ActiveMoiety"].select("IngredientSubstanceID", "MoietyName", "PharmSubstanceID")
    classes = t["PharmacologicClassLink"].join(t["PharmacologicClass"].select("PharmacologicClassID", F.col("ClassCode").alias("PharmClassCode")), "PharmacologicClassID").select("PharmSubstanceID", "PharmClassCode")
    facts = t["IngredientSubstance"].select("IngredientSubstanceID", "UNII", "SubstanceName").join(moiety, "IngredientSubstanceID", "left").join(classes, "PharmSubstanceID", "left").drop("PharmSubstanceID")
    products = spine(t).select("ProductID", "ProductName", "DocumentGUID").join(ndc, "ProductID", "left")
    return ing.join(facts, "IngredientSubstanceID").join(products, "ProductID").select("ProductID", "ProductName", "NDC", "UNII", "SubstanceName", "MoietyName", "PharmClassCode", "DocumentGUID")


def dea_schedule(t: Tables) -> DataFrame:
    p = t["Policy"].filter("PolicyClassCode = 'DEADrugSchedule'")
    return p.join(spine(t), "ProductID").select(F.col("PolicyCode").alias("DEAScheduleCode"), F.col("PolicyDisplayName").alias("DEASchedule"), "ProductID", "ProductName", "DocumentGUID", "LabelerName")


def product_summary(t: Tables) -> DataFrame:
    """One row per product; of several values the least is taken, where the choice was left open."""
    def least(name: str, col: str, alias: str, where: str = "true") -> DataFrame:
        return t[name].filter(where).groupBy("ProductID").agg(F.min(col).alias(alias))

    parts = [
        least("GenericMedicine", "GenericName", "GenericName"),
        least("ProductIdentifier", "IdentifierValue", "PrimaryNDC", "IdentifierType = 'NDC'"),
        least("ProductRouteOfAdministration", "RouteDisplayName", "Route"),
        least("Policy", "PolicyDisplayName", "DEASchedule", "PolicyClassCode = 'DEADrugSchedule'"),
        t["Ingredient"].filter("ClassCode <> 'IACT'").groupBy("ProductID").agg(F.count(F.lit(1)).alias("ActiveIngredientCount")),
    ]
    out = spine(t)
    for p in parts:
        out = out.join(p, "ProductID", "left")
    return out.select("ProductID", "ProductName", "FormDisplayName", "DocumentGUID", "LabelerName", "GenericName", "PrimaryNDC", "Route", "DEASchedule", F.coalesce("ActiveIngredientCount", F.lit(0)).alias("ActiveIngredientCount"))


def _sharing(t: Tables) -> dict[str, DataFrame]:
    """By relationship, the products (ProductID, ProductName, via) that have something to share."""
    base = t["Product"].select("ProductID", "ProductName")
    app = t["MarketingCategory"].filter("ApplicationOrMonographIDValue is not null").select("ProductID", F.col("ApplicationOrMonographIDValue").alias("via"))
    act = t["Ingredient"].filter("ClassCode <> 'IACT'").join(t["IngredientSubstance"], "IngredientSubstanceID").filter("UNII is not null").select("ProductID", F.col("UNII").alias("via"))
    return {"SameApplicationNumber": app.join(base, "ProductID"), "SameActiveIngredient": act.join(base, "ProductID")}


#: Products of one value on either side of a tile of pairs.
TILE = 4096


def related_pairs(t: Tables, tile: int = TILE) -> DataFrame:
    """All ordered pairs of products that share an application number or an active substance, with both names and documents.

    Left out are only products with themselves, and those of one name in one section.  The products of a value are dealt
    into parts of some ``tile`` rows, and each part meets each other in a task's group of its own, so no group grows
    with a value that many share.
    """
    section = t["Section"].select("SectionID", "StructuredBodyID")
    base = t["Product"].select("ProductID", "ProductName", "SectionID").join(section, "SectionID").join(t["StructuredBody"].select("StructuredBodyID", "DocumentID"), "StructuredBodyID")
    base = base.join(t["Document"].select("DocumentID", "DocumentGUID"), "DocumentID").select("ProductID", "ProductName", "SectionID", "DocumentGUID")
    app = t["MarketingCategory"].filter("ApplicationOrMonographIDValue is not null").select(F.lit("SameApplicationNumber").alias("RelationshipType"), F.lit(0).cast("bigint").alias("of"), F.col("ApplicationOrMonographIDValue").alias("SharedValue"), "ProductID")
    act = t["Ingredient"].filter(F.col("ClassCode").isin("ACTIB", "ACTIM", "ACTIR")).join(t["IngredientSubstance"].filter("UNII is not null").select("IngredientSubstanceID", "UNII"), "IngredientSubstanceID")
    act = act.select(F.lit("SameActiveIngredient").alias("RelationshipType"), F.col("IngredientSubstanceID").cast("bigint").alias("of"), F.col("UNII").alias("SharedValue"), "ProductID")
    key = ["RelationshipType", "of", "SharedValue"]
    rows = stored(app.unionByName(act).join(base, "ProductID"))
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")).filter("parts > 1")
    dealt = rows.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("ProductID"), F.col("parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    own = ["ProductID", "ProductName", "SectionID", "DocumentGUID"]
    left = dealt.select(*key, F.col("mine").alias("i"), each.alias("j"), *[F.col(c).alias(f"Source{c}") for c in own])
    right = dealt.select(*key, F.col("mine").alias("j"), each.alias("i"), *[F.col(c).alias(f"Related{c}") for c in own])
    both = left.join(right.hint("merge"), [*key, "i", "j"]).filter("SourceProductID <> RelatedProductID and not (SourceProductName = RelatedProductName and SourceSectionID = RelatedSectionID)")
    return both.select("SourceProductID", "SourceProductName", "SourceDocumentGUID", "RelatedProductID", "RelatedProductName", "RelatedDocumentGUID", "RelationshipType", "SharedValue")


def _pairs(left: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """The products of rows that share a value with those of left, under another name."""
    left = left.select(F.col("ProductID").alias("SourceProductID"), F.col("ProductName").alias("SourceProductName"), "via").distinct()
    right = rows.select(F.col("ProductID").alias("RelatedProductID"), F.col("ProductName").alias("RelatedProductName"), "via").distinct()
    both = left.join(right, "via").filter((F.col("SourceProductID") != F.col("RelatedProductID")) & (F.col("SourceProductName") != F.col("RelatedProductName")))
    return both.select("SourceProductID", "RelatedProductID", "RelatedProductName", F.col("via").alias("SharedValue"), F.lit(kind).alias("RelationshipType"))


def related_products(t: Tables, application: str, unii: str) -> DataFrame:
    """Pairs of products that share one application number, and those that share one active substance."""
    only = {"SameApplicationNumber": application, "SameActiveIngredient": unii}
    one, two = (_pairs(f, f, kind) for kind, rows in _sharing(t).items() for f in [rows.filter(F.col("via") == only[kind])])
    return one.unionByName(two)


def related_of(t: Tables, product_id: int) -> DataFrame:
    """One product's related products."""
    one, two = (_pairs(rows.filter(F.col("ProductID") == product_id), rows, kind) for kind, rows in _sharing(t).items())
    return one.unionByName(two)


def content_of(t: Tables, documents: DataFrame) -> DataFrame:
    """The section texts of some documents (DocumentID): all that is not theirs leaves before texts are put together."""
    wanted = sized(documents.select("DocumentID").distinct())
    section = stored(t["Section"].join(wanted, "DocumentID", "left_semi"))
    block = stored(t["SectionTextContent"].join(sized(section.select("SectionID").distinct()), "SectionID", "left_semi"))
    items = t["TextListItem"].join(sized(block.select("SectionTextContentID").distinct()), "SectionTextContentID", "left_semi")
    return section_content(t | {"Section": section, "SectionTextContent": block, "TextListItem": items})


def section_content(t: Tables) -> DataFrame:
    """Text per section: list items are joined in order, blocks in order; texts of more than 3 characters."""
    items = ordered_string_agg(t["TextListItem"], ["SectionTextContentID"], "ItemText", ["SequenceNumber", "TextListItemID"], " ", "ListText")
    blocks = t["SectionTextContent"].join(items, "SectionTextContentID", "left").withColumn("Block", F.coalesce("ContentText", "ListText"))
    text = ordered_string_agg(blocks, ["SectionID"], "Block", ["SequenceNumber", "SectionTextContentID"], " ", "ContentText")
    rows = t["Section"].join(text, "SectionID").filter(F.length("ContentText") > 3)
    w = Window.partitionBy("DocumentID").orderBy("SectionCode", "SectionID")
    return rows.select("DocumentID", "SectionID", "SectionCode", "Title", "ContentText", F.row_number().over(w).alias("SequenceNumber"))


#: Tags of section texts and their Markdown.
MARKDOWN_TAGS = (('<content styleCode="bold">', "**"), ('<content styleCode="italics">', "*"), ('<content styleCode="underline">', "_"), ("</content>", ""))


def to_markdown(col: Column, close: bool = False) -> Column:
    """Tags become Markdown.  Closing tags vanish, so emphasis stays open, as in the original view; close=True closes it."""
    out = col
    if close:
        for tag, mark in MARKDOWN_TAGS[:3]:
            out = F.regexp_replace(out, F.lit(tag + "(.*?)</content>"), F.lit(mark.replace("*", "\\*") + "$1" + mark.replace("*", "\\*")))
        out = F.replace(F.replace(out, F.lit("\\*"), F.lit("*")), F.lit("</content>"), F.lit(""))
        return out
    for tag, mark in MARKDOWN_TAGS:
        out = F.replace(out, F.lit(tag), F.lit(mark))
    return out


def section_markdown(t: Tables) -> DataFrame:
    """Markdown per section with a heading; list items have dashes."""
    li = t["TextListItem"].withColumn("Item", F.concat(F.lit("- "), "ItemText"))
    items = ordered_string_agg(li, ["SectionTextContentID"], "Item", ["SequenceNumber", "TextListItemID"], "\n", "ListText")
    blocks = t["SectionTextContent"].join(items, "SectionTextContentID", "left").withColumn("Block", F.coalesce(to_markdown(F.col("ContentText")), F.col("ListText")))
    text = ordered_string_agg(blocks, ["SectionID"], "Block", ["SequenceNumber", "SectionTextContentID"], "\n\n", "Body")
    rows = t["Section"].join(text, "SectionID").join(t["Document"].select("DocumentID", "DocumentGUID"), "DocumentID")
    md = F.concat(F.coalesce(F.concat(F.lit("## "), "Title", F.lit("\n\n")), F.lit("")), "Body")
    return rows.select("DocumentGUID", F.concat_ws("|", "DocumentGUID", F.coalesce("SectionCode", F.lit("NONE")), F.col("SectionID").cast("string")).alias("SectionKey"), "SectionCode", md.alias("FullSectionText"))


#: Prefixes of application numbers, in the order in which they are tried.
APPLICATION_PREFIXES = ("sANDA", "sNDA", "sBLA", "ANDA", "NDA", "BLA", "DMF", "OTC", "PMA", "IND")


def strip_prefix(col: Column) -> Column:
    return F.regexp_replace(col, "(?i)^(" + "|".join(APPLICATION_PREFIXES) + ")", "")


def ingredient_view(t: Tables, kind: str = "all") -> DataFrame:
    """Ingredients with their product's application; kind: all, active or inactive (null classes are neither)."""
    ing = {"all": lambda d: d, "active": lambda d: d.filter("ClassCode <> 'IACT'"), "inactive": lambda d: d.filter("ClassCode = 'IACT'")}[kind](t["Ingredient"])
    m = t["MarketingCategory"].select("ProductID", "CategoryDisplayName", "ApplicationOrMonographIDValue")
    rows = ing.join(t["IngredientSubstance"], "IngredientSubstanceID", "left").join(t["Product"], "ProductID").join(m, "ProductID", "left")
    return rows.select("ProductID", "ProductName", "UNII", "SubstanceName", "ClassCode", F.col("CategoryDisplayName").alias("ApplicationType"), strip_prefix(F.col("ApplicationOrMonographIDValue")).alias("ApplicationNumber"))


def activity_summary(t: Tables, active: bool) -> DataFrame:
    """Ingredient counts with the class code in the key; null classes fall out of both.  Names come to what is counted."""
    keep = "ClassCode <> 'IACT'" if active else "ClassCode = 'IACT'"
    counted = t["Ingredient"].filter(keep).groupBy("IngredientSubstanceID", "ClassCode").agg(F.countDistinct("ProductID").alias("ProductCount"))
    names = t["IngredientSubstance"].select("IngredientSubstanceID", "UNII", "SubstanceName").distinct()
    return counted.join(names, "IngredientSubstanceID").select("IngredientSubstanceID", "UNII", "SubstanceName", "ClassCode", "ProductCount")


def latest_label(t: Tables) -> DataFrame:
    """Per substance code and product name the label that took effect last, then the least DocumentGUID."""
    act = t["Ingredient"].filter("ClassCode <> 'IACT'").join(t["IngredientSubstance"], "IngredientSubstanceID").filter("UNII is not null").select("ProductID", "UNII", "SubstanceName")
    rows = act.join(spine(t), "ProductID").select("UNII", "SubstanceName", "ProductName", "DocumentGUID", "EffectiveTime", "ProductID")
    return top1_per_key(rows, ["UNII", "ProductName"], [F.col("EffectiveTime").desc(), F.col("DocumentGUID"), F.col("ProductID"), F.col("SubstanceName")]).drop("ProductID")


def indications(t: Tables) -> DataFrame:
    """Texts of indication sections by active substance; blank ones are left out."""
    act = t["Ingredient"].filter("ClassCode <> 'IACT'").join(t["IngredientSubstance"], "IngredientSubstanceID").select("ProductID", "UNII", "SubstanceName")
    sections = t["Section"].filter(F.upper("SectionDisplayName").like("INDICATION%")).select("SectionID")
    text = section_content(t).join(sections, "SectionID", "left_semi").select("SectionID", "ContentText")
    rows = act.join(t["Product"].select("ProductID", "ProductName", "SectionID"), "ProductID").join(text, "SectionID")
    return rows.filter(F.trim("ContentText") != "").select("UNII", "SubstanceName", "ProductName", "ContentText").distinct()


def inventory(t: Tables) -> DataFrame:
    """Totals, counts by application category, and the most frequent labelers and forms, ties included."""
    def total(name: str, category: str, label: str, order: int) -> DataFrame:
        return t[name].agg(F.count(F.lit(1)).alias("ItemCount")).select(F.lit(category).alias("Category"), F.lit(label).alias("Dimension"), "ItemCount", F.lit(order).alias("SortOrder"))

    def top(df: DataFrame, key: str, category: str, k: int, base: int) -> DataFrame:
        counts = topk_with_ties(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("ItemCount")), [F.col("ItemCount").desc()], k)
        n = F.row_number().over(Window.orderBy(F.col("ItemCount").desc(), F.col(key)))
        return counts.select(F.lit(category).alias("Category"), F.col(key).alias("Dimension"), "ItemCount", (F.lit(base) + n).alias("SortOrder"))

    parts = [
        total("Document", "TOTALS", "Documents", 1),
        total("Product", "TOTALS", "Products", 2),
        total("Organization", "TOTALS", "Organizations", 3),
        total("IngredientSubstance", "TOTALS", "Substances", 4),
        total("PharmacologicClass", "TOTALS", "Classes", 5),
        top(t["MarketingCategory"], "CategoryDisplayName", "BY_CATEGORY", 20, 100),
        top(labelers(t), "LabelerName", "TOP_LABELERS", 15, 200),
        top(t["Product"], "FormDisplayName", "TOP_FORMS", 10, 300),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orange_book_patents(t: Tables) -> DataFrame:
    """Patents of new drug applications with their labels; a patent knows whether a *PED sibling exists."""
    p = t["OBProduct"].filter("ApplType = 'N'").join(t["OBPatent"].filter("PatentExpireDate is not null"), "OrangeBookProductID")
    siblings = t["OBPatent"].filter(F.col("PatentNo").endswith("*PED")).select("OrangeBookProductID", F.regexp_replace("PatentNo", r"\*PED$", "").alias("PatentNo"), F.lit(1).alias("ped")).distinct()
    m = t["MarketingCategory"].filter("CategoryDisplayName = 'NDA'").select("ProductID", F.regexp_replace("ApplicationOrMonographIDValue", "^NDA", "").alias("ApplNo"))
    labels = m.join(spine(t).select("ProductID", "DocumentGUID"), "ProductID").select("ApplNo", "DocumentGUID").distinct()
    rows = p.join(siblings, ["OrangeBookProductID", "PatentNo"], "left").join(labels, "ApplNo", "left").join(t["OBUseCode"], "PatentUseCode", "left")
    return rows.select("ApplNo", "TradeName", "Ingredient", F.replace("Strength", F.lit(" **Discontinued**"), F.lit(" ")).alias("Strength"), "PatentNo", "PatentExpireDate", F.coalesce("ped", F.lit(0)).alias("HasPediatricExtension"), "PatentUseCode", "Definition", "DocumentGUID").distinct()
