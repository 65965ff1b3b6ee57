"""Parameterised label queries: filters, a fixed order, and an optional page over the label views.

Each takes the label tables by name.  Orders end in unique columns, so pages don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import search
from tessera.operators.relops import page
from tessera.plans import label_views as V
from tessera.session import stored

Tables = dict[str, DataFrame]
Page = tuple[int, int] | None


def _paged(df: DataFrame, order: list[Column | str], at: Page) -> DataFrame:
    return page(df, [F.col(c) if isinstance(c, str) else c for c in order], *(at or (None, None)))


def _terms(df: DataFrame, text: str | None, *cols: str) -> DataFrame:
    return df.filter(search.term_filter([F.col(c) for c in cols], text))


def by_application(t: Tables, number: str, at: Page = None) -> DataFrame:
    """Equal without spaces and case, or with that prefix, or holding its digits or itself."""
    n, col = number.replace(" ", "").upper(), F.upper(F.replace("ApplicationNumber", F.lit(" "), F.lit("")))
    digits = "".join(c for c in n if c.isdigit())
    return _paged(V.products_by_application(t).filter((col == n) | col.startswith(n) | col.contains(n) | (col.contains(digits) if digits else F.lit(False))), ["ProductID", "DocumentGUID"], at)


def application_summaries(t: Tables, text: str | None = None, at: Page = None) -> DataFrame:
    return _paged(_terms(V.application_summary(t), text, "ApplicationNumber"), [F.col("ProductCount").desc(), "ApplicationNumber", "CategoryCode"], at)


def by_class(t: Tables, text: str, at: Page = None) -> DataFrame:
    return _paged(_terms(V.class_products(t), text, "ClassDisplayName"), ["ClassDisplayName", "ProductName", "ProductID", "UNII"], at)


def by_class_exact(t: Tables, code: str, at: Page = None) -> DataFrame:
    return _paged(V.class_products(t).filter(F.col("ClassCode") == code), ["ProductName", "ProductID", "UNII"], at)


def class_edges(t: Tables, at: Page = None) -> DataFrame:
    return _paged(V.class_hierarchy(t), ["ParentName", "ChildName", "ParentCode", "ChildCode"], at)


def class_summaries(t: Tables, at: Page = None) -> DataFrame:
    return _paged(V.class_summary(t), [F.col("ProductCount").desc(), "ClassCode"], at)


def ingredient_counts(t: Tables, active: bool, text: str | None = None, least: int | None = None, at: Page = None) -> DataFrame:
    rows = _terms(V.activity_summary(t, active), text, "SubstanceName")
    return _paged(rows if least is None else rows.filter(F.col("ProductCount") >= least), [F.col("ProductCount").desc(), "IngredientSubstanceID", "ClassCode"], at)


def by_ingredient(t: Tables, unii: str | None = None, text: str | None = None, at: Page = None) -> DataFrame:
    """A code wins over a text."""
    rows = V.products_by_ingredient(t)
    rows = rows.filter(F.col("UNII") == unii) if unii else _terms(rows, text, "SubstanceName")
    return _paged(rows, ["SubstanceName", "ProductName", "ProductID"], at)


def ingredient_summaries(t: Tables, text: str | None = None, least: int | None = None, at: Page = None) -> DataFrame:
    rows = _terms(V.ingredient_summary(t), text, "SubstanceName")
    return _paged(rows if least is None else rows.filter(F.col("ProductCount") >= least), [F.col("ProductCount").desc(), "IngredientSubstanceID"], at)


def ingredients(t: Tables, kind: str = "all", unii: str | None = None, name: str | None = None, application: str | None = None, category: str | None = None, product: str | None = None, at: Page = None) -> DataFrame:
    rows = V.ingredient_view(t, kind)
    for col, value in (("UNII", unii), ("ApplicationNumber", application), ("ApplicationType", category)):
        rows = rows.filter(F.col(col) == value) if value else rows
    return _paged(_terms(_terms(rows, name, "SubstanceName"), product, "ProductName"), ["SubstanceName", "ProductName", "ProductID"], at)


def sharing_ingredients(t: Tables, application: str) -> DataFrame:
    """Products with any substance that the application's products have."""
    rows = V.ingredient_view(t)
    wanted = rows.filter((F.col("ApplicationNumber") == application) & F.col("UNII").isNotNull()).select("UNII").distinct()
    return rows.join(wanted, "UNII", "left_semi").select("ProductID", "ProductName").distinct()


def related_ingredients(t: Tables, text: str) -> DataFrame:
    """By product that has a matching ingredient: all of its other active and inactive ones."""
    rows = V.ingredient_view(t)
    hit = _terms(rows, text, "SubstanceName").select("ProductID").distinct()
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("SubstanceName"))))
    return rows.join(hit, "ProductID", "left_semi").groupBy("ProductID", "ProductName").agg(names(F.col("ClassCode") != "IACT").alias("Active"), names(F.col("ClassCode") == "IACT").alias("Inactive"))


def by_ndc(t: Tables, text: str, at: Page = None) -> DataFrame:
    return _paged(_terms(V.products_by_ndc(t), text, "ProductCode"), ["ProductCode", "ProductID", "GenericName"], at)


def by_package_ndc(t: Tables, text: str, at: Page = None) -> DataFrame:
    return _paged(_terms(V.package_by_ndc(t), text, "PackageCode"), ["PackageCode", "ProductID"], at)


def by_labeler(t: Tables, text: str, at: Page = None) -> DataFrame:
    return _paged(_terms(V.products_by_labeler(t), text, "LabelerName"), ["LabelerName", "ProductName", "ProductID"], at)


def labeler_summaries(t: Tables, at: Page = None) -> DataFrame:
    return _paged(V.labeler_summary(t), [F.col("ProductCount").desc(), "OrganizationID"], at)


def documents(t: Tables, set_guid: str | None = None, latest: bool = False, at: Page = None) -> DataFrame:
    rows = V.document_navigation(t)
    rows = rows.filter(F.col("SetGUID") == set_guid) if set_guid else rows
    return _paged(rows.filter("IsLatestVersion = 1") if latest else rows, [F.col("EffectiveTime").desc(), "DocumentID"], at)


def versions(t: Tables, guid: str) -> DataFrame:
    """By set or by document."""
    return _paged(V.version_history(t).filter((F.col("SetGUID") == guid) | (F.col("DocumentGUID") == guid)), [F.col("VersionNumber").desc(), "DocumentGUID"], None)


def sections(t: Tables, code: str, at: Page = None) -> DataFrame:
    return _paged(_terms(V.section_navigation(t), code, "SectionCode"), ["DocumentID", "SectionID"], at)


def section_types(t: Tables, at: Page = None) -> DataFrame:
    return _paged(V.section_type_summary(t), [F.col("DocumentCount").desc(), "SectionCode"], at)


#: Section codes and the number that their titles start with.
SECTION_NUMBERS = {"34067-9": "1", "34068-7": "2", "34070-3": "4", "43685-7": "5", "34084-4": "6", "34073-7": "7"}
UNCLASSIFIED = "42229-5"


def section_texts(t: Tables, document_id: int, code: str | None = None) -> DataFrame:
    """A document's texts in order; with a code also its unclassified sections whose titles start with the code's number.

    As in the original, a section that meets both conditions stands twice.
    """
    rows = V.section_content(t).filter(F.col("DocumentID") == document_id)
    if code is None:
        return _paged(rows, ["SectionCode", "SequenceNumber"], None)
    own = rows.filter(F.col("SectionCode").contains(code))
    number = SECTION_NUMBERS.get(code)
    extra = rows.filter((F.col("SectionCode") == UNCLASSIFIED) & F.col("Title").startswith(f"{number}.")) if number else rows.limit(0)
    return _paged(own.unionByName(extra), ["SectionCode", "SequenceNumber"], None)


def markdown(t: Tables, document_guid: str, code: str | None = None) -> DataFrame:
    rows = V.section_markdown(t).filter(F.col("DocumentGUID") == document_guid)
    return _paged(rows.filter(F.col("SectionCode") == code) if code else rows, ["SectionKey"], None)


def interactions(t: Tables, uniis: list[str], at: Page = None) -> DataFrame:
    return _paged(V.interaction_lookup(t).filter(F.col("UNII").isin(uniis)), ["ProductName", "ProductID", "NDC", "PharmClassCode"], at)


def controlled(t: Tables, code: str | None = None, at: Page = None) -> DataFrame:
    rows = V.dea_schedule(t)
    return _paged(rows.filter(F.col("DEAScheduleCode") == code) if code else rows, ["DEAScheduleCode", "ProductName", "ProductID"], at)


def products(t: Tables, text: str, at: Page = None) -> DataFrame:
    return _paged(_terms(V.product_summary(t), text, "ProductName"), ["ProductName", "ProductID"], at)


def related(t: Tables, product_id: int, kind: str | None = None) -> DataFrame:
    """The products that share an application number or an active substance with one product and have another name."""
    rows = V.related_of(t, product_id)
    return _paged(rows.filter(F.col("RelationshipType") == kind) if kind else rows, ["RelationshipType", "RelatedProductID"], None)


def inventory(t: Tables, category: str | None = None) -> DataFrame:
    rows = V.inventory(t)
    return _paged(rows.filter(F.col("Category") == category) if category else rows, ["SortOrder"], None)


def latest_labels(t: Tables, unii: str | None = None, product: str | None = None, substance: str | None = None, at: Page = None) -> DataFrame:
    rows = V.latest_label(t)
    rows = rows.filter(F.col("UNII") == unii) if unii else rows
    return _paged(_terms(_terms(rows, product, "ProductName"), substance, "SubstanceName"), ["ProductName", "UNII"], at)


def latest_label_sections(t: Tables, unii: str) -> DataFrame:
    """The newest labels of a substance with their section texts."""
    docs = V.latest_label(t).filter(F.col("UNII") == unii).select("UNII", "ProductName", "DocumentGUID").join(t["Document"].select("DocumentID", "DocumentGUID"), "DocumentGUID")
    docs = stored(docs)
    return docs.join(V.content_of(t, docs), "DocumentID")


def indications(t: Tables, unii: str | None = None, product: str | None = None, substance: str | None = None, text: str | None = None, at: Page = None) -> DataFrame:
    rows = V.indications(t)
    rows = rows.filter(F.col("UNII") == unii) if unii else rows
    rows = _terms(_terms(_terms(rows, product, "ProductName"), substance, "SubstanceName"), text, "ContentText")
    return _paged(rows, ["ProductName", "UNII", "ContentText"], at)


def expiring_patents(t: Tables, start: str, months: int, number: str | None = None, ingredient: str | None = None, trade_name: str | None = None, drop_twins: bool = True, at: Page = None) -> DataFrame:
    """Patents that expire from a day on within so many months; a base patent goes where its *PED twin is listed."""
    day = F.lit(start).cast("date")
    rows = V.orange_book_patents(t).filter(F.col("PatentExpireDate").between(day.cast("timestamp"), F.add_months(day, months).cast("timestamp")))
    rows = rows.filter(F.col("PatentNo") == number) if number else rows
    rows = _terms(_terms(rows, ingredient, "Ingredient"), trade_name, "TradeName")
    if drop_twins:
        twins = rows.filter(F.col("PatentNo").endswith("*PED")).select("ApplNo", F.regexp_replace("PatentNo", r"\*PED$", "").alias("PatentNo")).distinct()
        rows = rows.join(twins, ["ApplNo", "PatentNo"], "left_anti")
    return _paged(rows, ["PatentExpireDate", "TradeName", "PatentNo", "DocumentGUID"], at)


def activity(log: DataFrame, user: int | None = None, since: str | None = None, until: str | None = None, endpoint: str | None = None, at: Page = None) -> DataFrame:
    """Activity rows (id, ts, user_id, event_type), newest first."""
    for cond, given in ((F.col("user_id") == user, user), (F.col("ts") >= F.lit(since), since), (F.col("ts") <= F.lit(until), until), (F.col("event_type") == endpoint, endpoint)):
        log = log.filter(cond) if given is not None else log
    return _paged(log, [F.col("ts").desc(), F.col("event_id").desc()], at)


def favourites(marks: DataFrame, summaries: DataFrame, user: int) -> DataFrame:
    """A user's marked documents with their summaries, newest mark first."""
    return _paged(marks.filter(F.col("user_id") == user).join(summaries, "DocumentGUID"), [F.col("created").desc(), "DocumentGUID"], None)


def toggle(marks: DataFrame, user: int, guid: str, created: str) -> DataFrame:
    """The marks with one more, or without the one that was there."""
    one = marks.sparkSession.createDataFrame([(user, guid, created)], marks.schema)
    same = ["user_id", "DocumentGUID"]
    return marks.join(one.select(*same), same, "left_anti").select(*marks.columns).unionByName(one.join(marks.select(*same), same, "left_anti").select(*marks.columns))


def classes_for_query(t: Tables, text: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Classes that a free text asks for: one holds the other, else a known term stands in the text and one of its words in the class."""
    q, name = text.lower(), F.lower("ClassDisplayName")
    direct = name.contains(q) | F.lit(q).contains(name)
    words = [w for k, ws in (synonyms or {}).items() if k in q for w in ws]
    return V.class_summary(t).filter(direct | (search.partial_any([F.col("ClassDisplayName")], words) if words else F.lit(False)))
