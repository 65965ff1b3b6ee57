"""Parameterised label queries on the smallest tables."""

from pyspark.sql import functions as F

from tessera.operators.relops import distinct_counts
from tessera.plans import label_search as S
from tessera.plans import label_views as V
from tessera.plans.domain import tables

SF = "/root/testdata/sf0.001"


def test_queries_filter_and_page(spark):
    t = tables(spark, SF)
    a = S.by_application(t, "nda 4").collect()
    assert a and all("4" in r.ApplicationNumber for r in a) and [r.ProductID for r in a] == sorted(r.ProductID for r in a)
    two = [[r.ProductID for r in S.by_labeler(t, "customer", (k, 7)).collect()] for k in (1, 2)]
    assert len(two[0]) == 7 and not set(two[0]) & set(two[1])
    latest = S.documents(t, latest=True).collect()
    assert len({r.SetGUID for r in latest}) == len(latest)
    guid = latest[0].SetGUID
    v = [r.VersionNumber for r in S.versions(t, guid).collect()]
    assert v == sorted(v, reverse=True) and v[0] == latest[0].VersionNumber
    assert all(r.ProductCount >= 3 for r in S.ingredient_counts(t, True, least=3).collect())
    assert S.related_ingredients(t, "ring").filter(F.size("Active") == 0).count() == 0
    assert S.classes_for_query(t, "something for pain", {"pain": ["ring"]}).count() > 0


def test_patents_and_marks(spark):
    t = tables(spark, SF)
    p = S.expiring_patents(t, "2026-01-01", 2).select("ApplNo", "PatentNo").distinct().collect()
    numbers = {(r.ApplNo, r.PatentNo) for r in p}
    assert numbers and not {(a, n.removesuffix("*PED")) for a, n in numbers if n.endswith("*PED")} & numbers
    marks = spark.createDataFrame([(1, "a", "2024")], "user_id int, DocumentGUID string, created string")
    assert S.toggle(marks, 1, "a", "2025").count() == 0 and S.toggle(marks, 1, "b", "2025").count() == 2
    assert S.favourites(S.toggle(marks, 1, "b", "2025"), spark.createDataFrame([("a", 5), ("b", 6)], "DocumentGUID string, n int"), 1).first().n == 6


def test_counts_are_made_on_ids(spark):
    rows = spark.createDataFrame([("a", 1, 7), ("a", 1, 8), ("a", None, 8), (None, 2, 7), (None, 3, 7), ("b", None, None)], "k string, x int, y long")
    got = {r.k: (r.n, r.m) for r in distinct_counts(rows, ["k"], {"n": "x", "m": "y"}).collect()}
    assert got == {"a": (1, 2), None: (2, 1), "b": (0, 0)}
    t = tables(spark, SF, once=True)
    for f in (V.ingredient_summary, V.labeler_summary):
        assert "Expand" not in "".join(x for x in f(t)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ProductID" in x)


def test_texts_of_some_documents(spark):
    t = tables(spark, SF)
    documents = t["Document"].filter("DocumentID % 40 = 3").select("DocumentID")
    want = V.section_content(t).filter("DocumentID % 40 = 3").collect()
    assert want and sorted(map(repr, V.content_of(t, documents).select(*want[0].asDict()).collect())) == sorted(map(repr, want))


def test_related_products_are_all_pairs(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    products = [(i, "same" if i % 5 == 0 else f"p{i}", 1 if i in (5, 10) else i) for i in range(1, 41)]
    sections = sorted({s for _, _, s in products})
    t = {
        "Product": frame(products, ["ProductID", "ProductName", "SectionID"]),
        "Section": frame([(s, s) for s in sections], ["SectionID", "StructuredBodyID"]),
        "StructuredBody": frame([(s, s) for s in sections], ["StructuredBodyID", "DocumentID"]),
        "Document": frame([(s, f"doc-{s}") for s in sections], ["DocumentID", "DocumentGUID"]),
        "MarketingCategory": frame([(i, None if i == 7 else "NDA1" if i < 36 else "NDA2") for i in range(1, 41)], "ProductID long, ApplicationOrMonographIDValue string"),
        "Ingredient": frame([(1, 9, "ACTIB"), (2, 9, "ACTIM"), (3, 9, "IACT"), (4, 9, None)], "ProductID long, IngredientSubstanceID long, ClassCode string"),
        "IngredientSubstance": frame([(9, "U9")], ["IngredientSubstanceID", "UNII"]),
    }
    name, section = {i: n for i, n, _ in products}, {i: s for i, _, s in products}
    app = {i: "NDA1" if i < 36 else "NDA2" for i in name if i != 7}
    want = {(a, b, app[a]) for a in app for b in app if a != b and app[a] == app[b] and not (name[a] == name[b] and section[a] == section[b])}
    assert (5, 10, "NDA1") not in want and (5, 15, "NDA1") in want
    for tile in (4, V.TILE):
        got = V.related_pairs(t, tile=tile).collect()
        by_app = [(r.SourceProductID, r.RelatedProductID, r.SharedValue) for r in got if r.RelationshipType == "SameApplicationNumber"]
        assert len(by_app) == len(want) and set(by_app) == want
        assert sorted((r.SourceProductID, r.RelatedProductID) for r in got if r.RelationshipType == "SameActiveIngredient") == [(1, 2), (2, 1)]
        assert all(r.SourceDocumentGUID == f"doc-{section[r.SourceProductID]}" and r.RelatedDocumentGUID == f"doc-{section[r.RelatedProductID]}" for r in got)
