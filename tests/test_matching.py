"""Phrases, dictionaries, near names, class maps, searches, applications, checks, stores and imports against plain loops."""

import random
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions import applications, class_maps, phrases, populations, table_validation, terms, text_index, training_store
from tessera.streaming import imports


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(d[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_phrases_by_automaton_and_by_join(spark):
    aliases = [("AUC", "area"), ("AUC 0-24", "day"), ("cmax", "peak"), ("τ", "tau"), ("half", "half"), ("half life", "t"), ("c max", "peak"), ("", "none"), ("cmax", "other")]
    texts = [(1, "AUC  0-24 and Cmax, half-life"), (2, "xauc auc0 (auc) auc/τ"), (3, None), (4, ""), (5, "half lifes half life"), (6, "c max"), (7, "half"), (7, "half")]
    table, rows = spark.createDataFrame(aliases, "Alias string, Canonical string"), spark.createDataFrame(texts, "id int, text string")
    want = sorted([(1, 0, "auc 0-24", "day"), (1, 13, "cmax", "other"), (1, 19, "half", "half"), (2, 11, "auc", "area"), (2, 16, "auc", "area"), (2, 20, "tau", "tau"), (5, 0, "half", "half"), (5, 11, "half life", "t"), (6, 0, "c max", "peak"), (7, 0, "half", "half"), (7, 0, "half", "half")])
    assert sorted(map(tuple, phrases.matches(rows, table).collect())) == want
    assert sorted(set(map(tuple, phrases.matches(rows, table, bound=0).collect()))) == sorted(set(want))
    assert {r.id: r.Canonical for r in phrases.first_match(rows, table).collect()} == {1: "day", 2: "area", 5: "t", 6: "peak", 7: "half"}
    assert phrases.matches(rows, table.limit(0)).count() == 0 and phrases.matches(rows.limit(0), table).count() == 0


def test_terms_by_layers(spark):
    d = spark.createDataFrame([("Headache", "Nervous"), ("Nausea", "Gut"), ("Chill", None)], "Name string, System string")
    v = spark.createDataFrame([("head ache", "Headache"), ("sick", "Unlisted")], "Variant string, Name string")
    c = spark.createDataFrame([("gastro", "Gut"), ("misc", None), ("misc", "Gut")], "Alias string, System string")
    x = spark.createDataFrame([("Total",), (None,)], "Name string")
    rows = [(1, "HEAD-ACHE*", "gut"), (2, "nausea", None), (3, "sick", "Gastro."), (4, "total", None), (5, "odd thing", "misc"), (6, "odd  thing", "skin stuff"), (7, "rash of skin", "Gut"), (8, None, "Gut"), (9, " ", "Gut"), (10, "odd", None), (11, "chill", "Nervous")]
    out = terms.standardise(spark.createDataFrame(rows, "id int, ParameterName string, ParameterCategory string"), d, v, c, x, [("SKIN", "Skin")])
    got = {r.id: (r.ParameterName, r.ParameterCategory, r.NameLayer, r.SystemLayer, r.StdFlags) for r in out.collect()}
    assert got == {
        1: ("Headache", "Nervous", "variant", "name", "AE_STD:NAME;AE_STD:SOC_ALIGNED"), 2: ("Nausea", "Gut", "dictionary", "name", "AE_STD:NAME;AE_STD:SOC_FILLED"), 3: ("Unlisted", "Gut", "variant", "category-alias", "AE_STD:NAME;AE_STD:SOC"),
        5: ("Odd thing", None, "text", "category-none", "AE_STD:NAME;AE_STD:SOC_UNMAPPED"), 6: ("Odd thing", "Skin", "text", "category-pattern", "AE_STD:NAME;AE_STD:SOC"), 7: ("Rash of skin", "Skin", "text", "name-pattern", "AE_STD:NAME;AE_STD:SOC_ALIGNED"),
        10: ("Odd", None, "text", "unmapped", "AE_STD:NAME;AE_STD:SOC_UNMAPPED"), 11: ("Chill", "Nervous", "dictionary", "category", "AE_STD:NAME"),
    }
    assert {(r.ParameterName, r.SystemLayer): r.n for r in terms.unmapped(out).collect()} == {("Odd thing", "category-none"): 1, ("Odd", "unmapped"): 1}


def test_layers_are_tried_once_for_each_printed_name(spark):
    empty = spark.createDataFrame([], "Name string, System string, Variant string, Alias string")
    rows = spark.range(60).selectExpr("id", "concat('odd  thing ', id % 2) as ParameterName", "case when id % 3 = 0 then 'Gut' end as ParameterCategory")
    out = terms.standardise(rows, empty, empty, empty, empty, [("THING", "Things")])
    assert {(r.ParameterName, r.ParameterCategory, r.StdFlags): r["count"] for r in out.groupBy("ParameterName", "ParameterCategory", "StdFlags").count().collect()} == {
        (f"Odd thing {i}", "Things", f"AE_STD:NAME;AE_STD:SOC{x}"): n for i in (0, 1) for x, n in (("", 10), ("_FILLED", 20))
    }
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_near_names_are_complete(spark, least):
    r = random.Random(int(least * 10))
    base = ["".join(r.choice("abcä ") for _ in range(r.randint(1, 14))) for _ in range(40)]
    names = {n for b in base for n in (b, b[1:], b + r.choice("xy"), b.replace("a", "b", 1))} - {""}
    got = {(x.a, x.b): x.similarity for x in populations.near(spark.createDataFrame([(n,) for n in [*names, *base, None, ""]], "name string"), least).collect()}
    want = {(a, b): 1 - edit(a, b) / max(len(a), len(b)) for a in names for b in names if a < b}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= least - 1e-12})


def test_table_populations(spark):
    a = spark.createDataFrame([("adults", "Adults"), ("healthy adults", "Healthy adults"), ("children", "Children")], "Alias string, Canonical string")
    rows = [(1, "Healthy adults, day 1", "Adults", None), (2, "Adults", "Children", "x"), (3, "Adults", None, "Children"), (4, None, "", "Children"), (5, None, None, None), (6, "none", "Adults", "Children")]
    got = {r.id: (r.Population, round(r.PopulationConfidence, 6)) for r in populations.table_population(spark.createDataFrame(rows, "id int, Caption string, SectionTitle string, ParentTitle string"), a).collect()}
    alike = 1 - edit("healthy adults", "adults") / 14
    assert alike < 0.5 and got == {1: ("Adults", 0.4), 2: ("Children", 0.4), 3: ("Adults", 0.7), 4: ("Children", 0.8), 5: (None, 0.0), 6: ("Adults", 0.8)}


def page_of(axis, pairs, page, size):
    """The page's positions: as it is, or with the nearest pair."""
    at = {c: i for i, c in enumerate(axis)}
    start = min(max((page - 1) * size, 0), len(axis) - 1)
    own = list(range((page - 1) * size, min(page * size, len(axis))))
    if size < 2 or len(axis) < 2 or any(at[a] in own and at[b] in own for a, b, _ in pairs) or not pairs:
        return own
    best = min(pairs, key=lambda p: (not (at[p[0]] in own or at[p[1]] in own), min(abs(at[p[0]] - start), abs(at[p[1]] - start)), -p[2], min(at[p[0]], at[p[1]]), max(at[p[0]], at[p[1]])))
    chosen = {at[best[0]], at[best[1]]}
    for i in [*range(start, len(axis)), *range(start)]:
        if len(chosen) < size:
            chosen.add(i)
    return sorted(chosen)


def test_pages_of_classes(spark):
    axis = [f"c{i}" for i in range(9)]
    pairs = [("c0", "c4", 5), ("c1", "c8", 4), ("c2", "c3", 4), ("c5", "c0", 9), ("c6", "c1", 3), ("c7", "c0", 3)]
    rows = spark.createDataFrame([(c, i + 1, "EPC") for i, c in enumerate(axis)] + [("z", 10, "EPC"), ("y", 11, "Other")], "Class string, Position int, Type string")
    drawn = spark.createDataFrame(pairs + [("y", "c0", 7)], "A string, B string, PairCount int")
    for page, size in ((1, 2), (1, 4), (2, 3), (3, 3), (5, 2), (2, 8), (9, 3), (1, 1)):
        got, compacted = class_maps.window(rows, drawn, page, size, "epc")
        found = [(r.Class, r.Index) for r in got.orderBy("Index").collect()]
        want = page_of(axis, pairs, page, size)
        assert found == [(axis[i], k) for k, i in enumerate(want)] and compacted == (want != list(range((page - 1) * size, min(page * size, 9)))), (page, size)
    assert class_maps.window(rows, drawn.limit(0), 1, 3)[0].count() == 0


def test_class_cells(spark):
    obs = [("A [EPC]", t, f"d{k}", float(k)) for k, t in enumerate("pqrst")] + [("B", t, f"d{k}", float(k * k)) for k, t in enumerate("qrstu")] + [("C", "p", "d", 1.0), (None, "p", "d", 1.0), ("A [EPC]", "p", "e", 4.0)]
    values = class_maps.per_class_term(spark.createDataFrame(obs, "Class string, Term string, Drug string, LogRR double"))
    assert {r.Term: (r.Value, r.Count, r.Drugs, r.Largest) for r in values.filter("Class = 'A [EPC]'").collect()}["p"] == (2.0, 2, 2, 4.0)
    got = {(r.A, r.B): (r.PairCount, r.InsufficientN, r.Raw and round(r.Raw, 9), r.Coefficient and round(r.Coefficient, 9)) for r in class_maps.cells(values).collect()}
    assert got == {("A [EPC]", "B"): (4, False, 1.0, 1.0), ("A [EPC]", "C"): (1, True, None, None)}
    assert [r.Term for r in class_maps.drill_down(values, "A [EPC]", "B").orderBy("Term").collect()] == ["q", "r", "s", "t"]


def test_checks_of_tables(spark):
    schema = "TextTableID int, DocumentGUID string, ParameterName string, TreatmentArm string, SourceRowSeq int, ArmN int, PrimaryValue double, PrimaryValueType string, TableCategory string, LowerBound double, UpperBound double, ParseConfidence double, Time double, Timepoint string, ValidationFlags string, ParseRule string"
    row = lambda t, name, arm, seq, n=5, v=1.0, time=None, point=None, low=0.0, sure=0.9: (t, "d", name, arm, seq, n, v, "Count", "AdverseEvent", low, 1.0, sure, time, point, None, "r")
    rows = [row(1, "a", "X", 1), row(1, "a", "X", 1), row(1, "a", "Y", 1, v=None), row(1, "a", "Comparison", 1, n=None), row(2, "a", "X", 1, time=1.0), row(2, "a", "Y", 1), row(3, "a", "X", 1, time=1.0), row(3, "a", "Y", 1, point="single dose", low=2.0), row(4, None, " ", 1, n=None, sure=0.2)]
    frame, watch = table_validation.observed(spark.createDataFrame(rows, schema), "figures")
    got = Counter((r.TextTableID, r.Issue, r.Detail) for r in table_validation.issues(frame).collect())
    assert got == Counter([
        (1, "DUPLICATE_OBSERVATION", "(a, X, Row=1) x 2"), (1, "ARM_COVERAGE_GAP", "Y"), (1, "COUNT_DEVIATION", "expected 2 (2 arms, 1 parameters), got 3"), (1, "MISSING_ARM_N", "1"), (2, "TIME_EXTRACTION_INCONSISTENCY", "1 of 2 without time"),
        (3, "BOUND_INVERSION", "1"), (4, "MISSING_PARAMETER", "1"), (4, "MISSING_ARM_N", "1"), (4, "LOW_CONFIDENCE", "1"),
    ])
    assert watch.get == {"rows": 9, "values": 8, "flagged": 0, "AdverseEvent": 9, "PK": 0, "DrugInteraction": 0, "Efficacy": 0, "sure": 8, "likely": 0, "doubtful": 0, "unsure": 1}
    assert table_validation.issues(spark.createDataFrame([], schema)).count() == 0


def test_searches_with_synonyms(spark):
    entries = [(1, "High blood pressure; high BLOOD pressure"), (2, "pressure of water"), (3, "blood-pressure"), (4, None), (5, "blood blood blood")]
    e = spark.createDataFrame(entries, "id int, text string")
    q = spark.createDataFrame([("a", "What is hypertension?"), ("b", "The blood"), ("c", "of the"), ("d", None), ("e", "hyper tension")], "qid string, text string")
    s = spark.createDataFrame([("Hypertension", "blood pressure"), ("hypertension", "high"), ("of", "never"), ("", "x")], "Key string, Synonym string")
    asked = text_index.terms(q, s)
    assert sorted(map(tuple, asked.collect())) == [("a", "blood pressure"), ("a", "high"), ("a", "hypertension"), ("b", "blood"), ("c", "never"), ("e", "hyper"), ("e", "tension")]
    got = sorted((r.qid, r.Rank, r.id, r.Score) for r in text_index.best(e, text_index.index(e), asked, 2).collect())
    assert got == [("a", 1, 1, 4), ("a", 2, 3, 1), ("b", 1, 5, 3), ("b", 2, 1, 2)]


def test_equal_texts_are_searched_once(spark):
    texts = ["blood pressure", "Blood; pressure", "blood", "blood blood", None, "water"]
    e = spark.range(60).selectExpr("59 - id as id", f"element_at(array({', '.join('null' if t is None else repr(t) for t in texts)}), cast(id % 6 as int) + 1) as text")
    asked = spark.createDataFrame([("a", "blood"), ("b", "blood pressure"), ("c", "water"), ("d", "never")], "qid string, Term string")
    want = sorted(map(tuple, text_index.best(e, text_index.index(e), asked, 4).select("qid", "id", "Score", "Rank").collect()))
    found = text_index.best_of_texts(e, asked, 4)
    assert len(want) == 12 and sorted(map(tuple, found.collect())) == want
    many = text_index.best_of_texts(e, asked, 100)
    assert sorted((r.qid, r.n) for r in many.groupBy("qid").agg(F.count("id").alias("n")).collect()) == [("a", 40), ("b", 20), ("c", 10)]


def test_applications_and_ingredients(spark):
    left = ["NDA 123", "nda123", "ANDA045", "X99", "BLA7", None, "NDA123456"]
    right = ["NDA123", "N0451", "Z-045", "123456", "991", None, "77"]
    a, b = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    digits = lambda t: "".join(c for c in t or "" if c.isdigit())
    full = lambda t: (t or "").upper().replace(" ", "")
    exact = {(x, y, "exact") for x in left for y in right if x and y and full(x) == full(y)}
    done = {x for x, *_ in exact}
    want = exact | {(x, y, "digits") for x in left for y in right if x and y and x not in done and digits(x) == digits(y)}
    assert {tuple(r) for r in applications.by_number(a, b).collect()} == want
    assert {tuple(r) for r in applications.inside(a, b).collect()} == {(x, y) for x in left for y in right if len(digits(x)) >= 3 and digits(x) in digits(y)}
    lists = spark.createDataFrame([(1, "B; a ;A"), (2, "a;b;c"), (3, ""), (4, None), (5, "b;;A")], "a int, list string")
    names = spark.createDataFrame([("x", "a;b"), ("y", "C; b; a"), ("z", None)], "b string, list string")
    assert {tuple(r) for r in applications.same_ingredients(lists, names).collect()} == {(1, "x", 2), (5, "x", 2), (2, "y", 3)}


def test_training_store(spark):
    r, kept = random.Random(2), {}
    store = spark.createDataFrame([], "id int, text string, label string, trusted boolean, batch long")
    for batch in range(5):
        rows = [(r.randint(0, 30), f"t{r.randint(0, 9)}", r.choice("ab"), r.random() < 0.3) for _ in range(12)]
        for i, t, label, trusted in sorted(rows, key=lambda x: (x[0], not x[3], x[2], x[1])):
            old = kept.get(i)
            if old is None or trusted or (not old[2] and old[3] < batch):
                if old is None or old[3] < batch or (trusted and not old[2]):
                    kept[i] = (t, label, trusted, batch)
        kept = dict(sorted(kept.items(), key=lambda x: (not x[1][2], -x[1][3], x[0]))[:15])
        store = training_store.add(store, spark.createDataFrame(rows, "id int, text string, label string, trusted boolean"), batch, 15)
        assert {x.id: (x.text, x.label, x.trusted, x.batch) for x in store.collect()} == kept
    newest = sum(v[3] == 4 for v in kept.values())
    assert training_store.due(store, 3, newest) and not training_store.due(store, 3, newest + 1) and not training_store.due(store.limit(0), 0, 1)


def label(guid):
    return f'<document xmlns="urn:hl7-org:v3"><id root="{guid}"/><title>T {guid}</title></document>'


def archive(folder, name, *labels):
    with zipfile.ZipFile(folder / name, "w") as z:
        for k, xml in enumerate(labels):
            z.writestr(f"{k}.xml", xml)


def test_import_stops_and_goes_on(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    archive(inbox, "a.zip", label("a1"), label("a2"))
    archive(inbox, "b.zip", label("b1"), "<broken")
    (inbox / "c.zip").write_bytes(b"no archive")
    seen = []

    def fail(batch):
        seen.append(batch)
        if len(seen) == 2:
            raise RuntimeError("stopped behind the writes of the second batch")

    with pytest.raises(Exception, match="stopped"):
        imports.run(spark, str(inbox), out, 1, fail)
    archive(inbox, "d.zip", label("d1"))
    imports.run(spark, str(inbox), out, 1, seen.append)
    assert seen[1] == seen[2]  # the batch that wasn't committed runs again
    imports.run(spark, str(inbox), out, 1, seen.append)
    assert len(seen) == 5
    got = {r.path.rsplit("/", 1)[1]: (r.files, r.labels, r.errors) for r in imports.manifest(spark, out).collect()}
    assert got == {"a.zip": (2, 2, 0), "b.zip": (2, 1, 1), "c.zip": (0, 0, 1), "d.zip": (1, 1, 0)} and imports.manifest(spark, out).count() == 4
    assert Counter(r.DocumentGUID for r in imports.labels(spark, out).collect() if r.DocumentGUID) == Counter(["a1", "a2", "b1", "d1"])
    packed = spark.createDataFrame([(f"{k}.xml", label(f"p{k}")) for k in range(5)], "name string, xml string").repartition(2)
    for _ in range(2):  # a repeated task writes the same files
        assert sum(r.labels for r in imports.write_archives(packed, str(tmp_path / "more")).collect()) == 5
    imports.run(spark, str(tmp_path / "more"), str(tmp_path / "out2"))
    assert defaultdict(int, Counter(r.DocumentGUID for r in imports.labels(spark, str(tmp_path / "out2")).collect())) == {f"p{k}": 1 for k in range(5)}


def test_larger_inboxes_make_larger_batches():
    from tessera.plans import registry

    per_batch = registry.validation_queries.per_batch
    assert [-(-n // per_batch(n)) for n in (1, 4, 16, 32, 33, 900, 100_000)] == [1, 1, 4, 8, 7, 8, 8]


def test_an_archive_is_unpacked_at_a_time():
    import io
    import zipfile

    import pandas as pd

    from tessera.sources import spl

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.xml", "<a/>")
    frames = list(spl._unzip(iter([pd.DataFrame({"path": ["p", "q"], "content": [packed.getvalue(), b"broken"]})])))
    assert [list(f.source) for f in frames] == [["p"], ["q"]] and frames[0].xml[0] == "<a/>" and frames[1].error[0]
