"""Label XML: archives to documents, documents to typed tables, and back to XML and Markdown."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship_package
from tessera.sources import text_blocks

NS = "{urn:hl7-org:v3}"


def archives(spark: SparkSession, glob: str) -> DataFrame:
    """(source, name, xml, error) of the XML files in ZIP archives; a broken archive is one row with an error."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(_unzip, "source string, name string, xml string, error string")


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame an archive, so a task holds the texts of one at a time."""
    for pdf in batches:
        for path, content in zip(pdf.path, pdf.content, strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out = [(path, n, z.read(n).decode("utf-8", "replace"), None) for n in sorted(z.namelist()) if n.lower().endswith(".xml")]
            except zipfile.BadZipFile as e:
                out = [(path, None, None, str(e))]
            yield pd.DataFrame(out, columns=["source", "name", "xml", "error"])


def distinct_documents(files: DataFrame) -> DataFrame:
    """One row per content: files are equal when their SHA-256 without white space between tags is."""
    key = F.sha2(F.regexp_replace("xml", r">\s+<", "><"), 256)
    rows = files.filter("xml is not null").withColumn("sha256", key)
    first = rows.groupBy("sha256").agg(F.min(F.struct("source", "name")).alias("f"))
    return rows.join(first, "sha256").filter((F.col("source") == F.col("f.source")) & F.col("name").eqNullSafe(F.col("f.name"))).drop("f")


def _attr(node, path: str, name: str) -> str | None:
    found = node.find(path) if node is not None else None
    return found.get(name) if found is not None else None


def _text(node) -> str | None:
    return " ".join("".join(node.itertext()).split()) if node is not None else None


def _p(*names: str) -> str:
    return "/".join(NS + n for n in names)


#: Elements of the label standard that become rows of their own: kind, tag, {field: (path below it, attribute or None for the text)}.
#: A field whose path is empty is the element's own attribute.  A tag may name its parents, and then "@" and the code of the
#: section that it must stand in; of several entries for one element the one with most parents is taken.
ELEMENTS = (
    ("AuthorOrganization", "representedOrganization", {"Name": ("name", None), "Identifier": ("id", "extension"), "Root": ("id", "root")}),
    ("AssignedOrganization", "assignedOrganization", {"Name": ("name", None), "Identifier": ("id", "extension")}),
    ("BusinessOperation", "actDefinition", {"Code": ("code", "code"), "Name": ("code", "displayName"), "ProductCode": ("product/manufacturedProduct/manufacturedMaterialKind/code", "code")}),
    ("DocumentRelationship", "relatedDocument", {"Type": ("", "typeCode"), "DocumentID": ("relatedDocument/id", "root"), "SetID": ("relatedDocument/setId", "root"), "Version": ("relatedDocument/versionNumber", "value")}),
    ("Packaging", "asContent", {"Quantity": ("quantity/numerator", "value"), "Unit": ("quantity/numerator", "unit"), "PerQuantity": ("quantity/denominator", "value"), "Code": ("containerPackagedProduct/code", "code"), "Form": ("containerPackagedProduct/formCode", "displayName")}),
    ("MarketingStatus", "marketingAct", {"Code": ("code", "code"), "Status": ("statusCode", "code"), "Start": ("effectiveTime/low", "value"), "End": ("effectiveTime/high", "value")}),
    ("MarketingCategory", "approval", {"Number": ("id", "extension"), "Code": ("code", "code"), "Name": ("code", "displayName"), "Territory": ("author/territorialAuthority/territory/code", "code"), "Status": ("statusCode", "code"), "Start": ("effectiveTime/low", "value")}),
    ("ProductCharacteristic", "characteristic", {"Code": ("code", "code"), "Value": ("value", "value"), "ValueCode": ("value", "code"), "ValueName": ("value", "displayName"), "Unit": ("value", "unit"), "Text": ("value/originalText", None)}),
    ("ProductRelationship", "asEquivalentEntity", {"Code": ("code", "code"), "SourceCode": ("definingMaterialKind/code", "code")}),
    ("GenericMedicine", "genericMedicine", {"Name": ("name", None)}),
    ("Part", "partProduct", {"Name": ("name", None), "Code": ("code", "code"), "Form": ("formCode", "displayName")}),
    ("Policy", "policy", {"Class": ("", "classCode"), "Code": ("code", "code"), "Name": ("code", "displayName")}),
    ("Route", "substanceAdministration", {"Code": ("routeCode", "code"), "Name": ("routeCode", "displayName"), "DoseLow": ("doseQuantity/low", "value"), "Dose": ("doseQuantity", "value"), "DoseUnit": ("doseQuantity", "unit")}),
    ("ActiveMoiety", "activeMoiety", {"UNII": ("code", "code"), "Name": ("name", None)}),
    ("SectionMedia", "observationMedia", {"ID": ("", "ID"), "Text": ("text", None), "MediaType": ("value", "mediaType"), "File": ("value/reference", "value")}),
    ("SectionIndexing", "identifiedSubstance", {"Code": ("code", "code"), "Name": ("name", None), "Kind": ("asSpecializedKind/generalizedMaterialKind/code", "code"), "KindName": ("asSpecializedKind/generalizedMaterialKind/code", "displayName")}),
    ("LotDistribution", "productInstance", {"Lot": ("id", "extension"), "Expires": ("expirationTime/high", "value"), "Quantity": ("asInstanceOfKind/quantity", "value")}),
    ("REMS", "protocol", {"Code": ("code", "code"), "Name": ("code", "displayName"), "Requirement": ("component/requirement/code", "code"), "RequirementName": ("component/requirement/code", "displayName")}),
    ("AttachedDocument", "subjectOf/document", {"DocumentID": ("id", "root"), "Title": ("title", None), "TitleReference": ("title/reference", "value"), "MediaType": ("text", "mediaType"), "FileName": ("text/reference", "value")}),
    ("CertificationLink", "product/manufacturedProduct/manufacturedMaterialKind@BNCC", {"ProductCode": ("code", "code"), "CodeSystem": ("code", "codeSystem")}),
    ("ComplianceAction", "action", {"Code": ("code", "code"), "CodeSystem": ("code", "codeSystem"), "Name": ("code", "displayName"), "Start": ("effectiveTime/low", "value"), "End": ("effectiveTime/high", "value"), "On": ("effectiveTime", "value")}),
    ("DisciplinaryAction", "approval/subjectOf/action", {"Code": ("code", "code"), "CodeSystem": ("code", "codeSystem"), "Name": ("code", "displayName"), "On": ("effectiveTime", "value"), "Text": ("text", None)}),
    ("License", "actDefinition/subjectOf/approval", {"Number": ("id", "extension"), "Root": ("id", "root"), "Type": ("code", "code"), "TypeName": ("code", "displayName"), "Status": ("statusCode", "code"), "Expires": ("effectiveTime/high", "value"), "Territory": ("author/territorialAuthority/territory/code", "code"), "AgencyID": ("author/territorialAuthority/governingAgency/id", "extension"), "Agency": ("author/territorialAuthority/governingAgency/name", None)}),
    ("ProductEvent", "subjectOf", {"Code": ("productEvent/code", "code"), "Name": ("productEvent/code", "displayName"), "Start": ("productEvent/effectiveTime/low", "value"), "Quantity": ("quantity", "value"), "Unit": ("quantity", "unit")}),
    ("ProductExtension", "manufacturedProduct/subjectOf/document", {"URL": ("text/reference", "value"), "DocumentID": ("id", "root")}),
    ("WarningLetterProduct", "subject/manufacturedProduct/manufacturedProduct@48779-3", {"Name": ("name", None), "Suffix": ("name/suffix", None), "GenericName": ("asEntityWithGeneric/genericMedicine/name", None), "Form": ("formCode", "displayName"), "Code": ("code", "code")}),
    ("WarningLetterDate", "section@48779-3", {"Issued": ("effectiveTime/low", "value"), "Resolved": ("effectiveTime/high", "value")}),
    ("ToleranceSpecification", "observationCriterion", {"Code": ("code", "code"), "Value": ("value", "value"), "High": ("value/high", "value"), "Unit": ("value/high", "unit")}),
)
_PRODUCTS = "array<struct<ProductName:string,FormDisplayName:string,NDC:string,Ingredients:array<struct<UNII:string,SubstanceName:string,ClassCode:string>>>>"
PARSED = (
    "DocumentGUID string, SetGUID string, VersionNumber int, EffectiveTime string, Title string, Labeler string, error string, "
    "sections array<struct<SectionGUID:string,ParentSectionGUID:string,SectionCode:string,Title:string,Text:string,Position:int>>, products " + _PRODUCTS + ", elements array<struct<Kind:string,SectionGUID:string,Nth:int,Fields:map<string,string>>>, blocks array<" + text_blocks.BLOCK + ">"
)
_TEXT = pa.string()
_PARTS = {
    "sections": pa.struct([*[(n, _TEXT) for n in ("SectionGUID", "ParentSectionGUID", "SectionCode", "Title", "Text")], ("Position", pa.int32())]),
    "products": pa.struct([("ProductName", _TEXT), ("FormDisplayName", _TEXT), ("NDC", _TEXT), ("Ingredients", pa.list_(pa.struct([(n, _TEXT) for n in ("UNII", "SubstanceName", "ClassCode")])))]),
    "elements": pa.struct([("Kind", _TEXT), ("SectionGUID", _TEXT), ("Nth", pa.int32()), ("Fields", pa.map_(_TEXT, _TEXT))]),
}
#: The fields of PARSED before its lists.
_HEAD = pa.schema([(n, pa.int32() if n == "VersionNumber" else _TEXT) for n in ("DocumentGUID", "SetGUID", "VersionNumber", "EffectiveTime", "Title", "Labeler", "error")])


def _sections(root) -> list[dict]:
    out: list[dict] = []
    stack = [(s, None) for s in reversed(root.findall(_p("component", "structuredBody", "component", "section")))]
    while stack:
        s, parent = stack.pop()
        own = _attr(s, NS + "id", "root")
        out.append({"SectionGUID": own, "ParentSectionGUID": parent, "SectionCode": _attr(s, NS + "code", "code"), "Title": _text(s.find(NS + "title")), "Text": _text(s.find(NS + "text")), "Position": len(out)})
        stack += [(c, own) for c in reversed(s.findall(_p("component", "section")))]
    return out


def _products(root) -> list[dict]:
    out = []
    for p in root.iter(NS + "manufacturedProduct"):
        if p.find(NS + "name") is not None:
            found = [{"UNII": _attr(i, _p("ingredientSubstance", "code"), "code"), "SubstanceName": _text(i.find(_p("ingredientSubstance", "name"))), "ClassCode": i.get("classCode")} for i in p.findall(NS + "ingredient")]
            out.append({"ProductName": _text(p.find(NS + "name")), "FormDisplayName": _attr(p, NS + "formCode", "displayName"), "NDC": _attr(p, NS + "code", "code"), "Ingredients": found})
    return out


def _rules() -> dict[str, list[tuple]]:
    """By tag: (parents from the nearest on, section code or None, kind, fields), those with most parents first."""
    out: dict[str, list[tuple]] = {}
    for kind, tag, fields in ELEMENTS:
        path, _, code = tag.partition("@")
        *parents, own = path.split("/")
        out.setdefault(NS + own, []).append(([NS + p for p in reversed(parents)], code or None, kind, fields))
    return {tag: sorted(rules, key=lambda r: (-len(r[0]), r[1] is None)) for tag, rules in out.items()}


_RULES = _rules()


def _elements(root) -> list[dict]:
    """All elements of the known kinds in document order, with the innermost section that they stand in."""
    out: list[dict] = []
    # Up holds the tags above, the nearest first, as far as rules look.
    stack = [(root, None, None, ())]
    while stack:
        node, section, code, up = stack.pop()
        if node.tag == NS + "section":
            section, code = _attr(node, NS + "id", "root"), _attr(node, NS + "code", "code")
        for parents, where, kind, fields in _RULES.get(node.tag, ()):
            if list(up[: len(parents)]) != parents or (where is not None and where != code):
                continue
            got = {}
            for name, (path, attribute) in fields.items():
                at = node if not path else node.find(_p(*path.split("/")))
                got[name] = None if at is None else at.get(attribute) if attribute else _text(at)
            if any(v is not None for v in got.values()):
                out.append({"Kind": kind, "SectionGUID": section, "Nth": len(out), "Fields": list(got.items())})
                break
        stack += [(c, section, code, (node.tag, *up[:2])) for c in reversed(node)]
    return out


def _parse(xmls: list[str | None]) -> dict[str, pa.Array]:
    """The columns of PARSED.  Blocks, which are most of a label, become columns as they are, without a dict for each."""
    heads: list[tuple] = []
    parts: dict[str, list] = {k: [] for k in _PARTS}
    blocks: list[tuple] = []
    ends = [0]
    for xml in xmls:
        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError as e:
            root = None
            heads.append((*[None] * (len(_HEAD) - 1), str(e)))
        if root is not None:
            version = _attr(root, NS + "versionNumber", "value")
            org = root.find(_p("author", "assignedEntity", "representedOrganization", "name"))
            heads.append((_attr(root, NS + "id", "root"), _attr(root, NS + "setId", "root"), int(version) if version and version.isdigit() else None, _attr(root, NS + "effectiveTime", "value"), _text(root.find(NS + "title")), _text(org), None))
            blocks.extend(text_blocks.of_document(root))
        for name, of in (("sections", _sections), ("products", _products), ("elements", _elements)):
            parts[name].append([] if root is None else of(root))
        ends.append(len(blocks))
    out = {f.name: pa.array(c, f.type) for f, c in zip(_HEAD, zip(*heads, strict=True), strict=True)}
    out |= {k: pa.array(v, pa.list_(_PARTS[k])) for k, v in parts.items()}
    kinds = text_blocks.FIELD_TYPES
    columns = zip(*blocks, strict=True) if blocks else [()] * len(kinds)
    held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], fields=list(kinds))
    return out | {"blocks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, text_blocks.SLICE):
            yield batch.slice(start, text_blocks.SLICE)


def parsed(files: DataFrame) -> DataFrame:
    """One row per text of a column ``xml``: the document's head, its sections, products and elements, or the error of what is no XML."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            with text_blocks.uncollected():
                out = _parse(part.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict(out)

    return files.select("xml").mapInArrow(work, PARSED)


def parsed_beside(files: DataFrame) -> DataFrame:
    """parsed() with what stands beside the text: source, name, and as ``broken`` the error of an archive that can't be read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            source, name, broken, xml = part.columns
            with text_blocks.uncollected():
                out = _parse(xml.to_pylist())
            # What has no text is no label with an error of its own.
            out["error"] = pc.if_else(xml.is_valid(), out["error"], pa.scalar(None, _TEXT))
            yield pa.RecordBatch.from_pydict({"source": source, "name": name, "broken": broken} | out)

    return files.select("source", "name", "error", "xml").mapInArrow(work, "source string, name string, broken string, " + PARSED)


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """Documents, sections, products, elements, blocks of the texts and rejected texts.  Each is a view of the one parse; store parsed() where several are read."""
    return tables_of(parsed(files))


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of parsed rows."""
    good = rows.filter("error is null")
    split = lambda c: good.select("DocumentGUID", F.explode(c).alias("r")).select("DocumentGUID", "r.*")
    return {"document": good.select("DocumentGUID", "SetGUID", "VersionNumber", "EffectiveTime", "Title", "Labeler"), "section": split("sections"), "product": split("products"), "element": split("elements"), "block": split("blocks"), "rejected": rows.filter("error is not null").select("error")}


def elements(t: dict[str, DataFrame], kind: str) -> DataFrame:
    """The typed table of one kind of element: DocumentGUID, SectionGUID, Nth and the kind's fields."""
    fields = next(f for k, _, f in ELEMENTS if k == kind)
    rows = t["element"].filter(F.col("Kind") == kind)
    return rows.select("DocumentGUID", "SectionGUID", "Nth", *[F.col("Fields")[f].alias(f) for f in fields])


def _escape(col: Column) -> Column:
    out = F.coalesce(col, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def to_xml(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(DocumentGUID, xml): documents with their sections in order, nested as they were.

    Sections stand in document order (Position), parents before their children.  A section's depth follows
    from its ancestors; what has to be closed before a section is its predecessor's depth less its own.
    """
    links = F.map_from_entries(F.collect_list(F.struct(F.col("SectionGUID"), F.coalesce("ParentSectionGUID", F.lit("")))))
    rows = F.array_sort(F.collect_list(F.struct("Position", "SectionGUID", "ParentSectionGUID", "SectionCode", "Title", "Text")))
    grouped = sections.filter("SectionGUID is not null").groupBy("DocumentGUID").agg(rows.alias("rows"), links.alias("up"))
    # Depth by following parents, as deep as there are sections at most.
    step = lambda state, _: F.when(F.coalesce(F.try_element_at(F.col("up"), state["at"]), F.lit("")) == "", state).otherwise(F.struct(F.coalesce(F.try_element_at(F.col("up"), state["at"]), F.lit("")).alias("at"), (state["depth"] + 1).alias("depth")))
    depth = lambda guid: F.aggregate("rows", F.struct(guid.alias("at"), F.lit(1).alias("depth")), step)["depth"]
    deep = grouped.withColumn("depths", F.transform("rows", lambda r: depth(r["SectionGUID"])))
    held = lambda start, col, end: F.coalesce(F.concat(F.lit(start), F.when(col.isNotNull(), _escape(col)), F.lit(end)), F.lit(""))
    open_ = lambda r: F.concat(F.lit('<component><section><id root="'), _escape(r["SectionGUID"]), F.lit('"/>'), held('<code code="', r["SectionCode"], '"/>'), held("<title>", r["Title"], "</title>"), held("<text>", r["Text"], "</text>"))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("depths", F.greatest(i, F.lit(1))))
    close = "</section></component>"
    parts = F.transform("rows", lambda r, i: F.concat(F.repeat(F.lit(close), F.greatest(F.lit(0), before(i) - F.element_at("depths", i + 1) + 1).cast("int")), open_(r)))
    body = deep.select("DocumentGUID", F.concat(F.array_join(parts, ""), F.repeat(F.lit(close), F.coalesce(F.try_element_at("depths", F.lit(-1)), F.lit(0)))).alias("body"))
    xml = F.concat(F.lit('<document xmlns="urn:hl7-org:v3"><id root="'), _escape(F.col("DocumentGUID")), F.lit('"/><title>'), _escape(F.col("Title")), F.lit('</title><setId root="'), _escape(F.col("SetGUID")), F.lit('"/><versionNumber value="'), F.coalesce(F.col("VersionNumber").cast("string"), F.lit("")), F.lit('"/><component><structuredBody>'), F.coalesce("body", F.lit("")), F.lit("</structuredBody></component></document>"))
    return documents.join(body, "DocumentGUID", "left").select("DocumentGUID", xml.alias("xml"))


def to_markdown(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(DocumentGUID, markdown): a heading block, then the sections in order."""
    one = F.concat(F.lit("## "), F.coalesce("Title", F.lit("Untitled")), F.lit("\n\n"), F.coalesce("Text", F.lit("")))
    body = sections.groupBy("DocumentGUID").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("Position", one.alias("x")))), lambda s: s["x"]), "\n\n").alias("body"))
    return documents.join(body, "DocumentGUID", "left").select("DocumentGUID", F.concat(F.lit("# "), F.coalesce("Title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("markdown"))
