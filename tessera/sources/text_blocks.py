"""A section's text as rows: paragraphs, lists, tables and what they hold, numbered by their path.

One walk flattens the tree.  A block's Parent is the number of the block that holds it, so tables in cells and lists in
items keep their place; blocks of a section are numbered from 0 in document order.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import grid

NS = "{urn:hl7-org:v3}"
BLOCK = "struct<SectionGUID:string,Nth:int,Parent:int,Depth:int,Kind:string,Seq:int,Text:string,Style:string,Link:string,RowGroup:string,CellType:string,RowSpan:int,ColSpan:int,TableNth:int,RowSeq:int>"
FIELDS = tuple(f.split(":")[0] for f in BLOCK[7:-1].split(","))
#: Tags by the kind of block that they are; the groups of rows and the parts of lists have no row of their own.
KINDS = {"paragraph": "Paragraph", "list": "List", "item": "ListItem", "table": "Table", "tr": "TableRow", "th": "TableCell", "td": "TableCell", "renderMultiMedia": "Media", "col": "TableColumn"}
GROUPS = {"thead": "Header", "tbody": "Body", "tfoot": "Footer"}
#: Marks that stay in a text, as other steps read them.
MARKS = ("sup", "sub", "br", "content")


#: The same by full tag, as the walk asks for each node.
_KIND, _GROUP, _MARK, _CAPTION = {NS + k: v for k, v in KINDS.items()}, {NS + k: v for k, v in GROUPS.items()}, {NS + k: k for k in MARKS}, NS + "caption"
_APART = {*_KIND, *_GROUP, _CAPTION}
#: Labels that a task reads before it hands their blocks on.
SLICE = 500


@contextmanager
def uncollected() -> Iterator[None]:
    """Trees and tuples of a slice hold no cycles, so looking for such takes time alone."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def inline(node) -> str | None:
    """A block's own text with its marks; blocks and captions inside are left to their own rows.  None for no text."""
    if not len(node):
        return " ".join(node.text.split()) or None if node.text else None
    out: list[str] = []
    stack: list = [(node, True)]
    while stack:
        at, is_root = stack.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        if not is_root and at.tag in _APART:
            continue
        mark = None if is_root else _MARK.get(at.tag)
        if mark == "br":
            out.append("<br/>")
            continue
        if mark:
            style = at.get("styleCode")
            out.append(f'<{mark} styleCode="{style}">' if style else f"<{mark}>")
            stack.append((f"</{mark}>", False))
        for child in reversed(at):
            if child.tail:
                stack.append((child.tail, False))
            stack.append((child, False))
        if at.text:
            stack.append((at.text, False))
    return " ".join("".join(out).split()) or None


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.strip().isdigit() else None


def walk(text, section: str | None) -> list[tuple]:
    """The blocks of a text element as tuples of FIELDS.  Seq counts from 1 among the siblings of one kind (rows: of one group); a lone text is a paragraph."""
    if text is None:
        return []
    out: list[tuple] = []
    lone = inline(text)
    stack: list = [(child, None, 0, None, None, None) for child in reversed(text)]
    seen: dict[tuple, int] = {}
    if lone is not None:
        seen[None, "Paragraph", None] = 1
        out.append((section, 0, None, 0, "Paragraph", 1, lone, text.get("listType") or text.get("styleCode"), text.get("ID") or text.get("referencedObject"), None, None, None, None, None, None))
    while stack:
        node, parent, depth, group, table, row = stack.pop()
        kind = _KIND.get(node.tag)
        if kind is None:
            group = _GROUP.get(node.tag, group)
            stack += [(c, parent, depth, group, table, row) for c in reversed(node)]
            continue
        number, held = len(out), None
        if kind == "TableRow":
            held = group = group or "Body"
        elif kind == "TableCell":
            held = group
        key = (parent, kind, held)
        seq = seen[key] = seen.get(key, 0) + 1
        words = style = link = cell = rows = columns = at = None
        if kind in ("List", "Table"):
            caption = node.find(_CAPTION)
            words = inline(caption) if caption is not None else None
        elif kind != "TableRow":
            words = inline(node)
        if node.attrib:
            style, link = node.get("listType") or node.get("styleCode"), node.get("ID") or node.get("referencedObject")
        if kind == "TableCell":
            cell, at = node.tag[len(NS) :], row
            if node.attrib:
                rows, columns = _whole(node.get("rowspan")), _whole(node.get("colspan"))
        out.append((section, number, parent, depth, kind, seq, words, style, link, held, cell, rows, columns, table, at))
        if kind == "Table":
            # A table in a cell starts over.
            table, group = number, None
        elif kind == "TableRow":
            row = seq
        if len(node):
            stack += [(c, number, depth + 1, group, table, row) for c in reversed(node) if c.tag != _CAPTION]
    return out


def blocks(text, section: str | None) -> list[dict]:
    """The blocks of a text element as dicts."""
    return [dict(zip(FIELDS, b, strict=True)) for b in walk(text, section)]


def of_document(root) -> Iterator[tuple]:
    """The blocks of all sections' texts, in document order."""
    for s in root.iter(NS + "section"):
        own = s.find(NS + "id")
        yield from walk(s.find(NS + "text"), own.get("root") if own is not None else None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            rows: list[tuple] = []
            for xml in batch.column(0).slice(start, SLICE).to_pylist():
                try:
                    root = ElementTree.fromstring(xml or "")
                except ElementTree.ParseError:
                    continue
                own = root.find(NS + "id")
                guid = own.get("root") if own is not None else None
                rows += [(guid, *b) for b in of_document(root)]
            columns = zip(*rows, strict=True) if rows else [()] * len(_READ.names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)


FIELD_TYPES = pa.schema([(f.split(":")[0], pa.int32() if f.endswith(":int") else pa.string()) for f in BLOCK[7:-1].split(",")])
_READ = pa.schema([("DocumentGUID", pa.string()), *FIELD_TYPES])


#: Tags of cells and what they are called.
_CELLS = {NS + k: k for k in ("th", "td")}


def table_cells(text, add, new_table) -> None:
    """The cells of a text element's tables, as walk() numbers them: no other block is made.

    ``new_table`` is given a table's number and node, and ``add`` a cell's table, number, row, place, group, kind, spans and text.
    """
    if text is None:
        return
    number = 0 if inline(text) is None else 1
    stack: list = [(child, None, None, None, None) for child in reversed(text)]
    seen: dict[tuple, int] = {}
    while stack:
        node, parent, group, table, row = stack.pop()
        kind = _KIND.get(node.tag)
        if kind is None:
            group = _GROUP.get(node.tag, group)
            stack += [(c, parent, group, table, row) for c in reversed(node)]
            continue
        own = number
        number += 1
        if kind == "TableRow":
            group = group or "Body"
            row = seen[parent, kind, group] = seen.get((parent, kind, group), 0) + 1
            nth, rest = 0, ()
            for at, c in enumerate(node):
                tag = _CELLS.get(c.tag)
                if tag is None or len(c):
                    rest = node[at:]
                    break
                nth += 1
                words = c.text
                spans = (_whole(c.get("rowspan")), _whole(c.get("colspan"))) if c.attrib else (None, None)
                add((table, number, row, nth, group, tag, *spans, " ".join(words.split()) if words else None))
                number += 1
            if len(rest):
                # A cell with marks or blocks inside ends the short way.
                seen[own, "TableCell", group] = nth
                stack += [(c, own, group, table, row) for c in reversed(rest) if c.tag != _CAPTION]
            continue
        if kind == "TableCell":
            nth = seen[parent, kind, group] = seen.get((parent, kind, group), 0) + 1
            add((table, own, row, nth, group, _CELLS[node.tag], _whole(node.get("rowspan")), _whole(node.get("colspan")), inline(node)))
        elif kind == "Table":
            new_table(own, node)
            table, group = own, None
        if len(node):
            stack += [(c, own, group, table, row) for c in reversed(node) if c.tag != _CAPTION]


_OF_GRID = pa.schema([("DocumentGUID", pa.string()), ("SectionGUID", pa.string()), ("Nth", pa.int32()), ("Caption", pa.string()), ("Known", pa.bool_()), ("Leads", pa.bool_()), ("Unlabelled", pa.bool_()), ("RowSeq", pa.int32()), ("RowClass", pa.string()), ("Col", pa.int32()), ("HeaderPath", pa.string()), ("CellText", pa.string()), ("Category", pa.string()), ("Footnotes", pa.string())])
_CELL_KINDS = dict(zip(grid.CELL, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True))


def _read_grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            with uncollected():
                made = _grids_of(batch.column(0).slice(start, SLICE).to_pylist())
            if made is not None:
                yield made


def _grids_of(labels: list[str | None]) -> pa.RecordBatch | None:
    """The grids of the tables of some labels; cells that stand in no table make one of their own, which is not known."""
    cells: list[tuple] = []
    numbers: list[int] = []
    tables: dict[tuple, int] = {}
    captions: dict[int, str | None] = {}
    for doc, xml in enumerate(labels):
        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            continue
        own = root.find(NS + "id")
        guid = own.get("root") if own is not None else None
        for s in root.iter(NS + "section"):
            own = s.find(NS + "id")
            section, before = own.get("root") if own is not None else None, len(cells)
            place = lambda nth: tables.setdefault((doc, guid, section, nth), len(tables))  # noqa: E731,B023

            def new_table(nth: int, node) -> None:
                caption = node.find(_CAPTION)
                captions[place(nth)] = inline(caption) if caption is not None else None  # noqa: B023

            table_cells(s.find(NS + "text"), cells.append, new_table)
            last = at = None
            for c in cells[before:]:
                if at is None or c[0] != last:
                    last, at = c[0], place(c[0])
                numbers.append(at)
    if not cells:
        return None
    columns = list(zip(*cells, strict=True))[1:]
    fields = {n: pa.array(c, k) for (n, k), c in zip(_CELL_KINDS.items(), columns, strict=True)}
    of, rows = grid.assemble(np.array(numbers), fields)
    keys = list(zip(*tables, strict=True))[1:]
    facts = [pa.array(k, t) for k, t in zip(keys, (pa.string(), pa.string(), pa.int32()), strict=True)] + [pa.array([captions.get(i) for i in range(len(tables))], pa.string()), pa.array([i in captions for i in range(len(tables))])]
    leads = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
    blank = np.zeros(len(tables), bool)
    blank[of[leads]] = pc.equal(rows[4].take(pa.array(np.flatnonzero(leads))), "").to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays([*[f.take(pa.array(of)) for f in facts], pa.array(leads), pa.array(blank[of]), *rows], schema=_OF_GRID)


class Tables(NamedTuple):
    """Labels (a column ``xml``) of which the tables alone are read, as grids."""

    files: DataFrame


def read(files: DataFrame | Tables) -> DataFrame:
    """DocumentGUID and the blocks of the texts of a column ``xml``, as of(parsed()) gives them: nothing else of a label is read.

    Of Tables, the cells of their grids (grid.GRID_SCHEMA) with DocumentGUID, Caption and Known (whether it is a table's), Leads (a table's first cell)
    and Unlabelled (its first row has no label): a label's tables are rebuilt where it is read.
    """
    if isinstance(files, Tables):
        found = files.files.select("xml").mapInArrow(_read_grids, ", ".join(f"{f.name} {_SPARK[f.type]}" for f in _OF_GRID))
        return found.select(table_id(F.col("Nth")), *[f.name for f in _OF_GRID if f.name not in ("SectionGUID", "Nth")])
    return files.select("xml").mapInArrow(_read, "DocumentGUID string, " + BLOCK[7:-1].replace(":", " "))


_SPARK = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}


def of(parsed: DataFrame) -> DataFrame:
    """DocumentGUID and the blocks of its sections, from parsed labels."""
    return parsed.filter("error is null").select("DocumentGUID", F.explode("blocks").alias("b")).select("DocumentGUID", "b.*")


def table_id(nth):
    return F.xxhash64("DocumentGUID", "SectionGUID", nth).alias("TextTableID")
