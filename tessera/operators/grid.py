"""Label grids: cells with spans become rectangular rows with header paths.

A table's cells, no more than a printed page has, are gathered natively; many tables go through numpy in one
Arrow batch, where only rows that a row span covers are filled one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID_SCHEMA = "TextTableID long, RowSeq int, RowClass string, Col int, HeaderPath string, CellText string, Category string, Footnotes string"
_NAMES = [f.split()[0] for f in GRID_SCHEMA.split(", ")]
_GROUPS = ("Header", "Body", "Footer")
MAX_DIVIDER = 200
#: Tables that are rebuilt at once.
SLICE = 1000
#: Texts that clean() may change: any with a tag, a blank other than a space, or a space at an end or beside another.
_UNCLEAN = "[<\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  |^ | $"


def clean(text: str | None) -> tuple[str, list[str]]:
    """(text without tags, the contents of its superscripts)."""
    if "<" not in (text or ""):
        return " ".join((text or "").split()), []
    marks = [m.strip() for s in re.findall(r"(?is)<sup>(.*?)</sup>", text or "") for m in s.split(",") if m.strip()]
    t = re.sub(r"(?is)<sup>.*?</sup>", "", text or "")
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>", " ", t))).strip(), marks


#: Fields of a cell as its table is rebuilt from.
CELL = ("CellID", "RowSeq", "CellSeq", "RowGroupType", "CellType", "RowSpan", "ColSpan", "CellText")


def _cleaned(texts: pa.Array) -> tuple[pa.Array, dict[int, list[str]]]:
    """Texts without tags, and by place the contents of their superscripts."""
    texts = pc.fill_null(texts, "")
    odd = np.flatnonzero(pc.match_substring_regex(texts, _UNCLEAN).to_numpy(zero_copy_only=False))
    if not len(odd):
        return texts, {}
    pairs = [clean(t) for t in texts.take(pa.array(odd)).to_pylist()]
    changed = np.zeros(len(texts), bool)
    changed[odd] = True
    return pc.replace_with_mask(texts, pa.array(changed), pa.array([t for t, _ in pairs], pa.string())), {int(k): m for k, (_, m) in zip(odd, pairs, strict=True) if m}


def _before(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags stand before each row among the rows of its table; first is its table's first row."""
    total = np.cumsum(flags)
    return total - flags - (total - flags)[first]


def _spanned(rows: np.ndarray, start: np.ndarray, count: np.ndarray, end: np.ndarray, tall: np.ndarray, wide: np.ndarray) -> dict[int, dict[int, int]]:
    """By row, column -> cell, with row and column spans filled in, of the rows that a row span covers."""
    held: dict[int, dict[int, int]] = {}
    for row, at, n, last in zip(rows.tolist(), start[rows].tolist(), count[rows].tolist(), end[rows].tolist(), strict=True):
        here, c = held.setdefault(row, {}), 0
        for cell, h, w in zip(range(at, at + n), tall[at : at + n].tolist(), wide[at : at + n].tolist(), strict=True):
            while c in here:
                c += 1
            for below in range(row, min(row + h, last)):
                held.setdefault(below, {}).update((k, cell) for k in range(c, c + w))
            c += w
    return held


def assemble(table: np.ndarray, cells: dict[str, pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """The grids of many tables: cells by the names of CELL, each with the number of its table, to (numbers of tables, columns of GRID_SCHEMA behind the id).

    Rows are headers first, then continuations, dividers and data: the first row of a body without a head is a header, and so are
    rows of header cells alone before all others; a single cell as wide as the table divides it.
    """
    whole = lambda name, none: pc.fill_null(cells[name], none).to_numpy(zero_copy_only=False).astype(np.int64)
    rank = pc.fill_null(pc.index_in(cells["RowGroupType"], value_set=pa.array(_GROUPS)), 1).to_numpy(zero_copy_only=False)
    order = np.lexsort((whole("CellID", 0), whole("CellSeq", -1), whole("RowSeq", -1), rank, table))
    table, rank, seq = table[order], rank[order], whole("RowSeq", -1)[order]
    tall, wide = (np.maximum(whole(c, 1)[order], 1) for c in ("RowSpan", "ColSpan"))
    head = pc.fill_null(pc.equal(cells["CellType"], "th"), False).to_numpy(zero_copy_only=False)[order]
    text, marked = _cleaned(cells["CellText"].take(pa.array(order)))

    # Rows, each with its first cell, and tables, each with its first row.
    change = lambda *xs: np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in xs], axis=0))))
    start = change(table, rank, seq)
    count, of, kind = np.diff(np.append(start, len(table))), table[start], rank[start]
    top = change(of)
    per = np.diff(np.append(top, len(start)))
    place = np.repeat(np.arange(len(top)), per)
    first, end = np.repeat(top, per), np.repeat(top + per, per)
    row_of = np.repeat(np.arange(len(start)), count)
    widths = np.maximum.reduceat(np.add.reduceat(wide, start), top)
    width = widths[place]

    body, lead = kind == 1, np.arange(len(start)) == first
    all_head = np.logical_and.reduceat(head, start)
    open_ = _before(body & ~lead & ~all_head, first) == 0
    rest = body & ~lead & ~(all_head & open_)
    length = pc.utf8_length(text).to_numpy(zero_copy_only=False)[start]
    divider = rest & (count == 1) & (width > 1) & (wide[start] >= width) & (length > 0) & (length <= MAX_DIVIDER)
    data, header = rest & ~divider, (kind == 0) | (body & ~rest)

    # Where cells stand: rows that no row span covers are filled by their column spans alone.
    high = np.flatnonzero(tall > 1)
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, row_of[high], 1)
    np.add.at(edge, np.minimum(row_of[high] + tall[high], end[row_of[high]]), -1)
    covered = np.cumsum(edge[:-1]) > 0
    free = np.flatnonzero(~covered[row_of])
    left = np.cumsum(wide) - wide
    cell = np.repeat(free, wide[free])
    column = np.arange(len(cell)) - np.repeat(np.cumsum(wide[free]) - wide[free], wide[free]) + (left - left[start][row_of])[cell]
    row, shown = row_of[cell], start.copy()
    if len(high):
        held = _spanned(np.flatnonzero(covered), start, count, end, tall, wide)
        triples = np.array([(r, c, x) for r, places in held.items() for c, x in places.items()], np.int64).reshape(-1, 3)
        row, column, cell = np.concatenate((row, triples[:, 0])), np.concatenate((column, triples[:, 1])), np.concatenate((cell, triples[:, 2]))
        for r, places in held.items():
            shown[r] = next(iter(places.values()))
    inside = column < width[row]
    row, column, cell = row[inside], column[inside], cell[inside]

    # Header paths by table and column, in the order of rows; a text that repeats the one above counts once.
    slots = np.cumsum(widths) - widths
    code = text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    full = pc.not_equal(text, "").to_numpy(zero_copy_only=False)
    use = np.flatnonzero(header[row] & full[cell])
    use = use[np.lexsort((row[use], slots[place[row[use]]] + column[use]))]
    slot = slots[place[row[use]]] + column[use]
    if len(use):
        use, slot = (x[np.concatenate(([True], (slot[1:] != slot[:-1]) | (code[cell[use]][1:] != code[cell[use]][:-1])))] for x in (use, slot))
    offsets = np.searchsorted(slot, np.arange(int(widths.sum()) + 1)).astype(np.int32)
    paths = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), text.take(pa.array(cell[use]))), " > ")

    # Data rows are as wide as their table; places without a cell are blank.
    rows = np.flatnonzero(data)
    base = np.zeros(len(start), np.int64)
    base[rows] = np.cumsum(width[rows]) - width[rows]
    out_row = np.repeat(rows, width[rows])
    out_column = np.arange(len(out_row)) - base[out_row]
    out_cell = np.full(len(out_row), -1)
    mine = data[row]
    out_cell[base[row[mine]] + column[mine]] = cell[mine]
    blank = out_cell < 0
    texts = pc.fill_null(text.take(pa.array(out_cell, mask=blank)), "")
    above = np.maximum.accumulate(np.where(divider, np.arange(len(start)), -1))[out_row]
    category = text.take(pa.array(shown[above], mask=above < first[out_row]))
    notes = _notes(text, marked, table, np.flatnonzero((kind == 2)[row_of])) if marked else {}
    foot = pa.nulls(len(out_row), pa.string())
    if notes:
        known = np.isin(out_cell, np.array(list(notes)))
        foot = pa.array([notes[int(x)] if k else None for x, k in zip(out_cell, known, strict=True)], pa.string())
    columns = [pa.array((out_row - first[out_row]).astype(np.int32)), pa.repeat(pa.scalar("DataBody"), len(out_row)), pa.array(out_column.astype(np.int32)), paths.take(pa.array(slots[place[out_row]] + out_column)), texts, category, foot]
    return of[out_row], columns


def _notes(text: pa.Array, marked: dict[int, list[str]], table: np.ndarray, footers: np.ndarray) -> dict[int, str]:
    """By cell, the footnotes that its superscripts name."""
    marks: dict[int, dict[str, str]] = {}
    for t, words in zip(table[footers].tolist(), text.take(pa.array(footers)).to_pylist(), strict=True):
        if m := re.match(r"^([*†‡§a-z\d])\s*[.:)]?\s+(.+)$", words):
            marks.setdefault(t, {})[m[1]] = m[2]
    found = {k: "; ".join(marks[int(table[k])][m] for m in names if m in marks[int(table[k])]) for k, names in marked.items() if int(table[k]) in marks}
    return {k: v for k, v in found.items() if v}


def _rebuild_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            fields = part.column(1).flatten().flatten()
            many = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
            table, columns = assemble(np.repeat(np.arange(part.num_rows), many), dict(zip(CELL, fields, strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(table)), *columns], _NAMES)


def reconstruct(cells: DataFrame) -> DataFrame:
    """Cells (TextTableID, CellID, RowSeq, CellSeq, RowGroupType, CellType, RowSpan, ColSpan, CellText) to data cells with header paths."""
    item = F.struct(*CELL)
    return cells.groupBy("TextTableID").agg(F.collect_list(item).alias("cells")).mapInArrow(_rebuild_all, GRID_SCHEMA)
