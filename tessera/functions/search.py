"""The predicates of label searches, case-insensitive as columns of the label tables are."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: str | None) -> list[str]:
    """Lower-case terms between spaces, commas and semicolons, each once, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[ ,;]+", (text or "").lower()) if t))


def like(col: Column, term: str) -> Column:
    """Contains the term; its % and _ stay wildcards; null never does."""
    return F.coalesce(F.lower(col).like(f"%{term.lower()}%"), F.lit(False))


def not_like(col: Column, term: str) -> Column:
    """Doesn't contain the term; null passes."""
    return ~like(col, term)


def exact_any(col: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.lower(col).isin([t.lower() for t in wanted]), F.lit(False))


def partial_any(cols: list[Column], wanted: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [like(c, t) for c in cols for t in wanted])


def term_filter(cols: list[Column], text: str | None, exclude: list[str] = (), exact: bool = False) -> Column:
    """True for blank input; else any term in any column, and no excluded term in any."""
    found, out = terms(text), F.lit(True)
    if found:
        out = reduce(lambda a, b: a | b, [exact_any(c, found) for c in cols]) if exact else partial_any(cols, found)
    for t in exclude:
        out = reduce(lambda a, b: a & b, [not_like(c, t) for c in cols], out)
    return out


def difference(a: Column, b: Column) -> Column:
    """Number of equal places of the two Soundex codes, 0 to 4; null if either is null."""
    x, y = F.soundex(a), F.soundex(b)
    same = [(F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5)]
    return reduce(lambda p, q: p + q, same)
