"""Adverse-event statistics as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def relative_risk(a: Column, n1: Column, c: Column, n2: Column) -> dict[str, Column]:
    """Relative risk of a/n1 against c/n2 with Katz 95 % limits.

    Guards, in order: a missing or non-positive denominator (NO_ARMN, NO_COMPARATOR_N), a missing or
    negative count (INVALID_EVENT_COUNT), a count above its denominator (EVENTS_EXCEED_ARMN).  A zero
    cell adds 0.5 to both counts and 1 to both denominators, for the point and the limits
    (ZERO_CELL_CORRECTED).  Guarded rows have null results.
    """
    a, n1, c, n2 = (x.cast("double") for x in (a, n1, c, n2))
    reason = (
        F.when(n1.isNull() | (n1 <= 0), "NO_ARMN")
        .when(n2.isNull() | (n2 <= 0), "NO_COMPARATOR_N")
        .when(a.isNull() | c.isNull() | (a < 0) | (c < 0), "INVALID_EVENT_COUNT")
        .when((a > n1) | (c > n2), "EVENTS_EXCEED_ARMN")
    )
    zero = (a == 0) | (c == 0)
    half, one = F.when(zero, 0.5).otherwise(0.0), F.when(zero, 1.0).otherwise(0.0)
    aa, cc, m1, m2 = a + half, c + half, n1 + one, n2 + one
    ok = reason.isNull()
    rr = F.when(ok, (aa / m1) / (cc / m2))
    se = F.when(ok, F.sqrt(F.greatest(F.lit(0.0), 1 / aa - 1 / m1 + 1 / cc - 1 / m2)))
    return {
        "rr": rr,
        "rr_lower": F.exp(F.log(rr) - Z95 * se),
        "rr_upper": F.exp(F.log(rr) + Z95 * se),
        "reason": reason,
        "flags": F.when(ok & zero, "ZERO_CELL_CORRECTED"),
    }


def significance(lower: Column, upper: Column) -> Column:
    """elevated, protective or not significant; null if a limit is null."""
    return (
        F.when(lower.isNull() | upper.isNull(), None)
        .when((lower > 1) & (upper > 1), "elevated")
        .when((lower < 1) & (upper < 1), "protective")
        .otherwise("not significant")
    )
