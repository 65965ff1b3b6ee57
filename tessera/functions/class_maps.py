"""Correlations of drug classes over the terms that they share: map, axis, pages, drill-downs.

Observations are (Class, Term, Drug, LogRR).  Terms are brought together per class first; a class then meets another
through an equality join on the term, salted, so that a term that all classes have is dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.correlation import p_value, pearson
from tessera.operators.relops import positions, rank_avg_ties

#: Shared terms below which a pair's coefficient is not shown, at least.
FLOOR = 3
SALTS = 8


def class_type(name: Column) -> Column:
    """The bracketed type at a class name's end, in capitals; Other without one."""
    found = F.upper(F.trim(F.regexp_extract(F.coalesce(name, F.lit("")), r"\[([^\]]*)\]\s*$", 1)))
    return F.when(found.isin("", "OTHER"), "Other").otherwise(found)


def per_class_term(obs: DataFrame) -> DataFrame:
    """Class, Term, Value (median), Count, Drugs, and the observation that speaks for it: the largest effect, then the least drug."""
    best = F.max_by(F.struct("Drug", "LogRR"), F.struct(F.abs("LogRR"), F.col("LogRR")))
    rows = obs.filter("Class is not null and Term is not null and LogRR is not null")
    return rows.groupBy("Class", "Term").agg(F.median("LogRR").alias("Value"), F.count(F.lit(1)).alias("Count"), F.countDistinct("Drug").alias("Drugs"), best["LogRR"].alias("Largest"))


def pairs(values: DataFrame) -> DataFrame:
    """(A, B, Term, x, y) of classes A < B and each term that both have."""
    salt = F.pmod(F.xxhash64("Class"), F.lit(SALTS))
    left = values.select(F.col("Class").alias("A"), "Term", F.col("Value").alias("x"), salt.alias("salt"))
    right = values.select(F.col("Class").alias("B"), "Term", F.col("Value").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return left.join(right, ["Term", "salt"]).filter("A < B").select("A", "B", "Term", "x", "y")


def cells(values: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(A, B, PairCount, Raw, Coefficient, InsufficientN) of all pairs of classes with a common term: Spearman's r over those.

    Raw is the coefficient whatever the count; Coefficient is null below the floor.
    """
    p = pairs(values)
    ranked = p.withColumns({"rx": rank_avg_ties(F.col("x"), ["A", "B"]), "ry": rank_avg_ties(F.col("y"), ["A", "B"])})
    got = ranked.groupBy("A", "B").agg(F.count(F.lit(1)).alias("PairCount"), pearson(F.col("rx"), F.col("ry")).alias("Raw"))
    short = F.col("PairCount") < max(floor, FLOOR)
    return got.withColumns({"InsufficientN": short, "Coefficient": F.when(~short, F.col("Raw"))})


def with_p(rows: DataFrame) -> DataFrame:
    """rows with PValue and IsSignificant of the coefficient that is shown."""
    p = p_value(F.round("Coefficient", 12), F.col("PairCount").cast("double"))
    return rows.withColumn("PValue", p).withColumn("IsSignificant", F.coalesce(F.col("PValue") < 0.05, F.lit(False)))


def axis(obs: DataFrame, values: DataFrame, drawn: DataFrame, names: DataFrame) -> DataFrame:
    """Class, Name, Type, TermCount, DrugCount, HasRenderableMap and Position of all classes: those that can be drawn, then larger ones first."""
    sizes = values.groupBy("Class").agg(F.count(F.lit(1)).alias("TermCount"))
    drugs = obs.filter("Class is not null").groupBy("Class").agg(F.countDistinct("Drug").alias("DrugCount"))
    ends = drawn.select(F.explode(F.array("A", "B")).alias("Class")).distinct().withColumn("_drawn", F.lit(True))
    rows = drugs.join(sizes, "Class").join(ends, "Class", "left").join(names.groupBy("Class").agg(F.min("Name").alias("Name")), "Class", "left")
    rows = rows.withColumns({"HasRenderableMap": F.coalesce("_drawn", F.lit(False)), "Type": class_type(F.col("Name"))}).drop("_drawn")
    order = [F.col("HasRenderableMap").desc(), F.col("TermCount").desc(), F.col("DrugCount").desc(), F.upper(F.coalesce("Name", F.lit(""))), F.col("Class")]
    leading = [(~F.col("HasRenderableMap")).cast("int"), -F.least("TermCount", F.lit(1000))]
    return positions(rows, leading, order, "Position")


def facets(axis_rows: DataFrame) -> DataFrame:
    """Types with their numbers of classes and whether any can be drawn."""
    return axis_rows.groupBy("Type").agg(F.count(F.lit(1)).alias("ClassCount"), F.bool_or("HasRenderableMap").alias("HasRenderableMap"))


def window(axis_rows: DataFrame, drawn: DataFrame, page: int, size: int, kind: str | None = None) -> tuple[DataFrame, bool]:
    """(Class, Position, Index of a page's classes, whether the page was compacted).

    The axis holds the classes of a type that some pair draws.  A page without such a pair takes the nearest one in (with an
    end on the page first, then near its start, then with most terms), and is refilled from its start on, then from the axis's.
    """
    rows = axis_rows if kind is None else axis_rows.filter(F.upper("Type") == kind.upper())
    of_kind = rows.select("Class")
    kept = drawn.join(of_kind.withColumnRenamed("Class", "A"), "A", "left_semi").join(of_kind.withColumnRenamed("Class", "B"), "B", "left_semi")
    rows = rows.join(kept.select(F.explode(F.array("A", "B")).alias("Class")), "Class", "left_semi")
    rows = positions(rows.withColumnRenamed("Position", "_p"), [F.floor(F.col("_p") / 1000)], [F.col("_p")], "_at").withColumn("_at", F.col("_at") - 1)
    total = rows.count()
    start = min(max((page - 1) * size, 0), max(total - 1, 0))
    ends = rows.select("Class", "_at")
    placed = kept.join(ends.select(F.col("Class").alias("A"), F.col("_at").alias("i")), "A").join(ends.select(F.col("Class").alias("B"), F.col("_at").alias("j")), "B")
    on = lambda c: (F.col(c) >= (page - 1) * size) & (F.col(c) < page * size)
    # One row: the pair that comes first by these rules.
    rank = F.struct((~(on("i") & on("j"))).alias("whole"), (~(on("i") | on("j"))).alias("part"), F.least(F.abs(F.col("i") - start), F.abs(F.col("j") - start)).alias("far"), (-F.col("PairCount")).alias("n"), F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    best = placed.agg(F.min(rank).alias("r")).first()["r"]
    if best is None or size < 2 or total < 2 or not best["whole"]:
        chosen, compacted = rows.filter((F.col("_at") >= (page - 1) * size) & (F.col("_at") < page * size)), False
    else:
        pair = F.col("_at").isin(best["a"], best["b"])
        turn = F.when(pair, F.lit(-1)).when(F.col("_at") >= start, F.col("_at") - start).otherwise(F.col("_at") + total)
        # All of the page and the pair are among the first size by that turn, which is bounded.
        chosen, compacted = rows.orderBy(turn, "_at").limit(size), True
    by = Window.partitionBy(F.lit(0)).orderBy("_at")
    return chosen.select("Class", F.col("_p").alias("Position"), (F.row_number().over(by) - 1).alias("Index")), compacted


def drill_down(values: DataFrame, left: str, right: str) -> DataFrame:
    """The terms of two classes with both values, counts and ratios, by term."""
    side = lambda c, x: values.filter(F.col("Class") == c).select("Term", F.col("Value").alias(f"LogRR{x}"), F.col("Count").alias(f"Count{x}"), F.col("Drugs").alias(f"Drugs{x}"), F.col("Largest").alias(f"Largest{x}"))
    both = side(left, "X").join(side(right, "Y"), "Term")
    return both.withColumns({"RRX": F.exp("LogRRX"), "RRY": F.exp("LogRRY")})
