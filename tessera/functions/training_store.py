"""A bounded table of training rows that grows by increments: known rows are replaced, the oldest leave first, by class of trust.

The store is a table of (id, text, label, trusted, batch).  An increment gives a new table, so a failed run leaves the old one,
and the same increments in the same order always leave the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relops import positions

#: Rows kept at most, and new rows after which a model is fitted again.
MOST, RETRAIN = 60_000, 500
COLUMNS = ("id", "text", "label", "trusted", "batch")


def add(store: DataFrame, rows: DataFrame, batch: int, most: int = MOST) -> DataFrame:
    """The store after an increment of rows (id, text, label, trusted): at most ``most`` rows.

    A row replaces the one with its id, but for an untrusted one, which leaves a trusted one as it is.  Beyond the bound the
    oldest untrusted rows leave, then the oldest of all; of one batch those with larger ids.
    """
    new = rows.select("id", "text", "label", "trusted").withColumn("batch", F.lit(batch).cast("long"))
    both = store.select(*COLUMNS).unionByName(new)
    # Trusted before untrusted, then the newer; of one batch's repeats the least.
    order = [F.col("trusted").desc(), F.col("batch").desc(), F.col("label").asc_nulls_last(), F.col("text").asc_nulls_last()]
    one = both.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("_k = 1").drop("_k")
    # Batches are few, so rows are numbered batch by batch and not in one task.
    leading = [(~F.col("trusted")).cast("int"), -F.col("batch")]
    placed = positions(one, leading, [F.col("id")], "_at")
    return placed.filter(F.col("_at") <= most).select(*COLUMNS)


def due(store: DataFrame, fitted_at: int, least: int = RETRAIN) -> bool:
    """Whether rows of batches after ``fitted_at`` are enough to fit again, and at least two labels are there."""
    r = store.agg(F.sum(F.when(F.col("batch") > fitted_at, 1).otherwise(0)).alias("new"), F.countDistinct("label").alias("labels")).first()
    return (r["new"] or 0) >= least and r["labels"] >= 2
