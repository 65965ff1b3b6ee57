"""Report sinks: JSON lines, Markdown tables, delimited text, snapshots, sampled JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a line of a Markdown table; bars in values are escaped."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_markdown(df: DataFrame, path: str) -> None:
    """A Markdown table in each file: its header and rule line, then rows; a file is a task's, so each is a table of its own."""
    names = [c.replace("|", "\\|") for c in df.columns]
    head = f"| {' | '.join(names)} |\n|{' --- |' * len(names)}\n"
    # The number of a task's first row has no low bits; no task gathers its rows.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    markdown_rows(df).select(F.when(first, F.concat(F.lit(head), "value")).otherwise(F.col("value")).alias("value")).write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def pipe_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def sample_json(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows drawn at random, as JSON objects."""
    return df.orderBy(F.rand(seed)).limit(n).select(F.to_json(F.struct("*")).alias("value"))


def snapshot(df: DataFrame, path: str, partition_by: str | None = None, sort_by: str | None = None) -> DataFrame:
    """Replace a materialised table as a whole, stamped, and read it back."""
    out = df.withColumn("RefreshedAt", F.current_timestamp())
    if sort_by:
        out = out.sortWithinPartitions(sort_by)
    w = out.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def report_counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Counts by a field of JSON-lines reports."""
    return spark.read.json(path).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
