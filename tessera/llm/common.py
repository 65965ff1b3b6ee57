"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder, ship_package

#: White space of the word rules: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
#: A word in Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


#: With it, a query's shuffle files leave the disk when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Inside, queries remove their shuffle files when they have ended."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of df read back from the shared checkpoint folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _written(df: DataFrame, **options: str | int) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    with cleaning(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, **options: str | int) -> DataFrame:
    """The rows of df, written as a table in the shared checkpoint folder and read from there: its lineage is cut."""
    return _written(df, **options)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that has been read."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Shelf:
    """Tables that only some steps need: written like stored() ones, and removed as soon as they are dropped or the steps end.

    What is to outlive the steps must be stored, not kept.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *error: object) -> None:
        for _, path in self.held:
            remove(self.spark, path)
        self.held = []

    def keep(self, df: DataFrame, **options: str | int) -> DataFrame:
        self.held.append(_written(df, **options))
        return self.held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, next(path for t, path in self.held if t is table))
        self.held = [(t, path) for t, path in self.held if not any(t is table for table in tables)]


def unit_hash(*parts: Column | str | int) -> Column:
    """A long in [0, 2^52) that depends on the parts alone: the first 13 hex digits of an MD5.

    MD5 is used because every SQL engine has it, so results can be compared outside Spark.
    """
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def prepare(spark: SparkSession) -> None:
    """Send the package to the Python workers, and bound what goes to them at a time, by rows and by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One table; the package is sent to the Python workers on the way."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
