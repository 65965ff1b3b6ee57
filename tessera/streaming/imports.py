"""Archives of labels as a stream: each batch parses what has arrived, once, and can be repeated without harm.

A batch writes its labels and its part of the manifest to folders of its own number.  One that is repeated after a
failure replaces both, and one that was committed is never run again, so nothing is lost or doubled, wherever a run stops.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.session import ship_package
from tessera.sources import spl

_FILES = "path string, modificationTime timestamp, length long, content binary"
MANIFEST = "path string, modificationTime timestamp, length long, files long, labels long, errors long"


def run(spark: SparkSession, inbox: str, folder: str, per_batch: int = 100, done: Callable[[int], None] | None = None) -> None:
    """Import all archives that are in ``inbox`` and not yet in ``folder``'s manifest, ``per_batch`` at a time, and stop.

    ``done`` is called behind each batch's writes, before it is committed.
    """
    ship_package(spark)
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", per_batch).load(inbox)

    def batch(rows: DataFrame, number: int) -> None:
        labels = rows.select("path", "content").mapInPandas(spl._unzip, "source string, name string, xml string, error string")
        read = spl.parsed_beside(labels)
        read.write.mode("overwrite").parquet(f"{folder}/labels/batch={number}")
        back = rows.sparkSession.read.parquet(f"{folder}/labels/batch={number}")
        by = back.groupBy(F.col("source").alias("path")).agg(F.count("name").alias("files"), F.count("DocumentGUID").alias("labels"), F.count(F.coalesce("broken", "error")).alias("errors"))
        rows.select("path", "modificationTime", "length").join(by, "path", "left").fillna(0, ["files", "labels", "errors"]).write.mode("overwrite").parquet(f"{folder}/manifest/batch={number}")
        if done:
            done(number)

    q = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def write_archives(labels: DataFrame, folder: str) -> DataFrame:
    """Labels (name, xml) packed into ZIP files of a folder, by the tasks that hold them: (archive, labels) once the frame is read.

    An archive is named by its content, so a task that runs again writes the same files.
    """
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(uri)
        target.create_dir(root, recursive=True)
        for pdf in batches:
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                for name, xml in zip(pdf["name"], pdf["xml"], strict=True):
                    z.writestr(zipfile.ZipInfo(name), xml)
            name = f"{hashlib.sha256(packed.getvalue()).hexdigest()}.zip"
            with target.open_output_stream(f"{root}/{name}") as out:
                out.write(packed.getvalue())
            yield pd.DataFrame({"archive": [name], "labels": [len(pdf)]})

    return labels.select("name", "xml").mapInPandas(work, "archive string, labels long")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The archives that have been imported: path, modificationTime, length, files, labels, errors, batch."""
    schema = StructType([*spark.createDataFrame([], MANIFEST).schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """All imported labels, parsed, with their archive and name; a label's content counts once, as spl.distinct_documents does for files."""
    return spark.read.parquet(f"{folder}/labels")
