"""File arrival as a stream: the batch transformations run on what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def arriving(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts and value sums by type and time window; windows close once the watermark passes them."""
    w = F.window("ts", f"{minutes} minutes")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(df: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Process what has arrived, and stop: the latest row of each key.

    Each batch writes its changed rows to a folder of its own below the shared one, so a batch that is
    repeated after a failure replaces its rows, and nothing is kept on the driver.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    q = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    latest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("nth", F.row_number().over(latest)).filter("nth = 1").select(*df.columns)
