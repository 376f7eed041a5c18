"""Continuous ingest: files dropped into a folder become pieces, each id once; and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus
from corpusloom.runtime import path_exists


def read_drops(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(folder)


def start_append(stream: DataFrame, index: str, checkpoint: str, key: str = "id", once: bool = True):
    """Append rows whose id is new. A batch that runs again finds its ids in the index and adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(index).select(key) if path_exists(spark, index) else batch.select(key).limit(0)
        corpus.new_rows(known, batch, key).write.mode("append").parquet(index)

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def event_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; rows later than the watermark are left out."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), kind, "n")
