"""Chapter results that arrive over time: each micro-batch replaces the chapters it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEY = ["book", "chapter_number"]


def read_chapters(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def latest(rows: DataFrame) -> DataFrame:
    """Of a batch's rows of one chapter, the one with the highest version; ties: the larger response."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("version"), F.desc("response"))
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def upsert_chapters(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch, one row for each chapter, under its number, and writes a batch that comes again over itself; current_chapters() reads the newest."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chapters(spark: SparkSession, path: str) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r", "batch")
