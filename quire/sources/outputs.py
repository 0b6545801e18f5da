"""Chapter files in a folder: written, listed, put together, and removed when the master stands. All through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAPTER_FILE = r"_ch([0-9]+)\.json$"


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_chapter_json(chapters: DataFrame, folder: str) -> None:
    """chapters (stem, chapter_number, json): a text part below stem=.../chapter=NN; a chapter written again replaces the old one."""
    named = chapters.select("json", "stem", F.lpad(F.col("chapter_number").cast("string"), 2, "0").alias("chapter"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem", "chapter").text(folder)


def scan_chapter_dir(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """(chapter_number, json) of a document's chapters, by number."""
    every = spark.read.option("basePath", folder).text(f"{folder}/stem={stem}", wholetext=False)
    return every.select(F.col("chapter").cast("int").alias("chapter_number"), F.col("value").alias("json")).orderBy("chapter_number")


def save_failed_response(rows: DataFrame, folder: str) -> None:
    """rows (stem, chapter_number, attempt, response) are added to the log of failed answers."""
    rows.select("stem", "chapter_number", "attempt", "response").write.mode("append").json(folder)


def delete_chapter_outputs(spark: SparkSession, folder: str, stem: str) -> int:
    """Removes a document's chapter files and, when nothing is left, the folder; how many chapters went."""
    own, fs = _path(spark, f"{folder}/stem={stem}")
    if not fs.exists(own):
        return 0
    gone = sum(1 for s in fs.listStatus(own) if s.isDirectory())
    fs.delete(own, True)
    top, fs = _path(spark, folder)
    if not any(s.isDirectory() for s in fs.listStatus(top)):
        fs.delete(top, True)
    return gone


def finalize_chapter_outputs(spark: SparkSession, folder: str, stem: str, master: str) -> int:
    """Once ``master`` is written, removes the chapter files that went into it; how many went. Without a master they stay."""
    path, fs = _path(spark, master)
    return delete_chapter_outputs(spark, folder, stem) if fs.exists(path) else 0
