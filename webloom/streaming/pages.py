"""Streams of pages: files that come in are parsed and counted without ever being read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.html import html_select_one


def count_languages(spark: SparkSession, source: str, work: str) -> DataFrame:
    """(lang, side, n) by the lang attribute of pages and the parity of page_id.

    Each micro-batch appends its counts; offsets and results live below ``work``, so a restarted
    stream goes on where it was.
    """
    schema = spark.read.parquet(source).schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder, names = (source, "*.parquet") if files.getFileStatus(where).isDirectory() else source.rsplit("/", 1)
    pages = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder)
    lang = html_select_one("html", "html")["attrs"]["lang"]
    counted = pages.select(F.coalesce(lang, F.lit("")).alias("lang"), F.pmod("page_id", F.lit(2)).alias("side"))

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("lang", "side").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{work}/counts/batch={number}")

    counted.writeStream.foreachBatch(add).option("checkpointLocation", f"{work}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{work}/counts").groupBy("lang", "side").agg(F.sum("n").alias("n"))
