"""Extraction as files and pages arrive.

The stages of text files are stateless expressions, so they serve on a stream as they are. Page plans
write stage tables, which a stream cannot; they run on each micro-batch.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from contentloom.operators.crawl import rejects
from contentloom.schemas import item_columns
from contentloom.session import remove_stages, stage, staged
from contentloom.sources.files import text_items
from contentloom.sources.pages import page_facts

FILE_COLUMNS = "path string, text string"


def arriving_items(spark: SparkSession, folder: str, content_type: str, schema: str = FILE_COLUMNS) -> DataFrame:
    """Items of ``(path, text)`` tables that land in a folder, as a stream."""
    return text_items(spark.readStream.schema(schema).parquet(folder), content_type)


def page_items(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main text of each of the pages ``(page_id, url, url_key, html)`` under its title, with the page's
    id as ``source_id``; and rejects: pages that cannot be read or hold no main text."""
    named = pages.withColumn("source", F.col("url"))
    facts = stage(page_facts(named, "page_title", "main", keep=("source",)), "arrived-pages").withColumnRenamed("page_id", "source_id")
    full = F.col("main").isNotNull()
    items = facts.where(full).select("source_id", *item_columns(F.col("page_title"), F.col("main"), "blog", F.col("source")))
    empty = facts.withColumn("url", F.col("source"))
    lost = rejects(empty.where(F.col("readable") & ~full), "page", "no main text").unionByName(
        rejects(empty.where(~F.col("readable")), "page", "not readable")
    )
    return items, lost


def write_arriving_pages(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that extracts the pages of a stream batch by batch, into ``path/items`` and ``path/rejects``.

    Each batch has a folder of its own, which is replaced if the batch is run again after a failure, so
    every page counts once. Stage tables of a batch go with it.
    """

    def extract(pages: DataFrame, batch: int) -> None:
        there = set(staged())
        for name, rows in zip(("items", "rejects"), page_items(pages), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        remove_stages(pages.sparkSession, [p for p in staged() if p not in there])

    return stream.writeStream.foreachBatch(extract).option("checkpointLocation", checkpoint)
