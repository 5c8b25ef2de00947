"""Text files and page texts of books."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.functions.text import file_title, text_to_markdown, unix_newlines
from contentloom.functions.urls import base_name
from contentloom.schemas import item_columns


def scan_text_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files as ``(path, text, valid)``; text is NULL where the bytes are not UTF-8.

    Spark does not list files of no bytes; the empty-content filter would drop their items.
    """
    files = spark.read.format("binaryFile").load(paths)
    # Local paths as a manifest names them, without their scheme.
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select("path", F.when(valid, F.expr(unix_newlines("CAST(content AS STRING)"))).alias("text"), valid.alias("valid"))


def text_items(files: DataFrame, content_type: str) -> DataFrame:
    """One item per readable file, named after it. Other columns are kept."""
    return files.where(F.col("text").isNotNull()).select(
        *[c for c in files.columns if c not in ("text", "valid")],
        *item_columns(F.expr(base_name("path")), F.expr(text_to_markdown("text")), content_type),
    )


def transcript_items(files: DataFrame) -> DataFrame:
    return text_items(files, "call_transcript")


def generic_items(files: DataFrame) -> DataFrame:
    return text_items(files, "other")


def file_rejects(files: DataFrame) -> DataFrame:
    return files.where(~F.col("valid")).select("path", F.lit("read").alias("stage"), F.lit("not UTF-8").alias("reason"))


def join_texts(rows: DataFrame, group: list[str], order: str, text: str, sep: str = "", width: int = 256) -> DataFrame:
    """Texts of a group in order, NULL as empty.

    Built in stretches of the order column and then from the stretches, so that a group of
    very many rows is sorted and joined by many tasks first.
    """
    def joined(parts, at):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), parts.alias("text"))))
        return F.array_join(F.transform(pairs, lambda p: p["text"]), sep)

    stretch = F.expr(f"{order} div {width}").alias("stretch")
    part = rows.groupBy(*group, stretch).agg(joined(F.coalesce(F.col(text), F.lit("")), order).alias(text))
    return part.groupBy(*group).agg(joined(F.col(text), "stretch").alias(text))


def book_texts(page_texts: DataFrame, key: str = "file") -> DataFrame:
    """Page texts ``(file, page_no, text)`` to one text per file."""
    return join_texts(page_texts, [key], "page_no", "text")


def book_items(page_texts: DataFrame) -> DataFrame:
    """One item per book, named after its file without ``.pdf``."""
    return book_texts(page_texts).select(
        "file", *item_columns(F.expr(file_title("file")), F.expr(text_to_markdown("text")), "book")
    )
