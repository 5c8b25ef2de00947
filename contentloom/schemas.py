"""Column layouts shared by all jobs."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

ITEM_FIELDS = ("title", "content", "content_type", "source_url", "author", "user_id")

ITEM = T.StructType(
    [
        T.StructField("title", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("content_type", T.StringType(), False),
        T.StructField("source_url", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("user_id", T.StringType()),
    ]
)

# One row per run: what a caller gives for one source.
SOURCE = T.StructType(
    [
        T.StructField("source_id", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("is_file", T.BooleanType()),
        T.StructField("team_id", T.StringType()),
        T.StructField("force_content_type", T.StringType()),
        T.StructField("max_items", T.IntegerType()),
    ]
)

# Spark rows have no order of their own: items keep the place they were found at.
POSITION_FIELDS = ("source_id", "page_seq", "item_seq")


def item_columns(
    title: Column,
    content: Column,
    content_type: Column | str,
    source_url: Column | None = None,
    author: Column | None = None,
    user_id: Column | None = None,
) -> list[Column]:
    """The six item fields. Author and user id default to the empty string, the URL to NULL."""
    if isinstance(content_type, str):
        content_type = F.lit(content_type)
    url = F.lit(None).cast("string") if source_url is None else source_url
    return [
        title.alias("title"),
        content.alias("content"),
        content_type.alias("content_type"),
        url.alias("source_url"),
        (F.lit("") if author is None else author).alias("author"),
        (F.lit("") if user_id is None else user_id).alias("user_id"),
    ]


# What the tail of a run needs to know of the source. It travels with links and items as one
# column, so that no item has to be joined back to its source.
RUN_FIELDS = ("source", "is_file", "team_id", "force_content_type", "max_items")


def with_run(sources: DataFrame) -> DataFrame:
    return sources.withColumn("run", F.struct(*RUN_FIELDS))


def check_items(items: DataFrame) -> DataFrame:
    """Positions, run and item fields in fixed order and type; fails on a missing column."""
    want = [*POSITION_FIELDS, "run", *ITEM_FIELDS]
    missing = [c for c in want if c not in items.columns]
    if missing:
        raise ValueError(f"items lack columns {missing}")
    return items.select(
        *[F.col(c).cast("long").alias(c) for c in POSITION_FIELDS],
        "run",
        *[F.col(c).cast("string").alias(c) for c in ITEM_FIELDS],
    )
