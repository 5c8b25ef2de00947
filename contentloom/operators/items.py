"""The shared tail of every run: limit, type, empty filter, counts."""

from pyspark.sql import Column, DataFrame, Observation, functions as F

from contentloom.operators.routing import resolve_content_type
from contentloom.operators.skew import group_rank


def within_limit(rank: Column, size: Column, max_items: Column) -> Column:
    """No limit for NULL and 0; the first N; for a negative N all but the last -N."""
    n = F.coalesce(max_items.cast("long"), F.lit(0))
    return (n == 0) | ((n > 0) & (rank <= n)) | ((n < 0) & (rank <= size + n))


def judge_items(items: DataFrame, row: str | None = None) -> DataFrame:
    """Items with ``within``: whether their source's ``max_items`` allows them. Sources without a limit
    are not ranked, nor shuffled. ``row`` numbers the rows of a table."""
    n = F.coalesce(F.col("max_items"), F.lit(0))
    ranked = group_rank(items.where(n != 0), ["source_id"], ["page_seq", "item_seq"], row)
    allowed = within_limit(F.col("rank"), F.col("size"), F.col("max_items")).alias("within")
    free = items.where(n == 0).withColumn("within", F.lit(True))
    return free.unionByName(ranked.select(*items.columns, allowed))


def limit_items(items: DataFrame) -> DataFrame:
    """Keep what each source's ``max_items`` allows."""
    return judge_items(items).where("within").drop("within")


def finish_items(items: DataFrame) -> DataFrame:
    """Limit, then type, then the empty-content filter: fewer than the limit may be left.

    ``items`` carry the columns of their source row besides their own.
    """
    return resolve_types(limit_items(items)).where(has_content(F.col("content")))


def resolve_types(items: DataFrame) -> DataFrame:
    return items.withColumn(
        "content_type",
        resolve_content_type("force_content_type", "content_type", "source", "is_file"),
    )


def has_content(content: Column) -> Column:
    return content.isNotNull() & (content != "")


def _counts() -> dict[str, Column]:
    """Of judged items: found, within the limit, written, skipped as empty."""
    within, full = F.col("within"), has_content(F.col("content"))
    return {"found": F.count("*"), "limited": F.count_if(within), "written": F.count_if(within & full), "skipped": F.count_if(within & ~full)}


def summary_of(judged: DataFrame) -> DataFrame:
    """Per source: items found, within the limit, written, skipped as empty, and the type first written.
    One pass over items of ``judge_items``, summed where they lie before they are dealt by source."""
    written = F.col("within") & has_content(F.col("content"))
    first = F.min_by("content_type", F.when(written, F.struct("page_seq", "item_seq")))
    return resolve_types(judged).groupBy("source_id").agg(*(c.alias(n) for n, c in _counts().items()), first.alias("content_type"))


def observed(judged: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The same items, and the counts of all of them, which are there once the items have been written.
    They are to be written by a plan that reads them once: a sort by ranges reads them twice."""
    counts = Observation(name)
    return judged.observe(counts, *(c.alias(n) for n, c in _counts().items())), counts


def run_summary(items: DataFrame) -> DataFrame:
    return summary_of(judge_items(items))
