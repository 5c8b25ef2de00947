"""Reddit threads in their JSON form."""

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.functions.markdown import markdown
from contentloom.functions.text import decode_entities
from contentloom.functions.urls import reddit_json_url
from contentloom.operators.dom import dom_nodes
from contentloom.operators.skew import settled_join
from contentloom.schemas import item_columns
from contentloom.session import stage

_COMMENT = "$[1].data.children[0].data"


def first_comments(threads: DataFrame) -> DataFrame:
    """``(…, author, user_id, body_html)`` of each thread's first comment.

    A body that is not JSON, or that has no comment with a body, gives no row. The body is
    parsed once.
    """
    comment = F.try_variant_get(F.try_parse_json("body"), _COMMENT, "variant")
    kept = [c for c in threads.columns if c != "body"]

    def text(path):
        return F.try_variant_get("comment", path, "string")

    def optional(path):
        # A key that is not there gives the empty string, a JSON null stays NULL.
        value = F.try_variant_get("comment", path, "variant")
        return F.when(value.isNull(), F.lit("")).otherwise(text(path))

    return (
        threads.select(*kept, comment.alias("comment"))
        .select(
            *kept,
            optional("$.author").alias("author"),
            optional("$.author_fullname").alias("user_id"),
            text("$.body_html").alias("body_html"),
        )
        .where(F.col("body_html").isNotNull())
    )


def _rendered(comments: DataFrame, unescape: bool) -> DataFrame:
    """Markdown of ``body_html`` as ``content``, beside the other columns."""
    body = decode_entities("body_html") if unescape else "body_html"
    parsed = dom_nodes(comments.withColumn("body_html", F.expr(body)), "body_html")
    kept = [c for c in parsed.columns if c != "nodes"]
    return parsed.where(F.col("nodes").isNotNull()).select(*kept, F.expr(markdown()).alias("content"))


def _item(url: str) -> list[Column]:
    name = F.concat(F.lit("Reddit comment by "), F.coalesce(F.col("author"), F.lit("None")))
    return item_columns(name, F.col("content"), "reddit_comment", F.col(url), F.col("author"), F.col("user_id"))


def comment_items(threads: DataFrame, url: str = "source", unescape: bool = True) -> DataFrame:
    """Items of threads ``(url, body)``. Listings escape their HTML; ``unescape`` undoes that."""
    kept = [c for c in threads.columns if c != "body"]
    return _rendered(first_comments(threads), unescape).select(*kept, *_item(url))


def met_threads(sources: DataFrame, threads: DataFrame, unescape: bool = True) -> DataFrame:
    """Sources with their thread's comment; ``found`` is null where no thread is stored, false where
    it has no comment.

    Only the first comments of wanted threads are kept, each thread is rendered once, and what is
    joined with the sources is that. A thread that is stored twice counts once: by the smallest of
    its comments.
    """
    wanted = sources.withColumn("json_url", F.expr(reddit_json_url("source")))
    met = threads.select("json_url", "body").join(wanted.select("json_url").distinct(), "json_url", "left_semi")
    comment = F.min(F.struct("author", "user_id", "body_html")).alias("comment")
    first = first_comments(met).groupBy("json_url").agg(comment).select("json_url", "comment.*")
    rendered = _rendered(first, unescape).withColumn("found", F.lit(True))
    stored = met.select("json_url").distinct().join(rendered, "json_url", "left")
    stored = stored.withColumn("found", F.coalesce("found", F.lit(False)))
    return settled_join(wanted, stage(stored, "threads"), "json_url", "left")


def reddit_items(sources: DataFrame, threads: DataFrame, unescape: bool = True) -> DataFrame:
    """Sources whose stored thread ``(json_url, body)`` is there; all else gives no item."""
    return thread_items(met_threads(sources, threads, unescape))


def thread_items(met: DataFrame) -> DataFrame:
    place = (F.lit(0).alias("page_seq"), F.lit(0).alias("item_seq"))
    return met.where("found").select("source_id", "run", *place, *_item("source"))
