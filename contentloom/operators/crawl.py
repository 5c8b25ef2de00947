"""Link discovery and fetching, as joins with the table of crawled pages."""

from pyspark.sql import DataFrame, functions as F

from contentloom.functions.urls import is_article_url, url_key
from contentloom.operators.skew import settled_join


def discover(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Pages to extract per source: ``(…, page_seq, url, url_key)``.

    An article stands for itself and is not looked up. Any other source gives the article
    links of its page, and itself if the page has none or is missing.
    """
    own = F.expr(is_article_url("source"))
    itself = F.array("source")
    articles = sources.where(own).withColumn("found", itself)
    hubs = settled_join(
        sources.where(~own).withColumn("url_key", F.expr(url_key("source"))),
        facts.select("url_key", "links"),
        "url_key",
        "left",
    )
    hubs = hubs.withColumn("found", F.when(F.size("links") > 0, F.col("links")).otherwise(itself))
    both = articles.unionByName(hubs.select(*articles.columns))
    return both.select(*sources.columns, F.posexplode("found").alias("page_seq", "url")).withColumn(
        "url_key", F.expr(url_key("url"))
    )


def fetch(links: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Links with the wanted columns of their page; ``fetched`` is false where there is none."""
    found = facts.select("url_key", F.col("readable").alias("fetched"), *columns)
    joined = settled_join(links, found, "url_key", "left")
    return joined.withColumn("fetched", F.coalesce("fetched", F.lit(False)))


def explode_links(pages: DataFrame, links: str) -> DataFrame:
    """Second hop: one row per link of a fetched page, with ``item_seq``."""
    kept = [c for c in pages.columns if c not in ("url", "url_key", "fetched", links)]
    return pages.select(*kept, F.posexplode(links).alias("item_seq", "url")).withColumn(
        "url_key", F.expr(url_key("url"))
    )


def rejects(links: DataFrame, stage: str, reason: str) -> DataFrame:
    return links.select("source_id", "url", F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))
