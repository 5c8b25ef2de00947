"""Extractors of one page per source."""

from pyspark.sql import DataFrame, functions as F

from contentloom.functions.urls import url_key
from contentloom.operators.crawl import fetch, rejects
from contentloom.plans.website import Crawl, own_keys
from contentloom.schemas import item_columns


def _own_pages(sources: DataFrame, crawl: Crawl, *columns: str) -> DataFrame:
    facts = crawl.read(own_keys(sources), *columns)
    own = sources.select("source_id", "run", F.col("source").alias("url"), F.expr(url_key("source")).alias("url_key"))
    return fetch(own, facts, *columns)


def _one_item(pages: DataFrame, content: str, content_type: str, missing: str) -> tuple[DataFrame, DataFrame]:
    """Items, and rejects: pages that are not there, lack what is asked for, or whose title cannot
    be read."""
    title = F.coalesce("document_title", "url")
    has, readable = F.col(content).isNotNull(), F.col("title_readable")
    fetched = pages.where("fetched")
    items = fetched.where(has & readable).select(
        "source_id",
        "run",
        F.lit(0).alias("page_seq"),
        F.lit(0).alias("item_seq"),
        *item_columns(title, F.col(content), content_type, F.col("url")),
    )
    lost = (
        rejects(pages.where(~F.col("fetched")), "page", "not fetched")
        .unionByName(rejects(fetched.where(~has), "page", missing))
        .unionByName(rejects(fetched.where(has & ~readable), "page", "unreadable title"))
    )
    return items, lost


def substack_parts(sources: DataFrame, crawl: Crawl) -> tuple[DataFrame, DataFrame]:
    pages = _own_pages(sources, crawl, "document_title", "title_readable", "main")
    return _one_item(pages, "main", "blog", "no main text")


def substack_items(sources: DataFrame, crawl: Crawl) -> DataFrame:
    """Main text of the page under its document title."""
    return substack_parts(sources, crawl)[0]


def linkedin_parts(sources: DataFrame, crawl: Crawl) -> tuple[DataFrame, DataFrame]:
    pages = _own_pages(sources, crawl, "document_title", "title_readable", "post")
    return _one_item(pages, "post", "linkedin_post", "no post")


def linkedin_items(sources: DataFrame, crawl: Crawl) -> DataFrame:
    """The post of the page under its document title."""
    return linkedin_parts(sources, crawl)[0]
