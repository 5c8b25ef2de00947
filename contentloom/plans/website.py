"""The website extractor: hubs, rendered pages and single articles in one plan."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from contentloom.functions.urls import is_article_url, url_key
from contentloom.operators.crawl import discover, explode_links, fetch, rejects
from contentloom.schemas import item_columns
from contentloom.session import stage
from contentloom.sources.pages import met_pages, page_facts


@dataclass
class Crawl:
    """The crawled pages. A page is parsed when a source or a link meets it, and rendered in the form
    that is asked of it there; a page that no run meets is neither parsed nor moved."""

    pages: DataFrame

    def read(self, keys: DataFrame, *names: str, only: dict[str, str] | None = None) -> DataFrame:
        """Facts of the pages of ``keys`` (``url_key``, and flags that ``only`` may ask for), as a table."""
        flags = tuple(c for c in keys.columns if c != "url_key")
        once = keys.groupBy("url_key").agg(*(F.bool_or(c).alias(c) for c in flags)) if flags else keys.distinct()
        wanted = stage(once, "wanted-keys")
        facts = page_facts(met_pages(self.pages, wanted), *names, keep=flags, only=only, deal=False)
        return stage(facts.drop(*flags), "page-facts")


def own_keys(sources: DataFrame) -> DataFrame:
    return sources.select(F.expr(url_key("source")).alias("url_key"))


#: What the website route asks of a page that a source leads to.
PAGE_FACTS = ("n_containers", "hub_links", "rendered_links", "page_title", "main")


def website_parts(sources: DataFrame, crawl: Crawl, dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items and rejects. ``dedup`` keeps an article once where nested posts name it twice."""
    own = sources.select("source_id", "source", "run")
    # A page without article links is its own only link, so it is read to the end at once.
    no_links = "coalesce(size(links), 0) = 0"
    lists = crawl.read(
        own_keys(own.where(~F.expr(is_article_url("source")))), "links", *PAGE_FACTS, only={"main": f"{no_links} AND n_containers = 0"}
    )
    links = stage(discover(own, lists).select("source_id", "run", "page_seq", "url", "url_key"), "links")
    answered = lists.where(no_links).drop("links")
    further = links.select("url_key").join(answered.select("url_key"), "url_key", "left_anti")
    facts = answered.unionByName(crawl.read(further, *PAGE_FACTS, only={"main": "n_containers = 0"}))
    pages = fetch(links, facts, *PAGE_FACTS)
    has_links, has_posts = F.size("hub_links") > 0, F.col("n_containers") > 0
    read = pages.where("fetched")

    # Hubs and pages with unlinked posts lead to further pages; the rest are articles.
    hop = F.when(has_links, F.col("hub_links")).otherwise(F.col("rendered_links"))
    onward = read.where(has_posts).select(
        "source_id", "run", "page_seq", has_links.alias("from_hub"), F.array_distinct(hop).alias("next")
        if dedup else hop.alias("next"),
    )
    onward = stage(explode_links(onward, "next"), "onward-links")
    hub = F.col("from_hub")
    asked = onward.select("url_key", hub.alias("as_article"), (~hub).alias("as_main"))
    if onward.isEmpty():  # no hub, so no further pages
        asked = asked.limit(0)
    told = crawl.read(
        asked, "article_title", "article", "h1", "main", only={"article": "as_article", "main": "as_main AND h1 IS NOT NULL"}
    )
    articles = fetch(onward, told, "article_title", "article", "h1", "main")
    found = articles.where(F.col("fetched"))
    usable = hub | (F.col("h1").isNotNull() & F.col("main").isNotNull())
    place = ["source_id", "run", "page_seq", "item_seq"]
    linked_items = found.where(usable).select(
        *place,
        *item_columns(
            F.when(hub, F.coalesce("article_title", "url")).otherwise(F.col("h1")),
            F.when(hub, F.col("article")).otherwise(F.col("main")),
            "blog",
            F.col("url"),
        ),
    )
    single = read.where(~has_posts)
    page_items = single.where(F.col("main").isNotNull()).select(
        "source_id",
        "run",
        "page_seq",
        F.lit(0).alias("item_seq"),
        *item_columns(F.col("page_title"), F.col("main"), "blog", F.col("url")),
    )
    lost = (
        rejects(pages.where(~F.col("fetched")), "page", "not fetched")
        .unionByName(rejects(single.where(F.col("main").isNull()), "page", "no main text"))
        .unionByName(rejects(articles.where(~F.col("fetched")), "article", "not fetched"))
        .unionByName(rejects(found.where(~usable), "article", "no heading or main text"))
    )
    return linked_items.unionByName(page_items), lost


def website_items(sources: DataFrame, crawl: Crawl, dedup: bool = False) -> DataFrame:
    return website_parts(sources, crawl, dedup)[0]
