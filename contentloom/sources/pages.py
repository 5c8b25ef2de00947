"""The crawl table and what is read off each of its pages."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.functions import page as P
from contentloom.functions.elements import ELEMENTS
from contentloom.functions.maintext import main_text
from contentloom.functions.markdown import markdown, plain_markdown
from contentloom.functions.urls import url_key
from contentloom.operators.dom import dom_nodes
from contentloom.operators.keyfilter import KeyFilter
from contentloom.session import stage


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages with the key that a request would use."""
    pages = spark.read.parquet(path)
    return pages.selectExpr("page_id", "url", f"{url_key('url')} AS url_key", "html")


#: Setting of the session: tasks of the parse; spark.sql.shuffle.partitions if unset.
PARSE_TASKS = "spark.contentloom.parse.tasks"


def dealt(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages over the tasks of the parse, by the hash of ``keys``.

    A scan is split by its bytes, which say little of the work: a page costs a hundred times what its
    packed bytes cost to read, so a small file would be one task, and a large one a few long ones.
    """
    conf = pages.sparkSession.conf
    return pages.repartition(int(conf.get(PARSE_TASKS, None) or conf.get("spark.sql.shuffle.partitions")), *keys)


def page_nodes(pages: DataFrame, *keep: str, deal: bool = True) -> DataFrame:
    """Events of each page, and its elements, beside the columns ``keep``. ``deal`` is false for pages
    that are ``dealt`` already."""
    rows = pages.select(*keep, "html")
    return dom_nodes(dealt(rows, *keep) if deal else rows).selectExpr(*keep, "nodes", f"{ELEMENTS} AS elements")


def _facts() -> dict[str, str]:
    """What the extractors ask of a page. ``readable`` is false for a page the parser gives up on."""
    return {
        "readable": "nodes IS NOT NULL",
        "links": P.article_links(),
        "n_containers": f"size({P.post_containers()})",
        "hub_links": P.hub_links(),
        "rendered_links": P.read_more_links(),
        "page_title": P.page_title(),
        "article_title": P.article_title(),
        "h1": P.h1_text(),
        "document_title": P.document_title(),
        "title_readable": P.title_readable(),
        "article": article_markdown("date"),
        "main": plain_markdown(main_text()),
        "post": markdown(P.break_words_post()),
    }


#: Forms of a page's text, which cost more than the rest and are made where asked.
RENDERED = ("article", "main", "post")


def page_facts(
    pages: DataFrame, *names: str, keep: tuple[str, ...] = (), only: dict[str, str] | None = None, deal: bool = True
) -> DataFrame:
    """``page_id``, ``url_key``, ``readable``, the columns ``keep`` and the facts named, from one parse.

    ``only`` gives a condition for a form of the text, over the other facts and kept columns;
    pages that do not meet it are not rendered in this form. ``deal`` is that of ``page_nodes``.
    """
    facts, only = _facts(), only or {}
    first = [n for n in facts if n == "readable" or n in names and n not in RENDERED]
    forms = [n for n in RENDERED if n in names]
    base = ["page_id", "url_key", *keep]
    # What several columns are made of comes first, so that it is worked out once.
    shared = page_nodes(pages, "page_id", "url", "url_key", *keep, deal=deal)
    if {"links", "rendered_links"} & set(first):
        shared = shared.selectExpr("*", f"{P.anchors()} AS anchors")
    told = shared.selectExpr(*base, "nodes", "elements", *(f"{facts[n]} AS {n}" for n in first))
    if "article" in forms:
        told = told.selectExpr("*", f"{_asked(P.page_date(), 'article', only)} AS date")
    return told.selectExpr(*base, *first, *(f"{_asked(facts[n], n, only)} AS {n}" for n in forms))


def _asked(value: str, form: str, only: dict[str, str]) -> str:
    return f"CASE WHEN {only[form]} THEN {value} END" if form in only else value


def met_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """The pages of ``keys`` (``url_key``, each once, and other columns, which are added): of a URL
    that was crawled twice the page with the lowest id. ``keys`` should be a table.

    Pages of other URLs are left out by a filter in the scan, first of the ids, then of the pages.
    The others are ``dealt``, which is the exchange that the hash join asks for: pages move once and
    are not sorted. Were one side sent to all tasks instead, those of the other side would parse.
    """
    wanted = KeyFilter(keys, "url_key")
    ids = (
        wanted.maybe_wanted(pages.select("page_id", "url_key"))
        .join(keys, "url_key")
        .groupBy(*keys.columns)
        .agg(F.min("page_id").alias("page_id"))
    )
    return dealt(wanted.maybe_wanted(pages), "url_key", "page_id").join(ids.hint("shuffle_hash"), ["url_key", "page_id"])


def article_markdown(date: str) -> str:
    """Body of an article, under its date if it has one."""
    return f"concat(CASE WHEN {date} <> '' THEN concat('Date: ', {date}, '\\n\\n') ELSE '' END, {markdown(P.article_body())})"


def repeated_ids(rows: DataFrame, key: str = "url_key", row_id: str = "page_id") -> DataFrame:
    """Ids of all rows but the one with the lowest id of each key. Reads ids and keys only."""
    first = rows.groupBy(key).agg(F.min(row_id).alias(row_id)).select(row_id)
    return rows.select(row_id).join(first, row_id, "left_anti")


def one_per_key(rows: DataFrame, key: str = "url_key", row_id: str = "page_id") -> DataFrame:
    """The row with the lowest id of each key.

    The ids to drop are few in a crawl: they are staged, so that their size is known and the
    join with the wide rows can be a broadcast. ``rows`` is read twice more for its ids: it
    should be a table, not a parse.
    """
    return rows.join(stage(repeated_ids(rows, key, row_id), "repeated-ids"), row_id, "left_anti")
