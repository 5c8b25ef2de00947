"""Drive folder listings and the books they name."""

from pyspark.sql import DataFrame, functions as F

from contentloom.functions.elements import plain_text, select, text_within
from contentloom.functions.sql import bind, group, q
from contentloom.functions.text import WS, file_title, strip, text_to_markdown
from contentloom.functions.urls import drive_download_url
from contentloom.operators.skew import settled_join
from contentloom.schemas import item_columns
from contentloom.sources.files import book_texts

# Fixed value: how a listing's script names a file: id, parents, name, type.
SCRIPT_FILE = (
    rf'"([A-Za-z0-9_-]{{25,}})"[{WS}]*,[{WS}]*\[[^\]]+\][{WS}]*,[{WS}]*"([^"]+\.pdf)"[{WS}]*,[{WS}]*"application/pdf"'
)


def script_links(script: str) -> str:
    """``ARRAY<STRUCT<file_id, name>>`` of one script's text."""
    rule = q(SCRIPT_FILE)
    return (
        f"zip_with(regexp_extract_all({script}, {rule}, 1), regexp_extract_all({script}, {rule}, 2),"
        " (i, n) -> struct(i AS file_id, n AS name))"
    )


def _all_script_links() -> str:
    texts = select("e.tag = '#text' AND e.parent_tag = 'script' AND contains(e.text, 'application/pdf')", "nodes")
    return f"flatten(transform({texts}, e -> {script_links('e.text')}))"


def anchor_links() -> str:
    """``ARRAY<STRUCT<file_id, name>>`` of the links to PDF files of a page's ``nodes``."""
    anchors = select("e.tag = 'a' AND e.href RLIKE '/file/d/.+/view'")
    # Open anchors reach to the end of the page, so each cuts its text out of one string.
    texts = bind(plain_text("nodes"), "w", f"transform({anchors}, a -> struct(a.href AS href, {text_within('a', 'w')} AS text))")
    books = f"filter({texts}, a -> contains(lower(a.text), '.pdf') OR contains(lower(a.href), '.pdf'))"
    from_address = "concat(element_at(split(a.href, '/'), -2), '.pdf')"
    named = (
        f"transform({books}, a -> struct({group('a.href', '/file/d/([^/]+)')} AS file_id,"
        f" coalesce(nullif({strip('a.text')}, ''), {from_address}) AS name))"
    )
    return f"filter({named}, a -> a.file_id <> '')"


def listing_arrays() -> str:
    """All files that a listing's ``nodes`` name: links in scripts first, then anchors; repeats stay."""
    return f"concat({_all_script_links()}, {anchor_links()})"


def exploded_links(listings: DataFrame, links: str = "links") -> DataFrame:
    """One row per named file, in order."""
    kept = [c for c in listings.columns if c != links]
    each = listings.selectExpr(*kept, f"posexplode({links}) AS (pos, link)")
    return each.selectExpr(*kept, "pos", f"{drive_download_url('link.file_id')} AS url", "link.name AS name")


def listing_links(listings: DataFrame) -> DataFrame:
    """``nodes`` to one row per named file."""
    kept = [c for c in listings.columns if c not in ("nodes", "elements")]
    return exploded_links(listings.select(*kept, F.expr(listing_arrays()).alias("links")))


def first_names(links: DataFrame, group: list[str]) -> DataFrame:
    """Each file once per group, under the name met first."""
    return links.groupBy(*group, "url").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))


def drive_items(links: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Books of deduplicated links ``(…, url, name, pos)`` whose page texts ``(url, page_no, text)`` are stored.

    ``links`` is read more than once: stage it. Texts of other books are left out before they are gathered.

    A name with a slash could not be saved as a local file, so it gives no item.
    """
    wanted = links.select("url").distinct()
    books = book_texts(page_texts.join(wanted, "url", "left_semi"), "url")
    # Rules run once per book, not once per link to it.
    books = books.selectExpr("url", f"{text_to_markdown('text')} AS text")
    local = "concat('_gdrive_', translate(name, ' ', '_'))"
    found = settled_join(links.where(~F.col("name").contains("/")), books, "url")
    kept = [c for c in links.columns if c not in ("url", "name", "pos")]
    return found.select(
        *kept,
        F.lit(0).alias("page_seq"),
        F.col("pos").alias("item_seq"),
        *item_columns(F.expr(file_title(local)), F.col("text"), "book", F.col("url")),
    )
