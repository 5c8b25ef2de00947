"""URL, routing and type queries."""

from pyspark.sql import functions as F

from contentloom.functions import urls
from contentloom.operators.routing import Routes, resolve_content_type
from contentloom.schemas import item_columns, with_run
from contentloom.sources.pages import scan_pages
from suite.base import article_url_sql, expr, query, table


@query("scan_pages", "SELECT page_id, url, split_part(url, '#', 1) AS url_key, html FROM pages")
def scan_pages_query(spark, sf_dir):
    return scan_pages(spark, f"{sf_dir}/pages.parquet")


@query(
    "url_parts",
    r"""
    SELECT page_id, url,
      lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
      regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
      regexp_replace(url, '#.*$', '') AS url_key
    FROM pages""",
)
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        expr(urls.url_host("url")).alias("host"),
        expr(urls.url_path("url")).alias("path"),
        expr(urls.url_key("url")).alias("url_key"),
    )


# Slugs of every length, and addresses that meet one entry of each list.
CUSTOMER_URL = (
    "concat('https://a.example.com/', CASE c_custkey % 7 WHEN 0 THEN 'blog/' WHEN 1 THEN 'Tag/' ELSE '' END,"
    " lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN '/abc' WHEN c_custkey % 11 = 1 THEN '/x;y=1'"
    " ELSE concat('/item', cast(c_custkey AS string)) END,"
    " CASE WHEN c_custkey % 13 = 0 THEN '#top' WHEN c_custkey % 5 = 0 THEN '/' ELSE '' END)"
)


@query(
    "article_urls",
    f"""
    WITH u AS (SELECT url FROM pages UNION ALL SELECT {CUSTOMER_URL} FROM customer)
    SELECT url, {article_url_sql('url')} AS is_article FROM u""",
)
def article_urls(spark, sf_dir):
    both = table(spark, sf_dir, "pages").select("url").unionByName(
        table(spark, sf_dir, "customer").select(expr(CUSTOMER_URL).alias("url"))
    )
    return both.select("url", expr(urls.is_article_url("url")).alias("is_article"))


LINK_FORMS = (
    "https://Other.example.org/a?b=1#c", "//cdn.example.net/lib/x.js", "/root/page.html", "?q=2", "#part", "",
    "mailto:me@example.com", "next/page.html", "./here", "../up/one", "/a/./b/../c",
)
_FORMS = ", ".join(f"'{f}'" for f in LINK_FORMS)
# The root and the folder of a page, taken apart by hand.
_ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_DIR = f"CASE WHEN {_PATH} = '' THEN '/' ELSE regexp_replace({_PATH}, '[^/]*$', '') END"


@query(
    "resolve_links",
    f"""
    WITH f AS (SELECT page_id, url, unnest([{_FORMS}]) AS link FROM pages),
    b AS (SELECT *, {_ROOT} AS root, {_DIR} AS dir FROM f)
    SELECT page_id, link, CASE
      WHEN link = '' THEN url
      WHEN regexp_matches(link, '^[a-z]+:') THEN link
      WHEN starts_with(link, '//') THEN split_part(url, '//', 1) || link
      WHEN link = '/a/./b/../c' THEN root || '/a/c'
      WHEN starts_with(link, '/') THEN root || link
      WHEN starts_with(link, '?') THEN split_part(split_part(url, '#', 1), '?', 1) || link
      WHEN starts_with(link, '#') THEN split_part(url, '#', 1) || link
      WHEN starts_with(link, './') THEN root || dir || link[3:]
      WHEN starts_with(link, '../') THEN root || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END || link[4:]
      ELSE root || dir || link END AS resolved
    FROM b""",
)
def resolve_links(spark, sf_dir):
    forms = F.explode(F.array(*[F.lit(f) for f in LINK_FORMS])).alias("link")
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", "url", forms)
        .select("page_id", "link", expr(urls.resolve_link("url", "link")).alias("resolved"))
    )


THREAD_URL = (
    "concat('r/', lower(c_mktsegment), '/', cast(c_custkey AS string),"
    " CASE c_custkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '.json' WHEN 2 THEN '?x=1' ELSE '' END)"
)


@query(
    "reddit_json_urls",
    f"""
    WITH u AS (SELECT {THREAD_URL} AS url FROM customer)
    SELECT url, CASE WHEN ends_with(url, '.json') THEN url
      WHEN ends_with(url, '/') THEN url[:-2] || '.json' ELSE url || '.json' END AS json_url FROM u""",
)
def reddit_json_urls(spark, sf_dir):
    threads = table(spark, sf_dir, "customer").select(expr(THREAD_URL).alias("url"))
    return threads.select("url", expr(urls.reddit_json_url("url")).alias("json_url"))


MANIFEST_COLUMNS = {
    "source_id": "c_custkey",
    "source": (
        "concat(CASE c_custkey % 11 WHEN 0 THEN 'https://drive.google.com/drive/folders/f'"
        " WHEN 1 THEN 'http://site.example.com/p' WHEN 2 THEN 'Book.' WHEN 3 THEN 'reddit.com/r/a'"
        " WHEN 4 THEN 'www.substack.com/p/x' WHEN 5 THEN 'linkedin.com/posts/x' WHEN 6 THEN 'call'"
        " WHEN 7 THEN 'note' WHEN 8 THEN 'HTTP://X' WHEN 9 THEN 'https://www.reddit.com/r/b' ELSE 'a.pdf' END,"
        " cast(c_custkey AS string), CASE c_custkey % 11 WHEN 2 THEN '.PDF' WHEN 6 THEN '.Txt' WHEN 7 THEN '.md.gz'"
        " WHEN 10 THEN '.pdf.gz' ELSE '' END)"
    ),
    "is_file": "c_custkey % 11 IN (2, 6, 7) OR c_custkey % 22 = 10",
    "team_id": "lower(c_mktsegment)",
    "force_content_type": "CASE c_custkey % 4 WHEN 0 THEN 'forced' WHEN 1 THEN '' ELSE NULL END",
    "max_items": "CASE c_custkey % 5 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 100 WHEN 4 THEN -2 ELSE NULL END",
}
MANIFEST_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in MANIFEST_COLUMNS.items()) + " FROM customer"


def manifest(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(*[expr(v).alias(k) for k, v in MANIFEST_COLUMNS.items()])


ROUTE_SQL = """CASE WHEN contains(source, 'drive.google.com/drive/folders/') THEN 'drive'
  WHEN starts_with(source, 'http') THEN 'website'
  WHEN is_file AND ends_with(lower(source), '.pdf') THEN 'pdf'
  WHEN contains(source, 'reddit.com') THEN 'reddit'
  WHEN contains(source, 'substack.com') THEN 'substack'
  WHEN contains(source, 'linkedin.com') THEN 'linkedin'
  WHEN is_file AND ends_with(lower(source), '.txt') THEN 'transcript' ELSE 'generic' END"""


@query("route_sources", f"WITH m AS ({MANIFEST_SQL}) SELECT source_id, source, {ROUTE_SQL} AS route FROM m")
def route_sources(spark, sf_dir):
    return Routes().apply(manifest(spark, sf_dir)).select("source_id", "source", "route")


_OWN = "CASE WHEN source_id % 6 = 0 THEN 'own' WHEN source_id % 6 = 1 THEN NULL ELSE '' END"


@query(
    "content_types",
    f"""
    WITH m AS ({MANIFEST_SQL}), t AS (SELECT *, {_OWN} AS own FROM m)
    SELECT source_id, CASE WHEN force_content_type <> '' THEN force_content_type WHEN own <> '' THEN own
      WHEN is_file AND (ends_with(lower(source), '.pdf') OR ends_with(source, '.pdf.gz')) THEN 'book'
      WHEN is_file AND ends_with(lower(source), '.txt') THEN 'call_transcript'
      WHEN starts_with(source, 'https://www.reddit.com/') THEN 'reddit_comment' ELSE 'blog' END AS content_type
    FROM t""",
)
def content_types(spark, sf_dir):
    typed = manifest(spark, sf_dir).withColumn("own", expr(_OWN))
    return typed.select(
        "source_id",
        resolve_content_type("force_content_type", "own", "source", "is_file").alias("content_type"),
    )


@query(
    "custom_route",
    f"""
    WITH m AS ({MANIFEST_SQL})
    SELECT source_id, CASE WHEN contains(source, 'note') THEN 'notes' ELSE {ROUTE_SQL} END AS route,
      CASE WHEN contains(source, 'note') THEN source END AS title,
      CASE WHEN contains(source, 'note') THEN 'Note of ' || team_id END AS content
    FROM m""",
)
def custom_route(spark, sf_dir):
    def extract(sources):
        return sources.select(
            "source_id", "run", F.lit(0).alias("page_seq"), F.lit(0).alias("item_seq"),
            *item_columns(F.col("source"), F.concat(F.lit("Note of "), F.col("team_id")), "note"),
        )

    routes = Routes().register("notes", lambda source, is_file: source.contains("note"), extract, before="website")
    routed = routes.apply(with_run(manifest(spark, sf_dir)))
    (notes,) = routes.custom()
    taken = notes.extract(routed.where(F.col("route") == notes.name)).select(
        "source_id", F.lit(notes.name).alias("route"), "title", "content"
    )
    rest = routed.where(F.col("route") != notes.name).select(
        "source_id", "route", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content")
    )
    return taken.unionByName(rest)
