"""Queries over the events of single pages."""

from pyspark.sql import functions as F

from contentloom.functions import page as P
from contentloom.functions.maintext import main_text
from contentloom.functions.markdown import markdown
from contentloom.functions.sql import present
from contentloom.schemas import item_columns
from contentloom.sources.pages import article_markdown, page_nodes
from suite.base import (
    ARTICLE_MD_SQL, CLEAN_HTML, DOC_TITLE_SQL, MAIN_SQL, PAGE_TITLE_SQL, decode_sql, escape_sql, expr, query, table,
)
from suite.text_queries import item_sql

def _real(spark, sf_dir, *keep):
    return page_nodes(table(spark, sf_dir, "pages"), "page_id", *keep)


@query(
    "dom_nodes",
    f"""
    WITH c AS (SELECT page_id, {CLEAN_HTML} AS html FROM pages),
    t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM c)
    SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag
    UNION ALL SELECT page_id, 'script', 1 FROM pages UNION ALL SELECT page_id, 'style', 1 FROM pages""",
)
def dom_nodes_query(spark, sf_dir):
    tags = _real(spark, sf_dir).select("page_id", F.explode("elements").alias("e"))
    return tags.groupBy("page_id", F.col("e.tag").alias("tag")).agg(F.count("*").alias("n"))


@query("page_titles", f"SELECT page_id, {PAGE_TITLE_SQL} AS title FROM pages")
def page_titles(spark, sf_dir):
    return _real(spark, sf_dir).select("page_id", expr(P.page_title()).alias("title"))


@query("doc_titles", f"SELECT page_id, {DOC_TITLE_SQL} AS title FROM pages")
def doc_titles(spark, sf_dir):
    return _real(spark, sf_dir).select("page_id", expr(P.document_title()).alias("title"))


@query("main_text_pages", f"SELECT page_id, {MAIN_SQL} AS main FROM pages WHERE {MAIN_SQL} IS NOT NULL")
def main_text_pages(spark, sf_dir):
    return _real(spark, sf_dir).selectExpr("page_id", f"{present(main_text())} AS main")


# Head title, nav list, ad, article, footer; the article's bold text is closed before the footer.
_LINK_TEXT = escape_sql(decode_sql("regexp_extract(t, '>(.*)</a>', 1)"))
_LINK_HREF = decode_sql("regexp_extract(t, 'href=\"([^\"]*)\"', 1)")
_NAV_MD = (
    "array_to_string(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1),"
    f" lambda t: '* [' || {_LINK_TEXT} || '](' || {_LINK_HREF} || ')'), chr(10))"
)
_AD = """regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)"""
_FOOTER = "regexp_extract(html, '(?s)<footer>(.*?)(?:</footer>|$)', 1)"


@query(
    "page_markdown",
    f"""
    WITH p AS (SELECT page_id, {escape_sql(DOC_TITLE_SQL)} AS title, {_NAV_MD} AS nav,
      {escape_sql(decode_sql(f"trim({_AD})"))} AS ad, {ARTICLE_MD_SQL} AS article,
      {escape_sql(decode_sql(f"trim({_FOOTER})"))} AS footer FROM pages)
    SELECT page_id, title || chr(10) || chr(10) || nav || chr(10) || chr(10) || ad || chr(10) || chr(10) || article
      || chr(10) || chr(10) || footer AS markdown FROM p""",
)
def page_markdown(spark, sf_dir):
    return _real(spark, sf_dir).select("page_id", expr(markdown()).alias("markdown"))


@query("article_bodies", f"SELECT page_id, {ARTICLE_MD_SQL} AS body FROM pages")
def article_bodies(spark, sf_dir):
    return _real(spark, sf_dir).select("page_id", expr(markdown(P.article_body())).alias("body"))


# Articles in five forms, one per customer.
ARTICLE_HTML = """CASE c_custkey % 5
  WHEN 0 THEN concat('<html><head><title>T</title></head><body><article><p>no</p></article><main><h2> Second <i>', c_name,
    '</i></h2><h1>late</h1><time> 5 May </time><p>In ', c_mktsegment, '</p></main></body></html>')
  WHEN 1 THEN concat('<body><div>x</div><article><h1>', c_name, '</h1><h4 class="big text-slate-500  text-sm">1.2.', cast(c_custkey AS string),
    '</h4><ul><li>', c_mktsegment, '</li><li>two</li></ul></article></body>')
  WHEN 2 THEN concat('<div class="a"><span class="text-sm">no</span>', repeat('x', cast(c_custkey % 40 AS int)), '</div><div class="b"><span class="text-slate-500 text-sm">',
    'day</span><p>', repeat('y', cast(c_custkey % 30 AS int)), '</p></div><script>var long = "long long long long long long long long long";</script>')
  WHEN 3 THEN concat('<p>Only ', c_name, '</p>')
  ELSE concat('<h1></h1><time></time><span class="text-slate-500 text-sm">unused</span><div><h2>', c_name, '</h2></div>') END"""


def _articles(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"),
        F.concat(F.lit("https://a.example.com/"), "c_custkey").alias("url"),
        expr(ARTICLE_HTML).alias("html"),
    )
    return page_nodes(pages, "page_id", "url")


_A_URL = "'https://a.example.com/' || c_custkey"
_A_TITLE = (
    f"CASE c_custkey % 5 WHEN 0 THEN 'Second' || c_name WHEN 1 THEN c_name WHEN 2 THEN {_A_URL}"
    f" WHEN 3 THEN {_A_URL} ELSE '' END"
)
_A_DATE = "CASE c_custkey % 5 WHEN 0 THEN '5 May' WHEN 1 THEN '1.2.' || c_custkey WHEN 2 THEN 'day' ELSE '' END"
# The length of a div's own text, with the label that stands in it.
_DIV_B = "3 + c_custkey % 30 > 2 + c_custkey % 40"
_A_BODY = f"""CASE c_custkey % 5
  WHEN 0 THEN '## Second *' || c_name || '*' || chr(10) || chr(10) || '# late' || chr(10) || chr(10) || '5 May' || chr(10) || chr(10) || 'In ' || c_mktsegment
  WHEN 1 THEN '# ' || c_name || chr(10) || chr(10) || '#### 1.2.' || c_custkey || chr(10) || chr(10) || '* ' || c_mktsegment || chr(10) || '* two'
  WHEN 2 THEN CASE WHEN {_DIV_B} THEN 'day' || CASE WHEN c_custkey % 30 > 0 THEN chr(10) || chr(10) || repeat('y', CAST(c_custkey % 30 AS INT)) ELSE '' END
    ELSE 'no' || repeat('x', CAST(c_custkey % 40 AS INT)) END
  WHEN 3 THEN 'Only ' || c_name
  ELSE '## ' || c_name END"""


@query("article_titles", f"SELECT c_custkey AS page_id, {_A_TITLE} AS title FROM customer")
def article_titles(spark, sf_dir):
    return _articles(spark, sf_dir).select("page_id", F.coalesce(expr(P.article_title()), F.col("url")).alias("title"))


@query("page_dates", f"SELECT c_custkey AS page_id, {_A_DATE} AS date FROM customer")
def page_dates(spark, sf_dir):
    return _articles(spark, sf_dir).select("page_id", expr(P.page_date()).alias("date"))


@query(
    "largest_div",
    f"""
    SELECT c_custkey AS page_id, CASE WHEN c_custkey % 5 = 1 THEN '' WHEN c_custkey % 5 = 4 THEN ''
        WHEN {_DIV_B} THEN 'b' ELSE 'a' END AS classes,
      CASE WHEN c_custkey % 5 = 1 THEN 1 WHEN c_custkey % 5 = 4 THEN length(c_name)
        ELSE greatest(2 + c_custkey % 40, 3 + c_custkey % 30) END AS text_len
    FROM customer WHERE c_custkey % 5 IN (1, 2, 4)""",
)
def largest_div(spark, sf_dir):
    best = _articles(spark, sf_dir).select("page_id", expr(P.largest_div()).alias("d")).where(F.col("d").isNotNull())
    return best.select(
        "page_id",
        F.coalesce("d.classes", F.lit("")).alias("classes"),
        F.col("d.text_len").cast("long").alias("text_len"),
    )


_DATED = f"CASE WHEN {_A_DATE} <> '' THEN 'Date: ' || {_A_DATE} || chr(10) || chr(10) ELSE '' END || {_A_BODY}"


@query(
    "article_items",
    f"SELECT c_custkey AS page_id, {item_sql(_A_TITLE, _DATED, 'blog', _A_URL)} FROM customer",
)
def article_items(spark, sf_dir):
    content = expr(article_markdown("date"))
    return _articles(spark, sf_dir).withColumn("date", expr(P.page_date())).select(
        "page_id",
        *item_columns(F.coalesce(expr(P.article_title()), F.col("url")), content, "blog", F.col("url")),
    )


# Quill containers: without a heading, without a content part, and nested.
QUILL_HTML = """concat('<body><div class="x Quill-Post">', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('<h3> ', c_name, ' </h3>') END,
  CASE WHEN c_custkey % 4 = 0 THEN '<p>bare</p>' ELSE concat('<div class="post-Content"><p>', c_mktsegment, '</p></div><p>rest</p>') END,
  '</div><div class="quill"><p>second</p></div><div class="other"><h1>no</h1></div></body>')"""
_Q_HEAD = "CASE WHEN c_custkey % 3 = 0 THEN 'Untitled' ELSE c_name END"
_Q_BODY = (
    "CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'bare' ELSE '### ' || c_name || chr(10) || chr(10) || 'bare' END"
    " ELSE c_mktsegment END"
)


@query(
    "quill_posts",
    f"""
    SELECT c_custkey AS page_id, CAST(0 AS BIGINT) AS item_seq, {item_sql(_Q_HEAD, _Q_BODY, 'blog', _A_URL)} FROM customer
    UNION ALL SELECT c_custkey, 1, {item_sql("'Untitled'", "'second'", 'blog', _A_URL)} FROM customer""",
)
def quill_posts(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"),
        F.concat(F.lit("https://a.example.com/"), "c_custkey").alias("url"),
        expr(QUILL_HTML).alias("html"),
    )
    posts = page_nodes(pages, "page_id", "url").select(
        "page_id", "url", F.posexplode(expr(P.quill_posts())).alias("item_seq", "post")
    )
    return posts.select(
        "page_id",
        F.col("item_seq").cast("long").alias("item_seq"),
        *item_columns(F.col("post.title"), expr(markdown("post.body")), "blog", F.col("url")),
    )


POST_HTML = """concat(CASE WHEN c_custkey % 4 = 1 THEN '' ELSE concat('<head><title> ', c_name, ' </title></head>') END,
  CASE WHEN c_custkey % 3 = 0 THEN '<div class="break-words-not"><p>none</p></div>' ELSE concat('<div><div class="a break-words"><p>Post on <em>',
  c_mktsegment, '</em></p></div><div class="break-words">later</div></div>') END)"""
_P_BODY = "'Post on *' || c_mktsegment || '*'"


def _posts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"),
        F.concat(F.lit("linkedin.com/posts/"), "c_custkey").alias("url"),
        expr(POST_HTML).alias("html"),
    )


@query("linkedin_posts", f"SELECT c_custkey AS page_id, {_P_BODY} AS post FROM customer WHERE c_custkey % 3 <> 0")
def linkedin_posts(spark, sf_dir):
    posts = page_nodes(_posts(spark, sf_dir), "page_id")
    return posts.selectExpr("page_id", f"{present(markdown(P.break_words_post()))} AS post")
