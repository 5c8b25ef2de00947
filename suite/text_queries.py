"""Text, file, book, thread and Drive queries."""

from pyspark.sql import functions as F

from contentloom.functions import text as T
from contentloom.schemas import ITEM_FIELDS
from contentloom.session import stage
from contentloom.sources import drive as D
from contentloom.sources import files as S
from contentloom.sources.pages import page_nodes
from contentloom.sources.reddit import comment_items
from suite.base import decode_sql, expr, md_lines_sql, query, table

# One line per turn: chapter, capitals, colon, number and plain lines.
LINE = (
    "concat(CASE turn % 5 WHEN 0 THEN concat('CHAPTER ', cast(turn + 1 AS string), ' ', role)"
    " WHEN 1 THEN concat('  ', upper(role), ' NOTES  ') WHEN 2 THEN concat(role, ':')"
    " WHEN 3 THEN concat(cast(turn AS string), '. ', role) ELSE '' END, chr(10), text, chr(10))"
)
TRANSCRIPT_SQL = f"SELECT conv_id, string_agg({LINE}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


def _conversations(spark, sf_dir, text, sep):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", expr(text).alias("text"))
    return S.join_texts(rows, ["conv_id"], "turn", "text", sep)


def item_sql(title, content, content_type, source_url="CAST(NULL AS VARCHAR)", author="''", user_id="''"):
    return (
        f"{title} AS title, {content} AS content, '{content_type}' AS content_type, {source_url} AS source_url,"
        f" {author} AS author, {user_id} AS user_id"
    )


@query(
    "text_markdown",
    f"""
    WITH c AS ({TRANSCRIPT_SQL}), t AS (
      SELECT 'document' AS kind, doc_id AS id, text FROM documents
      UNION ALL SELECT 'conversation', conv_id, text FROM c)
    SELECT kind, id, {md_lines_sql('text')} AS markdown FROM t""",
)
def text_markdown(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    talks = _conversations(spark, sf_dir, LINE, "\n").select(
        F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "text"
    )
    return documents.unionByName(talks).select("kind", "id", expr(T.text_to_markdown("text")).alias("markdown"))


@query(
    "transcript_items",
    f"""
    WITH c AS ({TRANSCRIPT_SQL})
    SELECT conv_id, {item_sql("'conv_' || conv_id || '.txt'", md_lines_sql('text'), 'call_transcript')} FROM c""",
)
def transcript_items(spark, sf_dir):
    files = _conversations(spark, sf_dir, LINE, "\n").select(
        "conv_id", F.concat(F.lit("/calls/conv_"), "conv_id", F.lit(".txt")).alias("path"), "text"
    )
    return S.transcript_items(files).select("conv_id", *ITEM_FIELDS)


@query(
    "generic_items",
    f"""
    SELECT doc_id, {item_sql("'doc_' || doc_id || '.md'", md_lines_sql('text'), 'other')} FROM documents""",
)
def generic_items(spark, sf_dir):
    # Line ends as another system would have written them.
    raw = "replace(text, '\\n', '\\r\\n')"
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/notes/doc_"), "doc_id", F.lit(".md")).alias("path"),
        expr(T.unix_newlines(raw)).alias("text"),
    )
    return S.generic_items(files).select("doc_id", *ITEM_FIELDS)


# Page texts of books: one conversation is one file, one turn is one page, every fourth is empty.
PAGE_TEXT = "CASE WHEN turn % 4 = 3 THEN NULL ELSE text END"
BOOK_SQL = (
    f"SELECT conv_id, string_agg(coalesce({PAGE_TEXT}, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
)


@query(
    "book_items",
    f"""
    WITH b AS ({BOOK_SQL})
    SELECT 'shelf/conv_' || conv_id || '.pdf' AS file,
      {item_sql("'conv_' || conv_id", md_lines_sql('text'), 'book')} FROM b""",
)
def book_items(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("shelf/conv_"), "conv_id", F.lit(".pdf")).alias("file"),
        F.col("turn").alias("page_no"),
        expr(PAGE_TEXT).alias("text"),
    )
    return S.book_items(pages).select("file", *ITEM_FIELDS)


CHAPTER = "concat(CASE WHEN conv_id % 9 = 8 THEN 'Part ' ELSE 'Chapter ' END, cast(turn + 1 AS string), ' ', role, chr(10), text)"


@query(
    "chapters",
    f"""
    WITH whole AS (SELECT conv_id, string_agg({CHAPTER}, chr(10) ORDER BY turn) AS body FROM conversations
      WHERE conv_id % 9 = 8 GROUP BY conv_id)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
      'Chapter ' || (turn + 1) || ' ' || role AS title, trim(text, chr(32) || chr(10)) AS content
    FROM conversations WHERE conv_id % 9 <> 8 AND trim(text, chr(32) || chr(10)) <> ''
    UNION ALL SELECT conv_id, 0, 'Document', trim(body, chr(32) || chr(10)) FROM whole""",
)
def chapters(spark, sf_dir):
    books = _conversations(spark, sf_dir, CHAPTER, "\n")
    return books.select("conv_id", F.posexplode(expr(T.chapters("text"))).alias("pos", "c")).select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "c.title", "c.content"
    )


@query("decode_entities", f"SELECT page_id, {decode_sql('html')} AS text FROM pages")
def decode_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", expr(T.decode_entities("html")).alias("text"))


# Threads: every seventh has no comment, every eleventh no author, every thirteenth is not JSON.
THREAD_BODY = (
    "CASE WHEN c_custkey % 13 = 12 THEN '[{\"kind\"' WHEN c_custkey % 7 = 0 THEN"
    " '[{\"kind\":\"post\"},{\"data\":{\"children\":[]}}]' ELSE"
    " concat('[{\"kind\":\"post\"},{\"data\":{\"children\":[{\"data\":{',"
    " CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('\"author\":\"', c_name, '\",') END,"
    " '\"author_fullname\":\"t2_', cast(c_custkey AS string), '\",\"body_html\":\"&lt;div&gt;&lt;p&gt;I am in &lt;b&gt;',"
    " lower(c_mktsegment), '&lt;/b&gt; &amp;amp; more&lt;/p&gt;&lt;/div&gt;\"}},{\"data\":{\"author\":\"second\"}}]}}]') END"
)
_AUTHOR = "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END"
_REDDIT = item_sql(
    f"'Reddit comment by ' || {_AUTHOR}",
    "'I am in **' || lower(c_mktsegment) || '** & more'",
    "reddit_comment",
    "'r/' || c_custkey",
    _AUTHOR,
    "'t2_' || c_custkey",
)


@query(
    "reddit_items",
    f"SELECT c_custkey, {_REDDIT} FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 13 <> 12",
)
def reddit_items(spark, sf_dir):
    threads = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("r/"), "c_custkey").alias("source"), expr(THREAD_BODY).alias("body")
    )
    return comment_items(threads).select("c_custkey", *ITEM_FIELDS)


# Drive listings of up to 64 parts; a file id comes up twice in a listing, under two names.
LISTING = "cast(floor(p_partkey / 64) AS bigint)"
FILE_NO = f"{LISTING} * 48 + p_partkey % 48"
FILE_ID = f"concat('id_', lpad(cast({FILE_NO} AS string), 25, '0'))"
FILE_NAME = "replace(concat(p_name, ' ', cast(p_partkey AS string), '.pdf'), ' ', '_')"
SCRIPT_ROW = (
    f"concat('[\"', {FILE_ID}, '\" , [\"', p_brand, '\"], \"', {FILE_NAME}, '\",\"',"
    " CASE WHEN p_partkey % 10 = 9 THEN 'text/plain' ELSE 'application/pdf' END, '\"]')"
)
_URL = "'https://drive.google.com/uc?export=download&id='"


@query(
    "drive_script_links",
    f"SELECT p_partkey, {FILE_ID} AS file_id, {FILE_NAME} AS name FROM part WHERE p_partkey % 10 <> 9",
)
def drive_script_links(spark, sf_dir):
    scripts = table(spark, sf_dir, "part").select("p_partkey", expr(SCRIPT_ROW).alias("script"))
    return scripts.select("p_partkey", F.inline(expr(D.script_links("script")))).select("p_partkey", "file_id", "name")


# A third of the anchors has no text but .pdf in its address, a third is no PDF at all.
ANCHOR = (
    f"concat('<a href=\"/file/d/', {FILE_ID}, CASE p_partkey % 3 WHEN 1 THEN '/view?n=x.pdf\"> ' ELSE '/view\">' END,"
    f" CASE p_partkey % 3 WHEN 0 THEN concat(' <b>', p_brand, '</b> &amp; ', {FILE_NAME}) WHEN 1 THEN '' ELSE 'other' END, '</a>')"
)
_ANCHOR_NAME = f"CASE p_partkey % 3 WHEN 0 THEN p_brand || ' & ' || {FILE_NAME} ELSE {FILE_ID} || '.pdf' END"


@query(
    "drive_anchor_links",
    f"SELECT p_partkey, {FILE_ID} AS file_id, {_ANCHOR_NAME} AS name FROM part WHERE p_partkey % 3 < 2",
)
def drive_anchor_links(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select("p_partkey", expr(ANCHOR).alias("html"))
    return page_nodes(pages, "p_partkey").select("p_partkey", F.inline(expr(D.anchor_links())))


def _listings(spark, sf_dir):
    """Whole listing pages: one script with all rows, then the anchors."""
    parts = table(spark, sf_dir, "part").select(
        expr(LISTING).alias("listing"), "p_partkey", expr(SCRIPT_ROW).alias("row"), expr(ANCHOR).alias("anchor")
    )
    rows = S.join_texts(parts, ["listing"], "p_partkey", "row", ",")
    anchors = S.join_texts(parts, ["listing"], "p_partkey", "anchor")
    html = F.concat(F.lit("<html><script>var f=["), "row", F.lit("];</script><body>"), "anchor", F.lit("</body></html>"))
    return rows.join(anchors, "listing").select("listing", html.alias("html"))


LINKS_SQL = f"""
  SELECT {LISTING} AS listing, p_partkey AS pos, {_URL} || {FILE_ID} AS url, {FILE_NAME} AS name, {FILE_NO} AS file_no
  FROM part WHERE p_partkey % 10 <> 9
  UNION ALL SELECT {LISTING}, 1000000000000 + p_partkey, {_URL} || {FILE_ID}, {_ANCHOR_NAME}, {FILE_NO}
  FROM part WHERE p_partkey % 3 < 2"""
FIRST_SQL = f"""SELECT listing, url, arg_min(name, pos) AS name, any_value(file_no) AS file_no
  FROM ({LINKS_SQL}) GROUP BY listing, url"""


def _first_links(spark, sf_dir):
    links = D.listing_links(page_nodes(_listings(spark, sf_dir), "listing"))
    return D.first_names(links, ["listing"])


@query("drive_dedup", f"SELECT listing, url, name FROM ({FIRST_SQL})")
def drive_dedup(spark, sf_dir):
    return _first_links(spark, sf_dir).select("listing", "url", "name")


_TITLE = "'_gdrive_' || replace(replace(name, ' ', '_'), '.pdf', '')"


@query(
    "drive_books",
    f"""
    WITH b AS ({BOOK_SQL}), l AS ({FIRST_SQL})
    SELECT listing, {item_sql(_TITLE, md_lines_sql('text'), 'book', 'url')} FROM l JOIN b ON l.file_no = b.conv_id""",
)
def drive_books(spark, sf_dir):
    file_id = F.concat(F.lit("id_"), F.lpad(F.col("conv_id").cast("string"), 25, "0"))
    texts = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id).alias("url"),
        F.col("turn").alias("page_no"),
        expr(PAGE_TEXT).alias("text"),
    )
    return D.drive_items(stage(_first_links(spark, sf_dir), "links"), texts).select("listing", *ITEM_FIELDS)
