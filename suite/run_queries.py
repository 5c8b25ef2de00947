"""A whole run: one manifest with sources of all routes, teams, forced types and limits."""

from pyspark.sql import functions as F

from contentloom.functions import text as T
from contentloom.functions.urls import url_key
from contentloom.plans.run import Store, run_all
from contentloom.schemas import ITEM_FIELDS, SOURCE
from contentloom.sources.pages import scan_pages
from suite.base import DOC_TITLE_SQL, MAIN_MD_SQL, expr, md_lines_sql, query, table
from suite.crawl_queries import DISCOVERED_SQL, FIRST_PAGE_SQL, LINKEDIN_URL, PAGE_ITEMS_SQL, SUBSTACK_URL
from suite.page_queries import POST_HTML, _P_BODY
from suite.text_queries import (
    BOOK_SQL, LINE, LINKS_SQL, PAGE_TEXT, THREAD_BODY, TRANSCRIPT_SQL, _AUTHOR, _TITLE, _conversations, _listings, item_sql,
)

# Routes by the last digit (of eight) of a source's id: 0 website, 1 substack, 2 linkedin, 3 reddit,
# 4 transcript, 5 generic, 6 pdf, 7 drive. The rest of it is the row that the source is made of.
FORCED = "CASE WHEN floor(source_id / 8) % 4 = 0 THEN 'forced' ELSE NULL END"
LIMIT = "CASE floor(source_id / 8) % 5 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 100 WHEN 4 THEN -2 ELSE NULL END"
TEAM = "concat('team', cast(cast(floor(source_id / 8) AS bigint) % 3 AS string))"


def _id(row: str, route: int) -> str:
    return f"cast({row} * 8 + {route} AS bigint)"


REDDIT_URL = "concat('reddit.com/r/', cast(c_custkey AS string))"
CALL_PATH = "concat('/calls/conv_', cast(conv_id AS string), '.txt')"
NOTE_PATH = "concat('/notes/doc_', cast(doc_id AS string), '.md')"
BOOK_PATH = "concat('shelf/conv_', cast(conv_id AS string), '.pdf')"
FOLDER_URL = "concat('https://drive.google.com/drive/folders/l', cast(listing AS string))"
# What is not there: threads, calls and books that were not stored, notes that are no files.
NO_THREAD, NO_CALL, NO_NOTE, NO_BOOK = "c_custkey % 17 = 5", "conv_id % 10 = 9", "doc_id % 10 = 9", "conv_id % 10 = 8"


def _manifest(spark, sf_dir, listings):
    def sources(rows, row, route, source, is_file="false"):
        return rows.select(
            expr(_id(row, route)).alias("source_id"), expr(source).alias("source"), expr(is_file).alias("is_file")
        )

    pages, customers = table(spark, sf_dir, "pages"), table(spark, sf_dir, "customer")
    talks = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    documents = table(spark, sf_dir, "documents").select("doc_id")
    whole = (
        sources(pages, "page_id", 0, "url")
        .unionByName(sources(pages, "page_id", 1, SUBSTACK_URL))
        .unionByName(sources(customers, "c_custkey", 2, LINKEDIN_URL))
        .unionByName(sources(customers, "c_custkey", 3, REDDIT_URL))
        .unionByName(sources(talks, "conv_id", 4, CALL_PATH, "true"))
        .unionByName(sources(documents, "doc_id", 5, NOTE_PATH, f"NOT ({NO_NOTE})"))
        .unionByName(sources(talks, "conv_id", 6, BOOK_PATH, "true"))
        .unionByName(sources(listings, "listing", 7, FOLDER_URL))
    )
    settings = whole.select(
        "*", expr(TEAM).alias("team_id"), expr(FORCED).alias("force_content_type"), expr(LIMIT).cast("int").alias("max_items")
    )
    return settings.select(*SOURCE.names)


def _store(spark, sf_dir, listings):
    pages, customers = table(spark, sf_dir, "pages"), table(spark, sf_dir, "customer")

    def crawled(rows, row, billion, url, html):
        return rows.select(
            expr(f"{row} + {billion} * cast(1000000000 AS bigint)").alias("page_id"),
            expr(url).alias("url"),
            expr(url_key(f"({url})")).alias("url_key"),
            expr(html).alias("html"),
        )

    crawl = (
        scan_pages(spark, f"{sf_dir}/pages.parquet")
        .unionByName(crawled(pages, "page_id", 1, SUBSTACK_URL, "html"))
        .unionByName(crawled(customers, "c_custkey", 2, LINKEDIN_URL, POST_HTML))
        .unionByName(crawled(listings, "listing", 3, FOLDER_URL, "html"))
    )
    threads = customers.where(f"NOT ({NO_THREAD})").select(
        expr(f"concat({REDDIT_URL}, '.json')").alias("json_url"), expr(THREAD_BODY).alias("body")
    )
    calls = _conversations(spark, sf_dir, LINE, "\n").where(f"NOT ({NO_CALL})")
    notes = table(spark, sf_dir, "documents").where(f"NOT ({NO_NOTE})")
    files = calls.select(expr(CALL_PATH).alias("path"), "text").unionByName(
        notes.select(expr(NOTE_PATH).alias("path"), expr(T.unix_newlines("text")).alias("text"))
    )
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("page_no"), expr(PAGE_TEXT).alias("text")
    )
    file_id = F.concat(F.lit("id_"), F.lpad(F.col("conv_id").cast("string"), 25, "0"))
    address = F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id).alias("url")
    return Store(
        pages=crawl,
        threads=threads,
        files=files,
        book_pages=turns.where(f"NOT ({NO_BOOK})").select(expr(BOOK_PATH).alias("file"), "page_no", "text"),
        drive_pages=turns.select(address, "page_no", "text"),
    )


def _run(spark, sf_dir):
    listings = _listings(spark, sf_dir)
    return run_all(_manifest(spark, sf_dir, listings), _store(spark, sf_dir, listings))


_FIRST = f"""SELECT listing, url, arg_min(name, pos) AS name, any_value(file_no) AS file_no, min(pos) AS pos
  FROM ({LINKS_SQL}) GROUP BY listing, url"""
_COMMENT = item_sql(
    f"'Reddit comment by ' || {_AUTHOR}", "'I am in **' || lower(c_mktsegment) || '** & more'", "reddit_comment", REDDIT_URL, _AUTHOR,
    "'t2_' || c_custkey",
)
_POST_TITLE = f"CASE WHEN c_custkey % 4 = 1 THEN {LINKEDIN_URL} ELSE c_name END"
FOUND_SQL = f"""
  SELECT source_id * 8 AS source_id, page_seq, item_seq, title, content, content_type, source_url, author, user_id
    FROM ({PAGE_ITEMS_SQL}) WHERE source_id >= 0
  UNION ALL SELECT {_id('page_id', 1)}, 0, 0, {item_sql(DOC_TITLE_SQL, MAIN_MD_SQL, 'blog', SUBSTACK_URL)}
    FROM pages WHERE {MAIN_MD_SQL} IS NOT NULL
  UNION ALL SELECT {_id('c_custkey', 2)}, 0, 0, {item_sql(_POST_TITLE, _P_BODY, 'linkedin_post', LINKEDIN_URL)}
    FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT {_id('c_custkey', 3)}, 0, 0, {_COMMENT}
    FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 13 <> 12 AND NOT ({NO_THREAD})
  UNION ALL SELECT {_id('conv_id', 4)}, 0, 0, {item_sql("'conv_' || conv_id || '.txt'", md_lines_sql('text'), 'call_transcript')}
    FROM ({TRANSCRIPT_SQL}) WHERE NOT ({NO_CALL})
  UNION ALL SELECT {_id('doc_id', 5)}, 0, 0, {item_sql("'doc_' || doc_id || '.md'", md_lines_sql('text'), 'other')}
    FROM documents WHERE NOT ({NO_NOTE})
  UNION ALL SELECT {_id('conv_id', 6)}, 0, 0, {item_sql("'conv_' || conv_id", md_lines_sql('text'), 'book')}
    FROM ({BOOK_SQL}) WHERE NOT ({NO_BOOK})
  UNION ALL SELECT {_id('listing', 7)}, 0, pos, {item_sql(_TITLE, md_lines_sql('text'), 'book', 'url')}
    FROM ({_FIRST}) l JOIN ({BOOK_SQL}) b ON l.file_no = b.conv_id"""
LIMITED_RUN_SQL = f"""
  SELECT * FROM (SELECT *, {LIMIT} AS max_items, row_number() OVER (PARTITION BY source_id ORDER BY page_seq, item_seq) AS rn,
    count(*) OVER (PARTITION BY source_id) AS cnt FROM ({FOUND_SQL}))
  WHERE coalesce(max_items, 0) = 0 OR (max_items > 0 AND rn <= max_items) OR (max_items < 0 AND rn <= cnt + max_items)"""


@query(
    "manifest_run",
    f"""
    SELECT source_id, {TEAM} AS team_id, title, content, coalesce({FORCED}, content_type) AS content_type, source_url, author, user_id
    FROM ({LIMITED_RUN_SQL}) WHERE content <> ''""",
)
def manifest_run(spark, sf_dir):
    return _run(spark, sf_dir).items.select("source_id", "team_id", *ITEM_FIELDS)


@query(
    "run_rejects",
    f"""
    SELECT d.source_id * 8 AS source_id, d.url, 'page' AS stage, 'not fetched' AS reason
      FROM ({DISCOVERED_SQL}) d LEFT JOIN ({FIRST_PAGE_SQL}) k ON split_part(d.url, '#', 1) = k.url_key
      WHERE d.source_id >= 0 AND k.page_id IS NULL
    UNION ALL SELECT d.source_id * 8, d.url, 'page', 'no main text'
      FROM ({DISCOVERED_SQL}) d JOIN ({FIRST_PAGE_SQL}) k ON split_part(d.url, '#', 1) = k.url_key
      JOIN pages p ON p.page_id = k.page_id WHERE d.source_id >= 0 AND {MAIN_MD_SQL} IS NULL
    UNION ALL SELECT {_id('page_id', 1)}, {SUBSTACK_URL}, 'page', 'no main text' FROM pages WHERE {MAIN_MD_SQL} IS NULL
    UNION ALL SELECT {_id('c_custkey', 2)}, {LINKEDIN_URL}, 'page', 'no post' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT {_id('c_custkey', 3)}, {REDDIT_URL}, 'thread', CASE WHEN {NO_THREAD} THEN 'not stored' ELSE 'no comment' END
      FROM customer WHERE {NO_THREAD} OR c_custkey % 7 = 0 OR c_custkey % 13 = 12
    UNION ALL SELECT DISTINCT {_id('conv_id', 4)}, {CALL_PATH}, 'file', 'not stored' FROM conversations WHERE {NO_CALL}
    UNION ALL SELECT {_id('doc_id', 5)}, {NOTE_PATH}, 'file', 'not a file' FROM documents WHERE {NO_NOTE}
    UNION ALL SELECT DISTINCT {_id('conv_id', 6)}, {BOOK_PATH}, 'file', 'not stored' FROM conversations WHERE {NO_BOOK}
    UNION ALL SELECT {_id('listing', 7)}, url, 'download', 'not stored'
      FROM ({_FIRST}) WHERE file_no NOT IN (SELECT conv_id FROM conversations)""",
)
def run_rejects(spark, sf_dir):
    return _run(spark, sf_dir).rejects


@query(
    "manifest_summary",
    f"""
    WITH f AS (SELECT source_id, count(*) AS found FROM ({FOUND_SQL}) GROUP BY source_id),
    k AS (SELECT source_id, count(*) AS limited, count(*) FILTER (content <> '') AS written,
      count(*) FILTER (content = '') AS skipped,
      arg_min(coalesce({FORCED}, content_type), rn) FILTER (content <> '') AS content_type
      FROM ({LIMITED_RUN_SQL}) GROUP BY source_id)
    SELECT source_id, found, coalesce(limited, 0) AS limited, coalesce(written, 0) AS written,
      coalesce(skipped, 0) AS skipped, content_type FROM f LEFT JOIN k USING (source_id)""",
)
def manifest_summary(spark, sf_dir):
    return _run(spark, sf_dir).summary()
