"""Registration, table access and SQL shared by the query modules."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expr(sql: str) -> Column:
    """An expression written once for both engines."""
    return F.expr(sql)


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- SQL of the second engine -------------------------------------------------------------

WS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(28) || chr(29) || chr(30) || chr(31)"


def md_lines_sql(text: str) -> str:
    """Text to Markdown, for ASCII headings."""
    line = r"""CASE
        WHEN regexp_matches(x, '^(?i)chapter\s+\d+') THEN
          '# Chapter ' || regexp_extract(x, '^(?i)chapter\s+(\d+)', 1) ||
          CASE WHEN trim(regexp_extract(x, '^(?i)chapter\s+\d+(.*)$', 1)) <> ''
               THEN ': ' || trim(regexp_extract(x, '^(?i)chapter\s+\d+(.*)$', 1)) ELSE '' END
        WHEN regexp_matches(x, '^\d+\.\s+') THEN x
        WHEN regexp_matches(x, '^[A-Z][A-Z\s]+$') AND length(x) > 3 THEN
          '## ' || array_to_string(list_transform(string_split(lower(x), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')
        WHEN ends_with(x, ':') AND length(x) < 100 THEN '### ' || x
        ELSE x END"""
    return (
        f"coalesce(array_to_string(list_transform(list_filter(list_transform(string_split({text}, chr(10)),"
        f" lambda t: trim(t, {WS_SQL})), lambda t: t <> ''), lambda x: {line}), chr(10) || chr(10)), '')"
    )


def decode_sql(text: str) -> str:
    pairs = (
        ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"),
        ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'"),
    )
    for name, char in pairs:
        text = f"replace({text}, '{name}', {char})"
    return text


def escape_sql(text: str) -> str:
    return rf"replace(replace({text}, '*', '\*'), '_', '\_')"


# The table's pages have one title, one h1, one article, and bold text that is never closed.
CLEAN_HTML = r"regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
# A few titles are cut within an entity; HTML reads one without its semicolon all the same.
HTML_SQL = "replace(html, '&amp<', '&amp;<')"
H1_SQL = "trim(" + decode_sql(f"regexp_extract({HTML_SQL}, '(?s)<h1>(.*?)</h1>', 1)") + ")"
DOC_TITLE_SQL = "trim(" + decode_sql(f"regexp_extract({HTML_SQL}, '(?s)<title>(.*?)</title>', 1)") + ")"
PAGE_TITLE_SQL = (
    f"CASE WHEN length({H1_SQL}) > 5 THEN {H1_SQL} WHEN length({DOC_TITLE_SQL}) > 5 THEN {DOC_TITLE_SQL} ELSE 'Untitled' END"
)
ARTICLE_SQL = f"regexp_extract({HTML_SQL}, '(?s)<article>(.*?)</article>', 1)"
_LINES = (
    rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({ARTICLE_SQL}, '</?(p|h1)>', chr(10), 'g'),"
    r" '<[^>]*>', ' ', 'g'), chr(10)), lambda t: trim(regexp_replace(" + decode_sql("t") + r", '\s+', ' ', 'g'))), lambda t: t <> '')"
)
MAIN_SQL = f"nullif(array_to_string({_LINES}, chr(10)), '')"
# A second Markdown pass over plain text only escapes.
MAIN_MD_SQL = escape_sql(MAIN_SQL)

# Markdown of markup made of h1, p, br and unclosed b only: a break ends a block or shows nothing.
def body_md_sql(inner: str) -> str:
    text = f"regexp_replace({inner}, '(<br>)?</?p>|<br>$', chr(10) || chr(10), 'g')"
    text = f"replace(replace({text}, '<h1>', '# '), '</h1>', chr(10) || chr(10))"
    text = escape_sql(f"replace({text}, '<b>', chr(1))")
    text = decode_sql(text)
    text = f"regexp_replace({text}, ' *\\n *', chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, ' +', ' ', 'g'), '(\\x01)\\n+', chr(10) || chr(10) || chr(1), 'g')"
    text = f"trim(regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
    return f"replace({text}, chr(1), '**') || repeat('**', len(string_split({inner}, '<b>')) - 1)"


ARTICLE_MD_SQL = body_md_sql(ARTICLE_SQL)


# Fixed values, written down apart from the code they check.
SKIPPED_SQL = """'/category/', '/tag/', '/author/', '/page/', '/search', '/about', '/contact', '/privacy', '/terms', '/login',
  '/register', '/subscribe', '/newsletter', '/feed', '/sitemap', '/robots.txt', '/favicon', '/ads', 'javascript:', 'mailto:',
  'tel:', '#'"""
TAKEN_SQL = """'/blog/', '/post/', '/article/', '/news/', '/story/', '/202', '/2023/', '/2024/', '/2025/', '.html', '.php', '.asp'"""


def article_url_sql(url: str) -> str:
    def any_of(parts):
        return f"len(list_filter([{parts}], lambda p: contains(lower({url}), p))) > 0"

    path = rf"regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
    parts = f"string_split(trim({path}, '/'), '/')"
    return f"""CASE WHEN coalesce({url}, '') = '' THEN false
      WHEN {any_of(SKIPPED_SQL)} THEN false
      WHEN {any_of(TAKEN_SQL)} THEN true
      ELSE len({parts}) >= 2 AND length({parts}[-1]) > 3 AND length({parts}[-2]) > 3 END"""
