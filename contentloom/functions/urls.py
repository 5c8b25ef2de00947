"""URL rules."""

from contentloom.functions.sql import any_of, bind, group, q, replace_all

# Substrings that rule a URL out, then in, as an article.
SKIP_PARTS = (
    "/category/", "/tag/", "/author/", "/page/", "/search",
    "/about", "/contact", "/privacy", "/terms", "/login",
    "/register", "/subscribe", "/newsletter", "/feed",
    "/sitemap", "/robots.txt", "/favicon", "/ads",
    "javascript:", "mailto:", "tel:", "#",
)
ARTICLE_PARTS = (
    "/blog/", "/post/", "/article/", "/news/", "/story/",
    "/202", "/2023/", "/2024/", "/2025/",
    ".html", ".php", ".asp",
)

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_HOST = rf"^(?:{_SCHEME}:)?//([^/?#]*)"
_PATH = rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*(\?[^#]+)"
_FRAGMENT = r"^[^#]*(#.+)$"
_DOTS = r"(?:^|/)\.\.?(?:/|\z)"


def url_key(url: str) -> str:
    """The URL a request carries: everything but the fragment."""
    return f"substring_index({url}, '#', 1)"


def url_host(url: str) -> str:
    """Lower-cased network location, with port and user info; empty if there is none."""
    return f"lower({group(url, _HOST)})"


def url_path(url: str) -> str:
    """Path without the ``;params`` of its last segment."""
    return replace_all(group(url, _PATH), (";[^/]*$", ""))


def is_article_url(url: str) -> str:
    """Skip list first, then article list, then a slug: two last path parts over 3 characters."""
    low = f"lower({url})"
    slug = f"{replace_all(url_path(url), ('^/+|/+$', ''))} RLIKE {q('(?:^|/)[^/]{4,}/[^/]{4,}$')}"
    return (
        f"CASE WHEN {url} IS NULL OR {url} = '' THEN false WHEN {any_of(low, SKIP_PARTS)} THEN false"
        f" WHEN {any_of(low, ARTICLE_PARTS)} THEN true ELSE {slug} END"
    )


def _fold_dots(path: str) -> str:
    """Drop ``.`` segments and let ``..`` take the segment before it along."""
    kept = (
        f"aggregate(split({path}, '/'), CAST(array() AS ARRAY<STRING>), (acc, x) -> CASE"
        " WHEN x = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0))"
        " WHEN x = '.' THEN acc ELSE concat(acc, array(x)) END)"
    )
    tail = f"CASE WHEN {path} RLIKE {q(r'(?:^|/)[.][.]?$')} THEN array('') ELSE CAST(array() AS ARRAY<STRING>) END"
    return f"CASE WHEN {path} RLIKE {q(_DOTS)} THEN array_join(concat({kept}, {tail}), '/') ELSE {path} END"


def resolve_link(base: str, link: str) -> str:
    """Absolute form of a link found on the page ``base`` (an http or https URL)."""
    ref_path = group("ref", _PATH)
    ref_query = group("ref", _QUERY)
    base_path = group(base, _PATH)
    fragment = group("ref", _FRAGMENT)
    scheme = f"lower({group(base, f'^({_SCHEME}):')})"
    ref_scheme = f"lower({group('ref', f'^({_SCHEME}):')})"
    host = group(base, _HOST)
    merged = replace_all(f"concat({replace_all(base_path, ('[^/]*$', ''))}, {ref_path})", ("/{2,}", "/"))

    def build(at: str, path: str, query: str) -> str:
        rooted = bind(path, "p", "CASE WHEN p = '' OR startswith(p, '/') THEN p ELSE concat('/', p) END")
        return f"concat({scheme}, '://', {at}, {rooted}, {query}, {fragment})"

    folded = bind(
        f"CASE WHEN startswith({ref_path}, '/') THEN {ref_path} ELSE {merged} END",
        "m",
        f"coalesce(nullif({_fold_dots('m')}, ''), '/')",
    )
    same_page = build(host, base_path, f"coalesce(nullif({ref_query}, ''), {group(base, _QUERY)})")
    has_host = q(rf"^(?:{_SCHEME}:)?//[^/?#]")
    chosen = (
        f"CASE WHEN {base} IS NULL OR {base} = '' THEN {link} WHEN {link} = '' THEN {base}"
        f" WHEN {ref_scheme} NOT IN ('', {scheme}) THEN {link}"
        f" WHEN ref RLIKE {has_host} THEN {build(group('ref', _HOST), ref_path, ref_query)}"
        f" WHEN {ref_path} = '' THEN {same_page}"
        f" ELSE {build(host, folded, ref_query)} END"
    )
    return bind(replace_all(link, (r"^[\x00-\x20]+", ""), (r"[\t\r\n]", "")), "ref", chosen)


def reddit_json_url(url: str) -> str:
    """Address of the JSON form of a thread. A query string is left where it stands."""
    cut = replace_all(url, (r"/\z", ""))
    return f"CASE WHEN endswith({url}, '.json') THEN {url} ELSE concat({cut}, '.json') END"


def drive_download_url(file_id: str) -> str:
    return f"concat('https://drive.google.com/uc?export=download&id=', {file_id})"


def base_name(path: str) -> str:
    return f"substring_index({path}, '/', -1)"
