from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from contentloom.functions import urls
from contentloom.operators.routing import Routes, infer_content_type

ARTICLE = [
    ("https://x.io/blog", False),
    ("https://x.io/blog/category/dsa", False),
    ("https://x.io/topics#companies", False),
    ("https://x.io/a/b.html", True),
    ("https://ads.x.io/blog/y", False),
    ("https://x.io/learn/guides", True),
    ("https://x.io/learn/abc", False),
    ("https://x.io/learn/guide;v=1/", True),
    ("https://x.io/learn/gui;verylong", False),
    ("https://x.io/learn//guides", False),
    ("https://x.io/BLOG/y", True),
    ("https://x.io/a?next=/blog/", True),
    ("learn/guides", True),
    ("", False),
    (None, False),
]


def test_article_urls(evaluate):
    got = evaluate(urls.is_article_url("u"), [u for u, _ in ARTICLE], "u string")
    assert got == [want for _, want in ARTICLE]


def test_host_and_path_match_the_standard_library(evaluate):
    given_urls = [
        "https://User@Host.example.com:80/a/b;c?d#e", "//cdn.example.com/x", "plain/path", "http://h", "mailto:a@b",
        "http:x/y", "http://h?q=/a/b", "https://h/a;b/c;d",
    ]
    assert evaluate(urls.url_host("u"), given_urls, "u string") == [urlparse(u).netloc.lower() for u in given_urls]
    assert evaluate(urls.url_path("u"), given_urls, "u string") == [urlparse(u).path for u in given_urls]


def test_reddit_json_url(evaluate):
    got = evaluate(urls.reddit_json_url("u"), ["r/a/", "r/a.json", "r/a?x=1", "r/a", "r/a//"], "u string")
    assert got == ["r/a.json", "r/a.json", "r/a?x=1.json", "r/a.json", "r/a/.json"]


BASES = ["http://a.example/b/c/d;p?q", "https://h.example", "http://h.example/", "https://h.example/x/y/#f", "http://h/a//b/c"]
LINKS = [
    "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g",
    "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h",
    "g/../h", "http:g", "http://other/x/../y", "HTTPS://Other.example/A", "mailto:a@b", "javascript:x", "a//b", "/a//b/",
    " /spaced", "a\nb", "g?", "g#", "?", "tel:1", "a/b/../../../c", "//host", "/a/..", "x:y",
]
# The library lets parameters alone count as no path; such a link is not met on pages.
SKIPPED = {";x"}


def test_links_resolve_as_in_the_standard_library(evaluate):
    pairs = [(b, link) for b in BASES for link in LINKS if link not in SKIPPED]
    got = evaluate(urls.resolve_link("b", "l"), pairs, "b string, l string")
    wrong = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert not wrong


_part = st.sampled_from(["a", "b.html", "..", ".", "x y", "é", "long-slug", "c;d"])
_paths = st.builds(
    lambda lead, parts, tail: lead + "/".join(parts) + tail,
    st.sampled_from(["", "/", "//h.example/"]),
    st.lists(_part, min_size=1, max_size=5),
    st.sampled_from(["", "/", "?q=1", "#f", "?a=/b/../c#d"]),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_paths, min_size=40, max_size=80))
def test_any_links_resolve_as_in_the_standard_library(evaluate, links):
    pairs = [(BASES[i % len(BASES)], link) for i, link in enumerate(links)]
    got = evaluate(urls.resolve_link("b", "l"), pairs, "b string, l string")
    assert got == [urljoin(*p) for p in pairs]


SOURCES = [
    ("https://drive.google.com/drive/folders/x", False, "drive"),
    ("https://www.reddit.com/r/a", False, "website"),
    ("http-notes", False, "website"),
    ("HTTP://X", False, "generic"),
    ("book.PDF", True, "pdf"),
    ("book.pdf", False, "generic"),
    ("reddit.com/x.pdf", True, "pdf"),
    ("reddit.com/r/a", False, "reddit"),
    ("www.substack.com/p", None, "substack"),
    ("linkedin.com/p", None, "linkedin"),
    ("call.TXT", True, "transcript"),
    ("call.txt", None, "generic"),
    ("note.md", True, "generic"),
]


def test_first_route_that_accepts_wins(spark):
    df = spark.createDataFrame([(s, f) for s, f, _ in SOURCES], "source string, is_file boolean")
    got = {r.source: r.route for r in Routes().apply(df).collect()}
    assert got == {s: want for s, _, want in SOURCES}
    first = {r.source: r.route for r in Routes.hosts_first().apply(df).collect()}
    assert first["https://www.reddit.com/r/a"] == "reddit"
    assert first["reddit.com/x.pdf"] == "reddit"
    assert first["https://drive.google.com/drive/folders/x"] == "drive"


def test_registered_route(spark):
    routes = Routes().register("feed", lambda s, f: s.endswith(".rss"), lambda df: df, before="website")
    df = spark.createDataFrame([("http://x/a.rss", False), ("b.rss", False), ("z", False)], "source string, is_file boolean")
    assert [r.route for r in routes.apply(df).collect()] == ["feed", "feed", "generic"]
    with pytest.raises(ValueError):
        routes.register("feed", lambda s, f: F.lit(True), lambda df: df)
    last = Routes().register("late", lambda s, f: F.lit(True), lambda df: df)
    assert [r.route for r in last.apply(df).collect()] == ["website", "late", "late"]


def test_inferred_types(spark):
    cases = [
        ("a.pdf", True, "book"), ("a.PDF", True, "book"), ("a.pdf.gz", True, "book"), ("dir/a.ksh", True, "call_transcript"),
        ("a.txt", False, "blog"), (".txt", True, "blog"), ("https://old.Reddit.com/x", False, "reddit_comment"),
        ("https://x.io/reddit.com", False, "blog"), ("//www.linkedin.com/p", None, "linkedin_post"),
        ("https://a.substack.com/p", None, "blog"), ("a.md", True, "blog"),
    ]
    df = spark.createDataFrame([(s, f) for s, f, _ in cases], "source string, is_file boolean")
    got = {r.source: r.t for r in df.select("source", infer_content_type("source", "is_file").alias("t")).collect()}
    assert got == {s: want for s, _, want in cases}
