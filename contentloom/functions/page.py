"""What a page shows about itself: title, date, body, posts and links.

Expressions over the columns ``nodes`` and ``elements`` and, for links, ``url`` and ``anchors``.
"""

from contentloom.functions.elements import (
    class_holds, first, has_class, has_tag, packed_text, plain_text, select, subtree,
)
from contentloom.functions.sql import any_of, bind, q
from contentloom.functions.text import strip
from contentloom.functions.urls import is_article_url, resolve_link

# Labels of links to a full article.
READ_MORE = ("Read more", "Read More", "Continue reading", "Read article", "View post")
# Parts of addresses that such links lead to.
READ_MORE_PATHS = ("/blog/", "/post/", "/article/", "/news/")
# Classes that a post container carries, all of one entry.
POST_CLASSES = (("bg-white", "p-[30px]"), ("blog-post",), ("post",), ("article",))
UNTITLED = "Untitled"


def page_title() -> str:
    """First of each kind of heading in turn; only texts over 5 characters count."""
    tests = (
        has_tag("h1"), has_tag("title"),
        class_holds("title"), class_holds("heading"),
        has_tag("h2"), has_tag("h3"),
    )
    texts = [
        bind(packed_text(subtree(first(test))), "t", "CASE WHEN length(t) > 5 THEN t END") for test in tests
    ]
    return f"coalesce({', '.join(texts)}, {q(UNTITLED)})"


def article_title() -> str:
    """First h1 or h2; NULL only if there is none."""
    return packed_text(subtree(first(has_tag("h1", "h2"))))


def h1_text() -> str:
    return packed_text(subtree(first(has_tag("h1"))))


def document_title() -> str:
    """Stripped text of the title element; NULL if there is none."""
    return strip(plain_text(subtree(first(has_tag("title")))))


def title_readable() -> str:
    """False where the title element holds anything but one piece of text: it names nothing then."""
    title = subtree(first(has_tag("title")))
    return bind(title, "t", "coalesce(size(t) = 3 AND t[1].tag = '#text', true)")


def page_date() -> str:
    """Text of the date element, empty if there is none. Never parsed."""
    label = f"{has_tag('h4', 'span')} AND {class_holds('text-slate-500', 'text-sm')}"
    element = f"coalesce({first(has_tag('time'))}, {first(label)})"
    return f"coalesce({packed_text(subtree(element))}, '')"


def largest_div() -> str:
    """The div with the longest unstripped text; the first one on a tie."""
    sizes = f"transform({select(has_tag('div'))}, e -> struct(e.text_len AS n, -e.pos AS at))"
    return f"try_element_at(nodes, 1 - array_max({sizes}).at)"


def article_body() -> str:
    """Events of main, else article, else the largest div, else the whole page."""
    body = f"coalesce({first(has_tag('main'))}, {first(has_tag('article'))}, {largest_div()})"
    return f"coalesce({subtree(body)}, nodes)"


def post_containers() -> str:
    return select(f"e.tag = 'div' AND ({' OR '.join(f'({has_class(*k)})' for k in POST_CLASSES)})")


def anchors() -> str:
    """Resolved addresses of all links of a page, in order."""
    return f"transform({select("e.tag = 'a' AND e.href IS NOT NULL")}, a -> {resolve_link('url', 'a.href')})"


def article_links() -> str:
    """All article links of a page as a set, in the order first met. Reads ``anchors``."""
    return f"array_distinct(filter(anchors, u -> {is_article_url('u')}))"


def hub_links() -> str:
    """One link per post container: its first anchor, if that is not empty. A list."""
    firsts = f"transform({post_containers()}, d -> try_element_at(nodes, d.first_link + 1).href)"
    return f"transform(filter({firsts}, h -> h <> ''), h -> {resolve_link('url', 'h')})"


def read_more_links() -> str:
    """Links around a "read more" label and all article links of a rendered page, as a set.

    The label must stand in the first piece of text directly within its element, and the
    link must be an ancestor of that element. Links of a rendered page do not nest.
    """
    labels = select(
        f"e.tag = '#text' AND e.ord = 1 AND e.parent IS NOT NULL AND {any_of('e.text', READ_MORE)}",
        "nodes",
    )
    around = f"transform({labels}, t -> try_element_at(nodes, try_element_at(nodes, t.parent + 1).link + 1).href)"
    found = f"transform(filter({around}, h -> {any_of('h', READ_MORE_PATHS)}), h -> {resolve_link('url', 'h')})"
    return f"array_distinct(concat({found}, {article_links()}))"


def break_words_post() -> str:
    """Events of the first div with class token break-words, or NULL."""
    return subtree(first(f"e.tag = 'div' AND {has_class('break-words')}"))


def quill_posts() -> str:
    """``ARRAY<STRUCT<title, body>>``: one entry per quill container, body as events."""

    def inner(field: str) -> str:
        return f"try_element_at(nodes, c.{field} + 1)"

    containers = select("e.tag = 'div' AND contains(lower(coalesce(e.classes, '')), 'quill')")
    title = f"coalesce({packed_text(subtree(inner('first_head')))}, {q(UNTITLED)})"
    body = subtree(f"coalesce({inner('first_content')}, c)")
    return f"transform({containers}, c -> struct({title} AS title, {body} AS body))"
