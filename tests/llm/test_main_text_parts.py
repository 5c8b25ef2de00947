"""Main text is whole where class names or article elements say little."""

import math
import random

import pytest

from contentloom.llm import html_text

FIRST = "The first part of the text is long enough to be a paragraph of its own, and says so."
SECOND = "The second part goes on for about as long as the first one did, and then it ends here."
SIDE = "<aside>Side</aside><footer>End</footer>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='layout with-sidebar'><p>{FIRST}</p><p>{SECOND}</p></div>{SIDE}",
        f"<div id='discussion'><p>{FIRST}</p><p>{SECOND}</p></div>{SIDE}",
        f"<main><div class='widget'><p>{FIRST}</p><p>{SECOND}</p></div></main>{SIDE}",
        f"<article><p>{FIRST}</p></article><article><p>{SECOND}</p></article>{SIDE}",
        f"<article><p>{FIRST} </p></article><div class='sidebar'><p>{SECOND * 3}</p></div><article><p>{SECOND}</p></article>{SIDE}",
        f"<main><p>{FIRST}</p><article><p>{SECOND}</p></article></main>{SIDE}",
    ],
)
def test_all_parts_are_kept(body):
    assert html_text.main_text(f"<html><body>{body}</body></html>") == f"{FIRST}\n{SECOND}"


def test_heading_and_lead_before_the_article():
    page = f"<body><main><h1>Title</h1><p>{FIRST}</p><article><p>{SECOND}</p></article><div class=related>Other</div></main>{SIDE}</body>"
    assert html_text.main_text(page) == f"Title\n{FIRST}\n{SECOND}"


WHOLE = f"<article><p>{FIRST}</p>%s<p>{SECOND}</p></article>"
LINKS = "<ul><li><a href=/1>Another page of this site</a></li><li><a href=/2>And one more page</a></li></ul>"


@pytest.mark.parametrize("name", "site-footer page-sidebar main-menu site-nav content-notice content-ad comment-list share-buttons".split())
@pytest.mark.parametrize("page", ["<div class=text>%s</div>", "<main>%s</main>", "<article>%s</article>"])
def test_furniture_with_layout_words(name, page):
    text = f"<p>{FIRST}</p><p>{SECOND}</p>"
    furniture = f"<div class='{name}'><p>Furniture of the site</p></div>"
    for body in (page % text + furniture, page % (text + furniture)):
        assert html_text.main_text(f"<body>{body}{SIDE}</body>") == f"{FIRST}\n{SECOND}"


@pytest.mark.parametrize("name", ["discussion", "related-work", "share-price", "social-science"])
def test_named_parts_of_an_article(name):
    third = "A third part, whose name has a word of the site's furniture in it, is prose like the others."
    page = f"<body>{WHOLE}{SIDE}</body>"
    assert html_text.main_text(page % f"<section class={name}><p>{third}</p></section>") == f"{FIRST}\n{third}\n{SECOND}"
    assert html_text.main_text(page % f"<section class={name}>{LINKS}</section>") == f"{FIRST}\n{SECOND}"


def test_comments_longer_than_the_post():
    comments = "".join(f"<p>Comment {k}: {SECOND}</p>" for k in range(20))
    for post in (f"<article><p>{FIRST}</p><p>{SECOND}</p></article>", f"<div class=post><p>{FIRST}</p><p>{SECOND}</p></div>"):
        for part in (f"<div id=comments>{comments}</div>", f"<section class='comment-thread'>{comments}</section>"):
            assert html_text.main_text(f"<body>{post}{part}{SIDE}</body>") == f"{FIRST}\n{SECOND}"
    assert html_text.main_text(f"<body><div id=comments><p>{FIRST}</p></div>{SIDE}</body>") == FIRST


def test_teasers_beside_the_article():
    card = "<article class=card><h3>Elsewhere</h3><p>Some words about another page of the site.</p></article>"
    link = "<article><h3><a href=/x>Another page</a></h3><p>Some words about it.</p></article>"
    article = WHOLE % ""
    for teaser in (card, link):
        assert html_text.main_text(f"<body>{article}{teaser * 3}{SIDE}</body>") == f"{FIRST}\n{SECOND}"
        assert html_text.main_text(f"<body><main>{article}{teaser * 3}</main>{SIDE}</body>") == f"{FIRST}\n{SECOND}"


def test_heading_in_the_header_of_a_plain_page():
    page = f"<head><title>The title - Site</title></head><body><header><h1>%s</h1><p>Motto</p></header><div><p>{FIRST}</p><p>{SECOND}</p></div>{SIDE}"
    assert html_text.main_text(page % "The title") == f"The title\n{FIRST}\n{SECOND}"
    assert html_text.main_text(page % "Site") == f"{FIRST}\n{SECOND}"


def _plain_choice(page):
    """Density sums by their definition, every element's text and tags counted anew."""
    n, out = len(page.tags), page.set_aside()
    inside = [[k for k in range(v, page.ends[v]) if not out[k]] if not out[v] else [] for v in range(n)]

    def linked(k, v):
        while k != v and page.tags[k] != "a":
            k = page.parents[k]
        return page.tags[k] == "a"

    def count(v):
        own = set(inside[v])
        pieces = [(k, len(t.strip())) for k, t, _ in page.pieces if k in own]
        chars, links = sum(c for _, c in pieces), sum(c for k, c in pieces if linked(k, v))
        tags, link_tags = len(own - {v}), sum(page.tags[k] == "a" for k in own)
        return chars, links, tags or 1, link_tags or 1

    counts = [count(v) for v in range(n)]
    share = counts[0][1] / counts[0][0]

    def density(v):
        chars, links, tags, link_tags = counts[v]
        if not chars or out[v]:
            return 0.0
        base = math.log(chars / ((chars - links) or 1) * links + share * chars + math.e)
        return chars / tags * math.log(max(chars / (links or 1) * tags / link_tags, 1.0)) / math.log(max(base, 1.1))

    dense = [density(v) for v in range(n)]
    sums = [sum(dense[k] for k in range(1, n) if page.parents[k] == v) for v in range(n)]

    def best(v):
        return min(inside[v], key=lambda k: (-round(sums[k], 6), k))

    body = page.tags.index("body")
    core = node = best(body)
    path = [core]
    while node != body:
        node = page.parents[node]
        path.append(node)
    least = min(dense[v] for v in path)
    chosen, todo = set(), [body]
    while todo:
        v = todo.pop()
        if not out[v] and dense[v] >= least:
            chosen.add(best(v))
            todo += [k for k in range(1, n) if page.parents[k] == v]
    return chosen


def test_densities_by_their_definition():
    rng = random.Random(5)

    def part(depth):
        kind = rng.choice("div div p p ul section a".split()) if depth < 4 else "p"
        words = " ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(0, 30)))
        if kind in ("p", "a"):
            return f"<{kind}>{words} <a href=x>{words[:20]}</a></p>" if kind == "p" and rng.random() < 0.3 else f"<{kind}>{words}</{kind}>"
        return f"<{kind}>" + "".join(part(depth + 1) for _ in range(rng.randint(1, 4))) + f"</{kind}>"

    tried = 0
    for _ in range(150):
        page = html_text.Page("<html><body>" + "".join(part(0) for _ in range(3)) + SIDE + "</body></html>")
        out = page.set_aside()
        got = page._choose(out)
        if got and all(t not in ("article", "main") for t in page.tags):
            tried += 1
            assert page_text(page, got, out) == page_text(page, _plain_choice(page), out)
    assert tried > 100


def page_text(page, chosen, out):
    return [t for k, t, _ in page.pieces if t.strip() and not out[k] and any(v <= k < page.ends[v] for v in chosen)]
