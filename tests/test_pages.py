import random

import pytest
from pyspark.sql import functions as F

from contentloom.functions import page as P
from contentloom.functions.maintext import main_text
from contentloom.functions.markdown import markdown, plain_markdown, thinned
from contentloom.operators.dom import dom_nodes
from contentloom.sources.drive import anchor_links
from contentloom.sources.pages import page_nodes


@pytest.fixture(scope="session")
def read(spark):
    """Values of an expression over the events of pages."""

    def run(expr, *htmls, url="https://x.io/dir/page"):
        rows = [(i, url, h) for i, h in enumerate(htmls)]
        nodes = page_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url")
        got = nodes.selectExpr("*", f"{P.anchors()} AS anchors").selectExpr("page_id", f"{expr} AS v")
        return [r.v for r in sorted(got.collect(), key=lambda r: r.page_id)]

    return run


def _tree(events):
    return " ".join(e.text if e.tag == "#text" else e.tag for e in events)


def test_events(read):
    got = read(
        "nodes",
        '<P Class="a  b">x<br/>y</i><div/>&lt;z&nbsp;<!-- c --> w</p>',
        "<ul><li>1<li>2</ul>after",
        "<script>if (a<b) '</p>'</script><p>q",
        "", "text &amp", "<p>  \n  </p><pre>  \n </pre>",
    )
    assert _tree(got[0]) == "p x br y div /div <z   w /p"
    assert got[0][0].classes == "a b" and got[0][0].text_len == len("xy<z  w")
    assert _tree(got[1]) == "ul li 1 li 2 /li /li /ul after"
    assert [e.ord for e in got[1] if e.tag == "li"] == [1, 1]
    assert _tree(got[2]) == "script if (a<b) '</p>' /script p q /p"
    assert got[2][0].text_len == 0
    assert got[3] == [] and _tree(got[4]) == "text &"
    assert [e.text for e in got[5] if e.tag == "#text"] == ["\n", "  \n "]
    for events in got:
        for e in events:
            assert events[e.pos] == e and e.end >= e.pos
            if not e.tag.startswith(("#", "/")) and e.end > e.pos:
                assert events[e.end].tag == "/" + e.tag


def test_unreadable_page_gives_null(read):
    assert read("nodes IS NULL", "<p>ok</p>", None) == [False, True]


def test_titles(read):
    cases = {
        "<h1> A <b>long</b> one </h1><title>Other title</title>": "Alongone",
        "<h1>short</h1><title>Title &amp; more</title>": "Title & more",
        "<h1>short</h1><h1>second is longer</h1><h2>Heading two</h2>": "Heading two",
        '<p class="sub-title">By class title</p><h2>Heading two</h2>': "By class title",
        '<p class="x">n</p><div class="my heading">By heading</div>': "By heading",
        "<h3>Only a third</h3>": "Only a third",
        "<p>nothing</p>": "Untitled",
        "": "Untitled",
        "<h1>123456<script>x</script></h1>": "123456",
    }
    assert read(P.page_title(), *cases) == list(cases.values())


def test_article_parts(read):
    htmls = [
        "<h2> T </h2><h1>U</h1><time></time><span class='text-slate-500 text-sm'>d</span>",
        "<h1></h1><h4 class='text-sm x'>n</h4><h4 class='text-sm text-slate-500'>5 <b>May</b></h4>",
        "<p>none</p><div class='text-slate-500 text-sm'>no</div>",
    ]
    assert read(P.article_title(), *htmls) == ["T", "", None]
    assert read(P.page_date(), *htmls) == ["", "5May", ""]
    assert read(P.document_title(), "<title> a <!-- --> b </title>", "<p>x</p>", "<title></title>") == ["a  b", None, ""]


def test_title_readable(read):
    pages = ["<title>a</title>", "<p>none</p>", "<title></title>", "<title> </title>", "<title>a<b>c</b></title>"]
    assert read(P.title_readable(), *pages) == [True, True, False, True, False]
    assert read(P.page_title(), "<h1><![CDATA[wrapped]]></h1>") == ["wrapped"]


def test_article_body(read):
    bodies = {
        "<article>a</article><main>m</main>": "m",
        "<div>longer than</div><article>a</article>": "a",
        "<div>ab</div><div>cd</div><div>e</div>": "ab",
        "<div>a</div><div>b<div>c</div></div>": "b\n\nc",
        "<p>whole</p>": "whole",
    }
    assert read(markdown(P.article_body()), *bodies) == list(bodies.values())


def test_containers_and_links(read):
    page = (
        '<div class="bg-white p-[30px] x"><a>no</a><a href="/1">a</a><a href="/2">b</a></div>'
        '<div class="bg-white">n</div><div class="blog-posts">n</div><span class="post">n</span>'
        '<div class="post"><div class="article"><a href="in?x=1&amp;y=2">c</a></div></div>'
        '<div class="article"><a href=""></a><a href="/late">d</a></div><div class="blog-post"><button>x</button></div>'
    )
    assert read(f"size({P.post_containers()})", page) == [5]
    assert read(P.hub_links(), page) == [["https://x.io/1", "https://x.io/dir/in?x=1&y=2", "https://x.io/dir/in?x=1&y=2"]]
    links = '<a href="/blog/a">1</a><a href="/about/blog/">2</a><a href="/blog/b#x">3</a><a href="../blog/a">4</a><!-- <a href="/blog/c"> -->'
    assert read(P.article_links(), links) == [["https://x.io/blog/a"]]


def test_read_more(read):
    page = (
        '<a href="/post/1"><b>Read more</b></a><a href="/post/2">Read more</a><a href="/x/"><b>View post</b></a>'
        '<a href="/tag/news/"><i><b>- </b><u>Continue reading</u></i></a><a href="/blog/3"><p><i>x</i>Read article</p></a>'
        '<a href="/news/4#top"><p> <i>x</i>Read article</p></a><a href="/tag/post/">read more</a>'
    )
    assert read(P.read_more_links(), page) == [
        ["https://x.io/post/1", "https://x.io/tag/news/", "https://x.io/blog/3", "https://x.io/post/2"]
    ]


def test_quill_and_posts(read):
    page = (
        '<div class="ql Quill"><h3>T</h3><div class="Content">c<div class="quill"><p>n</p></div></div></div>'
        '<div class="quill-x"><p>all</p></div>'
    )
    (posts,) = read(f"transform({P.quill_posts()}, p -> struct(p.title AS t, {markdown('p.body')} AS b))", page)
    assert [tuple(p) for p in posts] == [("T", "c\n\nn"), ("Untitled", "n"), ("Untitled", "all")]
    post = markdown(P.break_words_post())
    assert read(post, '<p class="break-words">n</p><div class="x break-words">y</div>', "<div>z</div>") == ["y", None]


MARKDOWN = {
    "<h1>Hi</h1><p>a <b> bold </b>x<i></i></p><div>d<br>e<br></div>": "# Hi\n\na **bold** x\n\nd  \ne",
    "<h6>s<br>t</h6>": "###### s t",
    "<ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li> <li><p>d</p><p>e</p></li></ul><p>z</p>":
        "* a\n    + b\n        - c\n* d\n\n    e\n\nz",
    "<p>x</p><ol>\n<li>one</li>\n<li>two</li>\n</ol>after": "x\n\n1. one\n2. two\n\nafter",
    "<p>a</p><blockquote><p>q1</p><p>q2</p><blockquote>in</blockquote></blockquote><p>b</p>":
        "a\n\n> q1\n>\n> q2\n>\n> > in\n\nb",
    "<blockquote>just\ntext<ul><li>i</li></ul></blockquote>": "> just\n> text\n>\n> * i",
    '<a href="http://a_b/c">http://a_b/c</a> <a href="/x_y"> t_1 </a><a href="/q"></a><a>none</a><img src="s.png" alt="A\nB">':
        "<http://a_b/c> [t\\_1](/x_y) none![A B](s.png)",
    '<p><b><a href="/u"> x </a></b>y &gt;</p>': "**[x](/u)** y >",
    "<pre>  x\n    y *z*\n</pre><p><code>a_b</code> * _</p>": "```\n  x\n    y *z*\n```\n\n`a_b` \\* \\_",
    "<p>t</p><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody> <tr><td>1</td> <td>2<p>3</p></td></tr></tbody></table>end":
        "t\n\n| A | B |\n| --- | --- |\n| 1 | 2 3 |\n\nend",
    "<table>\n<tr><td>1</td></tr>\n<tr><td>2</td></tr></table>": "| 1 |\n| --- |\n| 2 |",
    "<p><b>aa<br><p>bb</p><p><b>cc<br><p>dd</p></p>": "**aa\n\nbb\n\n**cc\n\ndd****",
    "<h2>a\n b</h2>t\n\n\n u<hr>v<script>x</script><style>y</style><p>  </p><p></p>w": "## a b\n\nt\nu\n\n---\n\nv\n\nw",
    "<p><em><strong>x</strong></em> <i> <b> </b></i>y</p>": "***x*** y",
    '<a href="/p"><h2>T</h2></a><p>n</p>': "[## T](/p)\n\nn",
    "a &amp; b&nbsp;c": "a & b c",
    "": "",
}


def test_markdown(read):
    assert dict(zip(MARKDOWN, read(markdown(), *MARKDOWN))) == MARKDOWN


def test_long_page_stays_whole(read):
    many = "".join(f"<p>line <b>{i}</b> _x_<br></p>\n" for i in range(20_000))
    (text,) = read(markdown(), many)
    assert text.split("\n\n") == [f"line **{i}** \\_x\\_" for i in range(20_000)]
    (deep,) = read(markdown(), "<div>" * 3000 + "x" + "</div>" * 3000)
    assert deep == "x"


MAIN = {
    "<body><nav><p>no</p></nav><article><h1>T</h1><p>a <b>b</b><br>c</p><ul><li>one</li><li><a href='/x'>only link</a></li></ul>"
    "<table><tr><td>1</td><td><p>2</p></td></tr></table><div class='x share'><p>s</p></div>bare</article><p>out</p></body>":
        "T\na b c\none\n1 | 2",
    "<main><p>m</p></main><p>o</p>": "m",
    "<aside><article><p>no</p></article></aside><article><p>yes</p></article>": "yes",
    "<body><p>x<a href='/l'>link</a> longer text</p><p><a href='/l'>abc</a>ab</p><p id='ad'>ad</p></body>": "xlink longer text",
    "<p>a<p>b</p>c</p>": "a\nb\nc",
    "<p>one\n  line\t here</p><blockquote>q</blockquote><pre>p  r\ne</pre>": "one line here\nq\np r e",
    "<div>no block</div>": None,
    "": None,
}


def test_main_text(read):
    assert dict(zip(MAIN, read(main_text(), *MAIN))) == MAIN


def test_second_pass(evaluate):
    texts = ["a * b_c\n\n d  e", None, "x\t y", "\nq\n", "<b>kept</b> &amp;"]
    want = ["a \\* b\\_c\nd e", None, "x y", "q", "<b>kept</b> &amp;"]
    assert evaluate(plain_markdown("t"), texts, "t string") == want


@pytest.mark.parametrize(
    "page, start, length",
    [
        ("<p>" + "<b> " * 100_000 + "x", "***", 400_001),
        ("x" + "<br>" * 100_000 + "y", "x  \n", 300_002),
        ("<blockquote>a" + "<p></p>" * 100_000 + "</blockquote>b", "> a\n\nb", 6),
        ("<pre>" + "\n" * 100_000 + "x</pre>", "```\n", None),
        ("<blockquote>" * 100_000 + "x", "> > ", 200_001),
        ("<blockquote>\n<div>" * 30_000 + "x", "> > ", 60_001),
        ("<ul>" * 100_000 + "x", "x", 1),
        ("x" + "<ul>" * 30_000 + "</ul>\n" * 30_000 + "y", "x\n\ny", 4),
        ("<table>" + "<tr><td>x" * 5_000, "| x\n", None),
    ],
)
def test_markdown_of_malformed_pages(spark, page, start, length):
    """Such pages end in seconds and are whole."""
    nodes = dom_nodes(spark.createDataFrame([(page,)], "html string"))
    text = nodes.select(F.expr(markdown()).alias("m")).first()["m"]
    assert text.startswith(start)
    if length:
        assert len(text) == length


def _quoted(levels):
    lines = ["> " * (k + 1) + f"t{k}\n" + ("> " * k + ">\n" if k < levels - 1 else "") for k in range(levels)]
    return "".join(lines).strip()


def test_quotes_and_lists_of_any_depth(read):
    def pages(levels):
        quotes = "".join(f"<blockquote>t{k}" for k in range(levels)) + "</blockquote>" * levels
        return quotes, "".join(f"<ul><li>t{k}\n" for k in range(levels)) + "</li>\n</ul>\n" * levels

    for levels in (3, 40, 2_000):
        quotes, lists = read(markdown(), *pages(levels))
        assert quotes == _quoted(levels)
        assert lists == "\n".join(" " * 4 * k + "*+-"[k % 3] + f" t{k}" for k in range(levels))


def test_leaving_out_line_starts_changes_nothing(read):
    """Pages of random tags, shallow enough to be rendered from all their events, too."""
    parts = ["<blockquote>", "</blockquote>", "<p>", "</p>", "<ul>", "</ul>", "<ol>", "<li>", "</li>", "\n", " ", "a", "<br>",
             "<b>", "</b>", "<td>", "</td>", "<h2>", "</h2>", "<pre>", "</pre>", "<span>", "<div>", "</div>", "<tr>", "<hr>"]
    rng = random.Random(3)
    pages = []
    for _ in range(3_000):
        some = rng.sample(parts[:11], rng.randint(2, 6)) + rng.sample(parts, rng.randint(1, 4))
        pages.append("".join(rng.choice(some) for _ in range(rng.randint(3, 16))))
    got = read(f"struct({markdown()} AS whole, {markdown(thinned('nodes'))} AS thin)", *pages)
    assert [(p, g.thin) for p, g in zip(pages, got)] == [(p, g.whole) for p, g in zip(pages, got)]


def test_texts_of_anchors_that_stay_open(read):
    page = '<a href="/file/d/{0}/view">é{0}.pdf<script>x</script> \U0001f600</a>' + '<a href="/file/d/{1}/view"><b>one</b>&amp;' * 2 + "<p>two.pdf"
    ids = "A" * 28, "B" * 28
    (got,) = read(anchor_links(), page.format(*ids))
    assert [tuple(g) for g in got] == [(ids[0], f"é{ids[0]}.pdf \U0001f600"), (ids[1], "one&one&two.pdf"), (ids[1], "one&two.pdf")]


def test_open_anchors_cost_about_what_their_number_does(read):
    import time

    def seconds(n):
        pages = ['<a href="/file/d/x/view">t' * n + "end.pdf"] * 4
        start = time.perf_counter()
        got = read(f"size({anchor_links()})", *pages)
        assert got == [n] * 4
        return time.perf_counter() - start

    seconds(10)
    few, many = min(seconds(2000) for _ in range(2)), min(seconds(4000) for _ in range(2))
    assert many < 3 * few
