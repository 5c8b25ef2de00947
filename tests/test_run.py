import json

import pytest
from pyspark.sql import functions as F

from contentloom.operators.keyfilter import KeyFilter
from contentloom.operators.routing import Routes
from contentloom.plans.run import Store, extract, run, run_all
from contentloom.plans.sink import envelopes, write_envelopes, write_items
from contentloom.plans.sites import linkedin_parts
from contentloom.plans.website import Crawl, website_parts
from contentloom.schemas import ITEM_FIELDS, SOURCE, check_items, item_columns, with_run
from contentloom.functions.urls import url_key
from contentloom.session import remove_stages, stage, staged
from contentloom.sources.drive import drive_items
from contentloom.sources.reddit import comment_items
from contentloom.streaming.incremental import arriving_items, page_items, write_arriving_pages

ARTICLE = "<html><head><title>Doc {0}</title></head><body><article><h1>Article {0}</h1><p>Text of {0}.</p></article></body></html>"
FILE_ID = "A" * 30
PAGES = {
    # A page whose links name articles: each is extracted, once.
    "https://x.io/start": '<a href="/blog/a">a</a><a href="blog/a">again</a><a href="/blog/gone">g</a><a href="/about">n</a><a href="/blog/b?x=1">b</a>',
    "https://x.io/blog/a": ARTICLE.format("a"),
    "https://x.io/blog/b?x=1": ARTICLE.format("b"),
    # A hub: posts lead on, one of them twice, one to nowhere.
    "https://x.io/hub": '<div class="post"><div class="post"><a href="/one">1</a></div></div><div class="post"><a href="/none">0</a></div>'
    '<div class="article"><a href="/two#frag">2</a></div>',
    "https://x.io/one": "<body><div><h2>One</h2><time>May 1</time><p>Body * one</p></div></body>",
    "https://x.io/two": "<main><p>Body two</p></main>",
    # Posts without links: a rendered page. Its article has no h1.
    "https://app.io/": '<div class="post"><p>x</p></div><a href="/post/r"><b>Read more</b></a><a href="/post/noh1"><b>View post</b></a>',
    "https://app.io/post/r": '<h1>R title</h1><p>R text</p>',
    "https://app.io/post/noh1": "<h2>no</h2><p>text</p>",
    "https://empty.io/": "<body><nav><p>menu</p></nav></body>",
    "https://single.io": ARTICLE.format("single"),
    "www.substack.com/p/s": ARTICLE.format("sub"),
    "linkedin.com/posts/l": '<title> L </title><div class="break-words"><p>Hi <b>all</b></p></div>',
    "linkedin.com/posts/none": "<p>none</p>",
    "linkedin.com/posts/untitled": '<title></title><div class="break-words">x</div>',
    "https://drive.google.com/drive/folders/f": f'<script>["{FILE_ID}",["p"],"My Book.pdf","application/pdf"]</script>'
    f'<a href="/file/d/{FILE_ID}/view">other name.pdf</a><a href="/file/d/{"B" * 28}/view">b.pdf</a>',
}
THREAD = [{"kind": "post"}, {"data": {"children": [{"data": {"author": "ann", "author_fullname": "t2_a", "body_html": "&lt;p&gt;hi &lt;b&gt;you&lt;/b&gt;&lt;/p&gt;"}}]}}]
SOURCES = [
    # source, is_file, team, forced, limit
    ("https://x.io/start", False, "t1", None, None),
    ("https://x.io/hub", False, "t1", "", 2),
    ("https://app.io/", False, "t2", None, 0),
    ("https://empty.io/", False, "t2", None, None),
    ("https://missing.io/", False, "t2", None, None),
    ("https://single.io#part", False, "t2", "forced", -5),
    ("www.substack.com/p/s", False, "t2", None, None),
    ("linkedin.com/posts/l", False, "t2", None, None),
    ("linkedin.com/posts/none", False, "t2", None, None),
    ("linkedin.com/posts/untitled", False, "t2", None, None),
    ("reddit.com/r/x/", False, "t3", None, None),
    ("https://drive.google.com/drive/folders/f", False, "t3", "book!", None),
    ("shelf/Own.pdf", True, "t3", None, None),
    ("calls/c.txt", True, "t3", None, None),
    ("notes/n.md", True, "t3", None, None),
    ("notes/absent.md", False, "t3", None, None),
    ("calls/blank.txt", True, "t3", None, None),
    ("https://single.io", False, "t4", None, 1),
]


@pytest.fixture(scope="module")
def store(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(PAGES.items())], "page_id long, url string, html string")
    # The same address crawled twice: the first crawl counts.
    pages = pages.union(spark.createDataFrame([(99, "https://x.io/one#again", "<h1>later</h1>")], pages.schema))
    return Store(
        pages=pages.withColumn("url_key", F.expr(url_key("url"))),
        threads=spark.createDataFrame([("reddit.com/r/x.json", json.dumps(THREAD))], "json_url string, body string"),
        files=spark.createDataFrame(
            [("calls/c.txt", "CHAPTER 1\nHello:"), ("notes/n.md", "é note"), ("calls/blank.txt", " \n"), ("notes/absent.md", "x")],
            "path string, text string",
        ),
        book_pages=spark.createDataFrame([("shelf/Own.pdf", 1, "two"), ("shelf/Own.pdf", 0, "one ")], "file string, page_no int, text string"),
        drive_pages=spark.createDataFrame(
            [(f"https://drive.google.com/uc?export=download&id={FILE_ID}", 0, "CHAPTER 2 x")], "url string, page_no int, text string"
        ),
    )


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, s, f, t, c, n) for i, (s, f, t, c, n) in enumerate(SOURCES)]
    return spark.createDataFrame(rows, SOURCE)


@pytest.fixture(scope="module")
def items(sources, store):
    return stage(run(sources, store), "items")


@pytest.fixture(scope="module")
def done(items):
    return sorted(items.collect(), key=lambda r: (r.source_id, r.page_seq, r.item_seq))


def _short(rows, *fields):
    got = {}
    for r in rows:
        got.setdefault(SOURCES[r.source_id][0], []).append(tuple(r[f] for f in fields))
    return got


def test_items_of_every_route(done):
    assert _short(done, "title", "content", "content_type", "source_url") == {
        "https://x.io/start": [
            ("Article a", "Article a\nText of a.", "blog", "https://x.io/blog/a"),
            ("Article b", "Article b\nText of b.", "blog", "https://x.io/blog/b?x=1"),
        ],
        "https://x.io/hub": [
            ("One", "Date: May 1\n\n## One\n\nMay 1\n\nBody \\* one", "blog", "https://x.io/one"),
            ("One", "Date: May 1\n\n## One\n\nMay 1\n\nBody \\* one", "blog", "https://x.io/one"),
        ],
        # Its links are articles, so the page is a list of them, whatever its posts.
        "https://app.io/": [
            ("R title", "R title\nR text", "blog", "https://app.io/post/r"),
            ("Untitled", "no\ntext", "blog", "https://app.io/post/noh1"),
        ],
        "www.substack.com/p/s": [("Doc sub", "Article sub\nText of sub.", "blog", "www.substack.com/p/s")],
        "linkedin.com/posts/l": [("L", "Hi **all**", "linkedin_post", "linkedin.com/posts/l")],
        "reddit.com/r/x/": [("Reddit comment by ann", "hi **you**", "reddit_comment", "reddit.com/r/x/")],
        "https://drive.google.com/drive/folders/f": [
            ("_gdrive_My_Book", "# Chapter 2: x", "book!", f"https://drive.google.com/uc?export=download&id={FILE_ID}")
        ],
        "shelf/Own.pdf": [("Own", "one two", "book", None)],
        "calls/c.txt": [("c.txt", "# Chapter 1\n\n### Hello:", "call_transcript", None)],
        "notes/n.md": [("n.md", "é note", "other", None)],
        "https://single.io": [("Article single", "Article single\nText of single.", "blog", "https://single.io")],
    }
    assert {(r.author, r.user_id) for r in done if r.content_type != "reddit_comment"} == {("", "")}
    assert [(r.author, r.user_id) for r in done if r.content_type == "reddit_comment"] == [("ann", "t2_a")]


def test_output_contract(done):
    for r in done:
        assert r.title is not None and r.content and r.content_type


def test_hub_fallbacks_and_dedup(spark, store):
    sources = with_run(spark.createDataFrame([(0, "https://x.io/hub", False, "t", None, None)], SOURCE))
    items, lost = website_parts(sources, store.crawl)
    got = sorted((r.item_seq, r.title, r.content) for r in items.collect())
    assert [g[:2] for g in got] == [(0, "One"), (1, "One"), (3, "https://x.io/two#frag")]
    assert got[2][2] == "Body two"
    assert [tuple(r) for r in lost.collect()] == [(0, "https://x.io/none", "article", "not fetched")]
    items, _ = website_parts(sources, store.crawl, dedup=True)
    assert sorted(r.title for r in items.collect()) == ["One", "https://x.io/two#frag"]


def test_rendered_page_whose_links_are_no_articles(spark):
    pages = spark.createDataFrame(
        [
            (0, "https://r.io/", '<div class="post">x</div><a href="/tag/post/1"><b>Read more</b></a><a href="/tag/post/2"><b>Read more</b></a>'),
            (1, "https://r.io/tag/post/1", "<h1>One</h1><p>text</p>"),
            (2, "https://r.io/tag/post/2", "<p>no heading</p>"),
        ],
        "page_id long, url string, html string",
    ).withColumn("url_key", F.col("url"))
    sources = with_run(spark.createDataFrame([(5, "https://r.io/", False, "t", None, None)], SOURCE))
    items, lost = website_parts(sources, Crawl(pages))
    assert [(r.title, r.content) for r in items.collect()] == [("One", "One\ntext")]
    assert [(r.url, r.reason) for r in lost.collect()] == [("https://r.io/tag/post/2", "no heading or main text")]


def test_pages_that_no_source_meets_are_not_rendered(spark, store, monkeypatch):
    unmet = [(1000 + i, f"https://unmet.io/{i}", ARTICLE.format(i)) for i in range(2000)]
    pages = store.pages.unionByName(
        spark.createDataFrame(unmet, "page_id long, url string, html string").withColumn("url_key", F.col("url"))
    )
    read, facts = Crawl.read, []
    monkeypatch.setattr(Crawl, "read", lambda *a, **k: facts.append(read(*a, **k)) or facts[-1])
    rows = [(0, "https://x.io/start", False, "t", None, None), (1, "https://x.io/hub", False, "t", None, None)]
    items, _ = website_parts(with_run(spark.createDataFrame(rows, SOURCE)), Crawl(pages))
    assert items.count() == 5
    parsed = [[r.url_key.removeprefix("https://x.io/") for r in f.collect()] for f in facts]
    # The sources, then the articles of the one, then the posts of the other.
    assert [sorted(p) for p in parsed] == [["hub", "start"], ["blog/a", "blog/b?x=1"], ["one", "two"]]
    rendered = [[sum(r[c] is not None for r in f.collect()) for c in ("main", "article") if c in f.columns] for f in facts]
    assert rendered == [[0], [2], [0, 2]]


def test_key_filter(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("https://x.io/"), "id").alias("url_key"), "id")
    keys = rows.where("id % 100 = 7").select("url_key").unionByName(spark.createDataFrame([(None,), ("absent",)], "url_key string"))
    passed = KeyFilter(keys, "url_key").maybe_wanted(rows)
    assert passed.columns == rows.columns
    assert passed.where("id % 100 = 7").count() == 2000
    assert passed.count() < 2000 + 200_000 / 8
    assert KeyFilter(keys.limit(0), "url_key").maybe_wanted(rows).count() == 0
    left = KeyFilter(keys, "url_key").surely_unwanted(rows)
    assert left.count() + passed.count() == 200_000 and left.where("id % 100 = 7").count() == 0
    assert KeyFilter(keys.limit(0), "url_key").surely_unwanted(rows).count() == 200_000
    # Before the join, what no key asks for is gone from what is shuffled.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = passed.join(keys, "url_key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(url_key") < plan.index("BroadcastHashJoin")


def test_rejects(sources, store):
    web = with_run(Routes().apply(sources).where("route = 'website'"))
    _, lost = website_parts(web, store.crawl)
    got = {(SOURCES[r.source_id][0], r.url, r.reason) for r in lost.collect()}
    assert got == {
        ("https://x.io/start", "https://x.io/blog/gone", "not fetched"),
        ("https://x.io/hub", "https://x.io/none", "not fetched"),
        ("https://empty.io/", "https://empty.io/", "no main text"),
        ("https://missing.io/", "https://missing.io/", "not fetched"),
    }


def test_unreadable_titles(sources, store):
    posts = with_run(Routes().apply(sources).where("route = 'linkedin'"))
    lost = linkedin_parts(posts, store.crawl)[1].collect()
    assert sorted((r.url, r.reason) for r in lost) == [
        ("linkedin.com/posts/none", "no post"), ("linkedin.com/posts/untitled", "unreadable title"),
    ]


def test_rejects_of_every_route(spark, sources, store):
    more = [
        (100, "reddit.com/r/none", False, "t", None, None), (101, "shelf/None.pdf", True, "t", None, 1),
        (102, "https://drive.google.com/drive/folders/none", False, "t", None, None), (103, "calls/bad.txt", True, "t", None, None),
        (104, "www.substack.com/p/none", False, "t", None, None), (105, "reddit.com/r/bad", False, "t", None, 2),
    ]
    whole = sources.unionByName(spark.createDataFrame(more, SOURCE))
    files = store.files.unionByName(spark.createDataFrame([("calls/bad.txt", None), ("calls/c.txt", "CHAPTER 9")], "path string, text string"))
    threads = store.threads.unionByName(store.threads).unionByName(spark.createDataFrame([("reddit.com/r/bad.json", "{")], store.threads.schema))
    result = run_all(whole, Store(store.pages, threads, files, store.book_pages, store.drive_pages))
    got = sorted((r.url, r.stage, r.reason) for r in result.rejects.collect())
    assert got == sorted([
        ("https://x.io/blog/gone", "page", "not fetched"), ("https://x.io/none", "article", "not fetched"),
        ("https://empty.io/", "page", "no main text"), ("https://missing.io/", "page", "not fetched"),
        ("linkedin.com/posts/none", "page", "no post"), ("linkedin.com/posts/untitled", "page", "unreadable title"),
        ("notes/absent.md", "file", "not a file"), ("reddit.com/r/none", "thread", "not stored"), ("reddit.com/r/bad", "thread", "no comment"),
        ("shelf/None.pdf", "file", "not stored"), ("https://drive.google.com/drive/folders/none", "listing", "not fetched"),
        ("calls/bad.txt", "file", "not UTF-8"), ("www.substack.com/p/none", "page", "not fetched"),
        (f"https://drive.google.com/uc?export=download&id={'B' * 28}", "download", "not stored"),
    ])
    # Threads and files that are stored twice count once.
    assert result.items.groupBy("source_id", "page_seq", "item_seq").count().where("count > 1").count() == 0
    only = run_all(whole.where("source_id < 12"), Store(files=store.files))
    assert only.items.count() == 0 and only.rejects.count() == 12
    assert {r.stage for r in only.rejects.collect()} == {"store"}


def test_registered_route_takes_part_in_a_run(spark, sources, store):
    def notes(df):
        return df.select(
            "source_id", "run", F.lit(0).alias("page_seq"), F.lit(0).alias("item_seq"),
            *item_columns(F.col("source"), F.lit("own"), ""),
        )

    routes = Routes().register("notes", lambda s, f: s.startswith("notes/"), notes, before="website")
    only_files = Store(files=store.files)
    got = {r.title: r.content_type for r in run(sources, only_files, routes).where("content = 'own'").collect()}
    assert got == {"notes/n.md": "blog", "notes/absent.md": "blog"}
    with pytest.raises(ValueError):
        check_items(spark.range(1))


def test_limits_of_a_run(spark, sources, store):
    two = sources.withColumn("max_items", F.lit(-1))
    got = _short(sorted(run(two, store).collect(), key=lambda r: (r.source_id, r.page_seq, r.item_seq)), "title")
    assert got == {
        "https://x.io/start": [("Article a",)],
        "https://x.io/hub": [("One",), ("One",)],
        "https://app.io/": [("R title",)],
    }
    assert extract(sources.where("source_id = 1"), store).count() == 3


def test_counts_of_a_run_are_gathered_while_it_is_written(sources, store, tmp_path):
    whole = run_all(sources, store)
    items, counts = whole.counted_items()
    write_items(items, str(tmp_path / "out"))
    by_source = whole.summary().collect()
    for name in ("found", "limited", "written", "skipped"):
        assert counts[name] == sum(r[name] for r in by_source)
    assert counts["written"] == items.sparkSession.read.json(str(tmp_path / "out")).count()
    hub = next(r for r in by_source if SOURCES[r.source_id][0] == "https://x.io/hub")
    assert (hub.found, hub.limited, hub.written, hub.skipped, hub.content_type) == (3, 2, 2, 0, "blog")
    blank = next(r for r in by_source if SOURCES[r.source_id][0] == "calls/blank.txt")
    assert (blank.found, blank.written, blank.skipped, blank.content_type) == (1, 0, 1, None)


def test_threads(spark):
    def body(data):
        return json.dumps([{}, {"data": {"children": [{"data": data}]}}])

    rows = [
        ("a", body({"author": "x", "body_html": "&lt;i&gt;a&lt;/i&gt;"})),
        ("b", body({"author": None, "body_html": "plain"})),
        ("c", body({"author": "x"})),
        ("d", "[{}]"),
        ("e", "{"),
        ("f", json.dumps([{}, {"data": {"children": []}}])),
        ("g", None),
        ("h", body({"author": "x", "body_html": None})),
    ]
    threads = spark.createDataFrame(rows, "source string, body string")
    got = {r.source: r for r in comment_items(threads).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].content, got["a"].user_id) == ("*a*", "")
    assert (got["b"].title, got["b"].author) == ("Reddit comment by None", None)
    raw = {r.source: r.content for r in comment_items(threads, unescape=False).collect()}
    assert raw["a"] == "<i>a</i>"


def test_drive_names_with_a_slash_give_no_item(spark):
    links = spark.createDataFrame([("u", "a/b.pdf", 0), ("u", "ok x.pdf.pdf", 1)], "url string, name string, pos long")
    texts = spark.createDataFrame([("u", 0, "t")], "url string, page_no int, text string")
    assert [r.title for r in drive_items(links, texts).collect()] == ["_gdrive_ok_x"]


def test_item_sink_keeps_nulls_and_text(items, tmp_path):
    write_items(items, str(tmp_path / "out/deep"))
    write_items(items, str(tmp_path / "out/deep"))
    lines = [json.loads(x) for p in (tmp_path / "out/deep").rglob("*.json") for x in p.read_text("utf-8").splitlines()]
    assert len(lines) == items.count()
    note = next(x for x in lines if x["title"] == "n.md")
    assert note["source_url"] is None and note["content"] == "é note"
    assert {p.name for p in (tmp_path / "out/deep").iterdir() if p.is_dir()} == {f"team_id=t{i}" for i in (1, 2, 3, 4)}


def test_a_run_written_again_replaces_its_own_items_only(items, tmp_path):
    path = str(tmp_path / "out")

    def written():
        back = items.sparkSession.read.json(path).select("team_id", "run", "title")
        return sorted(map(tuple, back.collect()))

    def titles(df, run):
        return [(r.team_id, run, r.title) for r in df.collect()]

    write_items(items, path, "monday")
    write_items(items.where("team_id <> 't1'"), path, "tuesday")
    both = titles(items, "monday") + titles(items.where("team_id <> 't1'"), "tuesday")
    assert written() == sorted(both)
    write_items(items, path, "monday")
    assert written() == sorted(both)
    # Fewer items of one team: its folder of this run changes, no other.
    fewer = items.where("team_id = 't3' AND title = 'n.md'")
    write_items(fewer, path, "monday")
    rest = titles(items.where("team_id <> 't3'"), "monday") + titles(items.where("team_id <> 't1'"), "tuesday")
    assert written() == sorted([("t3", "monday", "n.md"), *rest])


def test_envelopes(items, tmp_path):
    rows = envelopes(items).collect()
    assert all(r.part == 0 for r in rows)
    by_source = {SOURCES[r.source_id][0]: json.loads(r.envelope) for r in rows}
    assert by_source["https://x.io/start"]["team_id"] == "t1"
    assert [i["title"] for i in by_source["https://x.io/start"]["items"]] == ["Article a", "Article b"]
    (own,) = by_source["shelf/Own.pdf"]["items"]
    assert list(own) == list(ITEM_FIELDS) and own["source_url"] is None
    parts = {(r.source_id, r.part): json.loads(r.envelope)["items"] for r in envelopes(items, 1).collect()}
    assert [parts[0, n][0]["title"] for n in (0, 1)] == ["Article a", "Article b"]
    write_envelopes(items, str(tmp_path / "env"), by="source_id")
    assert json.loads(next((tmp_path / "env/source_id=14").glob("*.txt")).read_text("utf-8"))["items"][0]["content"] == "é note"
    write_envelopes(items, str(tmp_path / "teams"))
    lines = [x for p in (tmp_path / "teams/team_id=t3").glob("*.txt") for x in p.read_text("utf-8").splitlines()]
    assert len(lines) == 5 and {json.loads(x)["team_id"] for x in lines} == {"t3"}


def test_stage_tables_are_removed(spark):
    before = staged()
    one, two = stage(spark.range(3), "one"), stage(spark.range(4), "two")
    own = [p for p in staged() if p not in before]
    assert remove_stages(spark, own[:1]) == 1
    assert two.count() == 4 and staged() == [*before, own[1]]
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        one.count()
    assert remove_stages(spark, own) == 1 and staged() == before


def test_files_as_they_arrive(spark, store, tmp_path):
    store.files.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arriving_items(spark, str(tmp_path / "in"), "other").writeStream.format("memory").queryName("arrived")
    query = stream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert {r.title for r in spark.table("arrived").collect()} == {"c.txt", "n.md", "blank.txt", "absent.md"}


def test_pages_as_they_arrive(spark, store, tmp_path):
    arrived = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    ids = store.pages.where("page_id <> 99")
    stream = spark.readStream.schema(ids.schema).parquet(arrived)

    def next_batch(rows):
        rows.coalesce(1).write.mode("append").parquet(arrived)
        query = write_arriving_pages(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    before = staged()
    next_batch(ids.where("page_id % 2 = 0"))
    next_batch(ids.where("page_id % 2 = 1"))
    assert staged() == before
    items, lost = page_items(ids)
    for name, rows in (("items", items), ("rejects", lost)):
        got = spark.read.parquet(str(tmp_path / "out" / name))
        assert {r.batch for r in got.collect()} == {0, 1}
        assert sorted(map(repr, got.drop("batch").collect())) == sorted(map(repr, rows.collect()))
    assert items.count() + lost.count() == len(PAGES)
