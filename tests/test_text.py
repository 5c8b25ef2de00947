import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from contentloom.functions import text as T
from contentloom.sources.files import book_items, file_rejects, generic_items, join_texts, scan_text_files, transcript_items

MARKDOWN = [
    ("", ""),
    (None, ""),
    ("chapter 3  The End", "# Chapter 3: The End"),
    ("CHAPTER 12", "# Chapter 12"),
    ("CHAPTER 4: Go", "# Chapter 4: : Go"),
    ("Chapters 4", "Chapters 4"),
    ("chapter ٣ x", "# Chapter ٣: x"),
    ("1. FIRST:", "1. FIRST:"),
    ("1.FIRST:", "### 1.FIRST:"),
    ("ALL CAPS LINE", "## All Caps Line"),
    ("ABC", "ABC"),
    ("ABCD", "## Abcd"),
    ("ABC1", "ABC1"),
    ("FOO\tBAR", "## Foo\tBar"),
    ("FOO  BAR", "## Foo  Bar"),
    ("Note:", "### Note:"),
    ("x" * 99 + ":", "x" * 99 + ":"),
    ("x" * 98 + ":", "### " + "x" * 98 + ":"),
    ("a\n\n\n  b ", "a\n\nb"),
    ("　a \n\x1cb\x1f", "a\n\nb"),
]


def test_text_to_markdown(evaluate):
    assert evaluate(T.text_to_markdown("t"), [t for t, _ in MARKDOWN], "t string") == [m for _, m in MARKDOWN]


def _expected(text):
    """The rules once more, in plain Python."""
    out = []
    for line in filter(None, (part.strip() for part in text.split("\n"))):
        head = re.fullmatch(r"(?is)chapter\s+(\d+)(.*)", line)
        if head:
            rest = head[2].strip()
            out.append(f"# Chapter {head[1]}" + (f": {rest}" if rest else ""))
        elif re.match(r"\d+\.\s+", line):
            out.append(line)
        elif len(line) > 3 and re.fullmatch(r"[A-Z][A-Z\s]+", line):
            out.append("## " + line.title())
        elif line[-1] == ":" and len(line) < 100:
            out.append("### " + line)
        else:
            out.append(line)
    return "\n\n".join(out)


_line = st.one_of(
    st.text(alphabet="AB C\t :1.x", max_size=12),
    st.sampled_from(["chapter 1", "CHAPTER  22: x", "12. A", "ÀB CD", "Chapter x", " LOUD  WORDS ", " a ", "a\rb"]),
    st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=15),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(_line, max_size=6).map("\n".join), min_size=20, max_size=40))
def test_any_text_follows_the_rules(evaluate, texts):
    assert evaluate(T.text_to_markdown("t"), texts, "t string") == [_expected(t) for t in texts]


CHAPTERS = [
    (
        "chapter 1: A\nfoo\nChapter 2\nbar chapter 3 x\nend\n",
        [("chapter 1: A", "foo"), ("Chapter 2", "bar"), ("chapter 3 x", "end")],
    ),
    ("  no heads here\n", [("Document", "no heads here")]),
    ("chapter 1\n\nchapter 2\nbody", [("chapter 2", "body")]),
    ("chapter 1 see chapter 2\nfoo", [("chapter 1 see chapter 2", "foo")]),
    ("chapter 9", [("Document", "chapter 9")]),
    ("CHAPTER\n7 x\nlines\nmore", [("CHAPTER\n7 x", "lines\nmore")]),
]


def test_chapters(evaluate):
    got = evaluate(T.chapters("t"), [t for t, _ in CHAPTERS], "t string")
    assert [[tuple(c) for c in cs] for cs in got] == [want for _, want in CHAPTERS]


def test_entities(evaluate):
    got = evaluate(T.decode_entities("t"), ["&lt;b&gt; &amp;lt; &quot;&#39;&nbsp;&copy;&middot;", "&ampx"], "t string")
    assert got == ["<b> &lt; \"' ©·", "&ampx"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("CHAPTER 1\r\nHé:\rend".encode())
    (tmp_path / "b.txt").write_bytes(b"bad \xff\xfe")
    (tmp_path / "c.txt").write_bytes(b" \n")
    files = scan_text_files(spark, [str(tmp_path)])
    assert str(tmp_path / "a.txt") in {r.path for r in files.collect()}
    items = {r.title: r for r in transcript_items(files).collect()}
    assert items["a.txt"].content == "# Chapter 1\n\n### Hé:\n\nend"
    assert items["c.txt"].content == ""
    assert set(items) == {"a.txt", "c.txt"}
    assert items["a.txt"].source_url is None and items["a.txt"].author == ""
    assert [r.path.rsplit("/", 1)[1] for r in file_rejects(files).collect()] == ["b.txt"]
    assert {r.content_type for r in generic_items(files).collect()} == {"other"}


def test_books_join_pages_in_order_without_separator(spark):
    pages = [("d/A.pdf.pdf", n, None if n == 3 else f"p{n}\n" if n % 2 else f"p{n}") for n in range(700)]
    pages.append(("B.PDF", 5, None))
    df = spark.createDataFrame(pages, "file string, page_no int, text string").repartition(7)
    got = {r.file: r for r in book_items(df).collect()}
    text = "".join(p[2] or "" for p in pages[:700])
    assert got["d/A.pdf.pdf"].title == "A"
    assert got["d/A.pdf.pdf"].content == _expected(text)
    assert got["B.PDF"].title == "B.PDF" and got["B.PDF"].content == ""


def test_join_texts_keeps_separators_between_stretches(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), "id", F.col("id").cast("string").alias("t"))
    (row,) = join_texts(df, ["g"], "id", "t", ",", width=7).collect()
    assert row.t == ",".join(map(str, range(1000)))
