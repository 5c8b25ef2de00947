"""HTML to an array of document events, one Arrow-batched pass over the pages.

Each page stays one row, so nothing is shuffled. Its ``nodes`` column lists the events
of the document in order: an opening (``tag = 'p'``), a closing (``tag = '/p'``) or a
piece of text (``tag = '#text'``). An element is the slice from its opening to its
closing, which is how every selection further down is written, as plain Spark expressions.
"""

from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Elements that never hold content.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)

# Marks are bits that an element hands down to all it holds.
HIDDEN, PRE, CODE, HEADING, CELL, BLOCK, CHROME, LINKED = (1 << i for i in range(8))

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LINE_BLOCKS = ("p", *HEADINGS, "li", "pre", "blockquote", "tr")

# Subtrees, by tag and by class or id token, that are not main text.
CHROME_TAGS = (
    "script", "style", "noscript", "nav", "header", "footer", "aside", "form", "button", "iframe", "svg",
)
CHROME_TOKENS = frozenset(
    ("ad", "ads", "advert", "comment", "comments", "sidebar", "menu", "cookie", "share")
)


def _tag_marks() -> dict[str, int]:
    rules = (
        (HIDDEN, ("script", "style", "template", "rt", "rp")),
        (PRE, ("pre",)),
        (CODE, ("pre", "code", "kbd", "samp")),
        (HEADING, (*HEADINGS, "title")),
        (CELL, ("td", "th")),
        (BLOCK, LINE_BLOCKS),
        (CHROME, CHROME_TAGS),
    )
    marks: dict[str, int] = {}
    for bit, tags in rules:
        for tag in tags:
            marks[tag] = marks.get(tag, 0) | bit
    return marks


TAG_MARKS = _tag_marks()
DEPTH_TAGS = ("blockquote", "ul", "ol")

_FIELDS = (
    ("pos", pa.int32(), T.IntegerType()),
    ("end", pa.int32(), T.IntegerType()),
    ("parent", pa.int32(), T.IntegerType()),
    ("depth", pa.int32(), T.IntegerType()),
    ("ord", pa.int32(), T.IntegerType()),
    ("tag", pa.string(), T.StringType()),
    ("parent_tag", pa.string(), T.StringType()),
    ("classes", pa.string(), T.StringType()),
    ("href", pa.string(), T.StringType()),
    ("src", pa.string(), T.StringType()),
    ("alt", pa.string(), T.StringType()),
    ("text", pa.string(), T.StringType()),
    ("text_len", pa.int32(), T.IntegerType()),
    ("marks", pa.int32(), T.IntegerType()),
    ("quotes", pa.int32(), T.IntegerType()),
    ("bullets", pa.int32(), T.IntegerType()),
    ("numbers", pa.int32(), T.IntegerType()),
    # Places of the nearest link around an event and of the first link within an element.
    ("link", pa.int32(), T.IntegerType()),
    ("first_link", pa.int32(), T.IntegerType()),
    # Likewise of the first h1 to h3 and the first div with "content" in its class.
    ("first_head", pa.int32(), T.IntegerType()),
    ("first_content", pa.int32(), T.IntegerType()),
    # Characters of shown text before the event; with text_len, an element's stretch of the page's text.
    ("text_at", pa.int32(), T.IntegerType()),
)
_END, _HREF, _TEXT_LEN, _FIRST_LINK, _FIRST_HEAD, _FIRST_CONTENT = 1, 8, 12, 18, 19, 20
NODE = T.StructType([T.StructField(n, s) for n, _, s in _FIELDS])
NODES = T.ArrayType(NODE)
_ARROW_NODE = pa.struct([(n, a) for n, a, _ in _FIELDS])


class _Frame:
    """An open element: its row, what it hands down, and how many children of a kind it has had."""

    __slots__ = ("tag", "row", "marks", "depths", "link", "table", "seen")

    def __init__(self, tag, row, marks, depths, link, table):
        self.tag, self.row, self.marks, self.depths, self.link = tag, row, marks, depths, link
        self.table = self if tag == "table" else table
        self.seen = {}

    def count(self, kind):
        n = self.seen[kind] = self.seen.get(kind, 0) + 1
        return n


class _Events(HTMLParser):
    """Turns one page into event rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def read(self, html):
        self.reset()
        self.rows, self.buffer = [], []
        self.seen_chars = 0
        self.stack = [_Frame("", None, 0, (0, 0, 0), None, None)]
        self.open = {}
        self.feed(html)
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._close_top()
        return self.rows

    def _add(self, tag, frame, ord_, marks, classes=None, href=None, src=None, alt=None, text=None, n=0):
        pos = len(self.rows)
        parent = frame.row[0] if frame.row else None
        row = [
            pos, pos, parent, len(self.stack) - 1, ord_, tag, frame.tag, classes,
            href, src, alt, text, n, marks, *frame.depths, frame.link, None, None, None, self.seen_chars,
        ]
        self.rows.append(row)
        return row

    def _flush(self):
        if not self.buffer:
            return
        text = "".join(self.buffer)
        self.buffer = []
        top = self.stack[-1]
        if not top.marks & PRE and not text.strip("\t\n\x0c\r "):
            text = "\n" if "\n" in text else " "
        n = 0 if top.marks & HIDDEN else len(text)
        self._add("#text", top, top.count("#text"), top.marks, text=text, n=n)
        self.seen_chars += n

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_starttag(self, tag, attrs):
        self._flush()
        attrs = dict(attrs)
        tokens = (attrs.get("class") or "").split()
        top = self.stack[-1]
        marks = top.marks | TAG_MARKS.get(tag, 0)
        href = attrs["href"] or "" if "href" in attrs else None
        if tag == "a" and href:
            marks |= LINKED
        if not CHROME_TOKENS.isdisjoint(tokens) or not CHROME_TOKENS.isdisjoint((attrs.get("id") or "").split()):
            marks |= CHROME
        # Table rows are numbered over the whole table, all else among its siblings.
        owner = (top.table or top) if tag == "tr" else top
        row = self._add(
            tag, top, owner.count(tag), marks, " ".join(tokens) if "class" in attrs else None,
            href, attrs.get("src"), attrs.get("alt"),
        )
        is_link = tag == "a" and href is not None
        if is_link:
            self._first_within(_FIRST_LINK, row[0])
        if tag in ("h1", "h2", "h3"):
            self._first_within(_FIRST_HEAD, row[0])
        if tag == "div" and "content" in (attrs.get("class") or "").lower():
            self._first_within(_FIRST_CONTENT, row[0])
        if tag in ("td", "th"):
            top.count("cells")
        if tag in VOID_TAGS:
            return
        depths = top.depths
        if tag in DEPTH_TAGS:
            depths = tuple(d + (t == tag) for d, t in zip(depths, DEPTH_TAGS))
        frame = _Frame(tag, row, marks, depths, row[0] if is_link else top.link, top.table)
        row[_TEXT_LEN] = -self.seen_chars
        self.stack.append(frame)
        self.open[tag] = self.open.get(tag, 0) + 1

    def _first_within(self, field, pos):
        """Note a place on all open elements; further out than one that has its own, all do."""
        for frame in reversed(self.stack):
            if frame.row is None or frame.row[field] is not None:
                break
            frame.row[field] = pos

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_top()

    def handle_endtag(self, tag):
        self._flush()
        if self.open.get(tag):
            while self._close_top() != tag:
                pass

    def _close_top(self):
        frame = self.stack.pop()
        self.open[frame.tag] -= 1
        row = frame.row
        ord_ = frame.seen.get("cells", 0) if frame.tag == "tr" else row[4]
        close = self._add("/" + frame.tag, self.stack[-1], ord_, frame.marks, href=row[_HREF])
        row[_END] = close[0]
        row[_TEXT_LEN] += self.seen_chars
        # A row's opening and closing carry its number and its cells.
        if frame.tag == "tr":
            close[_TEXT_LEN] = row[4]
        return frame.tag

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.buffer.append(data[6:])
            self._flush()


def _nodes_array(pages):
    """Events of pages (NULL where a page cannot be read) to one Arrow list column, built field by field."""
    offsets = [0]
    for events in pages:
        offsets.append(offsets[-1] + len(events or ()))
    fields = zip(*chain.from_iterable(events or () for events in pages)) if offsets[-1] else ((),) * len(_FIELDS)
    columns = [pa.array(v, a) for v, (_, a, _) in zip(fields, _FIELDS)]
    values = pa.StructArray.from_arrays(columns, fields=list(_ARROW_NODE))
    mask = pa.array([events is None for events in pages], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


#: Pages are given out as soon as they hold so many events: what a task holds as Python objects, some
#: 500 bytes an event, is that and one page, however long the batches of the scan are and however
#: much of a page is markup.
CHUNK_EVENTS = 16_384
#: Nor are more pages put in one batch.
CHUNK_PAGES = 4_096


def _chunks(column):
    """Ranges of rows with the events of their pages. Pages are taken out of the column one by one."""
    parser, pages, start, size = _Events(), [], 0, 0
    for i, html in enumerate(column):
        try:
            events = parser.read(html.as_py()) if html.is_valid else None
        except AssertionError:
            events = None
        pages.append(events)
        size += len(events or ())
        if size >= CHUNK_EVENTS or len(pages) == CHUNK_PAGES:
            # The parser keeps no page, nor does the list once its events are an array.
            parser.rows = events = None
            yield start, pages
            pages, start, size = [], i + 1, 0
    if pages:
        yield start, pages


def dom_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the column ``html`` by ``nodes``; all other columns are kept.

    Select the columns wanted before the call: whatever is there travels to Python and back.
    """
    keep = [f for f in pages.schema.fields if f.name != html]

    def parse(batches):
        for batch in batches:
            kept, columns, nodes = [batch.column(f.name) for f in keep], None, None
            for start, parsed in _chunks(batch.column(html)):
                columns = [c.slice(start, len(parsed)) for c in kept]
                nodes = _nodes_array(parsed)
                parsed.clear()
                yield pa.RecordBatch.from_arrays([*columns, nodes], [*(f.name for f in keep), "nodes"])
            del batch, kept, columns, nodes  # the next batch is read without this one

    return pages.mapInArrow(parse, T.StructType([*keep, T.StructField("nodes", NODES)]))
