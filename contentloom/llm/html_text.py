"""Main text of pages by composite text density.

A page is read once into a tree: tags, with unclosed ones closed as browsers do. Elements that are
never part of an article (menus, footers, sidebars, notices, adverts, forms, reader comments, ...)
are set aside by tag, role and class. A class that only has a word of such a name in it
(``share-price``, ``related-work``) is a hint: within an article or ``main`` element, density
decides, and a part whose link-adjusted characters per tag are like the article's stays. For every element left, text density is its characters per
tag, adjusted by how many characters and tags of it are links; the density sum of an element is
the sum of its children's densities. The element with the largest sum is the core of the article.
The smallest density on the path from there to the body is the threshold: elements at least as
dense give up the element of the largest sum within them, too, so articles in several parts are
whole. Where parts lie in ``article`` elements, these are taken whole, with the articles beside them
that are no teasers of other pages (by class, or a heading that is a link, or much text in links);
where the core lies in a ``main`` element, its headings of the first level belong to the article.
A class or id that sets an element aside does not, if that holds most of the page's text; reader
comments are spared only if there is no other text. On a page without ``article`` and ``main``, a
heading in the page's header that begins the document's title belongs to the text.

Text is what stands in these elements: character references decoded, white space within a block
one space, blocks trimmed, those without text left out, joined in page order by a line end.

The work is linear in the page but for the search of the largest sums, which is bounded by its
depth. Pages are read one by one in Arrow batches; nothing is shuffled.

Defined cases: null or empty pages, and pages without text, give the empty text. Pages cut off
anywhere are read to where they go. Repeated rows give equal rows. Other columns are not read.
"""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentloom.llm.texts import in_batches

_TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)"""
    r"""|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
#: A class name with one of these says what stands beside an element, not what it is.
LAYOUT_WORDS = frozenset("with has no without layout".split())
#: Words that leave the meaning of the others in a class name as it is.
PLAIN_WORDS = frozenset(
    "site page main content wrapper wrap container outer inner area box block section group list item items bar row col column"
    " grid panel slot unit left right top bottom primary secondary global local mobile desktop header heading title body text"
    " link links button buttons icon icons post posts article articles story stories author meta thread count feed form"
    " media message label holder zone region the a".split()
)
TEASER_WORDS = frozenset("card cards teaser teasers preview tile excerpt promo related recommended".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul caption"
    " dialog menu search".split()
)
#: Starting one of the first closes an open one of the second, unless one of the third is nearer.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
OUTSIDE = frozenset(
    "head script style noscript nav footer aside form button select textarea input iframe svg math canvas object embed"
    " video audio template dialog menu map fieldset datalist progress meter search".split()
)
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer sidebar aside widget widgets"
    " banner cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer"
    " comment comments commentlist reply replies respond disqus discussion"
    " related recommended recommendations share sharing social newsletter subscribe subscription signup login"
    " masthead topbar toolbar copyright".split()
)
#: Of these, the ones that readers write.
READER_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: How a class or id sets an element aside: as a hint, by its name, or as readers' comments.
HINT, NAMED, READERS = 1, 2, 3


class Page:
    """Elements in page order, each with the place after its last descendant, and text pieces."""

    def __init__(self, source: str):
        self.tags, self.parents, self.ends, self.aside = ["#root"], [-1], [0], [False]
        #: How class or id alone set it aside, if they do.
        self.named = [0]
        #: Elements whose class is that of a teaser.
        self.teasers: set[int] = set()
        self.title = ""
        #: Element, text, and in which block it stands.
        self.pieces: list[tuple[int, str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        tags, stack, opened, block, at = self.tags, [0], {}, 0, 0
        lower = None

        def close_top() -> None:
            nonlocal block
            top = stack.pop()
            self.ends[top] = len(tags)
            opened[tags[top]] -= 1
            block += tags[top] in BLOCK

        def close_to(place: int) -> None:
            while len(stack) > place:
                close_top()

        def text(piece: str) -> None:
            if piece and not piece.isspace():
                self.pieces.append((stack[-1], piece, block))
            elif piece and self.pieces:
                self.pieces.append((stack[-1], " ", block))

        position = 0
        while match := _TAG.search(source, position):
            text(source[position : match.start()])
            position = match.end()
            slash, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
            if not name:
                continue
            name = name.lower()
            if slash:
                if opened.get(name):
                    at = len(stack) - 1
                    while tags[stack[at]] != name:
                        at -= 1
                    close_to(at)
                elif name in ("p", "br"):
                    block += 1
                continue
            if opened.get("head") and name not in IN_HEAD and name != "head":
                while opened.get("head"):
                    close_top()
            if name in BLOCK:
                if opened.get("p"):
                    while opened.get("p"):
                        close_top()
                block += 1
            if name in CLOSES:
                ended, within = CLOSES[name]
                if any(opened.get(t) for t in ended):
                    at = len(stack) - 1
                    while at and tags[stack[at]] not in ended and tags[stack[at]] not in within:
                        at -= 1
                    if at and tags[stack[at]] in ended:
                        close_to(at)
            node = len(tags)
            tags.append(name)
            self.parents.append(stack[-1])
            self.ends.append(node + 1)
            aside = _is_aside(name, attributes)
            named = 0 if aside else _named_aside(name, attributes)
            self.aside.append(aside or named > 0)
            self.named.append(named)
            if name == "article" and not TEASER_WORDS.isdisjoint(w for c in _class_names(attributes) for w in c):
                self.teasers.add(node)
            if name in ("br", "td", "th", "img", "wbr"):
                self.pieces.append((stack[-1], " " if name != "wbr" else "", block))
            if name in VOID:
                continue
            if name in RAW:
                lower = lower or source.lower()
                if len(lower) != len(source):  # a letter whose lower case is longer
                    lower = re.sub("[A-Z]", lambda m: m[0].lower(), source)
                end = lower.find(f"</{name}", position)
                if end < 0:
                    position = len(source)
                    break
                if name == "title" and not self.title:
                    self.title = " ".join(html.unescape(source[position:end]).split())
                position = end
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
        text(source[position:])
        opened["#root"] = 1
        close_to(0)

    def _sizes(self) -> tuple[list[int], list[int], list[int]]:
        """Characters, characters in links, and tags within each element."""
        n = len(self.tags)
        chars, links, marks = [0] * n, [0] * n, [0] * n
        for node, piece, _ in self.pieces:
            chars[node] += len(piece.strip())
        for node in range(n - 1, 0, -1):
            if self.tags[node] == "a":
                links[node] = chars[node]
            parent = self.parents[node]
            chars[parent] += chars[node]
            links[parent] += links[node]
            marks[parent] += marks[node] + 1
        return chars, links, marks

    def set_aside(self) -> list[bool]:
        """Elements that no article text is taken from. One that holds an article, or a form or an
        element named so by class or id that holds most of the page's text, is no such element itself.
        Beside an article, such a named element is set aside all the same; within, a hint counts only
        if the element is less than half as dense as the article, or a third of it is links."""
        n = len(self.tags)
        holds = [False] * n
        for node in range(n - 1, 0, -1):
            if holds[node] or (self.tags[node] in ("article", "main") and not self.aside[node]):
                holds[self.parents[node]] = True
        size, links, marks = self._sizes()
        #: The nearest article or main element around each element.
        within = [0] * n
        for node in range(1, n):
            within[node] = node if self.tags[node] in ("article", "main") else within[self.parents[node]]
        # Text that nothing sets aside: whether there is any but the readers'.
        beside = [False] * n
        for node in range(1, n):
            beside[node] = beside[self.parents[node]] or (self.aside[node] and not holds[node]) or (
                self.tags[node] == "header" and not within[node]
            )
        others = any(not beside[node] and not piece.isspace() for node, piece, _ in self.pieces)

        def dense(node: int) -> bool:
            around = within[self.parents[node]]
            own, whole = ((size[k] - links[k]) / (marks[k] or 1) for k in (node, around))
            return 3 * links[node] <= size[node] and 2 * own >= whole

        out = [False] * n
        for node in range(1, n):
            parent, tag, named = self.parents[node], self.tags[node], self.named[node]
            own = self.aside[node] or (tag == "header" and not within[node])
            if own and holds[node]:
                own = False
            elif own and named == READERS:
                own = others
            elif own and named == HINT and within[parent]:
                own = not dense(node)
            elif own and (tag == "form" or (named and (within[node] or not holds[0]))):
                own = 2 * size[node] <= size[0]
            out[node] = out[parent] or own
        self._set_teasers_aside(out, size, links)
        return out

    def _set_teasers_aside(self, out: list[bool], size: list[int], links: list[int]) -> None:
        """Article elements that only announce another page, beside a larger one that does not."""
        articles = [k for k, tag in enumerate(self.tags) if tag == "article" and not out[k]]
        teasers, largest, whole = [], 0, -1
        #: The first heading with text from each place on.
        heading = [len(out)] * (len(out) + 1)
        for k in range(len(out) - 1, 0, -1):
            here = size[k] and self.tags[k] in ("h1", "h2", "h3", "h4", "h5", "h6")
            heading[k] = k if here else heading[k + 1]
        for node in articles:
            first = heading[node + 1]
            # A heading that is a link, with a few words.
            announces = first < self.ends[node] and links[first] == size[first] and size[node] <= 10 * size[first]
            if announces or node in self.teasers or 2 * links[node] > size[node]:
                teasers.append(node)
            elif size[node] > largest:
                largest, whole = size[node], node
        for node in teasers:
            if not out[node] and size[node] < largest and not node < whole < self.ends[node]:
                out[node : self.ends[node]] = [True] * (self.ends[node] - node)

    def _title_heading(self) -> int:
        """The heading in a page header that begins the document's title, or 0."""
        heads = [k for k, tag in enumerate(self.tags) if tag == "h1"]
        if len(heads) != 1 or "article" in self.tags or "main" in self.tags:
            return 0
        node = self.parents[heads[0]]
        while node > 0 and self.tags[node] != "header":
            node = self.parents[node]
        top = heads[0]
        text = "".join(piece for k, piece, _ in self.pieces if top <= k < self.ends[top])
        text = " ".join(html.unescape(text).split())
        return top if node > 0 and text and self.title.startswith(text) else 0

    def main_text(self) -> str:
        out = self.set_aside()
        chosen = self._choose(out)
        if not chosen:
            return ""
        heading = self._title_heading()
        if heading and out[heading]:
            chosen.append(heading)
            out[heading : self.ends[heading]] = [False] * (self.ends[heading] - heading)
        kept, upto = [False] * len(self.tags), 0
        for node in sorted(set(chosen)):
            for k in range(max(node, upto), self.ends[node]):
                kept[k] = True
            upto = max(upto, self.ends[node])
        blocks, last = [], None
        for node, piece, block in self.pieces:
            if kept[node] and not out[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(html.unescape(piece) if "&" in piece else piece)
        lines = (" ".join("".join(parts).split()) for parts in blocks)
        return "\n".join(line for line in lines if line)

    def _choose(self, out: list[bool]) -> list[int]:
        """Elements whose text is the article."""
        n = len(self.tags)
        chars, marks, link_chars, link_marks = [0] * n, [0] * n, [0] * n, [0] * n
        for node, piece, _ in self.pieces:
            if not out[node]:
                chars[node] += len(piece.strip())
        for node in range(n - 1, 0, -1):
            if out[node]:
                continue
            parent = self.parents[node]
            if self.tags[node] == "a":
                link_chars[node], link_marks[node] = chars[node], link_marks[node] + 1
            chars[parent] += chars[node]
            link_chars[parent] += link_chars[node]
            marks[parent] += marks[node] + 1
            link_marks[parent] += link_marks[node]
        if not chars[0]:
            return []
        share = link_chars[0] / chars[0]
        density, sums = [0.0] * n, [0.0] * n
        for node in range(n):
            c = chars[node]
            if not c or out[node]:
                continue
            tags, links, link_tags = marks[node] or 1, link_chars[node], link_marks[node] or 1
            base = math.log(c / ((c - links) or 1) * links + share * c + math.e)
            plain = math.log(max(c / (links or 1) * tags / link_tags, 1.0))
            density[node] = c / tags * plain / math.log(max(base, 1.1))
            if node:
                sums[self.parents[node]] += density[node]
        # The root stands in for a missing body.
        body = next((k for k in range(n) if self.tags[k] == "body" and not out[k]), 0)
        if not sums[body]:
            body = 0
        #: The element with the largest sum in each subtree, the outermost of equals.
        best = list(range(n))
        for node in range(n - 1, 0, -1):
            parent = self.parents[node]
            if not out[node] and sums[best[node]] > sums[best[parent]]:
                best[parent] = best[node]
        core = best[body]
        #: The outermost article around each element.
        article = [0] * n
        for node in range(1, n):
            article[node] = article[self.parents[node]] or (node if self.tags[node] == "article" else 0)
        top, node = body, core
        while node > 0:
            if self.tags[node] == "main":
                top = node
                break
            node = self.parents[node]
        if self.tags[top] == "main" and not article[core]:
            return [top]
        threshold, node = density[core], core
        while node > top:
            node = self.parents[node]
            threshold = min(threshold, density[node]) if node >= top else threshold
        chosen, todo = [], [top]
        while todo:
            node = todo.pop()
            if not out[node] and density[node] >= threshold:
                chosen.append(best[node])
                todo += self._children(node)
        chosen = {article[node] or node for node in chosen}
        parents = {self.parents[node] for node in chosen if self.tags[node] == "article"}
        for node in range(top, self.ends[top]):
            beside = self.tags[node] == "article" and self.parents[node] in parents
            if not out[node] and (beside or (self.tags[top] == "main" and self.tags[node] == "h1")):
                chosen.add(node)
        return sorted(chosen)

    def _children(self, node: int) -> list[int]:
        children, at = [], node + 1
        while at < self.ends[node]:
            children.append(at)
            at = self.ends[at]
        return children


def _is_aside(tag: str, attributes: str) -> bool:
    if tag in OUTSIDE:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if name == "role":
            if value in OUTSIDE_ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _class_names(attributes: str) -> list[list[str]]:
    """Words of each name in class and id."""
    return [
        _WORD.findall(whole)
        for match in _ATTRIBUTE.finditer(attributes or "")
        if match[1].lower() in ("class", "id")
        for whole in (match[2] or match[3] or match[4] or "").lower().split()
    ]


def _named_aside(tag: str, attributes: str) -> int:
    """How a class or id, taken as a whole name, sets an element aside: not at all (0), by its name,
    as readers' comments, or as a hint only, if it has words that may give the name another meaning."""
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = 0
    for words in _class_names(attributes):
        if OUTSIDE_WORDS.isdisjoint(words) or not LAYOUT_WORDS.isdisjoint(words):
            continue
        sure = all(w in OUTSIDE_WORDS or w in PLAIN_WORDS for w in words) and words != ["discussion"]
        found = max(found, HINT if not sure else NAMED if READER_WORDS.isdisjoint(words) else READERS)
    return found


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )

    def texts(batches):
        for batch in batches:
            for part in in_batches(batch, 2):
                found = [main_text(page) for page in part.column(2).to_pylist()]
                arrays = [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
