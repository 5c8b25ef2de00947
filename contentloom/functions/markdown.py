"""Document events to Markdown, as one expression.

Every event maps to a piece of text; the joined pieces are then tidied with regular
expressions. Layout that is only settled once the neighbours are known (emphasis around
nothing, blank lines, list items, quote prefixes) is written with Unicode noncharacters,
which no text carries, and replaced at the end. The work stays in the JVM and is linear in the
page and its Markdown: quotes and lists nest to any depth, and each level is a prefix of every line
within, so events that only start lines again where the lines start anyway are left out before.
"""

from contentloom.functions.elements import marked
from contentloom.functions.sql import bind, group, q, q_list, replace_all
from contentloom.operators.dom import CELL, CODE, HEADING, HEADINGS, HIDDEN, PRE

(
    ESC, BOLD, BOLD_END, ITALIC, ITALIC_END, LINK, LINK_MID, LINK_END, BREAK, ITEM, BULLET, ROW,
    GROUP, QUOTE, INDENT, SPACE, TAB, NEWLINE, FENCE_END, COPY, COPY_END, AUTO, AUTO_END,
) = (chr(0xFDD0 + i) for i in range(23))

BLOCK_TAGS = (
    "p", "div", "address", "article", "aside", "body", "dd", "details", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "header", "hgroup", "main", "nav", "section", "caption",
)


def _closing(*tags: str) -> tuple[str, ...]:
    return tuple(f"/{t}" for t in tags)


def _in(*tags: str) -> str:
    return f"e.tag IN ({q_list(tags)})"


def _cat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def escape(text: str) -> str:
    return f"replace(replace({text}, '*', {q(ESC + '*')}), '_', {q(ESC + '_')})"


def _collapse(text: str) -> str:
    one_line = replace_all(text, (r" {2,}|[ \t\x0B\f]*[\t\x0B\f][ \t\x0B\f]*", " "))
    return f"CASE WHEN {text} RLIKE '[\\\\r\\\\n]' THEN {replace_all(one_line, (r' ?[\r\n]\s*', chr(10)))} ELSE {one_line} END"


_LISTS = "(e.bullets + e.numbers)"
_QUOTES = f"repeat({q(QUOTE)}, e.quotes)"
_NEW_LINE = _cat(q("\n"), _QUOTES, f"repeat({q(INDENT)}, {_LISTS} * 4)")
_APART = _cat(_NEW_LINE, _NEW_LINE)
_FLAT = marked("e", CELL, HEADING)
_GAP = f"CASE WHEN {_FLAT} THEN ' ' ELSE {_APART} END"
_HEADING_GAP = f"CASE WHEN {marked('e', CELL)} THEN ' ' ELSE {_APART} END"

_SHOWN = bind(
    _collapse("e.text"), "c", f"CASE WHEN {marked('e', CODE)} THEN c ELSE {escape('c')} END"
)
_PRE_TEXT = (
    f"regexp_replace(translate({replace_all('e.text', (chr(13) + chr(10) + '?', chr(10)))}, {q(' ' + chr(9) + chr(10))},"
    f" {q(SPACE + TAB + NEWLINE)}), {q(NEWLINE)}, {_cat(q(NEWLINE), _QUOTES)})"
)
_TEXT = f"""CASE
  WHEN {marked('e', HIDDEN)} THEN ''
  WHEN {marked('e', PRE)} THEN {_PRE_TEXT}
  ELSE replace({_SHOWN}, '\\n', CASE WHEN {_FLAT} OR {_LISTS} > 0 THEN ' ' ELSE {_NEW_LINE} END) END"""
_BULLET = f"""CASE WHEN e.parent_tag = 'ol' THEN concat(CAST(e.ord AS STRING), '.')
  ELSE substring('*+-', pmod(greatest(e.bullets, 1) - 1, 3) + 1, 1) END"""
_LINKED = "e.href <> ''"

_PIECE = f"""CASE
  WHEN e.tag = '#text' THEN {_TEXT}
  WHEN {_in(*BLOCK_TAGS, *_closing(*BLOCK_TAGS))} THEN {_GAP}
  WHEN {_in('b', 'strong')} THEN {q(BOLD)}
  WHEN {_in('/b', '/strong')} THEN {q(BOLD_END)}
  WHEN {_in('i', 'em')} THEN {q(ITALIC)}
  WHEN {_in('/i', '/em')} THEN {q(ITALIC_END)}
  WHEN e.tag = 'a' AND {_LINKED} THEN {q(LINK)}
  WHEN e.tag = '/a' AND {_LINKED} THEN {_cat(q(LINK_MID), escape('e.href'), q(LINK_END))}
  WHEN e.tag = 'li' THEN {_cat(q(ITEM), _QUOTES, f"repeat({q(INDENT)}, greatest({_LISTS} - 1, 0) * 4)", _BULLET, q(BULLET))}
  WHEN {_in('ul', 'ol')} THEN CASE WHEN {_LISTS} = 0 THEN {_cat(_GAP, q(GROUP))} ELSE '' END
  WHEN {_in('/ul', '/ol')} THEN CASE WHEN {_LISTS} = 0 THEN {_GAP} ELSE {_NEW_LINE} END
  WHEN e.tag = 'br' THEN CASE WHEN {_FLAT} THEN ' ' ELSE {_cat(q(BREAK), _NEW_LINE)} END
  WHEN {_in(*HEADINGS)} THEN {_cat(_HEADING_GAP, "repeat('#', CAST(right(e.tag, 1) AS INT))", "' '")}
  WHEN {_in('title', '/title', *_closing(*HEADINGS))} THEN {_HEADING_GAP}
  WHEN e.tag = 'img' THEN {_cat("'!['", replace_all("coalesce(e.alt, '')", (chr(92) + 's+', ' ')), "']('", "coalesce(e.src, '')", "')'")}
  WHEN {_in('code', '/code')} AND NOT {marked('e', PRE)} THEN '`'
  WHEN e.tag = 'pre' THEN {_cat(_GAP, "'```'", q(NEWLINE), _QUOTES)}
  WHEN e.tag = '/pre' THEN {_cat(q(FENCE_END), _QUOTES, "'```'", _GAP)}
  WHEN e.tag = 'blockquote' THEN {_cat(_GAP, f"CASE WHEN {_FLAT} THEN '' ELSE {q(QUOTE)} END")}
  WHEN e.tag = '/blockquote' THEN {_GAP}
  WHEN e.tag = 'hr' THEN {_cat(_GAP, "'---'", _GAP)}
  WHEN e.tag = 'table' THEN {_cat(_GAP, q(GROUP))}
  WHEN e.tag = '/table' THEN {_GAP}
  WHEN e.tag = 'tr' THEN {_cat(q(ROW), _QUOTES, "'|'")}
  WHEN e.tag = '/tr' AND e.text_len = 1 THEN {_cat(q(ROW), _QUOTES, "'|'", "repeat(' --- |', e.ord)")}
  WHEN {_in('td', 'th')} THEN ' '
  WHEN {_in('/td', '/th')} THEN ' |'
  ELSE '' END"""

_GAP_TAGS = (*BLOCK_TAGS, *_closing(*BLOCK_TAGS), "blockquote", "/blockquote", "/ul", "/ol")
_SPEAKING = (
    "#text", *_GAP_TAGS, "b", "strong", "/b", "/strong", "i", "em", "/i", "/em", "a", "/a", "li", "ul", "ol", "br",
    *HEADINGS, *_closing(*HEADINGS), "title", "/title", "img", "code", "/code", "pre", "/pre", "hr",
    "table", "/table", "tr", "/tr", "td", "th", "/td", "/th",
)
_SILENT = f"""NOT {_in(*_SPEAKING)} OR (e.tag = '#text' AND {marked('e', HIDDEN)})
  OR ({_in('ul', 'ol')} AND {_LISTS} > 0) OR ({_in('a', '/a')} AND NOT coalesce({_LINKED}, false))"""
# What an event adds to a run of blanks: 1 a blank, 2 line starts, 0 something else.
_KIND = f"""CASE
  WHEN e.tag = '#text' THEN CASE WHEN {marked('e', PRE)} OR e.text NOT IN (' ', '\n') THEN 0
    WHEN e.text = ' ' OR {_FLAT} OR {_LISTS} > 0 THEN 1 ELSE 2 END
  WHEN NOT {_in(*_GAP_TAGS)} THEN 0
  WHEN {_in('/ul', '/ol')} AND {_LISTS} > 0 THEN 2
  WHEN {_FLAT} THEN 1 ELSE 2 END"""
# A line that shows where it is blank, too, however the lines after it are quoted.
_FIRM = f"({_LISTS} > 0 OR e.quotes = 0)"
# Whether an event starts two lines.
_TWO = f"(NOT (e.tag = '#text' OR ({_in('/ul', '/ol')} AND {_LISTS} > 0)))"
DEEP = 16


def thinned(nodes: str) -> str:
    """Events that give the same Markdown, without those that a neighbour makes needless.

    Of the line starts in a run, Markdown shows the last and the first, or the first of the least
    quoted (``_blank_lines``); so a start goes that has a start on both sides and is no less quoted
    than the one before it, or that is more quoted than the one after it. Nothing that is left out is
    what another one relies on. Each round works on what the one before it left side by side.
    """
    shown = f"filter({nodes}, e -> NOT ({_SILENT}))"
    rated = f"transform({shown}, e -> struct({_KIND} AS kind, {_FIRM} AS firm, {_TWO} AS two, e.quotes AS quotes, e AS event))"
    as_before = "p.kind = 2 AND p.quotes <= e.quotes AND (p.firm OR NOT e.firm)"
    as_after = "NOT e.firm AND f.quotes < e.quotes AND f.two"
    needless = f"e.kind > 0 AND f.kind > 0 AND (e.kind = 1 OR (f.kind = 2 AND (({as_before}) OR ({as_after}))))"
    around = bind("get(n, i + 1)", "f", bind("get(n, i - 1)", "p", f"coalesce({needless}, false)"))
    left = f"aggregate(array(1, 2, 3), {rated}, (n, k) -> filter(n, (e, i) -> NOT {around}))"
    return f"transform({left}, e -> e.event)"


_OPEN = f"{BOLD}{ITALIC}"
_SHUT = f"{BOLD_END}{ITALIC_END}"
_BLANK = rf"\s{QUOTE}{INDENT}{BREAK}"

def _holds(*signs: str) -> str:
    return " OR ".join(f"contains(t, {q(s)})" for s in signs)


def _matches(pattern: str) -> str:
    return f"t RLIKE {q(pattern)}"


def _each_run(run: str, change: str) -> str:
    """Every match of ``run`` replaced by an expression of it (``x``) and of the text up to the
    next match (``ahead``). The text is cut at the matches, so each is worked on once."""
    cut = f"split({replace_all('t', (f'({run})', f'{COPY}$1{COPY_END}'))}, {q(f'[{COPY}{COPY_END}]')}, -1)"
    ahead = change.replace("ahead", "r[i + 1]")
    return bind(cut, "r", f"array_join(transform(r, (x, i) -> CASE WHEN i % 2 = 1 THEN {ahead} ELSE x END), '')")


def _changed(*changes: tuple[str, str]) -> str:
    return replace_all("t", *changes)


# Patterns below repeat single characters of a class and never a group, which the engine would
# match by recursion. Where a run may be long and lead to nothing, it is only tried from its start.
_BLANKS = " \t\n\x0b\x0c\r" + QUOTE + INDENT + BREAK
_FROM_START = rf"(?<![{_BLANK}])"

_LINK_TIDY = (
    (rf"{LINK}([{_BLANK}]+)", rf"$1{LINK}"),
    (rf"{_FROM_START}([{_BLANK}]++)({LINK_MID}[^{LINK_END}]*{LINK_END})", "$2$1"),
)


def _without(chars: str) -> str:
    return f"translate(x, {q(chars)}, '')"


def _breaks() -> str:
    """Line breaks of a run of blanks: those with a blank line after them, or at the end of a
    block, show nothing; the others are two spaces."""
    shown, gone = ((rf" *{BREAK}", put) for put in ("  ", ""))
    last_gap = rf"(?s)\A(.*)(\n[{QUOTE}{INDENT}]*\n.*)\z"
    halves = f"concat({replace_all(group('x', last_gap), gone)}, {replace_all(group('x', last_gap, 2), shown)})"
    at_end = f"(ahead = '' AND i + 2 = size(r)) OR ahead RLIKE {q(rf'^[{ITEM}{ROW}]')}"
    return (
        f"CASE WHEN {at_end} THEN {replace_all('x', gone)}"
        f" WHEN x RLIKE {q(rf'\n[{QUOTE}{INDENT}]*+\n')} THEN {halves} ELSE {replace_all('x', shown)} END"
    )


def _blank_lines() -> str:
    """Of the line starts in a run, the first and the last stay. A blank quoted line does not
    count as the first if a line of a lower quote follows in the run."""
    quotes = f"length({group('l', f'^({QUOTE}*)')})"
    blank = f"l RLIKE {q(f'^{QUOTE}+$')} AND a.least < {quotes}"
    step = f"struct(least(a.least, {quotes}) AS least, CASE WHEN {blank} THEN a.kept ELSE l END AS kept)"
    # From the last line back; the last one itself only says how deep it is.
    deep = f"struct(length({group('element_at(s, -1)', f'^({QUOTE}*)')}) AS least, CAST(NULL AS STRING) AS kept)"
    found = f"aggregate(reverse(slice(s, 2, size(s) - 2)), {deep}, (a, l) -> {step}, a -> a.kept)"
    return bind("split(x, '\\n', -1)", "s", f"concat(coalesce(concat('\n', {found}), ''), '\n', element_at(s, -1))")


_NOTHING = rf"{BOLD}(?:{ITALIC}{ITALIC_END})*+{BOLD_END}|{ITALIC}(?:{BOLD}{BOLD_END})*+{ITALIC_END}"

# Each step runs only on text that shows its trigger.
_TIDY = (
    (_holds(LINK), _changed(*_LINK_TIDY)),
    # Blanks move out of emphasis.
    (
        _matches(rf"[{_OPEN}][{_BLANK}]"),
        _each_run(rf"[{_OPEN}][{_OPEN}{_BLANK}]*+", f"concat({_without(_OPEN)}, {_without(_BLANKS)})"),
    ),
    (
        _matches(rf"[{_BLANK}][{_SHUT}]"),
        _each_run(
            rf"(?<![{_SHUT}{_BLANK}])[{_SHUT}{_BLANK}]*[{_SHUT}]", f"concat({_without(_BLANKS)}, {_without(_SHUT)})"
        ),
    ),
    # Emphasis around nothing goes.
    (_matches(rf"[{_OPEN}][{_SHUT}]"), _changed((_NOTHING, ""))),
    (
        _holds(LINK),
        _changed(
            *_LINK_TIDY,
            (rf"{LINK}{LINK_MID}[^{LINK_END}]*{LINK_END}", ""),
            # A link whose text is its address; then no escapes within addresses.
            (
                rf"{LINK}([^{LINK}{LINK_MID}{LINK_END}]*){LINK_MID}\1{LINK_END}",
                rf"{AUTO}$1{AUTO_END}",
            ),
            (
                rf"([{LINK_MID}{AUTO}][^{ESC}{LINK_END}{AUTO_END}]*|\G(?!\A)[^{ESC}{LINK_END}{AUTO_END}]*){ESC}",
                "$1",
            ),
        ),
    ),
    (_holds(" \n", "\n ", "  "), _changed((r" {2,}", " "), (r" \n ?|\n ", "\n"))),
    (_holds(QUOTE, INDENT), _changed((rf"([{QUOTE}{INDENT}]) +", "$1"))),
    (
        _holds(BREAK),
        _each_run(rf"{_FROM_START}[{_BLANK.replace(BREAK, '')}]*+{BREAK}[{_BLANK}]*+", _breaks()),
    ),
    (
        _holds(GROUP),
        _changed(
            (rf"{_FROM_START}[{_BLANK}]++(?=[{ITEM}{ROW}])", ""),
            (rf"{BULLET}[{_BLANK}]*+", " "),
            (rf"[{ITEM}{ROW}]", "\n"),
            (rf"(?<![{QUOTE}{INDENT}])[{QUOTE}{INDENT}]++{GROUP}\n?|{GROUP}\n?", ""),
        ),
    ),
    # An item or row outside a list or table.
    (_holds(ITEM, BULLET, ROW), _changed((f"[{ITEM}{ROW}]", "\n"), (rf"{BULLET}[{_BLANK}]*+", " "))),
    # Runs of blank lines within quotes and lists, then elsewhere.
    (
        _holds(QUOTE, INDENT),
        _each_run(rf"\n[{QUOTE}{INDENT}]*+\n[\n{QUOTE}{INDENT}]*+", _blank_lines()),
    ),
    (_holds(INDENT), _changed((rf"(?<!{INDENT}){INDENT}++(?=\n|\z)", ""))),
    (_holds("\n\n\n"), _changed((r"\n{3,}", "\n\n"))),
    (
        _holds(FENCE_END),
        _changed((rf"(?<![{NEWLINE}{QUOTE}])({QUOTE}*+)(?:{NEWLINE}[{NEWLINE}{QUOTE}]*+)?{FENCE_END}", f"$1{NEWLINE}")),
    ),
)


def markdown(nodes: str = "nodes") -> str:
    """Markdown of a slice of document events, with ``#`` headings."""
    deep = f"exists(d, e -> e.quotes + {_LISTS} > {DEEP})"
    events = bind(nodes, "d", f"CASE WHEN {deep} THEN {thinned('d')} ELSE d END")
    text = f"array_join(transform({events}, e -> {_PIECE}), '')"
    for trigger, tidied in _TIDY:
        text = bind(text, "t", f"CASE WHEN {trigger} THEN {tidied} ELSE t END")
    blank = " \t\n\x0b\x0c\r" + INDENT
    text = f"trim(TRAILING {q(blank + QUOTE)} FROM trim(LEADING {q(blank)} FROM {text}))"
    for sign, shown in ((QUOTE + "\n", ">\n"), (QUOTE, "> "), (BOLD, "**"), (BOLD_END, "**"), (LINK_MID, "](")):
        text = f"replace({text}, {q(sign)}, {q(shown)})"
    signs = ITALIC + ITALIC_END + LINK + LINK_END + AUTO + AUTO_END + ESC + INDENT + SPACE + TAB + NEWLINE
    return f"translate({text}, {q(signs)}, {q('**[)<>' + chr(92) + '  ' + chr(9) + chr(10))})"


def plain_markdown(text: str) -> str:
    """Markdown of text that holds no markup: escapes, and collapses white space within lines."""
    return replace_all(bind(text, "m", _collapse("m")), (r"([*_])", r"\\$1"), (r"^\n|\n\z", ""))
