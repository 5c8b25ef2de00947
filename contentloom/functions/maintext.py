"""Main text of a page as plain lines, as one expression over its events."""

from contentloom.functions.elements import first, marked, subtree
from contentloom.functions.sql import bind, q, q_list, replace_all
from contentloom.operators.dom import BLOCK, CELL, CHROME, HIDDEN, LINE_BLOCKS, LINKED

LINE, LINK, LINK_END, CELL_END = (chr(0xFDD0 + i) for i in range(4))

_EDGES = [f"{side}{tag}" for tag in LINE_BLOCKS for side in ("", "/")]

# A block within a table cell does not end the row's line.
_PIECE = f"""CASE
  WHEN {marked('e', CHROME)} THEN ''
  WHEN e.tag = '#text' THEN CASE
    WHEN {marked('e', HIDDEN)} OR NOT {marked('e', BLOCK)} THEN ''
    WHEN {marked('e', LINKED)} THEN concat({q(LINK)}, e.text, {q(LINK_END)}) ELSE e.text END
  WHEN e.tag IN ('/td', '/th') THEN {q(CELL_END)}
  WHEN e.tag IN ({q_list(_EDGES)}) THEN CASE WHEN {marked('e', CELL)} THEN ' ' ELSE {q(LINE)} END
  WHEN e.tag = 'br' THEN ' '
  ELSE '' END"""

_SHOWN = replace_all(
    "x",
    (rf"[{LINK}{LINK_END}]", ""),
    (r"(?U)\s{2,}|[^\S ]", " "),
    (rf" ?{CELL_END} ?", CELL_END),
    (rf"^[ {CELL_END}]+|[ {CELL_END}]+\z", ""),
    (CELL_END, " | "),
)


def _mostly_links(line: str) -> str:
    bare = replace_all(line, (rf"[{CELL_END}\s]+", ""))
    size = f"length({replace_all('b', (f'[{LINK}{LINK_END}]', ''))})"
    rest = f"length({replace_all('b', (f'{LINK}[^{LINK_END}]*{LINK_END}', ''))})"
    return f"contains({line}, {q(LINK)}) AND {bind(bare, 'b', f'({size} - {rest}) * 2 > {size}')}"


def main_text() -> str:
    """One line per paragraph, heading, list item, quote or table row; NULL if nothing is left."""
    regions = [first(f"e.tag = '{tag}' AND NOT {marked('e', CHROME)}") for tag in ("article", "main", "body")]
    events = f"coalesce({subtree(f'coalesce({", ".join(regions)})')}, nodes)"
    lines = f"split(array_join(transform({events}, e -> {_PIECE}), ''), {q(LINE)})"
    shown = f"transform(filter({lines}, x -> NOT ({_mostly_links('x')})), x -> {_SHOWN})"
    return f"nullif(array_join(filter({shown}, x -> x <> ''), '\\n'), '')"
