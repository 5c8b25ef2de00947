"""Selections over a column of document events. An element is known by its opening event.

Tests are expressions over an event named ``e``. The columns read are ``nodes``, all events,
and ``elements``, the openings among them.
"""

from contentloom.functions.sql import bind, q, q_list
from contentloom.functions.text import strip
from contentloom.operators.dom import HIDDEN


def marked(event: str, *bits: int) -> str:
    """The event carries one of the marks."""
    return f"({event}.marks & {sum(bits)} <> 0)"


def has_tag(*tags: str) -> str:
    return f"e.tag IN ({q_list(tags)})"


def has_class(*tokens: str) -> str:
    """All the given class tokens are there, each as a whole token."""
    return " AND ".join(f"contains(concat(' ', coalesce(e.classes, ''), ' '), {q(f' {t} ')})" for t in tokens)


def class_holds(*parts: str) -> str:
    """All the given parts come up in the class string, wherever."""
    return " AND ".join(f"coalesce(contains(e.classes, {q(p)}), false)" for p in parts)


# Looking for an element passes over texts and closings once, not once per search.
ELEMENTS = "filter(nodes, e -> NOT e.tag RLIKE '^[#/]')"


def select(test: str, events: str = "elements") -> str:
    return f"filter({events}, e -> {test})"


def first(test: str, events: str = "elements") -> str:
    """First match in document order, or NULL."""
    return f"try_element_at({select(test, events)}, 1)"


def subtree(element: str, nodes: str = "nodes") -> str:
    """All events of an element, its own opening and closing included."""
    return bind(element, "d", f"slice({nodes}, d.pos + 1, d.end - d.pos + 1)")


def _texts(nodes: str) -> str:
    return f"filter({nodes}, x -> x.tag = '#text' AND NOT {marked('x', HIDDEN)})"


def packed_text(nodes: str) -> str:
    """Text of a slice: every piece stripped, joined with nothing between."""
    return f"array_join(transform({_texts(nodes)}, x -> {strip('x.text')}), '')"


def plain_text(nodes: str) -> str:
    """Text of a slice as it stands."""
    return f"array_join(transform({_texts(nodes)}, x -> x.text), '')"


def text_within(element: str, whole: str) -> str:
    """Text of an element as it stands, cut out of the text of the whole page. Costs a look-up,
    however many elements hold the same text."""
    return f"substring({whole}, {element}.text_at + 1, {element}.text_len)"
