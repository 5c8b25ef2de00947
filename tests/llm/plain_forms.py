"""Plain restatements that several tests use."""

import re

# The base rules, as the contract states them.
KINDS = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    ("access", re.compile("(AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile("([0-9a-f]+)"), 24),
)


def plain_spans(text):
    spans = [
        (m.start(), n, m.end(), kind)
        for n, (kind, pattern, least) in enumerate(KINDS)
        for m in pattern.finditer(text or "")
        if len(m[1]) >= least
    ]
    return sorted(spans)


def masked(text, mark="[REDACTED]"):
    if text is None:
        return None
    out, at = [], 0
    for start, _, end, _ in plain_spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
