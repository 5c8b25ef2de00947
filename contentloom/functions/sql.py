"""Small helpers for expression text."""


def q(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def q_list(values) -> str:
    return ", ".join(q(v) for v in values)


def any_of(text: str, parts) -> str:
    """The text holds one of the fixed parts."""
    return f"({text} RLIKE {q('|'.join(_plain(p) for p in parts))})"


def _plain(part: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in part)


def replace_all(text: str, *changes: tuple[str, str]) -> str:
    """Regular-expression replacements, one after the other."""
    for pattern, put in changes:
        text = f"regexp_replace({text}, {q(pattern)}, {q(put)})"
    return text


def group(text: str, pattern: str, n: int = 1) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {n})"


def bind(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def present(value: str) -> str:
    """Rows where the value is not NULL, as a generator.

    A filter would be pushed below the projection and work the value out a second time.
    """
    return f"explode(filter(array({value}), v -> v IS NOT NULL))"
