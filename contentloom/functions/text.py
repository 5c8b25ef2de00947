"""Plain-text rules."""

from contentloom.functions.sql import bind, group, q, replace_all

# Unicode white space plus U+001C to U+001F, written out so that no regex flag is needed.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


# The same characters one by one.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: str) -> str:
    return f"trim(BOTH {q(WS_CHARS)} FROM {text})"


def unix_newlines(text: str) -> str:
    """Line ends as a text-mode file read gives them."""
    return replace_all(text, ("\r\n?", "\n"))


def text_lines(text: str) -> str:
    """Stripped lines, blank ones dropped."""
    return f"filter(transform(split({text}, '\\n'), t -> {strip('t')}), t -> t <> '')"


def _title_words(line: str) -> str:
    # Pieces start at a letter that follows white space, so each piece is one word.
    words = f"split({line}, {q(rf'(?<=[{WS}])(?=[A-Z])')})"
    return f"array_join(transform({words}, w -> concat(left(w, 1), lower(substring(w, 2)))), '')"


_CHAPTER = rf"(?is)^chapter[{WS}]+(\p{{Nd}}+)(.*)\z"


def _markdown_line(line: str) -> str:
    rest = bind(strip(group(line, _CHAPTER, 2)), "r", "CASE WHEN r <> '' THEN concat(': ', r) ELSE '' END")
    return (
        f"CASE WHEN {line} RLIKE {q(_CHAPTER)} THEN concat('# Chapter ', {group(line, _CHAPTER)}, {rest})"
        f" WHEN {line} RLIKE {q(rf'^\p{{Nd}}+[.][{WS}]+')} THEN {line}"
        f" WHEN {line} RLIKE {q(rf'^[A-Z][A-Z{WS}]+\z')} AND length({line}) > 3 THEN concat('## ', {_title_words(line)})"
        f" WHEN endswith({line}, ':') AND length({line}) < 100 THEN concat('### ', {line})"
        f" ELSE {line} END"
    )


def text_to_markdown(text: str) -> str:
    """Chapter, all-caps and colon lines become headings; lines are parted by a blank line."""
    return f"coalesce(array_join(transform({text_lines(text)}, x -> {_markdown_line('x')}), '\\n\\n'), '')"


def chapters(text: str) -> str:
    """``ARRAY<STRUCT<title, content>>``; one entry named Document if there is no chapter."""
    rule = q(rf"(?is)(chapter[{WS}]+\p{{Nd}}+[^\n]*)\n(.*?)(?=chapter[{WS}]+\p{{Nd}}+|\z)")
    pairs = (
        f"zip_with(regexp_extract_all({text}, {rule}, 1), regexp_extract_all({text}, {rule}, 2),"
        f" (h, b) -> struct({strip('h')} AS title, {strip('b')} AS content))"
    )
    whole = f"array(struct('Document' AS title, {strip(text)} AS content))"
    return bind(f"filter({pairs}, p -> p.content <> '')", "found", f"CASE WHEN size(found) > 0 THEN found ELSE {whole} END")


# The entities that stored bodies carry. The ampersand comes last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)


def decode_entities(text: str) -> str:
    for name, char in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(char)})"
    return text


def file_title(path: str) -> str:
    """Base name with every ``.pdf`` taken out."""
    return f"replace(substring_index({path}, '/', -1), '.pdf', '')"
