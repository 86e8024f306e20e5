"""Functions of document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalizers import text

FENCE = "(?s)```.*?```"
#: Regular expressions of the cleaning passes in their order, with their replacements: fixed values.
CLEAN_PASSES = (
    (r"!\[\[(.*?)\]\]", ""),
    (r"\[\[(.*?)\]\]", "$1"),
    (r"(?s)%%.*?%%", ""),
    (r"\*\*(.*?)\*\*", "$1"),
    (r"\*(.*?)\*", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"#{1,6}\s+", ""),
    (r"\n\s*\n\s*\n+", "\n\n"),
)
EMBED = CLEAN_PASSES[0][0]
HEADER = r"(?m)^#{1,6}\s+(.+)$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_markdown(c: Column) -> Column:
    """Markup off. Inline code marks are taken off before fences could be seen, so
    text in fences is cleaned like any other."""
    t = text(c)
    for pattern, into in CLEAN_PASSES:
        t = F.regexp_replace(t, "(?d)" + pattern, into)
    return strip(t)


def clean_markdown_keeping_code(c: Column) -> Column:
    """Like clean_markdown, but fenced blocks stay as they are."""
    t = text(c)
    outside = F.split(t, FENCE, -1)
    fences = F.regexp_extract_all(t, F.lit("(" + FENCE + ")"), 1)

    def cleaned(x: Column) -> Column:
        for pattern, into in CLEAN_PASSES:
            x = F.regexp_replace(x, "(?d)" + pattern, into)
        return x

    parts = F.transform(outside, lambda x, i: F.concat(cleaned(x), F.coalesce(F.get(fences, i), F.lit(""))))
    return strip(F.array_join(parts, ""))


def wiki_links(c: Column) -> Column:
    """Targets of [[links]] in order, embeds not among them."""
    return F.regexp_extract_all(F.regexp_replace(text(c), "(?d)" + EMBED, ""), F.lit(r"(?d)\[\[(.*?)\]\]"), 1)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(text(c)) / 4)


def is_suitable(c: Column, min_chars: int = 100, max_code: float = 0.7) -> Column:
    """Long enough, and not mostly fenced code."""
    t = text(c)
    code = F.aggregate(F.regexp_extract_all(t, F.lit("(" + FENCE + ")"), 1), F.lit(0), lambda n, x: n + F.length(x))
    return (F.length(strip(t)) >= min_chars) & (code <= max_code * F.length(t))


def route(c: Column, file_type: Column | None = None, limit: int = 8000) -> Column:
    """skip, document or chunk; a PDF that is not skipped is always chunked."""
    pdf = F.lower(text(file_type)).isin("pdf", ".pdf") if file_type is not None else F.lit(False)
    return F.when(~is_suitable(c), "skip").when(pdf | (token_estimate(c) >= limit), "chunk").otherwise("document")


#: Words and joints of the contexts, and what a page is cleaned by: fixed values.
CONTEXT_PARTS = ("Document", "Type", "Tags")
NO_CONTEXT = "Personal knowledge document"
JOINT = " | "
LINE_ENDS, HYPHEN, BLANK_LINES = r"\r\n|\n|\r", "-\n", r"\n\s*\n\s*\n+"


def extraction_context(title: Column, file_type: Column, tags: Column) -> Column:
    def part(name: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))

    values = (title, file_type, F.array_join(F.slice(tags, 1, 3), ", "))
    t = F.concat_ws(JOINT, *[part(n, v) for n, v in zip(CONTEXT_PARTS, values)])
    return F.when(t == "", NO_CONTEXT).otherwise(t)


def chunk_context(page: Column, pages: Column, idx: Column, title: Column) -> Column:
    page_text = F.when(page.isNotNull() & pages.isNotNull(), F.concat(F.lit("Page "), page, F.lit(" of "), pages)).when(page.isNotNull(), F.concat(F.lit("Page "), page))
    return F.concat_ws(JOINT, F.coalesce(page_text, F.concat(F.lit("Chunk "), idx)), title)


def word_count(c: Column) -> Column:
    t = strip(text(c))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def section_headers(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit("(?d)" + HEADER), 1)


def clean_list(c: Column) -> Column:
    """Entries without # and blanks at the ends; empty ones go."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(F.replace(text(x), F.lit("#"), F.lit("")))), lambda x: x != "")


def pages(c: Column) -> Column:
    return F.split(text(c), "\f", -1)


def json_from_reply(c: Column) -> Column:
    """The JSON in a model's reply: in a json fence, in any fence, or all of it; null if it is none."""
    t = text(c)
    fenced = F.regexp_extract(t, r"(?s)```json\s*(.*?)```", 1)
    plain = F.regexp_extract(t, r"(?s)```\s*(.*?)```", 1)
    body = strip(F.when(fenced != "", fenced).when(plain != "", plain).otherwise(t))
    return F.to_json(F.try_parse_json(body))


def normalized_page(page: Column, headers: Column, footers: Column) -> Column:
    """A page without its running header and footer, words joined over line ends,
    at most one blank line in a row."""
    lines = F.split(text(page), LINE_ENDS, -1)
    lines = F.when(F.array_contains(headers, strip(lines[0])), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    last = F.element_at(lines, -1)
    lines = F.when((F.size(lines) > 1) & F.array_contains(footers, strip(last)), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    t = F.replace(F.array_join(lines, "\n"), F.lit(HYPHEN), F.lit(""))
    return strip(F.regexp_replace(t, BLANK_LINES, "\n\n"))
