"""Text functions of notes, chunks, model outputs and results as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as a link, a tag and a header.
WIKILINK = r"!?\[\[([^\[\]|#]*(?:\[[^\[\]]*\][^\[\]|#]*)*)(?:#[^\[\]|]*)?(?:\|[^\[\]]*)?\]\]"
HASHTAG = r"#([a-zA-Z][a-zA-Z0-9_-]*)"
HEADER = r"^#{1,3}\s+.+$"
#: Lines of a model's answer that begin with an opening are chatter; of remarks only the words themselves.
OPENINGS = ("here is", "here's", "this is", "a hypothetical", "mock snippet", "sure, here", "snippet:")
REMARKS = ("certainly", "absolutely", "hope this helps")
FENCE = r"(?s)```(?:[a-zA-Z0-9+#-]+)?\n(.*?)```"
#: MediaWiki markup that goes, and what inline markup becomes, in this order.
WIKI_DROPPED = (r"(?s)<ref[^>]*>.*?</ref>", r"<ref[^>]*/>", r"\{\{[^{}]*\}\}")
WIKI_INLINE = ((r"(?d)'''(.*?)'''", "**$1**"), (r"(?d)''(.*?)''", "*$1*"), (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"), (r"(?md)^\*(?!\*)\s?", "- "))
#: What a page that can't be had is answered with.
ERROR_4XX, ERROR_TIMEOUT, ERROR_CONTENT, ERROR_EMPTY = "ERROR: http code 4xx", "ERROR: request timeout", "ERROR: unsupported content", "ERROR: empty response"
#: Where a line ends, as str.splitlines() has it, for splitting with and without the ends.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
AFTER_LINE = r"(?<=[\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029])|(?<=\r)(?!\n)"
RUBRIC = (("perfect", 1.0), ("good", 0.75), ("some", 0.5), ("bad", 0.25))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_sorted(array: Column | str) -> Column:
    return F.sort_array(F.array_distinct(_col(array)))


def wikilinks(text: Column | str) -> Column:
    """Distinct link targets, without header and alias; blank ones are left out."""
    return distinct_sorted(F.filter(F.regexp_extract_all(_col(text), F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x) != ""))


def hashtags(text: Column | str) -> Column:
    return distinct_sorted(F.regexp_extract_all(_col(text), F.lit(HASHTAG), F.lit(1)))


def newlines(text: Column | str) -> Column:
    return F.length(_col(text)) - F.length(F.replace(_col(text), F.lit("\n"), F.lit("")))


def leading_lines(text: Column | str) -> Column:
    """How many lines the white space at the start spans."""
    return newlines(F.regexp_extract(_col(text), r"^\s*", 0))


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def note_id(path: Column | str) -> Column:
    return F.md5(_col(path))


def chunk_id(path: Column | str, position: Column | str) -> Column:
    return F.concat(note_id(path), F.lit("_"), _col(position).cast("string"))


def note_id_of_chunk(chunk: Column | str) -> Column:
    return F.regexp_replace(_col(chunk), r"_[^_]*$", "")


def stem(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]+?)(?:\.md)?$", 1)


def line_slice(text: Column | str, offset: int = 0, limit: int | None = None) -> Column:
    """Lines offset to offset + limit with their terminators; an offset beyond the end or a limit of 0 gives ''."""
    if limit == 0:
        return F.when(_col(text).isNotNull(), F.lit(""))
    parts = F.split(_col(text), AFTER_LINE)
    return F.array_join(F.slice(parts, offset + 1, F.size(parts) if limit is None else F.lit(limit)), "")


def clean_generated(text: Column | str, most_words: int = 120) -> Column:
    """A model's passage without chatter: what a fence holds, or all of it without fence marks; at most so many words."""
    t = F.regexp_replace(stripped(text), rf"(?imd)^(?:{'|'.join(OPENINGS)})\b.*?\n", "")
    t = stripped(F.regexp_replace(t, rf"(?imd)^(?:{'|'.join(REMARKS)})[.,!:\s]*", ""))
    t = F.when(t.rlike(FENCE), stripped(F.regexp_extract(t, FENCE, 1))).otherwise(F.replace(t, F.lit("```"), F.lit("")))
    words = F.split(stripped(t), r"\s+")
    return F.when(F.size(words) > most_words, F.array_join(F.slice(words, 1, most_words), " ")).otherwise(stripped(t))


def parse_tags(text: Column | str) -> Column:
    """Comma- or line-separated tags without marks and blanks."""
    parts = F.transform(F.split(F.replace(_col(text), F.lit("\n"), F.lit(",")), ","), lambda x: F.regexp_replace(F.trim(x), "^#+", ""))
    return F.filter(parts, lambda x: F.trim(x) != "")


def mediawiki(text: Column | str) -> Column:
    """MediaWiki markup as Markdown: references and templates go, headings rise a level, emphasis, links and first-level bullets turn."""
    t = _col(text)
    for dropped in WIKI_DROPPED:
        t = F.regexp_replace(t, dropped, "")
    for level in range(6, 1, -1):  # of more marks than both ends share, the rest belongs to the heading
        t = F.regexp_replace(t, rf"(?md)^={{{level}}}\s*(.*?)\s*={{{level}}}\s*$", "#" * (level - 1) + " $1")
    for markup, becomes in WIKI_INLINE:
        t = F.regexp_replace(t, markup, becomes)
    return stripped(t)


def looks_like_html(text: Column | str) -> Column:
    return F.lower(F.ltrim(_col(text))).rlike(r"^(<!doctype html|<html|<head|<body)")


def looks_like_pdf(data: Column | str) -> Column:
    return F.substring(_col(data), 1, 5) == F.lit("%PDF-")


def content_type(header: Column | str) -> Column:
    return F.lower(F.trim(F.split_part(_col(header), F.lit(";"), F.lit(1))))


def plain_text(text: Column | str) -> Column:
    return F.when(F.trim(_col(text)) != "", _col(text))


def error_message(status: Column | str, timed_out: Column | str) -> Column:
    """What a failed request is answered with; null for one that succeeded."""
    s = _col(status)
    return F.when(_col(timed_out), ERROR_TIMEOUT).when((s >= 400) & (s < 500), ERROR_4XX).when(~s.between(200, 299), ERROR_CONTENT)


def model_text(content: Column | str) -> Column:
    """The text of a model answer that is a string or a JSON list of {text} parts."""
    parts = F.from_json(_col(content), "array<struct<text:string>>")
    listed = F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return F.when(F.ltrim(_col(content)).startswith("["), F.coalesce(listed, _col(content))).otherwise(_col(content))


def rubric_score(answer: Column | str) -> Column:
    """The value of the first rubric word, by order of merit, that an answer contains; 0 for none."""
    low, out = F.lower(_col(answer)), None
    for word, value in RUBRIC:
        out = F.when(low.contains(word), value) if out is None else out.when(low.contains(word), value)
    return out.otherwise(0.0)


def truncated(text: Column | str, most: int, marker: str = "...") -> Column:
    return F.when(F.length(_col(text)) > most, F.concat(F.substring(_col(text), 1, most), F.lit(marker))).otherwise(_col(text))


def joined_length(lengths: Column | str, separator: int = 2) -> Column:
    """The length of parts with separators between them."""
    own = _col(lengths)
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x) + separator * F.greatest(F.size(own) - 1, F.lit(0))


def score_label(score: Column | str) -> Column:
    return F.when(_col(score).isNotNull(), F.format_string(" (Score: %.3f)", _col(score))).otherwise("")


def renamed_links(text: Column | str, old: str, new: str) -> Column:
    """[[old]] and [[old|alias]] in any case, with new in the place of old."""
    quoted = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in old)
    return F.regexp_replace(_col(text), rf"(?i)\[\[{quoted}(\|[^\]]+)?\]\]", "[[" + new.replace("\\", "\\\\").replace("$", "\\$") + "$1]]")
